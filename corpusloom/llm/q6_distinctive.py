"""Queries of distinctive terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load, records_with_form
from . import distinctive


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.scores(distinctive.record_terms(records_with_form(spark, folder)))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms whose scores show them concentrated in few records, checked for how many."""
    return distinctive.concentrated(_scores(spark, folder), 4, 3).select("index", "term")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every record with its score."""
    return _scores(spark, folder).drop("records", "residual")


def previews(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of the element texts of every preview, with its score over all previews."""
    one = load(spark, folder, "previews").where("index is not null and elements is not null").groupBy("index").agg(F.min("elements").alias("elements"))
    texts = one.select("index", F.array_join(F.transform("elements", lambda e: F.coalesce(e["text"], F.lit(""))), "\n").alias("text"))
    return distinctive.scores(distinctive.text_terms(texts, "index", "text")).drop("records", "residual").withColumn("score", F.round("score", 4))


QUERIES = {"p6_found": found, "p6_terms": scored, "p6_previews": previews}
SQL = {
    "p6_previews": r"""
with one as (select index, min(elements) as elements from previews where index is not null and elements is not null group by index),
texts as (select index, array_to_string(list_transform(elements, lambda e: coalesce(e.text, '')), chr(10)) as text from one),
terms as (select index, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) as term from texts),
counts as (select index, term, count(*) as tf from terms group by all),
stats as (select term, count(*) as df, sum(tf)::bigint as cf from counts group by term),
n as (select count(*) as records from texts)
select index, term, tf, df, cf, round(tf * (-log2(df / records) + log2(1 - exp(-cf / records))), 4) as score
from counts join stats using (term), n"""
}
