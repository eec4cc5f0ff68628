"""Queries of abusive, hateful and sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import load, spread
from . import abuse


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score in every category."""
    documents = load(spark, folder, "documents").select("doc_id", "text")
    scorer = abuse.fit(abuse.labelled_sample(documents, load(spark, folder, "content_labels")))
    return abuse.score(spread(documents, "doc_id"), scorer)


def found(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spark, folder).where("flagged").select("doc_id", "category")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Rates per source."""
    return abuse.rates(scores(spark, folder), load(spark, folder, "documents").select("doc_id", "source"))


QUERIES = {"p9_found": found, "p9_scores": scores, "p9_sources": sources}
