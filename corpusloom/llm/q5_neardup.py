"""Queries of near-duplicate records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import records_with_form
from .neardup import NearConfig, NearDuplicates, near_duplicates
from .texts import record_texts


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    records = records_with_form(spark, folder, F.expr("form = 'txt' or form = 'xml' and record_element = 'page'"))
    return near_duplicates(record_texts(records), NearConfig(words=3, threshold=0.6, least_words=20), id="index")


def found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).pairs().select(F.col("id_a").alias("index_a"), F.col("id_b").alias("index_b"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with the class of its exact copies and its number of links."""
    return _near(spark, folder).documents().withColumnRenamed("id", "index")


QUERIES = {"p5_found": found, "p5_documents": documents}
