"""Queries of oversized records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import records_with_form
from . import pieces


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    large = F.octet_length("bytes") > pieces.limit_of(F.col("target_record_bytes"))
    return pieces.oversized_pieces(records_with_form(spark, folder, F.col("form") == "txt", large))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """How far down the boundaries of each record had to be sought, by its cuts."""
    return pieces.boundaries(_pieces(spark, folder))


def cut(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized records."""
    return _pieces(spark, folder)


def cut_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many pieces begin at which kind of boundary where which was needed, and their sizes."""
    size = F.octet_length("piece_bytes")
    return _pieces(spark, folder).groupBy("needed", "cut").agg(F.count("*").alias("pieces"), F.avg(size).alias("mean_bytes"), F.max(size).alias("most_bytes"))


QUERIES = {"p2_found": found, "p2_pieces": cut, "p2_cut_kinds": cut_kinds}
