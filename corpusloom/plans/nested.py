"""Queries of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..tables import records_with_form


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return records_with_form(spark, folder, F.expr("form = 'json' or form = 'xml' and record_element = 'release'"))


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    layout = nested.layout_of(records)
    return nested.tables(nested.triples(records, layout), layout)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """The containers of all records, from the rows of the pivoted tables."""
    return nested.nodes(_tables(spark, folder))


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """The table of tracks of all releases, each with its parent's key."""
    return nested.flat_table(nested.triples(_records(spark, folder)), "release/tracks/track", ["@n", "position", "title", "duration"]).withColumnRenamed("@n", "n")


def layouts(spark: SparkSession, folder: str) -> DataFrame:
    """The tables and columns that come out of all records."""
    return spark.createDataFrame(nested.layout_rows(nested.layout_of(_records(spark, folder))), "`table` string, name string, repeated boolean")


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every table of all releases and JSON records, and their repeated values, with keys of parents."""
    return _tables(spark, folder)


QUERIES = {"p3_found": found, "p3_tracks": tracks, "p3_layout": layouts, "p3_tables": tables}
