"""Queries of leaked evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load, spread
from .leakage import leaks


def leaked(spark: SparkSession, folder: str) -> DataFrame:
    """Exact leaks and paraphrases with what speaks for them."""
    return leaks(spread(load(spark, folder, "documents").select("doc_id", "text"), "doc_id"), load(spark, folder, "eval_items"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(spark, folder).where("kind = 'exact'").select("doc_id", "item_id")


def by_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks of each suite and kind: rows, items, and how often the answer stands beside."""
    suites = load(spark, folder, "eval_items").groupBy("item_id").agg(F.min("suite").alias("suite"))
    return leaked(spark, folder).join(suites, "item_id").groupBy("suite", "kind").agg(F.count("*").alias("leaks"), F.countDistinct("item_id").alias("items"), F.count(F.when(F.col("answer"), 1)).alias("with_answer"))


def recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of the exact leaks, how many the cosine search had found by itself."""
    near = F.count(F.when(F.col("near"), 1))
    return leaked(spark, folder).groupBy("kind").agg(F.count("*").alias("leaks"), near.alias("near"), (near / F.count("*")).alias("recall"))


QUERIES = {"p7_found": found, "p7_leaks": leaked, "p7_suites": by_suite, "p7_recall": recall}
