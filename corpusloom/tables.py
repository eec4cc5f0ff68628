"""The given tables, with each record counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import checkpoint, tune

#: Keys that stand in several rows, of about 50 bytes each, that are sent to every task at most; more are joined.
MAX_REPEATED = 400_000


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def placed(table: DataFrame) -> DataFrame:
    """A table read from files with ``_place``: a number for the place of each row in its file, the same whenever it is read."""
    return table.withColumn("_place", F.xxhash64("_metadata.file_path", "_metadata.row_index"))


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """corpus, form, record_element, target_record_bytes, overlap_bytes; one row per corpus."""
    return load(spark, folder, "stream_configs").where("corpus is not null").dropDuplicates(["corpus"])


def records_with_form(spark: SparkSession, folder: str, wanted: Column | None = None, suited: Column | None = None) -> DataFrame:
    """index, bytes, form, record_element, target_record_bytes, overlap_bytes, corpus of records, each index once.

    ``wanted`` filters by form and ``suited`` by any column before deliveries are compared. The configuration is left to Spark, which
    broadcasts it only while its size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    config = forms(spark, folder).select("corpus", "form", "record_element", "target_record_bytes", "overlap_bytes")
    if wanted is not None:
        config = config.where(wanted)
    records = placed(load(spark, folder, "records")).where("bytes is not null and index is not null").select("index", "bytes", "corpus", "_place")
    joined = records.join(config, "corpus")
    return spread(once(joined if suited is None else joined.where(suited), "index", "bytes"), "index")


def once(rows: DataFrame, key: str, data: str) -> DataFrame:
    """One row per key of rows with ``_place``: of those whose data has the least hash, the least place; null keys are dropped.

    Keys that come more than once are found from hashes alone, so ``data`` isn't moved unless there are too many to be sent to every task.
    Repeated keys are then joined, and a key that very many rows have is one row of the joined side.
    """
    known = rows.where(F.col(key).isNotNull()).withColumn("_rank", F.struct(F.xxhash64(data).alias("hash"), F.col("_place").alias("place")))
    counted = known.groupBy(key).agg(F.count("*").alias("_n"), F.min("_rank").alias("_best")).where("_n > 1").drop("_n")
    repeated = checkpoint(counted)
    few = repeated.limit(MAX_REPEATED + 1).count() <= MAX_REPEATED
    joined = known.join(F.broadcast(repeated) if few else repeated, key, "left")
    return joined.where("_best is null or _best = _rank").drop("_best", "_rank", "_place")


def distinct_by(df: DataFrame, key: str, large: list[str]) -> DataFrame:
    """One row per key, of any rows: the one with the smallest values of ``large``; null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    order = [*large, *[c for c in rest if c not in large]]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over as many partitions as there are cores, where a small file would keep most of them idle; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
