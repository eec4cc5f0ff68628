"""Records of files as they arrive in a folder, numbered as they come, and found or appended by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import TextConfig, XmlConfig
from ..functions.matching import contains_whole_words
from ..sources import records


def stream(spark: SparkSession, path: str, form: str, config: XmlConfig | TextConfig, log: str | None = None) -> DataFrame:
    """filename, part, local, bytes, position of every file that was not read before, whatever its name; the files of a batch are numbered by name.

    ``log`` is the folder that keeps which files have arrived, by default one beside ``path`` (``path.arrivals``). It belongs to the
    checkpoints that were begun with it and must last as long as they do.
    """
    records.register(spark)
    reader = spark.readStream.format("xmlrecords" if form == "xml" else "textrecords")
    if isinstance(config, XmlConfig):
        reader = reader.option("recordElement", config.record_element).option("maxRecordBytes", config.max_record_bytes)
    else:
        reader = reader.option("targetRecordBytes", config.target_record_bytes)
    if log is not None:
        reader = reader.option("arrivalLog", log)
    return reader.load(path)


def matching_records(streamed: DataFrame, query: str) -> DataFrame:
    """Those records of a stream that hold the words."""
    return streamed.where(contains_whole_words(F.make_valid_utf8(F.col("bytes").cast("string")), query))


def append_numbered(streamed: DataFrame, table: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Append the stream to a Parquet table with ``index`` going on from what is there.

    Each micro-batch writes a folder of its own, named by its number, so one that is run again after a failure
    takes the place of its first run and the numbers stay. Where the next batch begins stands in a table of one row beside it
    (``table.next``), so no batch reads what earlier ones wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = spark.read.parquet(f"{table}.next/batch={number - 1}").first()["next"] if number > 0 else 0
        rows = records.numbered(batch, first=first).select("index", "filename", "bytes")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        own = spark.read.schema(rows.schema).parquet(f"{table}/batch={number}")
        own.agg(F.coalesce(F.max("index") + 1, F.lit(first)).alias("next")).write.mode("overwrite").parquet(f"{table}.next/batch={number}")
        if then is not None:
            then(own)

    return streamed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
