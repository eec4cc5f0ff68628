"""A folder of text files as one materialised table of records, with ranges, checkpoints and a sidecar."""

from __future__ import annotations

import bz2
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHECKPOINT_INTERVAL, TextConfig, checkpoint_interval
from ..errors import InvalidConfiguration, IoError
from . import records

VERSION = 2
#: Bytes that follow each record in the flat form.
SEPARATOR = b"\n\n"
#: Checkpoints that are ordered together.
SPAN = 100_000


def text_files(folder: str) -> list[str]:
    """The ``*.txt`` files of a folder, not of those below it, by the bytes of their names."""
    try:
        names = [e.name for e in os.scandir(folder) if e.is_file() and os.path.splitext(e.name)[1].lower() == ".txt"]
    except OSError as e:
        raise IoError(str(e)) from e
    return [os.path.join(folder, n) for n in sorted(names, key=os.fsencode)]


def file_ranges(rows: DataFrame) -> DataFrame:
    """start, end (inclusive), filename of each file that has records."""
    return rows.groupBy("filename").agg(F.min("index").alias("start"), F.max("index").alias("end")).select("start", "end", "filename")


def checkpoints(rows: DataFrame, interval: int) -> DataFrame:
    """index (of the next record), position (byte in the flat form) after every ``interval`` records.

    Sizes are added up per block of records between two checkpoints, and per span of blocks; only the spans are ordered in one place.
    """
    checkpoint_interval(interval)
    blocks = rows.groupBy(F.expr(f"index div {interval}").alias("_block")).agg(F.count("*").alias("_n"), F.sum(F.octet_length("bytes") + len(SEPARATOR)).alias("_bytes"))
    blocks = blocks.withColumn("_span", F.expr(f"_block div {SPAN}"))
    spans = blocks.groupBy("_span").agg(F.sum("_bytes").alias("_all")).withColumn("_before", F.expr("sum(_all) over (order by _span) - _all")).drop("_all")
    ended = blocks.withColumn("_within", F.expr("sum(_bytes) over (partition by _span order by _block)")).join(spans, "_span").where(F.col("_n") == interval)
    return ended.select(((F.col("_block") + 1) * interval).alias("index"), (F.col("_before") + F.col("_within")).alias("position"))


class FolderSource:
    """Records of all text files of a folder, numbered across them; kept beside it and used again while the sidecar fits.

    Beside the folder stand three tables, of the records, of the ranges of files and of the checkpoints, and the sidecar, which says how they were made.
    """

    form = "txt"

    def __init__(self, spark: SparkSession, folder: str, config: TextConfig = TextConfig(), interval: int = CHECKPOINT_INTERVAL, refresh: bool = False) -> None:
        self.spark, self.folder, self.config, self.interval = spark, folder.rstrip("/"), config, checkpoint_interval(interval)
        if refresh or not (os.path.exists(self.sidecar_path) and os.path.exists(self.dataset_path)):
            self._materialise()
        else:
            self._load()

    @property
    def dataset_path(self) -> str:
        return f"{self.folder}.records.parquet"

    @property
    def ranges_path(self) -> str:
        return f"{self.folder}.ranges.parquet"

    @property
    def checkpoints_path(self) -> str:
        return f"{self.folder}.checkpoints.parquet"

    @property
    def sidecar_path(self) -> str:
        return f"{self.folder}.sidecar.json"

    def _materialise(self) -> None:
        files = text_files(self.folder)
        schema = "index bigint, filename string, bytes binary"
        if files:
            scanned = records.scan(self.spark, _glob(self.folder), "txt", self.config)
            kept = scanned.where(F.col("filename").isin([os.path.basename(f) for f in files]) if len(files) < 1000 else F.lower("filename").endswith(".txt"))
            rows = records.numbered(kept).select("index", "filename", "bytes")
        else:
            rows = self.spark.createDataFrame([], schema)
        Path(self.sidecar_path).unlink(missing_ok=True)  # without it the tables count for nothing, should this be cut off
        rows.repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").parquet(self.dataset_path)
        written = self.records()
        file_ranges(written).write.mode("overwrite").parquet(self.ranges_path)
        checkpoints(written, self.interval).write.mode("overwrite").parquet(self.checkpoints_path)
        body = {"version": VERSION, "target_record_bytes": self.config.target_record_bytes, "checkpoint_interval": self.interval}
        partial = f"{self.sidecar_path}.tmp"
        Path(partial).write_text(json.dumps(body, indent=2) + "\n")
        os.replace(partial, self.sidecar_path)

    def _load(self) -> None:
        try:
            body = json.loads(Path(self.sidecar_path).read_text())
            found = (body["version"], body["target_record_bytes"], body["checkpoint_interval"])
        except OSError as e:
            raise IoError(str(e)) from e
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidConfiguration(f"invalid directory sidecar: {e}") from e
        for name, have, want in zip(("version", "target_record_bytes", "checkpoint_interval"), found, (VERSION, self.config.target_record_bytes, self.interval), strict=True):
            if have != want:
                raise InvalidConfiguration(f"directory sidecar has {name} {have}, not {want}")

    def records(self) -> DataFrame:
        return self.spark.read.parquet(self.dataset_path)

    def records_from(self, index: int) -> DataFrame:
        return self.records().where(F.col("index") >= index)

    def file_ranges(self) -> DataFrame:
        """start, end (inclusive), filename of each file with records."""
        return self.spark.read.parquet(self.ranges_path)

    def checkpoints(self) -> DataFrame:
        """index (of the next record), position (byte in the flat form)."""
        return self.spark.read.parquet(self.checkpoints_path)


def _glob(folder: str) -> str:
    return os.path.join("".join(f"[{c}]" if c in "*?[" else c for c in folder), "*.[tT][xX][tT]")


def write_flat(rows: DataFrame, target: str) -> None:
    """All records in order, each with two line ends, as one file: a record at a time passes through the driver."""
    partial = f"{target}.partial"
    with open(partial, "wb") as out:
        for r in rows.select("index", "bytes").orderBy("index").toLocalIterator():
            out.write(bytes(r["bytes"]) + SEPARATOR)
    os.replace(partial, target)


def save_decompressed(path: str) -> str:
    """The decompressed copy of a ``.bz2`` file beside it; refused where it or its partial form exists."""
    if not path.lower().endswith(".bz2"):
        raise InvalidConfiguration("only .bz2 input can be saved decompressed")
    target = path[: -len(".bz2")]
    partial = f"{target}.partial"
    for existing in (target, partial):
        if os.path.exists(existing):
            raise InvalidConfiguration(f"{existing} already exists")
    try:
        with bz2.open(path, "rb") as source, open(partial, "xb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
        os.replace(partial, target)
    except (OSError, EOFError) as e:
        if os.path.exists(partial):
            os.remove(partial)
        raise IoError(str(e)) from e
    return target
