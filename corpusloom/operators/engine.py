"""The record engine: look up, list and find records, prepare previews and search them, and extract evidence."""

from __future__ import annotations

import contextlib
import os
import re
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import Accumulator, StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHECKPOINT_INTERVAL, EVIDENCE_BYTES, EVIDENCE_RECORDS, PROGRESS_STEP, PreviewConfig, TextConfig, XmlConfig, checkpoint_interval
from ..errors import InvalidConfiguration, NotPrepared, raise_kind
from ..functions import evidence, matching, preview
from ..session import forget, written
from ..sources import folder, records

MAX_INDEX = (1 << 63) - 1
CHECKPOINTS = "index bigint, position bigint"
#: Records that are asked for by number.
FEW = 1000


@dataclass(frozen=True)
class Record:
    index: int
    bytes: bytes

    def __len__(self) -> int:
        return len(self.bytes)

    @property
    def text(self) -> str:
        return self.bytes.decode("utf-8", "replace")


def record_bytes(data: str) -> Column:
    """The length of a record."""
    return F.octet_length(data).cast("bigint")


def _raise_first(df: DataFrame) -> DataFrame:
    """Raise the error of the record with the least index, where there is one."""
    bad = df.where("error is not null").orderBy("index").select("error").first()
    if bad is not None:
        kind, _, message = bad["error"].partition(":")
        raise_kind(kind, message)
    return df.drop("error")


def _told(e: Exception) -> Iterator[str]:
    """All that an error of Spark says: its own text, and that of the Java exceptions it came from."""
    yield str(e)
    todo, seen = [getattr(e, "java_exception", None) or getattr(e, "_origin", None)], 0
    while todo and seen < 100:
        java, seen = todo.pop(), seen + 1
        if java is not None:
            yield str(java.getMessage())
            todo += [java.getCause(), *java.getSuppressed()]


def _checked(run: Callable):  # noqa: ANN202
    """Turn an error that a record source met in a task into the error it was."""
    try:
        return run()
    except (PySparkException, Py4JJavaError) as e:
        for text in _told(e):
            if m := re.search(r"record-error\|(\w+)\|(.*?)\|end", text, re.S):
                raise_kind(m.group(1), m.group(2))
        raise


@contextlib.contextmanager
def _told_of(done: Accumulator | None, progress: Callable[[int], None] | None):  # noqa: ANN202
    """While the block runs, tell what an accumulator has reached, in whole steps; a task that is run again counts again, so it is an estimate."""
    if done is None or progress is None:
        yield
        return
    over = threading.Event()

    def watch() -> None:
        told = 0
        while not over.wait(0.2):
            reached = done.value // PROGRESS_STEP * PROGRESS_STEP
            if reached > told:
                told = reached
                progress(told)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    """In order of index; a limit of 0 gives one row, as the engine tests it after a row is taken."""
    ordered = df.orderBy("index")
    return ordered if limit is None else ordered.limit(max(limit, 1))


class RecordEngine:
    """An engine over records (index, bytes), a DataFrame or a callable that makes one from a session.

    ``form`` (xml or txt) decides how previews and evidence read a record. Results that may be large are DataFrames in order of
    index; single records are objects. Nothing is computed until it is asked for, apart from ``prep``.
    """

    def __init__(self, source: DataFrame | Callable[[SparkSession], DataFrame], form: str = "xml", spark: SparkSession | None = None, initial_checkpoints: DataFrame | None = None, file: tuple[str, XmlConfig] | None = None) -> None:
        self._source, self.form = source, form
        self._spark = spark or (source.sparkSession if isinstance(source, DataFrame) else SparkSession.getActiveSession())
        self._checkpoints = initial_checkpoints if initial_checkpoints is not None else self._spark.createDataFrame([], CHECKPOINTS)
        self._file = file  # a plain XML file, in which checkpoints can be sought
        self._interval, self._config = CHECKPOINT_INTERVAL, PreviewConfig()
        self._previews: DataFrame | None = None
        self._count = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, record_element: str = "page", form: str | None = None, max_record_bytes: int | None = None, target_record_bytes: int | None = None, keep: bool = False) -> RecordEngine:
        """A file (``.txt`` is text, else XML; either may end in ``.bz2``), or a folder of text files.

        With ``keep`` a file is parsed once, now, into a Parquet table in the shared folder, which all else reads by index; else it is parsed whenever
        all its records are asked for.
        """
        if os.path.isdir(path):
            source = folder.FolderSource(spark, path, TextConfig(target_record_bytes) if target_record_bytes else TextConfig())
            return cls.over_folder(source)
        form = records.form_of(path, form)
        if form == "xml":
            config = XmlConfig(record_element, max_record_bytes) if max_record_bytes is not None else XmlConfig(record_element)
        else:
            config = TextConfig(target_record_bytes) if target_record_bytes is not None else TextConfig()
        scanned = _checked(lambda: records.scan(spark, path, form, config))
        if keep:
            parsed = _checked(lambda: written(scanned))
            rows = written(records.numbered(parsed).select("index", "bytes", "position").repartitionByRange("index").sortWithinPartitions("index"))
            forget(parsed)
            return cls(rows, form, spark)
        rows = scanned.withColumn("index", F.col("local")) if records.is_single(path) else records.numbered(scanned)
        plain = form == "xml" and records.is_single(path) and not path.lower().endswith(".bz2")
        return cls(rows.select("index", "bytes", "position"), form, spark, file=(path, config) if plain else None)

    @classmethod
    def over_folder(cls, source: folder.FolderSource) -> RecordEngine:
        engine = cls(source.records(), "txt", source.spark, source.checkpoints())
        engine._interval = source.interval
        return engine

    @classmethod
    def over_previews(cls, previews: DataFrame) -> RecordEngine:
        """An engine that is prepared with given previews (index, elements) and has no records."""
        spark = previews.sparkSession
        engine = cls(spark.createDataFrame([], "index bigint, bytes binary"), "xml", spark)
        engine._previews = previews.select("index", "elements", F.lit(None).cast("string").alias("error"))
        return engine

    # configuration

    @property
    def source(self) -> DataFrame | Callable[[SparkSession], DataFrame]:
        return self._source

    @property
    def checkpoint_interval(self) -> int:
        return self._interval

    def set_checkpoint_interval(self, n: int) -> None:
        self._interval = checkpoint_interval(n)

    def with_checkpoint_interval(self, n: int) -> RecordEngine:
        self.set_checkpoint_interval(n)
        return self

    @property
    def preview_config(self) -> PreviewConfig:
        return self._config

    def set_preview_config(self, config: PreviewConfig) -> None:
        """For the next ``prep``; previews that exist stay."""
        self._config = config

    def with_preview_config(self, config: PreviewConfig) -> RecordEngine:
        self.set_preview_config(config)
        return self

    def checkpoints(self) -> DataFrame:
        """index (of the next record), position (byte in the file)."""
        return self._checkpoints

    # records

    def records(self) -> DataFrame:
        return self._source if isinstance(self._source, DataFrame) else self._source(self._spark)

    def count(self) -> int:
        return _checked(lambda: self.records().count())

    def get(self, index: int) -> Record | None:
        if not 0 <= index <= MAX_INDEX:
            raise InvalidConfiguration(f"record index {index} is out of range")
        rows = self._from_checkpoint(index)
        if rows is None:
            rows = self.records()
        row = _checked(lambda: rows.where(F.col("index") == index).select("bytes").first())
        return None if row is None or row["bytes"] is None else Record(index, bytes(row["bytes"]))

    def _from_checkpoint(self, index: int) -> DataFrame | None:
        """Records from the last checkpoint, or the beginning of a small file, up to ``index``, read by a seek."""
        if self._file is None:
            return None
        point = self._checkpoints.where((F.col("index") <= index) & F.col("position").isNotNull()).orderBy(F.desc("index")).first()
        if point is None and index >= self._interval and not records.is_single(self._file[0]):
            return None
        position, first = (0, 0) if point is None else (point["position"], point["index"])
        rows = records.scan_at(self._spark, *self._file, position, min(index - first + 1, MAX_INDEX))
        return rows.select((F.col("local") + first).alias("index"), "bytes")

    def list(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """index, bytes of records from ``start`` up to but without ``end``; all without bounds."""
        out = self.records().select("index", "bytes")
        if start is not None:
            out = out.where(F.col("index") >= start)
        if end is not None:
            out = out.where(F.col("index") < end)
        return out.orderBy("index")

    def decode(self, schema: str) -> DataFrame:
        """index, value: XML records read with a schema; broken ones are errors."""
        text = F.make_valid_utf8(F.col("bytes").cast("string"))
        return self.records().select("index", F.from_xml(text, schema, {"mode": "FAILFAST"}).alias("value"))

    # previews

    @property
    def is_prepared(self) -> bool:
        return self._previews is not None

    @property
    def prepared_preview_count(self) -> int:
        return self._count

    def prep(self, progress: Callable[[int], None] | None = None) -> int:
        """Previews of all records, and a checkpoint after every interval; how many. An error leaves what was there before.

        ``progress`` is told the number of records that are done, in steps of ``PROGRESS_STEP`` as tasks end, and in the end all of them.
        """
        rows = self.records()
        done = None if progress is None else self._spark.sparkContext.accumulator(0)
        new = preview.previews(rows, self._config, self.form, done).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with _told_of(done, progress):
                total = _checked(new.count)
            _raise_first(new)
        except BaseException:
            new.unpersist()
            raise
        if self.form == "xml" and "position" in rows.columns:
            at = rows.where((F.col("index") + 1) % self._interval == 0).select((F.col("index") + 1).alias("index"), "position")
            self._checkpoints = _checked(lambda: written(at))
        if self._previews is not None:
            self._previews.unpersist()
        self._previews, self._count = new, total
        if progress is not None:
            progress(total)
        return total

    def clear_previews(self) -> None:
        if self._previews is not None:
            self._previews.unpersist()
        self._previews, self._count = None, 0

    def previews(self) -> DataFrame:
        """index, elements."""
        if self._previews is None:
            raise NotPrepared("previews are not prepared; run prep() first")
        return self._previews.drop("error")

    def preview_at(self, index: int) -> list[tuple[str, str]] | None:
        if self._previews is None:
            return None
        row = self.previews().where(F.col("index") == index).first()
        return None if row is None else [(e["name"], e["text"]) for e in row["elements"]]

    def preview_sample(self, n: int = 3) -> DataFrame:
        return self.previews().orderBy("index").limit(n)

    # search

    def _hits(self, query: str) -> DataFrame:
        if query == "":
            raise InvalidConfiguration("search query must not be empty")
        return self.previews().where(F.exists("elements", lambda e: matching.contains_whole_words(e["text"], query)))

    def search_previews(self, query: str, limit: int | None = None) -> DataFrame:
        return _limited(self._hits(query), limit)

    def search_preview_indexes(self, query: str, limit: int | None = None) -> DataFrame:
        return _limited(self._hits(query).select("index"), limit)

    def find(self, query: str, limit: int | None = None, mode: str = "auto") -> DataFrame:
        """index of records that hold the words: in their previews once prepared, else in their bytes, markup and all.

        ``mode`` says which where it isn't auto: previews or records.
        """
        if query == "":
            raise InvalidConfiguration("search query must not be empty")
        if mode == "previews" or mode == "auto" and self.is_prepared:
            return self.search_preview_indexes(query, limit)
        text = F.make_valid_utf8(F.col("bytes").cast("string"))
        return _limited(self.records().where(matching.contains_whole_words(text, query)).select("index"), limit)

    # evidence

    def fragments(self, query: str, max_bytes: int = EVIDENCE_BYTES) -> DataFrame:
        """index, record, error of every record; see ``evidence.fragments``."""
        return evidence.fragments(self.records().select("index", "bytes"), query, max_bytes, self.form)

    def get_fragment(self, index: int, query: str, max_bytes: int = EVIDENCE_BYTES) -> str | None:
        evidence.check_request(query, max_bytes)
        record = self.get(index)
        return None if record is None else evidence.fragment(record.bytes, query, max_bytes, self.form)

    def search_to_get_fragment(self, query: str, record_limit: int = EVIDENCE_RECORDS, max_bytes: int = EVIDENCE_BYTES) -> DataFrame:
        """index, record: evidence from the first ``record_limit`` records whose previews hold the query; those without any are left out."""
        if record_limit <= 0 or max_bytes <= 0:
            raise InvalidConfiguration("record limit and max_bytes must be greater than zero")
        hits = self.search_preview_indexes(query, record_limit)
        if record_limit <= FEW:
            # as many numbers as were asked for: they are pushed down to a table, and sought in a file
            wanted = [r["index"] for r in hits.collect()]
            own = self._sought(wanted) if self._file is not None and len(wanted) <= EVIDENCE_RECORDS else self.records().select("index", "bytes").where(F.col("index").isin(wanted))
        else:
            own = self.records().select("index", "bytes").join(hits, "index", "left_semi")
        found = evidence.fragments(own, query, max_bytes, self.form)
        if record_limit <= FEW:  # computed once, and of as many bytes as were asked for
            found = self._spark.createDataFrame(_checked(found.collect), found.schema)
        else:
            found = _checked(lambda: written(evidence.fragments(own, query, max_bytes, self.form)))
        return _raise_first(found).where("record is not null").orderBy("index")

    def _sought(self, wanted: list[int]) -> DataFrame:
        """index, bytes of a few records, one by one."""
        rows = [(i, r.bytes) for i in wanted if (r := self.get(i)) is not None]
        return self._spark.createDataFrame(rows, "index bigint, bytes binary")
