"""Record sources: XML and plain text files, compressed or not, as Spark data sources, and the global record index."""

from __future__ import annotations

import bz2
import contextlib
import glob
import hashlib
import io
import itertools
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

from ..config import MAX_RECORD_BYTES, TARGET_RECORD_BYTES, TextConfig, XmlConfig
from ..errors import InvalidConfiguration, IoError, RecordError, XmlError
from ..functions import textsplit, xmltok
from ..session import checkpoint, map_arrow, tune, written

SCHEMA = "filename string, part int, local bigint, bytes binary, position bigint"
_ARROW = pa.schema([("filename", pa.string()), ("part", pa.int32()), ("local", pa.int64()), ("bytes", pa.binary()), ("position", pa.int64())])
_BATCH_BYTES = 4 << 20
#: Bytes of a plain file that one task reads.
SPLIT_BYTES = 64 << 20


def form_of(path: str, form: str | None = None) -> str:
    """xml or txt: as asked for, else by the file's ending."""
    if form in ("xml", "txt"):
        return form
    if form is not None:
        raise InvalidConfiguration(f"unknown form {form}")
    name = path.lower().removesuffix(".bz2")
    return "txt" if name.endswith(".txt") else "xml"


def open_bytes(path: str):  # noqa: ANN201
    try:
        return bz2.open(path, "rb") if path.lower().endswith(".bz2") else open(path, "rb")
    except OSError as e:
        raise IoError(str(e)) from e


def text_records(file: io.BufferedIOBase, target: int, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, None]]:
    """Chunks of the paragraphs of a UTF-8 text, read a line at a time; of those alone before which the last blank line begins between two places."""
    for paragraph in textsplit.paragraphs(_lines(file, start, stop)):
        for chunk in textsplit.chunks(paragraph, target):
            yield chunk.encode(), None


def _lines(file: io.BufferedIOBase, start: int, stop: int | None) -> Iterator[str]:
    """Lines of the paragraphs that belong to a part; the first of the file belongs to the first part."""
    if start:
        file.seek(start - 1)
        start += len(file.readline()) - 1
    at, own = start, start == 0
    while raw := file.readline():
        blank = not textsplit.trim(raw.decode("utf-8", "replace"))
        if stop is not None and at >= stop and (blank or not own):
            return
        if blank or own:
            own = True
            try:
                yield raw.decode("utf-8")
            except UnicodeDecodeError as e:
                raise IoError("stream did not contain valid UTF-8") from e
        at += len(raw)


class FilePart(InputPartition):
    def __init__(self, path: str, part: int, start: int, stop: int | None) -> None:
        self.path, self.part, self.start, self.stop = path, part, start, stop


class _Options:
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "")
        self.element = options.get("recordElement", options.get("recordelement", "page"))
        self.max_bytes = int(options.get("maxRecordBytes", options.get("maxrecordbytes", MAX_RECORD_BYTES)))
        self.target = int(options.get("targetRecordBytes", options.get("targetrecordbytes", TARGET_RECORD_BYTES)))
        #: Bytes from which on a plain file is cut into parts. Text may always be; XML only where no record element stands in another, in a comment or in CDATA (see ``can_split``).
        self.split_bytes = int(options.get("splitBytes", options.get("splitbytes", -1)))
        #: Where to begin in a single plain XML file, at the end of a record, and how many records to read from there.
        self.start = int(options.get("startPosition", options.get("startposition", 0)))
        self.most = int(options.get("maxRecords", options.get("maxrecords", 0)))

    def files(self) -> list[str]:
        paths = [self.path] if os.path.isfile(self.path) else sorted(p for p in glob.glob(os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path) if os.path.isfile(p))
        if not paths:
            raise IoError(f"no file at {self.path}")
        return sorted(paths, key=lambda p: os.path.basename(p).encode())


def _part_records(part: FilePart, o: _Options, form: str) -> Iterator[tuple[bytes, int | None]]:
    with open_bytes(part.path) as file:
        if form == "txt":
            yield from text_records(file, o.target, part.start, part.stop)
        elif part.stop is None:
            if part.start:
                file.seek(part.start)
            for data, end in xmltok.records(file.read, o.element, o.max_bytes, inside=part.start > 0):
                yield data, part.start + end
        else:
            yield from _records_from(file, part.start, part.stop, o)


def _start_tag(element: bytes) -> str:
    """A start tag, with the slash of an empty element as its group."""
    return r"<" + re.escape(element.decode()) + r"(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)?(/?)>"


def _records_from(file: io.BufferedIOBase, start: int, stop: int, o: _Options) -> Iterator[tuple[bytes, int]]:
    """Records whose start tag begins at ``start`` or later and before ``stop``, where parts may be read by themselves."""
    tag = re.compile(_start_tag(o.element.encode()).encode())
    file.seek(start)
    data, base, at = file.read(1 << 16), start, 0
    while base + at < stop:
        m = tag.search(data, at)
        if m is None:
            more = file.read(1 << 20)
            if not more:
                return
            # what may be the beginning of a tag is looked at again with what follows
            keep = data.rfind(b"<", at)
            keep = len(data) if keep < 0 else keep
            data, base, at = data[keep:] + more, base + keep, 0
            continue
        if base + m.start() >= stop:
            return
        if m.group(1):
            at = m.end()
            continue
        first = base + m.start()
        file.seek(first)
        record, length = next(xmltok.records(lambda n: file.read(min(n, 1 << 16)), o.element, o.max_bytes))
        yield record, first + length
        base, at = first + length, 0
        file.seek(base)
        data = file.read(1 << 16)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, form: str) -> None:
        self.o, self.form = _Options(options), form
        XmlConfig(self.o.element, self.o.max_bytes) if form == "xml" else TextConfig(self.o.target)

    def partitions(self) -> list[FilePart]:
        out = []
        try:
            files = self.o.files()
        except RecordError as e:
            raise RuntimeError(f"record-error|io|{e.args[0]}|end") from e
        for path in files:
            size = os.path.getsize(path)
            step = self.o.split_bytes if self.o.split_bytes >= 0 else SPLIT_BYTES if self.form == "txt" else 0
            if step > 0 and size > step and not self.o.start and not self.o.most and not path.lower().endswith(".bz2"):
                out += [FilePart(path, k, a, min(a + step, size)) for k, a in enumerate(range(0, size, step))]
            else:
                out.append(FilePart(path, 0, self.o.start, None))
        return out

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.o, self.form)


def _read(partition: FilePart, o: _Options, form: str) -> Iterator[pa.RecordBatch]:
    name = os.path.basename(partition.path)
    rows: list[tuple] = []
    held = 0
    try:
        found = _part_records(partition, o, form)
        for local, (data, position) in enumerate(itertools.islice(found, o.most) if o.most else found):
            rows.append((name, partition.part, local, data, position))
            held += len(data)
            if held > _BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    except RecordError as e:
        kind = "xml" if isinstance(e, XmlError) else "io" if isinstance(e, IoError) else "invalid"
        raise RuntimeError(f"record-error|{kind}|{e.args[0]}|end") from e
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class ArrivalLog:
    """Files of a folder by the order in which they were first seen: entry n, a file in the log's folder, names those that were new then.

    A file is known by its path and modification time. Entries are never changed, so a batch that is run again reads what it read.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.last, self.id = folder, 0, ""
        self.seen: dict[str, int] = {}

    def entry(self, number: int) -> dict | None:
        try:
            with open(os.path.join(self.folder, f"{number}.json"), encoding="utf-8") as file:
                return json.load(file)
        except FileNotFoundError:
            return None

    def catch_up(self) -> None:
        while (found := self.entry(self.last + 1)) is not None:
            self.last, self.id = self.last + 1, found["log"]
            self.seen |= found["files"]

    def add(self, files: dict[str, int]) -> None:
        """Take in those of the files that are not known; another writer's entry of the same number stays, and is read first."""
        self.catch_up()
        while new := {p: t for p, t in files.items() if self.seen.get(p) != t}:
            os.makedirs(self.folder, exist_ok=True)
            own = os.path.join(self.folder, f".{uuid.uuid4().hex}")
            with open(own, "w", encoding="utf-8") as file:
                json.dump({"log": self.id or uuid.uuid4().hex, "files": new}, file)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(own, os.path.join(self.folder, f"{self.last + 1}.json"))
            except FileExistsError:
                pass
            finally:
                os.unlink(own)
            self.catch_up()


def _beside(path: str) -> str:
    """The folder of the log where none is named: beside the folder that is read, or the one above the first wildcard."""
    fixed = path.rstrip("/")
    while glob.has_magic(fixed):
        fixed = os.path.dirname(fixed)
    tail = "" if fixed == path.rstrip("/") else "-" + hashlib.md5(path.encode()).hexdigest()[:12]
    return f"{fixed or '.'}.arrivals{tail}"


class RecordStreamReader(DataSourceStreamReader):
    """Every file that was not read before, under whatever name it arrives; the offset is a place in the log of arrivals. Files are read by tasks.

    A file whose modification time changes has arrived again and is read again as a whole. One that is gone before it is read is an error.
    """

    def __init__(self, options: dict, form: str) -> None:
        self.o, self.form = _Options(options), form
        self.log = ArrivalLog(options.get("arrivalLog", options.get("arrivallog")) or _beside(self.o.path))

    def _files(self) -> dict[str, int]:
        found = {}
        try:
            for path in self.o.files():
                with contextlib.suppress(FileNotFoundError):
                    found[path] = os.stat(path).st_mtime_ns
        except IoError:
            pass
        return found

    def initialOffset(self) -> dict:
        return {"entry": 0, "log": ""}

    def latestOffset(self, *_: object) -> dict:
        self.log.add(self._files())
        return {"entry": self.log.last, "log": self.log.id}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        if "file" in start or "file" in end:
            raise InvalidConfiguration("the checkpoint is of an earlier version, which missed files; begin with a new one and an empty table")
        if start["entry"] and start["log"] != end["log"]:
            raise InvalidConfiguration(f"the log of arrivals in {self.log.folder} is not the one that the checkpoint goes by")
        out: list[FilePart] = []
        alike: Counter[str] = Counter()
        for number in range(start["entry"] + 1, end["entry"] + 1):
            entry = self.log.entry(number)
            if entry is None or entry["log"] != end["log"]:
                raise IoError(f"no entry {number} in the log of arrivals in {self.log.folder}")
            for path, changed in entry["files"].items():
                try:
                    if os.stat(path).st_mtime_ns != changed:  # it has arrived again, and a later entry names it
                        continue
                except FileNotFoundError as e:
                    raise IoError(f"{path} is gone before it was read") from e
                name = os.path.basename(path)
                out.append(FilePart(path, alike[name], 0, None))
                alike[name] += 1
        return out

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.o, self.form)


class XmlRecords(DataSource):
    """``spark.read.format("xmlrecords").option("recordElement", "page").load(path)``"""

    form = "xml"

    @classmethod
    def name(cls) -> str:
        return f"{cls.form}records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:  # noqa: ANN001
        return RecordReader(self.options, self.form)

    def streamReader(self, schema) -> RecordStreamReader:  # noqa: ANN001
        return RecordStreamReader(self.options, self.form)


class TextRecords(XmlRecords):
    """``spark.read.format("textrecords").option("targetRecordBytes", 4096).load(path)``"""

    form = "txt"

    @classmethod
    def name(cls) -> str:
        return "textrecords"


def register(spark: SparkSession) -> None:
    tune(spark)
    spark.dataSource.register(XmlRecords)
    spark.dataSource.register(TextRecords)


def can_split(spark: SparkSession, path: str, element: str, step: int = SPLIT_BYTES) -> bool:
    """Whether parts of plain XML files may be read by themselves: no record element stands in another, in a comment or in CDATA.

    Every part is searched for the tags alone, by a task each; start and end tags must take turns within the parts and from one to the next.
    """
    register(spark)
    parts = [(p, k, a, min(a + step, size)) for p in _Options({"path": path}).files() if not p.lower().endswith(".bz2") and (size := os.path.getsize(p)) > step for k, a in enumerate(range(0, size, step))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_turns(p, element.encode(), a, z) for p, _, a, z in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string())], names=["path", "part", "turns"])

    rows = spark.createDataFrame(parts, "path string, part int, a bigint, z bigint").repartition(max(1, len(parts)), "path", "part")
    told = map_arrow(rows, look, "path string, part int, turns string").orderBy("path", "part").collect() if parts else []  # two letters for each part
    for _, own in itertools.groupby(told, lambda r: r["path"]):
        turns = [r["turns"] for r in own]
        if None in turns:
            return False
        joined = "".join(turns)
        if joined != "se" * (len(joined) // 2):
            return False
    return True


def _turns(path: str, element: bytes, start: int, stop: int) -> str | None:
    """The tags of record elements that begin in a part: s or e for an odd number that take turns, the first and the last for an even one.

    None where they don't take turns, or a comment or the like hides one.
    """
    name = re.escape(element)
    tag = re.compile(rb"(<!--|<!\[CDATA\[|<\?|<!)|(</)" + name + rb"\s*>|<" + name + rb"(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)?(/?)>")
    ends = {b"<!--": b"-->", b"<![CDATA[": b"]]>", b"<?": b"?>", b"<!": b">"}
    opening = re.compile(rb"</?" + name + rb"[\s/>]")
    kinds: list[str] = []
    with open(path, "rb") as file:
        file.seek(start)
        data, at = file.read(stop - start + (1 << 16)), 0
        while (m := tag.search(data, at)) is not None and m.start() < stop - start:
            at = m.end()
            if m.group(1):
                end = data.find(ends[m.group(1)], at)
                while end < 0 and (more := file.read(1 << 24)):
                    data += more
                    end = data.find(ends[m.group(1)], at)
                if end < 0 or opening.search(data, at, end):
                    return None
                at = end
            elif not m.group(3):
                kind = "e" if m.group(2) else "s"
                if kinds[-1:] == [kind]:
                    return None
                kinds = [*kinds[:1], kind]
    return "" if not kinds else kinds[0] if kinds[0] == kinds[-1] else "".join(kinds)


def scan(spark: SparkSession, path: str, form: str | None = None, config: XmlConfig | TextConfig | None = None, split_bytes: int | None = None) -> DataFrame:
    """filename, part, local, bytes, position of all records of a file, a folder or a glob.

    Plain files larger than ``split_bytes`` (by default ``SPLIT_BYTES``; 0 for never) are read in parts where that is right.
    """
    register(spark)
    form = form_of(path, form)
    reader = spark.read.format("xmlrecords" if form == "xml" else "textrecords")
    if isinstance(config, XmlConfig):
        reader = reader.option("recordElement", config.record_element).option("maxRecordBytes", config.max_record_bytes)
    elif isinstance(config, TextConfig):
        reader = reader.option("targetRecordBytes", config.target_record_bytes)
    step = SPLIT_BYTES if split_bytes is None else split_bytes
    if form == "xml" and step and not can_split(spark, path, config.record_element if isinstance(config, XmlConfig) else "page", step):
        step = 0
    return reader.option("splitBytes", step).load(path)


def scan_at(spark: SparkSession, path: str, config: XmlConfig, position: int, most: int) -> DataFrame:
    """local, bytes, position of at most ``most`` records of a plain XML file from a place where one ends, by a seek in one task."""
    register(spark)
    reader = spark.read.format("xmlrecords").option("recordElement", config.record_element).option("maxRecordBytes", config.max_record_bytes)
    return reader.option("startPosition", position).option("maxRecords", most).load(path).select("local", "bytes", "position")


def is_single(path: str) -> bool:
    """Whether a scan of the path is of one file read as a whole, whose records come numbered."""
    return os.path.isfile(path) and (path.lower().endswith(".bz2") or os.path.getsize(path) <= SPLIT_BYTES)


def kept(rows: DataFrame, order: str) -> DataFrame:
    """The rows with ``index`` by a unique sortable column, as a Parquet table in the shared folder whose files are ranges of the index.

    It is ordered once; a filter on ``index`` then reads the row groups it needs. The table lasts as long as the application.
    """
    return written(numbered_by(rows, order))


def numbered(rows: DataFrame, order: tuple[str, ...] = ("filename", "part"), local: str = "local", first: int = 0) -> DataFrame:
    """With ``index``: contiguous over all files in order of their names, from numbers that are contiguous within each.

    Only a count per file and part is ordered in one place; records stay where they are.
    """
    counts = rows.groupBy(*order).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_first", F.expr(f"sum(_n) over (order by {', '.join(f'cast({c} as binary)' if c == 'filename' else c for c in order)} rows between unbounded preceding and current row) - _n + {first}L")).drop("_n")
    return rows.join(offsets, list(order)).withColumn("index", F.col("_first") + F.col(local)).drop("_first")


def numbered_by(df: DataFrame, order: str, first: int = 0) -> DataFrame:
    """With ``index`` by a unique sortable column: ranged partitions are sorted each for itself and offset by the counts before.

    The sorted partitions are checkpointed: were they made anew for the counts and for the rows, their bounds could differ.
    """
    places = (1 << 33) - 1  # an increasing id holds the partition above its 33 bits of place
    ranged = checkpoint(df.repartitionByRange(_partitions(df), F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    local = ranged.withColumns({"_part": F.shiftright("_id", 33), "_local": F.col("_id").bitwiseAND(F.lit(places))}).drop("_id")
    return numbered(local, ("_part",), "_local", first).drop("_part", "_local")


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def scan_column(df: DataFrame, key: str, data: str, config: XmlConfig | TextConfig) -> DataFrame:
    """key, local, bytes: the records of the XML or text that each row holds in a binary column, in order; errors as of a file."""
    xml = isinstance(config, XmlConfig)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = []
            local: list[int] = []
            out: list[bytes] = []
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = io.BytesIO(b)
                found = xmltok.records(file.read, config.record_element, config.max_record_bytes) if xml else text_records(file, config.target_record_bytes)
                try:
                    for n, (record, _) in enumerate(found):
                        keys.append(k)
                        local.append(n)
                        out.append(record)
                except RecordError as e:
                    raise RuntimeError(f"record-error|{'xml' if isinstance(e, XmlError) else 'io' if isinstance(e, IoError) else 'invalid'}|{e.args[0]}|end") from e
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(local, pa.int64()), pa.array(out, pa.binary())], names=[key, "local", "bytes"])

    chosen = df.select(key, F.col(data).cast("binary").alias("bytes")).where("bytes is not null")
    return map_arrow(chosen, cut, f"{key} {df.schema[key].dataType.simpleString()}, local bigint, bytes binary")
