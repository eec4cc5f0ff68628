"""Queries of files, folders, the service and the prompt: what they answer over files written from the given tables, and the SQL it equals."""

from __future__ import annotations

import bz2
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..config import PreviewConfig, TextConfig, XmlConfig
from ..errors import RecordError
from ..functions import evidence
from ..operators.engine import MAX_INDEX, RecordEngine
from ..operators.service import Service
from ..session import map_arrow, shared_folder
from ..sources import folder, records
from ..streaming import folder_stream
from ..tables import load
from .engine import _CHUNKS, _NUMBERED, _PARAGRAPHS, _element, _engine, _escaped, _has, _prefix, _windows

TARGET, INTERVAL = 1024, 10
_STEP = 1 << 16


def _own_folder(spark: SparkSession) -> str:
    path = shared_folder(spark).removeprefix("file:")
    path = os.path.join("/" + path.lstrip("/"), f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _write(rows: DataFrame, name: str, order: str, data: str, open_: Callable = open, before: bytes = b"", after: bytes = b"") -> None:
    """A file for each value of ``name``, a path, of the ``data`` of its rows in order; by tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = None, None
        count = 0
        for batch in batches:
            for path, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != own:
                    if file is not None:
                        file.write(after)
                        file.close()
                    own, file = path, open_(path, "wb")
                    file.write(before)
                    count += 1
                file.write(part)
        if file is not None:
            file.write(after)
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    sorted_ = rows.repartition(name).sortWithinPartitions(name, order).select(name, F.col(data).cast("binary"))
    map_arrow(sorted_, write, "n bigint").collect()


def _folder(spark: SparkSession, path: str) -> folder.FolderSource:
    """A folder with a file of the documents of each language, parted by blank lines."""
    base = _own_folder(spark)
    own = load(spark, path, "documents").where("text is not null and doc_id is not null")
    file = F.concat(F.lit(f"{base}/"), F.coalesce("lang", F.lit("none")), F.lit(".txt"))
    _write(own.select(file.alias("path"), "doc_id", F.concat("text", F.lit("\n\n")).alias("data")), "path", "doc_id", "data")
    return folder.FolderSource(spark, base, TextConfig(TARGET), INTERVAL)


def folder_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the folder, numbered over its files."""
    return _folder(spark, path).records().select("index", "filename", F.md5("bytes").alias("digest"))


def folder_from(spark: SparkSession, path: str) -> DataFrame:
    """Records from an index on, of a source that was made before and is loaded by its sidecar."""
    first = _folder(spark, path)
    again = folder.FolderSource(spark, first.folder, TextConfig(TARGET), INTERVAL)
    return again.records_from(25).select("index", F.octet_length("bytes").cast("bigint").alias("n_bytes"))


def folder_ranges(spark: SparkSession, path: str) -> DataFrame:
    return _folder(spark, path).file_ranges().select(F.col("start").alias("start_index"), F.col("end").alias("end_index"), "filename")


def folder_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """The folder's checkpoints as its engine has them, before and after previews are prepared."""
    engine = RecordEngine.over_folder(_folder(spark, path))
    before = engine.checkpoints()
    engine.prep()
    return before.join(engine.checkpoints(), ["index", "position"])


def folder_flat(spark: SparkSession, path: str) -> DataFrame:
    """The flat form of the folder: its size, and the records that stand at checkpoints in it."""
    source = _folder(spark, path)
    target = f"{source.folder}.flat"
    folder.write_flat(source.records(), target)
    with open(target, "rb") as file:
        found = []
        for point in source.checkpoints().orderBy("index").limit(50).collect():
            file.seek(point["position"])
            found.append((point["index"], file.read(20).decode("utf-8", "ignore")[:5]))
    found.append((-1, str(os.path.getsize(target))))
    return spark.createDataFrame(found, "index bigint, text string")


def folder_found(spark: SparkSession, path: str) -> DataFrame:
    """Records of an opened folder that hold a word, unprepared."""
    return RecordEngine.over_folder(_folder(spark, path)).find("museum")


_ONE = ("c_custkey", "c_name", "c_mktsegment")


_COMMENT = b"<!-- <customer> -->"


def _customer_file(spark: SparkSession, path: str, ending: str, head: bytes = _COMMENT) -> str:
    """All customers as one XML file, plain or compressed in several streams."""
    base = _own_folder(spark)
    c = load(spark, path, "customer")
    one = F.concat(F.lit("<customer>"), *[_element(n, _escaped(F.col(n))) for n in _ONE], F.lit("</customer>\n"))
    _write(c.select(F.lit(f"{base}/customers.xml{ending}").alias("path"), "c_custkey", one.alias("data")), "path", "c_custkey", "data", bz2.open if ending else open, b"<?xml version='1.0'?>" + head + b"<all><customer/>", b"</all>")
    return f"{base}/customers.xml{ending}"


def compressed_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a compressed file."""
    engine = RecordEngine.open(spark, _customer_file(spark, path, ".bz2"), "customer")
    return engine.list(10, 200).select("index", F.col("bytes").cast("string").alias("record"))


def compressed_found(spark: SparkSession, path: str) -> DataFrame:
    """Records of a compressed file that hold a word, in markup too."""
    engine = RecordEngine.open(spark, _customer_file(spark, path, ".bz2"), "customer")
    return engine.find("building").withColumn("n", F.lit(engine.count()).cast("bigint"))


def sought_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that was saved decompressed, by a seek to the checkpoint before each, and one past the end."""
    plain = folder.save_decompressed(_customer_file(spark, path, ".bz2"))
    engine = RecordEngine.open(spark, plain, "customer").with_checkpoint_interval(INTERVAL)
    last = engine.prep() - 1
    found = [(i, engine.get(i)) for i in (0, 9, 10, 25, last, last + 1, MAX_INDEX)]
    return spark.createDataFrame([("last" if i == last else "past" if i > last else str(i), None if r is None else r.text) for i, r in found], "place string, record string")


def file_positions(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoints of a plain file."""
    engine = RecordEngine.open(spark, _customer_file(spark, path, ""), "customer").with_checkpoint_interval(INTERVAL)
    engine.prep()
    return engine.checkpoints()


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """Plain files read in parts, where a comment doesn't forbid it: the records are those of the whole."""
    files = {name: _customer_file(spark, path, "", head) for name, head in (("parts", b""), ("whole", _COMMENT))}
    out = None
    for name, file in files.items():
        scanned = records.scan(spark, file, "xml", XmlConfig("customer"), _STEP)
        rows = records.numbered(scanned).select(F.lit(name).alias("read"), "index", F.md5("bytes").alias("digest"), F.lit(records.can_split(spark, file, "customer", _STEP)).alias("split"))
        out = rows if out is None else out.unionByName(rows)
    text = _own_folder(spark)
    own = load(spark, path, "documents").where("text is not null and doc_id is not null")
    _write(own.select(F.lit(f"{text}/all.txt").alias("path"), "doc_id", F.concat("text", F.lit("\n\n")).alias("data")), "path", "doc_id", "data")
    rows = records.numbered(records.scan(spark, f"{text}/all.txt", "txt", TextConfig(TARGET), _STEP))
    return out.unionByName(rows.select(F.lit("text").alias("read"), "index", F.md5("bytes").alias("digest"), F.lit(True).alias("split")))


def streamed_records(spark: SparkSession, path: str) -> DataFrame:
    """Files of customers that arrive one after another, numbered as they come, and found."""
    base = _own_folder(spark)
    c = load(spark, path, "customer").withColumn("path", F.concat(F.lit(f"{base}/in/"), (9 - F.col("c_nationkey") % 3).cast("string"), F.lit(".xml")))
    os.makedirs(f"{base}/in")
    one = F.concat(F.lit("<customer>"), _element("c_name", _escaped(F.col("c_name"))), F.lit("</customer>"))
    streamed = folder_stream.stream(spark, f"{base}/in", "xml", XmlConfig("customer"))
    for k in range(3):  # the later file has the earlier name
        _write(c.where(F.col("c_nationkey") % 3 == k).select("path", "c_custkey", one.alias("data")), "path", "c_custkey", "data", open, b"<d>", b"</d>")
        query = folder_stream.append_numbered(streamed, f"{base}/table", f"{base}/checkpoint")
        query.processAllAvailable()
        query.stop()
    return folder_stream.matching_records(spark.read.parquet(f"{base}/table"), "customer").select("index", "filename", F.col("bytes").cast("string").alias("record"))


def errors(spark: SparkSession, path: str) -> DataFrame:
    """What wrong options, requests and records are refused with."""
    base = _own_folder(spark)

    def file(name: str, data: bytes) -> str:
        with open(f"{base}/{name}", "wb") as out:
            out.write(data)
        return f"{base}/{name}"

    engine = RecordEngine(spark.createDataFrame([(0, b"a target here")], "index bigint, bytes binary"), "txt", spark)
    cases: dict[str, Callable] = {
        "cut off": lambda: RecordEngine.open(spark, file("cut.xml", b"<d><page>1")).count(),
        "too large": lambda: RecordEngine.open(spark, file("big.xml", b"<d><page>12345</page></d>"), max_record_bytes=17).count(),
        "just fits": lambda: RecordEngine.open(spark, file("fits.xml", b"<d><page>12345</page></d>"), max_record_bytes=18).count(),
        "broken markup": lambda: RecordEngine.open(spark, file("bad.xml", b"<d><page><a></b></page></d>")).count(),
        "not UTF-8": lambda: RecordEngine.open(spark, file("bad.txt", b"\xff\xfe")).count(),
        "no element": lambda: XmlConfig(""),
        "no target": lambda: TextConfig(0),
        "no interval": lambda: engine.set_checkpoint_interval(0),
        "no children": lambda: PreviewConfig(max_children=0),
        "empty query": lambda: engine.find(""),
        "blank request": lambda: engine.get_fragment(0, "  "),
        "no budget": lambda: engine.get_fragment(0, "target", 0),
        "small budget": lambda: engine.get_fragment(0, "target", 5),
        "no records": lambda: engine.search_to_get_fragment("target", 0),
        "not prepared": lambda: engine.search_previews("target"),
        "negative index": lambda: engine.get(-1),
        "bad range": lambda: cli.range_arguments("1-2"),
        "no file": lambda: RecordEngine.open(spark, f"{base}/none.xml").count(),
        "saved twice": lambda: folder.save_decompressed(file("plain.xml", b"")),
    }
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, "none"))
        except RecordError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "name string, error string")


def service_answers(spark: SparkSession, path: str) -> DataFrame:
    """Status, code and results of requests to the service, over documents, before previews are prepared and after."""
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=200))
    service = Service("docs", engine)
    rows: list[tuple] = []

    def ask(name: str, method: str, url: str, body: dict | bytes | None = None) -> None:
        status, pieces = service.respond(method, url, body if isinstance(body, bytes) else b"" if body is None else json.dumps(body).encode())
        answer = json.loads(b"".join(pieces))
        code = answer.get("error", {}).get("code")
        results = answer["results"] if "results" in answer else [answer]
        rows.extend((name, status, code, r.get("index"), r.get("preview", r.get("record"))) for r in results or [{}])

    search = lambda query, **more: {"corpus": "docs", "query": query} | more
    ask("corpus", "GET", "/local_data/corpus")
    ask("status", "GET", "/local_data/status?corpus=docs")
    ask("unprepared", "POST", "/local_data/search", search("museum"))
    engine.prep()
    ask("search", "POST", "/local_data/search", search("museum", limit=3))
    ask("search all", "POST", "/local_data/search", search("museum"))
    ask("search none", "POST", "/local_data/search", search("zzzqqq"))
    ask("find evidence", "POST", "/local_data/findevidence", search("museum", record_limit=4, max_bytes=40))
    ask("record", "GET", "/local_data?corpus=docs&i=5")
    ask("no record", "GET", f"/local_data?corpus=docs&i={MAX_INDEX}")
    ask("get evidence", "GET", "/local_data/getevidence?corpus=docs&i=3&query=the&max_bytes=30")
    ask("no evidence", "GET", "/local_data/getevidence?corpus=docs&i=3&query=zzzqqq")
    ask("other corpus", "GET", "/local_data?corpus=other&i=1")
    ask("no corpus", "GET", "/local_data?i=1")
    ask("no number", "GET", "/local_data?corpus=docs&i=x")
    ask("first of two", "GET", "/local_data?corpus=docs&i=x&i=5")
    ask("blank query", "POST", "/local_data/search", search(" "))
    ask("bad body", "POST", "/local_data/search", b"{")
    ask("bad limit", "POST", "/local_data/search", search("museum", limit=-1))
    ask("limit 0", "POST", "/local_data/search", search("museum", limit=0))
    ask("no limit left", "POST", "/local_data/findevidence", search("museum", record_limit=0))
    ask("no path", "GET", "/nothing")
    ask("no method", "POST", "/local_data/corpus")
    return spark.createDataFrame(rows, "request string, status bigint, code string, index bigint, text string")


def prompt_answers(spark: SparkSession, path: str) -> DataFrame:
    """What the prompt says to lines, in order, over documents."""
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=60))
    lines = ["showpreptable", "find museum 3", 'find "museum 2"', "prep 7", "showpreptable 4", "searchpreptable the 2", "spotonpreptable the 1", "get 5", f"get {MAX_INDEX}", "list 2..4", "getfragment 3 the 30", "getfragment 3 zzzqqq", "searchtogetfragment the 2 30", "clearpreptable", "showpreptable", "bogus"]
    # how often progress is told depends on time
    said = [(n, k, text) for n, line in enumerate(lines) for k, text in enumerate(t for t in cli.answer(engine, line) if not re.fullmatch(r"\d+ records", t))]
    said += [(len(lines), k, text) for k, text in enumerate(map(str, (cli.search_arguments('"Visual Studio 7"'), cli.search_arguments("a b"), cli.range_arguments(" 3 .. 9"))))]
    return spark.createDataFrame(said, "line bigint, n bigint, text string")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """The clean text of page records with two texts of preserved space, references within and other elements around."""
    safe = F.regexp_replace("text", r"[&<>{}\\]", "")
    body = F.concat(F.lit("<page><title>gone</title><text xml:space='preserve'>x"), safe, F.lit("y<ref>no <b>no</b></ref>z<br/>w</text><text xml:space=\"preserve\">u<i>v</i></text><text>gone</text></page>"))
    own = load(spark, path, "documents").where("text is not null and doc_id is not null and not contains(text, '== References ==')")
    return evidence.cleaned(own.select(F.col("doc_id").alias("index"), body.cast("binary").alias("bytes")))


QUERIES = {
    f.__name__: f
    for f in (
        folder_records, folder_from, folder_ranges, folder_checkpoints, folder_flat, folder_found, compressed_records, compressed_found, sought_records, file_positions, split_file, streamed_records, errors, service_answers,
        prompt_answers, wiki_pages,
    )
}

# the folder's files in order of their names, of documents in order of their ids
_FILED = "(select coalesce(lang, 'none') || '.txt' as filename, doc_id, text || chr(10) || chr(10) as text from documents where text is not null and doc_id is not null)"
_FOLDER_PARAGRAPHS = _PARAGRAPHS.replace("from documents where text is not null", f"from {_FILED}")
_FOLDER = f"""(select row_number() over (order by filename, doc_id, n, k) - 1 as index, filename, chunk
from {_CHUNKS.replace(_PARAGRAPHS, _FOLDER_PARAGRAPHS).replace('TARGET', str(TARGET))} join (select filename, doc_id from {_FILED}) using (doc_id))"""
_POINTS = f"(select index, position from (select index + 1 as index, (sum(strlen(chunk) + 2) over (order by index))::bigint as position from {_FOLDER}) where index % {INTERVAL} = 0)"
_XML = "'<customer>' || " + " || ".join(f"'<{n}>' || replace(replace(replace({n}::varchar, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</{n}>'" for n in _ONE) + " || '</customer>'"
_CUSTOMERS = f"(select row_number() over (order by c_custkey) - 1 as index, {_XML} as record, c_mktsegment from customer)"
_HEAD = len(b"<?xml version='1.0'?>" + _COMMENT + b"<all><customer/>")
_SAFE = r"regexp_replace(text, '[&<>{}\\]', '', 'g')"
_ERRORS = {
    "InvalidConfiguration": ["cut off", "too large", "no element", "no target", "no interval", "no children", "empty query", "blank request", "no budget", "small budget", "no records", "negative index", "bad range", "saved twice"],
    "NotPrepared": ["not prepared"],
    "XmlError": ["broken markup"],
    "IoError": ["not UTF-8", "no file"],
    "none": ["just fits"],
}
_MATCH = _has(_prefix(200), "museum")
_CONSTANT = [
    ("corpus", 200, None), ("status", 200, None), ("unprepared", 409, "corpus_not_prepared"), ("search none", 200, None), ("no record", 404, "record_not_found"), ("no evidence", 404, "evidence_not_found"), ("other corpus", 404, "corpus_not_found"),
    ("no corpus", 400, "invalid_request"), ("no number", 400, "invalid_request"), ("first of two", 400, "invalid_request"), ("blank query", 400, "invalid_query"), ("bad body", 400, "invalid_request"), ("bad limit", 400, "invalid_request"),
    ("no limit left", 400, "invalid_request"), ("no path", 404, "not_found"), ("no method", 404, "not_found"),
]
_PREVIEW = f"'<text>: ' || {_prefix(200)}"


def _answers(name: str, rows: str) -> str:
    return f"select '{name}' as request, 200::bigint as status, null::varchar as code, index, text from {rows}"


_MATCHES = f"(select index, {_PREVIEW} as text, text as whole from {_NUMBERED} where {_MATCH} order by index"
_SHORT = _prefix(60)
_THE = _has(_SHORT, "the")


def _said(line: int, n: str, text: str, rows: str = "") -> str:
    return f"select {line}::bigint as line, ({n})::bigint as n, {text} as text {rows}"


def _shown(index: str, short: str) -> str:
    return f"'#' || {index} || ' (' || (4 + strlen({short})) || ' bytes):'"


_SPOT = f"(select index, {_SHORT} as short from {_NUMBERED} where {_THE} order by index limit 1)"
_FIRST = f"(select index, {_SHORT} as short from {_NUMBERED} where index < 3)"
SQL = {
    "folder_records": f"select index, filename, md5(chunk) as digest from {_FOLDER}",
    "folder_from": f"select index, strlen(chunk) as n_bytes from {_FOLDER} where index >= 25",
    "folder_ranges": f"select min(index) as start_index, max(index) as end_index, filename from {_FOLDER} group by filename",
    "folder_checkpoints": f"select index, position from {_POINTS}",
    "folder_flat": f"""
select p.index, left(chunk, 5) as text from (select * from {_POINTS} order by index limit 50) p join {_FOLDER} f on f.index = p.index
union all select -1, sum(strlen(chunk) + 2)::bigint::varchar from {_FOLDER}""",
    "folder_found": f"select index from {_FOLDER} where {_has('chunk', 'museum')}",
    "compressed_records": f"select index, record from {_CUSTOMERS} where index >= 10 and index < 200",
    "compressed_found": f"select index, (select count(*) from customer) as n from {_CUSTOMERS} where c_mktsegment = 'BUILDING'",
    "sought_records": f"""
select place, record from (select unnest(['0', '9', '10', '25']) as place) join {_CUSTOMERS} on index = place::bigint
union all select 'last', record from {_CUSTOMERS} where index = (select count(*) - 1 from customer) union all select unnest(['past', 'past']), null""",
    "file_positions": f"select index + 1 as index, ({_HEAD} - 1 + sum(strlen(record) + 1) over (order by index))::bigint as position from {_CUSTOMERS} qualify (index + 1) % {INTERVAL} = 0",
    "split_file": f"""
select unnest(['parts', 'whole']) as read, index, md5(record) as digest, unnest([true, false]) as split from {_CUSTOMERS}
union all select 'text', row_number() over (order by doc_id, n, k) - 1, md5(chunk), true from {_CHUNKS.replace(_PARAGRAPHS, _FOLDER_PARAGRAPHS).replace('TARGET', str(TARGET))}""",
    "streamed_records": "select row_number() over (order by c_nationkey % 3, c_custkey) - 1 as index, (9 - c_nationkey % 3)::varchar || '.xml' as filename, '<customer><c_name>' || c_name || '</c_name></customer>' as record from customer",
    "errors": " union all ".join(f"select unnest({names}) as name, '{kind}' as error" for kind, names in _ERRORS.items()),
    "service_answers": " union all ".join(
        [f"select '{n}' as request, {s}::bigint as status, {'null' if c is None else repr(c)}::varchar as code, null::bigint as index, null::varchar as text" for n, s, c in _CONSTANT]
        + [_answers("search", f"{_MATCHES} limit 3)"), _answers("search all", f"{_MATCHES})"), _answers("limit 0", f"{_MATCHES} limit 1)"), _answers("record", f"(select * from {_NUMBERED} where index = 5)")]
        + [_answers("find evidence", f"(select index, record as text from {_windows(f'(select index, whole as text from {_MATCHES} limit 4))', ['museum'], 40)})")]
        + [_answers("get evidence", f"(select index, record as text from {_windows(f'(select * from {_NUMBERED} where index = 3)', ['the'], 30)})")]
    ),
    "prompt_answers": " union all ".join(
        [
            _said(0, "0", "'0 previews'"),
            _said(1, "row_number() over (order by index) - 1", "'#' || index", f"from (select index from {_NUMBERED} where {_has('text', 'museum')} order by index limit 3)"),
            _said(2, "row_number() over (order by index) - 1", "'#' || index", f"from (select index from {_NUMBERED} where {_has('text', 'museum')} order by index limit 2)"),
            f"select 3, 0, 'prepared ' || count(*) || ' records' from {_NUMBERED}",
            _said(4, "0", _shown("4", _SHORT), f"from {_NUMBERED} where index = 4"),
            _said(4, "1", f"'  <text>: ' || {_SHORT}", f"from {_NUMBERED} where index = 4"),
            _said(5, "row_number() over (order by index) - 1", "'#' || index", f"from (select index from {_NUMBERED} where {_THE} order by index limit 2)"),
            _said(6, "0", _shown("index", "short"), f"from {_SPOT}"),
            _said(6, "1", "'  <text>: ' || short", f"from {_SPOT}"),
            _said(7, "0", "'#5: ' || text", f"from {_NUMBERED} where index = 5"),
            _said(8, "0", "'no such record'"),
            _said(9, "index - 2", "'#' || index || ': ' || text", f"from {_NUMBERED} where index in (2, 3)"),
            _said(10, "0", "record", f"from {_windows(f'(select * from {_NUMBERED} where index = 3)', ['the'], 30)}"),
            _said(11, "0", "'no evidence'"),
            _said(12, "row_number() over (order by index) - 1", "'#' || index || ': ' || record", f"from {_windows(f'(select * from {_NUMBERED} where {_THE} order by index limit 2)', ['the'], 30)}"),
            _said(13, "0", "'cleared'"),
            _said(14, "0", "'0 previews'"),
            _said(15, "0", "'unknown command: bogus; try help'"),
            _said(16, "0", "'(''Visual Studio'', 7)'"),
            _said(16, "1", "'(''a b'', None)'"),
            _said(16, "2", "'(3, 9)'"),
        ]
    ),
    "wiki_pages": f"select doc_id as index, 'x' || {_SAFE} || 'y z wu v' as text from documents where text is not null and doc_id is not null and not contains(text, '== References ==')",
}
