import bz2
import io
import json
import os
import random
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.config import PreviewConfig, TextConfig, XmlConfig
from corpusloom.errors import InvalidConfiguration, IoError, NotPrepared
from corpusloom.functions import preview
from corpusloom.operators.engine import RecordEngine
from corpusloom.operators.service import Service, serve
from corpusloom.sources import folder, records
from corpusloom.streaming import folder_stream

BOOKS = b"""<d><page id="7"><maker>Ada</maker><title>First One</title><year>1870</year></page>
<page><maker>Brenna</maker><title>Second &amp; Two</title></page>
<page><maker>Ada</maker><title>First Again</title><x>hidden</x></page></d>"""


@pytest.fixture(scope="module")
def xml_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("xml") / "books.xml"
    path.write_bytes(BOOKS)
    return str(path)


def indexes(df):
    return [r["index"] for r in df.collect()]


def test_xml_engine(spark, xml_path):
    engine = RecordEngine.open(spark, xml_path).with_preview_config(PreviewConfig(stop_element=None))
    assert engine.get(1).text.startswith("<page><maker>Brenna")
    assert engine.get(3) is None
    assert indexes(engine.list(1, 3)) == [1, 2] and indexes(engine.list(2, 2)) == [] and len(indexes(engine.list())) == 3
    assert indexes(engine.find("first")) == [0, 2] and indexes(engine.find("first", 1)) == [0] and indexes(engine.find("first", 0)) == [0]
    assert indexes(engine.find("id")) == [0]  # attributes count while unprepared
    assert indexes(engine.find("   ")) == []
    with pytest.raises(InvalidConfiguration):
        engine.find("")
    with pytest.raises(NotPrepared):
        engine.search_previews("x")
    assert not engine.is_prepared and engine.preview_at(0) is None
    assert engine.with_checkpoint_interval(2).prep() == 3 == engine.prepared_preview_count
    assert [c["index"] for c in engine.checkpoints().collect()] == [2]
    assert indexes(engine.find("id")) == [] and indexes(engine.find("id", mode="records")) == [0]
    assert engine.preview_at(1) == [("maker", "Brenna"), ("title", "Second  Two")]
    assert indexes(engine.search_preview_indexes("ADA")) == [0, 2]
    assert [tuple(r) for r in engine.search_to_get_fragment("ada", 5, 512).collect()] == [(0, "Ada First One 1870"), (2, "Ada First Again hidden")]
    assert engine.get_fragment(0, "first", 9) == "Ada First" and engine.get_fragment(0, "nothing") is None and engine.get_fragment(9, "a") is None
    with pytest.raises(InvalidConfiguration):
        engine.search_to_get_fragment("ada", 0)
    assert engine.previews().select(preview.retained_bytes(F.col("elements"))).first()[0] == len("makerAdatitleFirst Oneyear1870")
    assert [r["value"]["title"] for r in engine.decode("title string").orderBy("index").collect()][1] == "Second & Two"
    engine.clear_previews()
    assert not engine.is_prepared and engine.prepared_preview_count == 0 and engine.checkpoints().count() == 1


def test_records_are_sought_by_checkpoint(spark, tmp_path, monkeypatch):
    path = tmp_path / "pages.xml"
    path.write_bytes(b"<d>" + b"".join(b"<page>%d</page> <page/>\n" % k for k in range(25)) + b"</d>")
    engine = RecordEngine.open(spark, str(path)).with_checkpoint_interval(10)
    assert engine.get(24).text == "<page>24</page>"  # by a scan
    assert engine.prep() == 25 and [c["index"] for c in engine.checkpoints().orderBy("index").collect()] == [10, 20]
    monkeypatch.setattr(engine, "_source", None)  # what follows may only seek
    assert [engine.get(k).text for k in (10, 19, 20, 24)] == [f"<page>{k}</page>" for k in (10, 19, 20, 24)]
    assert engine.get(25) is None and engine.get(1000) is None
    cut = RecordEngine.open(spark, str(path)).with_checkpoint_interval(2)
    cut.prep()
    path.write_bytes(path.read_bytes().partition(b"24</page>")[0])
    with pytest.raises(InvalidConfiguration, match="inside record"):
        cut.get(24)


def test_kept_files_are_parsed_once(spark, tmp_path):
    path = tmp_path / "pages.xml"
    path.write_bytes(b"<d>" + b"".join(b"<page>word %d</page>" % k for k in range(300)) + b"</d>")
    engine = RecordEngine.open(spark, str(path), keep=True).with_preview_config(PreviewConfig(stop_element=None))
    path.unlink()
    assert engine.count() == 300 and engine.get(299).text == "<page>word 299</page>" and engine.get(300) is None
    assert indexes(engine.list(7, 9)) == [7, 8] and indexes(engine.find("77")) == [77]
    engine.prep()
    assert [c["index"] for c in engine.checkpoints().orderBy("index").collect()] == [100, 200, 300]
    with pytest.raises(InvalidConfiguration, match="inside record"):
        path.write_bytes(b"<d><page>cut")
        RecordEngine.open(spark, str(path), keep=True)


def test_many_records_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"a word {k}".encode()) for k in range(50)], "index bigint, bytes binary")
    engine = RecordEngine(rows, "txt", spark)
    engine.prep()
    few = [tuple(r) for r in engine.search_to_get_fragment("word", 20, 6).collect()]
    monkeypatch.setattr("corpusloom.operators.engine.FEW", 5)
    assert few == [tuple(r) for r in engine.search_to_get_fragment("word", 20, 6).collect()] and len(few) == 20


def test_progress_is_told(spark):
    rows = spark.range(0, 60_000, 1, 6).select(F.col("id").alias("index"), F.lit(b"x").alias("bytes"))
    told = []
    engine = RecordEngine(rows, "txt", spark)
    assert engine.prep(told.append) == 60_000 == told[-1]
    assert told == sorted(told) and all(n % 10_000 == 0 for n in told)


def test_kept_tables_are_read_by_range(spark):
    df = spark.createDataFrame([(k * 3, f"t{k}") for k in range(2000)], "k int, t string")
    own = records.kept(df, "k")
    assert [tuple(r) for r in own.where("index = 77").collect()] == [(231, "t77", 77)] and own.count() == 2000
    plan = own.where("index = 77")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(index,77)" in plan and "Exchange" not in plan


def test_default_preview_stops_at_title(spark, xml_path):
    engine = RecordEngine.open(spark, xml_path)
    engine.prep()
    assert indexes(engine.find("hidden")) == [] and engine.preview_at(0) == [("maker", "Ada"), ("title", "First One")]


def test_errors_reach_the_caller(spark, tmp_path):
    (tmp_path / "cut.xml").write_bytes(b"<d><page>1")
    with pytest.raises(InvalidConfiguration, match="inside record"):
        RecordEngine.open(spark, str(tmp_path / "cut.xml")).count()
    (tmp_path / "big.xml").write_bytes(b"<d><page>12345</page></d>")
    with pytest.raises(InvalidConfiguration, match="max_record_bytes"):
        RecordEngine.open(spark, str(tmp_path / "big.xml"), max_record_bytes=4).count()
    with pytest.raises(InvalidConfiguration):
        RecordEngine.open(spark, str(tmp_path / "big.xml"), "")


def test_compressed_and_split_files(spark, tmp_path):
    pages = b"".join(b"<page><n>%d</n><t>%s</t></page>\n" % (i, b"x" * (i % 90)) for i in range(400))
    (tmp_path / "a.xml").write_bytes(b"<d>" + pages + b"</d>")
    half = len(pages) // 2
    (tmp_path / "a.xml.bz2").write_bytes(bz2.compress(b"<d>" + pages[:half]) + bz2.compress(pages[half:] + b"</d>"))
    whole = records.numbered(records.scan(spark, str(tmp_path / "a.xml")))
    want = [bytes(r["bytes"]) for r in whole.orderBy("index").collect()]
    assert len(want) == 400
    for other in (records.scan(spark, str(tmp_path / "a.xml.bz2")), records.scan(spark, str(tmp_path / "a.xml"), split_bytes=777)):
        rows = records.numbered(other).orderBy("index").collect()
        assert [bytes(r["bytes"]) for r in rows] == want and [r["index"] for r in rows] == list(range(400))
    target = folder.save_decompressed(str(tmp_path / "a.xml.bz2").replace("a.xml.bz2", "a.xml.bz2")) if not (tmp_path / "a.xml").exists() else None
    assert target is None
    (tmp_path / "a.xml").unlink()
    assert folder.save_decompressed(str(tmp_path / "a.xml.bz2")) == str(tmp_path / "a.xml")
    with pytest.raises(InvalidConfiguration):
        folder.save_decompressed(str(tmp_path / "a.xml.bz2"))


def test_parts_of_files(spark, tmp_path):
    rng = random.Random(5)
    for n in range(300):  # paragraphs of a text belong to one part each, wherever it is cut
        text = "".join(rng.choice(["a", "b c", "\n", "\n", "\n \n", "\r\n", "\u00e9", "\u3000"]) for _ in range(rng.randrange(60)))
        data = text.encode()
        whole = [b for b, _ in records.text_records(io.BytesIO(data), 5)]
        step = rng.randrange(1, 20)
        parts = [b for a in range(0, max(1, len(data)), step) for b, _ in records.text_records(io.BytesIO(data), 5, a, a + step)]
        assert parts == whole, (n, text, step)
    page = "<page x='1'><a>{}</a></page><page/>"
    plain = "<d>" + "".join(page.format(k) for k in range(200)) + "</d>"
    cases = {
        plain: True,
        plain.replace("<a>100</a>", "<page>in</page>"): False,
        plain.replace("<a>100</a>", "<!-- <page> -->"): False,
        plain.replace("<a>100</a>", "<!-- pages -->"): True,
        plain.replace("<a>100</a>", "<![CDATA[</page>]]>"): False,
        plain.replace("<a>100</a>", "<pages></pages>"): True,
        plain.replace("<a>100</a></page>", "<a>100</a>"): False,
    }
    for text, right in cases.items():
        (tmp_path / "a.xml").write_text(text)
        for step in (64, 500, 10_000):
            assert records.can_split(spark, str(tmp_path / "a.xml"), "page", step) == (right or step == 10_000), (text[:0], step)
    (tmp_path / "a.xml").write_text(plain)
    rows = records.numbered(records.scan(spark, str(tmp_path / "a.xml"), split_bytes=500))
    assert [bytes(r["bytes"]).decode() for r in rows.orderBy("index").collect()] == [page.format(k).removesuffix("<page/>") for k in range(200)]


def test_folder_source(spark, tmp_path):
    where = tmp_path / "notes"
    (where / "below").mkdir(parents=True)
    (where / "b.TXT").write_text("three\n\nfour\n")
    (where / "a.txt").write_text("one fox\n\n\ntwo\n")
    (where / "empty.txt").write_text("\n\n")
    (where / "c.xml").write_text("<page/>")
    (where / "below" / "d.txt").write_text("five\n")
    source = folder.FolderSource(spark, str(where), interval=2)
    ranges = lambda s: [tuple(r) for r in s.file_ranges().orderBy("start").collect()]
    assert ranges(source) == [(0, 1, "a.txt"), (2, 3, "b.TXT")]
    points = [(2, len("one fox\n\n\ntwo\n\n\n")), (4, len("one fox\n\n\ntwo\n\n\nthree\n\n\nfour\n\n\n"))]
    assert [tuple(r) for r in source.checkpoints().orderBy("index").collect()] == points
    engine = RecordEngine.over_folder(source)
    assert engine.get(2).text == "three\n" and [tuple(r) for r in engine.checkpoints().orderBy("index").collect()] == points
    engine.prep()
    assert engine.preview_at(0) == [("text", "one fox\n")] and engine.get_fragment(0, "fox", 3) == "fox"
    (where / "a.txt").write_text("changed\n")
    assert ranges(folder.FolderSource(spark, str(where), interval=2)) == [(0, 1, "a.txt"), (2, 3, "b.TXT")]  # kept as it was
    assert ranges(folder.FolderSource(spark, str(where), interval=2, refresh=True))[0] == (0, 0, "a.txt")
    with pytest.raises(InvalidConfiguration, match="checkpoint_interval"):
        folder.FolderSource(spark, str(where), interval=3)
    with pytest.raises(InvalidConfiguration, match="target_record_bytes"):
        folder.FolderSource(spark, str(where), TextConfig(9), interval=2)
    (tmp_path / "notes.sidecar.json").write_text("{")
    with pytest.raises(InvalidConfiguration):
        folder.FolderSource(spark, str(where), interval=2)
    (tmp_path / "notes.sidecar.json").unlink()
    again = folder.FolderSource(spark, str(where), interval=2)
    folder.write_flat(again.records(), str(tmp_path / "notes.flat"))
    assert (tmp_path / "notes.flat").read_text() == "changed\n\n\nthree\n\n\nfour\n\n\n"
    assert indexes(again.records_from(1).orderBy("index")) == [1, 2]
    assert json.loads((tmp_path / "notes.sidecar.json").read_text())["version"] == folder.VERSION


def test_closure_source_and_numbering(spark):
    made = lambda s: records.numbered_by(s.createDataFrame([(k * 7 % 101, f"word{k} text") for k in range(101)], "k int, t string"), "k").select("index", F.col("t").cast("binary").alias("bytes"))
    engine = RecordEngine(made, "txt", spark)
    assert indexes(engine.list()) == list(range(101))
    assert engine.prep() == 101 and indexes(engine.find("text", 3)) == [0, 1, 2]


def test_service(spark, xml_path):
    engine = RecordEngine.open(spark, xml_path).with_preview_config(PreviewConfig(stop_element=None))
    service = Service("books", engine)
    ask = lambda m, u, b=None: service.handle(m, u, b"" if b is None else json.dumps(b).encode())
    assert ask("GET", "/local_data/corpus") == (200, {"corpus": "books"})
    assert ask("GET", "/local_data/status?corpus=books") == (200, {"corpus": "books", "prepared": False})
    assert ask("POST", "/local_data/search", {"corpus": "books", "query": "ada"})[0] == 409
    engine.prep()
    status, body = ask("POST", "/local_data/search", {"corpus": "books", "query": "brenna"})
    assert status == 200 and body["results"] == [{"index": 1, "preview": "<maker>: Brenna\n<title>: Second  Two"}]
    assert ask("POST", "/local_data/findevidence", {"corpus": "books", "query": "ada", "record_limit": 1})[1]["results"] == [{"index": 0, "record": "Ada First One 1870"}]
    assert ask("GET", "/local_data?corpus=books&i=1")[1]["index"] == 1
    assert ask("GET", "/local_data/getevidence?corpus=books&i=0&query=first+one&max_bytes=9")[1] == {"corpus": "books", "query": "first one", "index": 0, "record": "First One"}
    code = lambda *a: (lambda r: (r[0], r[1]["error"]["code"]))(ask(*a))
    assert code("GET", "/nothing") == code("POST", "/local_data/corpus") == (404, "not_found")
    assert code("GET", "/local_data?corpus=other&i=1") == (404, "corpus_not_found")
    assert code("GET", "/local_data?corpus=books&i=x") == code("GET", "/local_data?i=1") == code("GET", "/local_data?corpus=books&i=-1") == (400, "invalid_request")
    assert code("GET", "/local_data?corpus=books&i=77") == (404, "record_not_found")
    assert code("GET", "/local_data/getevidence?corpus=books&i=0&query=zzz") == (404, "evidence_not_found")
    assert code("GET", "/local_data/getevidence?corpus=books&i=0&query=+") == code("POST", "/local_data/search", {"corpus": "books", "query": " "}) == (400, "invalid_query")
    assert code("POST", "/local_data/search", {"corpus": "books", "query": "a", "limit": -1}) == (400, "invalid_request")
    assert code("POST", "/local_data/findevidence", {"corpus": "books", "query": "ada", "record_limit": 0}) == (400, "invalid_request")
    assert service.handle("POST", "/local_data/search", b"{")[0] == 400
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/local_data/corpus") as r:
        assert json.load(r) == {"corpus": "books"}
    asked = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/local_data/search", b'{"corpus": "books", "query": "ada"}')
    with urllib.request.urlopen(asked) as r:
        assert json.load(r) == {"corpus": "books", "query": "ada", "results": [{"index": 0, "preview": "<maker>: Ada\n<title>: First One\n<year>: 1870"}, {"index": 2, "preview": "<maker>: Ada\n<title>: First Again\n<x>: hidden"}]}
    server.shutdown()


def test_cli(spark, xml_path):
    engine = RecordEngine.open(spark, xml_path)
    say = lambda line: list(cli.answer(engine, line, xml_path))
    assert cli.search_arguments('"Visual Studio 7"') == ("Visual Studio", 7) and cli.search_arguments("a b") == ("a b", None)
    assert say("find first 1") == ["#0"] and say("get 9") == ["no such record"] and len(say("list 0..2")) == 2
    assert say("prep 2") == ["prepared 3 records"] and say("searchpreptable first") == ["#0", "#2"]
    assert say("spotonpreptable brenna")[1:] == ["  <maker>: Brenna", "  <title>: Second  Two"]
    assert say("showpreptable")[0] == "3 previews" and say("getfragment 0 first one 9") == ["First One"]
    assert say("searchtogetfragment ada 1 3") == ["#0: Ada"] and say("clearpreptable") == ["cleared"] and say("bogus")[0].startswith("unknown")
    with pytest.raises(InvalidConfiguration):
        say("list 1-2")


def test_stream(spark, tmp_path):
    where, table = tmp_path / "in", str(tmp_path / "table")
    where.mkdir()
    (where / "a.xml").write_bytes(b"<d><page>one</page><page>two</page></d>")
    streamed = folder_stream.stream(spark, str(where), "xml", XmlConfig("page"))
    for name, body in (("", b""), ("b.xml", b"<d><page>three two</page></d>")):
        if name:
            (where / name).write_bytes(body)
        query = folder_stream.append_numbered(streamed, table, str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(table).orderBy("index").collect()
    assert [(r["index"], bytes(r["bytes"])) for r in rows] == [(0, b"<page>one</page>"), (1, b"<page>two</page>"), (2, b"<page>three two</page>")]
    assert folder_stream.matching_records(spark.read.parquet(table), "two").count() == 2


def test_stream_reads_files_whatever_their_names(spark, tmp_path):
    where, table = tmp_path / "in", str(tmp_path / "table")
    where.mkdir()
    streamed = folder_stream.stream(spark, str(where), "txt", TextConfig(1024), str(tmp_path / "log"))

    def run():
        query = folder_stream.append_numbered(streamed, table, str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
        return [(r["index"], r["filename"], bytes(r["bytes"])) for r in spark.read.parquet(table).orderBy("index").collect()]

    (where / "2024-02.txt").write_text("february")
    want = [(0, "2024-02.txt", b"february")]
    assert run() == want
    (where / "2024-01.txt").write_text("january")  # sorts before what was read
    (where / "2024-02.txt").unlink()  # one that was read may go
    want.append((1, "2024-01.txt", b"january"))
    assert run() == want and run() == want
    (where / "a-feed.txt").write_text("other")
    (where / "2024-01.txt").write_text("january, again")
    os.utime(where / "2024-01.txt", ns=(1, 1))
    assert run() == [*want, (2, "2024-01.txt", b"january, again"), (3, "a-feed.txt", b"other")]


def test_stream_log_of_arrivals(tmp_path):
    where = tmp_path / "in"
    for folder_name in ("x", "y"):
        (where / folder_name).mkdir(parents=True)
        (where / folder_name / "a.txt").write_text(folder_name)
    options = {"path": str(where / "*" / "*.txt")}
    one, two = (records.RecordStreamReader(options, "txt") for _ in range(2))
    zero, first = one.initialOffset(), one.latestOffset()
    assert two.latestOffset() == one.latestOffset() == first  # both go by one log, and nothing is new
    assert sorted((os.path.relpath(p.path, where), p.part) for p in two.partitions(zero, first)) == [("x/a.txt", 0), ("y/a.txt", 1)]
    (where / "x" / "0.txt").write_text("0")
    second = two.latestOffset()
    assert [os.path.basename(p.path) for p in one.partitions(first, second)] == ["0.txt"] and one.latestOffset() == second
    (where / "x" / "0.txt").unlink()
    with pytest.raises(IoError, match="gone"):
        one.partitions(first, second)
    with pytest.raises(InvalidConfiguration, match="earlier version"):
        one.partitions({"file": "a.txt"}, second)
    with pytest.raises(InvalidConfiguration, match="log of arrivals"):
        one.partitions(first, second | {"log": "other"})


def test_numbers_follow_the_order_at_any_partitioning(spark):
    df = spark.createDataFrame([((k * 7919) % 5003,) for k in range(5003)], "k int").repartition(7)
    for n in ("3", "50"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = records.numbered_by(df, "k", first=5).collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted((r["k"], r["index"]) for r in rows) == [(k, k + 5) for k in range(5003)]
