"""Queries of the record engine over the given tables, and the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PreviewConfig, TextConfig, XmlConfig
from ..functions import evidence, matching, preview, textsplit
from ..operators.engine import MAX_INDEX, RecordEngine, record_bytes
from ..sources import folder, records
from ..tables import distinct_by, load


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """index, bytes, text, doc_id of documents in order of doc_id: a table that is kept while the application runs and the file is as it was."""
    own = load(spark, path, "documents")
    changed = own.agg(F.max("_metadata.file_modification_time"), F.max("_metadata.file_size")).first()  # of the files alone
    known = spark.sparkContext.__dict__.setdefault("_corpusloom_numbered", {})
    if known.get(path, (None,))[0] != changed:
        known[path] = changed, records.kept(own.where("text is not null and doc_id is not null").select("doc_id", "text"), "doc_id")
    return known[path][1].withColumn("bytes", F.col("text").cast("binary"))


def _engine(spark: SparkSession, path: str) -> RecordEngine:
    return RecordEngine(_numbered(spark, path).select("index", "bytes"), "txt", spark)


def find_word(spark: SparkSession, path: str) -> DataFrame:
    return _engine(spark, path).find("la")


def find_phrase(spark: SparkSession, path: str) -> DataFrame:
    return _engine(spark, path).find(" Once was, and ")


def find_first(spark: SparkSession, path: str) -> DataFrame:
    return _engine(spark, path).find("museum", 7)


def find_limit_zero(spark: SparkSession, path: str) -> DataFrame:
    return _engine(spark, path).find("museum", 0)


def find_blank(spark: SparkSession, path: str) -> DataFrame:
    return _engine(spark, path).find("   ")


def get_record(spark: SparkSession, path: str) -> DataFrame:
    """Single records by index, and one past the end."""
    engine = _engine(spark, path)
    found = [(i, engine.get(i)) for i in (0, 7, 100, MAX_INDEX)]
    return spark.createDataFrame([(i, None if r is None else r.text, None if r is None else len(r)) for i, r in found], "index bigint, text string, n_bytes bigint")


def list_range(spark: SparkSession, path: str) -> DataFrame:
    return _engine(spark, path).list(50, 90).select("index", F.octet_length("bytes").alias("n_bytes"))


def record_stats(spark: SparkSession, path: str) -> DataFrame:
    """Records, bytes and empty records by corpus, each index once."""
    own = load(spark, path, "records").where("bytes is not null").select("index", "corpus", record_bytes("bytes").alias("n")).distinct()
    return own.groupBy("corpus").agg(F.count("*").alias("records"), F.sum("n").alias("bytes"), F.max("n").alias("largest"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"))


def text_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    own = load(spark, path, "documents").where("text is not null")
    return own.select("doc_id", F.posexplode(textsplit.paragraphs_column("text")).alias("n", "paragraph"))


def text_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs cut at 300 bytes."""
    own = load(spark, path, "documents").where("text is not null").select("doc_id", F.posexplode(textsplit.paragraphs_column("text")).alias("n", "p"))
    return own.select("doc_id", "n", F.posexplode(textsplit.chunks_column("p", 300)).alias("k", "chunk"))


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """All text records of all documents, numbered over them."""
    own = load(spark, path, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    rows = records.scan_column(own, "doc_id", "data", TextConfig(1024))
    return records.numbered(rows, ("doc_id",)).select("index", "doc_id", F.octet_length("bytes").cast("bigint").alias("n_bytes"))


def _escaped(c: Column) -> Column:
    c = c.cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _customers(spark: SparkSession, path: str) -> DataFrame:
    """c_nationkey, local, bytes: customers written as one XML text per nation, and read from it."""
    c = load(spark, path, "customer")
    one = F.concat(F.lit("<customer>"), _element("c_custkey", F.col("c_custkey").cast("string")), _element("c_name", _escaped(F.col("c_name"))), _element("c_mktsegment", _escaped(F.col("c_mktsegment"))), F.lit("<note/></customer>"))
    texts = c.select("c_nationkey", "c_custkey", one.alias("x")).groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "x"))), lambda s: s["x"]), "\n").alias("x"))
    whole = texts.select("c_nationkey", F.concat(F.lit("<?xml version='1.0'?><nation><!-- <customer> --><customer/>"), "x", F.lit("</nation>")).alias("data"))
    return records.scan_column(whole, "c_nationkey", "data", XmlConfig("customer"))


def xml_records(spark: SparkSession, path: str) -> DataFrame:
    return _customers(spark, path).groupBy("c_nationkey").agg(F.count("*").alias("records"), F.max("local").alias("last"))


def xml_decode(spark: SparkSession, path: str) -> DataFrame:
    """Customers read from XML with a schema."""
    rows = records.numbered(_customers(spark, path), ("c_nationkey",))
    return RecordEngine(rows.select("index", "bytes"), "xml", spark).decode("c_custkey bigint, c_name string, c_mktsegment string").select("value.*")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """index, bytes: parts as XML records."""
    p = load(spark, path, "part")
    body = F.concat(
        F.lit("<part id='1'>root text"), _element("brand", F.concat(_element("b", _escaped(F.col("p_brand"))), F.lit("x"))), F.lit("<empty/>"), _element("title", _escaped(F.col("p_name"))), _element("type", _escaped(F.col("p_type"))), F.lit("</part>")
    )
    return p.select(F.col("p_partkey").alias("index"), body.cast("binary").alias("bytes"))


def preview_xml(spark: SparkSession, path: str) -> DataFrame:
    """Previews that stop at the title."""
    own = preview.previews(_parts(spark, path), PreviewConfig(), "xml")
    return own.select("index", F.posexplode("elements").alias("n", "e")).select("index", "n", "e.name", "e.text")


def preview_entities(spark: SparkSession, path: str) -> DataFrame:
    """References add nothing to a preview."""
    own = load(spark, path, "documents").where("text is not null").select(F.col("doc_id").alias("index"), F.concat(F.lit("<d><t>"), _escaped(F.col("text")), F.lit("</t></d>")).cast("binary").alias("bytes"))
    found = preview.previews(own, PreviewConfig.new(4096, 10), "xml")
    return found.select(F.col("index").alias("doc_id"), F.md5(F.get("elements", F.lit(0))["text"]).alias("digest"))


def preview_text(spark: SparkSession, path: str) -> DataFrame:
    own = load(spark, path, "documents").where("text is not null").select(F.col("doc_id").alias("index"), F.col("text").cast("binary").alias("bytes"))
    found = preview.previews(own, PreviewConfig(target_bytes=101), "txt")
    return found.select(F.col("index").alias("doc_id"), F.get("elements", F.lit(0))["text"].alias("text"))


def _previews(spark: SparkSession, path: str) -> DataFrame:
    own = load(spark, path, "previews").where("index is not null and elements is not null")
    filled = F.transform("elements", lambda e: F.struct(F.coalesce(e["name"], F.lit("")).alias("name"), F.coalesce(e["text"], F.lit("")).alias("text")))
    return distinct_by(own.select("index", filled.alias("elements")), "index", ["elements"])


def search_previews(spark: SparkSession, path: str) -> DataFrame:
    """Indexes of given previews that hold a phrase."""
    return RecordEngine.over_previews(_previews(spark, path)).search_preview_indexes("the museum")


def spot_previews(spark: SparkSession, path: str) -> DataFrame:
    """The first five of them as text."""
    hits = RecordEngine.over_previews(_previews(spark, path)).search_previews("the museum", 5)
    return hits.select("index", preview.formatted(F.col("elements")).alias("preview"))


def preview_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _previews(spark, path).select("index", preview.retained_bytes(F.col("elements")).cast("bigint").alias("n_bytes"), F.size("elements").cast("bigint").alias("n_elements"))


def preview_contains(spark: SparkSession, path: str) -> DataFrame:
    return _previews(spark, path).where(preview.contains_text(F.col("elements"), "oun")).select("index")


def preview_at(spark: SparkSession, path: str) -> DataFrame:
    """Single previews of at most 50 bytes by index, and one past the end."""
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=50))
    before = engine.preview_at(0)
    engine.prep()
    found = [(-1, before), *((i, engine.preview_at(i)) for i in (0, 7, 100, MAX_INDEX))]
    return spark.createDataFrame([(i, None if p is None else p[0][0], None if p is None else p[0][1]) for i, p in found], "index bigint, name string, text string")


def preview_sample(spark: SparkSession, path: str) -> DataFrame:
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=50))
    engine.prep()
    return engine.preview_sample().select("index", F.element_at("elements", 1)["text"].alias("text"))


def search_engine(spark: SparkSession, path: str) -> DataFrame:
    """The first seven previews of at most 200 bytes that hold a word."""
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=200))
    engine.prep()
    return engine.search_previews("museum", 7).select("index", preview.formatted(F.col("elements")).alias("preview"))


def find_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Where a word stands: in previews once they are prepared, and in whole records by mode."""
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=200))
    before = engine.find("museum").withColumn("at", F.lit("unprepared"))
    engine.prep()
    return before.unionByName(engine.find("museum").withColumn("at", F.lit("prepared"))).unionByName(engine.find("museum", mode="records").withColumn("at", F.lit("records")))


def engine_life(spark: SparkSession, path: str) -> DataFrame:
    """What the engine says of itself before previews are prepared, then, and when they are cleared."""
    engine = _engine(spark, path)
    told: list[int] = []
    rows = [("interval", engine.checkpoint_interval), ("prepared before", int(engine.is_prepared)), ("count before", engine.prepared_preview_count)]
    rows += [("records", engine.count()), ("prep", engine.with_checkpoint_interval(7).prep(told.append)), ("told last", told[-1]), ("told in order", int(told == sorted(told)))]
    rows += [("interval after", engine.checkpoint_interval), ("prepared", int(engine.is_prepared)), ("count", engine.prepared_preview_count), ("previews", engine.previews().count()), ("text checkpoints", engine.checkpoints().count())]
    engine.clear_previews()
    rows += [("cleared", int(engine.is_prepared)), ("count cleared", engine.prepared_preview_count), ("children", engine.preview_config.max_children)]
    return spark.createDataFrame(rows, "name string, value bigint")


def broken_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Records of invalid UTF-8: as they are shown, and found by what follows the broken byte."""
    rows = _numbered(spark, path).select("index", F.concat(F.lit(b"\xffmuseum\xc3 "), "bytes").alias("bytes"))
    engine = RecordEngine(rows, "txt", spark)
    return engine.find("museum\ufffd", 5).withColumn("text", F.lit(engine.get(3).text[:9]))


def get_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of at most 40 bytes from single records, and from one past the end."""
    engine = _engine(spark, path)
    found = [(i, engine.get_fragment(i, "the", 40)) for i in (0, 1, 2, 3, 50, 100, MAX_INDEX)]
    return spark.createDataFrame(found, "index bigint, record string")


def evidence_xml_window(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of at most 24 bytes from XML records."""
    engine = RecordEngine(_parts(spark, path), "xml", spark)
    return engine.fragments("text brand", 24).where("record is not null").select("index", "record")


def search_to_windows(spark: SparkSession, path: str) -> DataFrame:
    """The first twenty previews of at most 300 bytes that hold the word, and at most 60 bytes of evidence of each."""
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=300))
    engine.prep()
    return engine.search_to_get_fragment("museum", 20, 60)


def evidence_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts as evidence: the budget exceeds them."""
    found = evidence.fragments(_numbered(spark, path).select("index", "bytes"), "once-was", 1 << 24, "txt")
    return found.where("record is not null").select("index", F.md5("record").alias("digest"))


def evidence_window(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of at most 80 bytes from every document that has the words."""
    found = evidence.fragments(_numbered(spark, path).select("index", "bytes"), "once was", 80, "txt")
    return found.where("record is not null").select("index", "record")


def evidence_xml(spark: SparkSession, path: str) -> DataFrame:
    """The clean text of XML records."""
    return evidence.cleaned(_parts(spark, path))


def search_to_fragment(spark: SparkSession, path: str) -> DataFrame:
    """The first five previews that hold the word, and their evidence."""
    engine = _engine(spark, path).with_preview_config(PreviewConfig(target_bytes=1 << 24))
    engine.prep()
    return engine.search_to_get_fragment("harbour", 5, 1 << 24).select("index", F.md5("record").alias("digest"))


def _with_blocks(change: Callable[[Column], Column] = lambda c: c) -> Column:
    """The whole text with blocks set in, and references that are to be cut off."""
    return F.concat(F.lit(" {{Infobox}}"), change(F.substring("text", 1, 40)), F.lit("{{a|b}}{{c}}"), change(F.expr("substring(text, 41)")), F.lit(" == References == gone"))


def clean_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts with blocks set in beside their own, cleaned by built-in functions."""
    own = load(spark, path, "documents").where("text is not null")
    return own.select("doc_id", evidence.clean_wiki_column(_with_blocks()).alias("text"))


def clean_pages(spark: SparkSession, path: str) -> DataFrame:
    """The clean text of page records that hold such whole texts with preserved space."""
    body = F.concat(F.lit("<page><title>gone</title><revision><id>1</id><text xml:space='preserve'>"), _with_blocks(_escaped), F.lit("</text></revision></page>"))
    own = load(spark, path, "documents").where("text is not null and doc_id is not null")
    return evidence.cleaned(own.select(F.col("doc_id").alias("index"), body.cast("binary").alias("bytes")))


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """Words of letters, digits and underscores in every document: how many, where the last one ends, and all of them as they are compared."""
    own = matching.word_ranges_of(load(spark, path, "documents").where("text is not null"), "doc_id", "text")
    return own.select("doc_id", F.size("words").cast("bigint").alias("words"), F.md5(F.array_join("words.word", " ").cast("binary")).alias("digest"))


def file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """First and last index of every file."""
    own = load(spark, path, "records").where("bytes is not null and filename is not null")
    return folder.file_ranges(own).select(F.col("start").alias("start_index"), F.col("end").alias("end_index"), "filename")


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Byte positions after every hundredth record, each record followed by two bytes."""
    own = distinct_by(load(spark, path, "records").where("bytes is not null").select("index", F.col("bytes")), "index", ["bytes"])
    return folder.checkpoints(own, 100)


def file_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """For every file the checkpoint from which its middle record is reached."""
    ranges = load(spark, path, "file_ranges").select("filename", F.expr("(start_index + end_index) div 2").alias("wanted")).distinct()
    points = load(spark, path, "checkpoints").where("position is not null").select("filename", "index", "position").distinct()
    joined = ranges.join(points, "filename").where(F.col("index") <= F.col("wanted"))
    return joined.groupBy("filename", "wanted").agg(F.max("index").alias("index"), F.max_by("position", "index").alias("position"))


QUERIES = {
    f.__name__: f
    for f in (
        find_word, find_phrase, find_first, find_limit_zero, find_blank, get_record, list_range, record_stats, text_paragraphs, text_chunks, text_records, xml_records, xml_decode, preview_xml, preview_entities,
        preview_text, preview_at, preview_sample, search_engine, find_prepared, engine_life, broken_bytes, get_fragments, evidence_xml_window, search_to_windows, search_previews, spot_previews, preview_sizes, preview_contains, evidence_text, evidence_window, evidence_xml, search_to_fragment, clean_documents, clean_pages, word_counts, file_ranges, checkpoints, file_checkpoints,
    )
}

_NUMBERED = "(select row_number() over (order by doc_id) - 1 as index, text, doc_id from documents where text is not null)"


def _has(text: str, words: str) -> str:
    return rf"regexp_matches(lower({text}), '(^|[^\p{{L}}\p{{N}}_]){words}($|[^\p{{L}}\p{{N}}_])')"


_PREVIEWS = "(select index, min(list_transform(elements, lambda e: {'name': coalesce(e.name, ''), 'text': coalesce(e.text, '')})) as elements from previews where index is not null and elements is not null group by index)"
_HIT = rf"len(list_filter(elements, lambda e: {_has('e.text', 'the museum')})) > 0"
_PARAGRAPHS = r"(select doc_id, unnest(p) as paragraph, unnest(range(len(p))) as n from (select doc_id, regexp_extract_all(text, '(?:[^\n]*\S[^\n]*(?:\n|$))+') as p from documents where text is not null))"
_CHUNKS = r"""(
with recursive tokens as (
  select doc_id, n, k, token, sum(strlen(token)) over (partition by doc_id, n order by k) as stop from (
    select doc_id, n, unnest(t) as token, unnest(range(len(t))) as k from (
      select doc_id, n, regexp_extract_all(paragraph, '[^\s\x0b\x{85}\p{Z}]*[\s\x0b\x{85}\p{Z}]|[^\s\x0b\x{85}\p{Z}]+$') as t from PARAGRAPHS))),
cuts as (
  select doc_id, n, -1 as k, 0 as start, 0 as stop, max(stop) as whole from tokens group by doc_id, n
  union all
  select doc_id, n, k, start, stop, whole from (
    select c.doc_id, c.n, c.k + 1 as k, c.stop as start, c.whole,
      case when c.whole - c.stop <= TARGET then c.whole else coalesce(max(t.stop) filter (t.stop <= c.stop + TARGET), min(t.stop)) end as stop
    from cuts c join tokens t on t.doc_id = c.doc_id and t.n = c.n and t.stop > c.stop group by c.doc_id, c.n, c.k, c.stop, c.whole))
select c.doc_id, c.n, c.k, string_agg(t.token, '' order by t.k) as chunk
from cuts c join tokens t on t.doc_id = c.doc_id and t.n = c.n and t.stop > c.start and t.stop <= c.stop where c.k >= 0 group by all)"""
_CHUNKS = _CHUNKS.replace("PARAGRAPHS", _PARAGRAPHS)
_MUSEUM = "museum"
_PART_TEXT = "'root text ' || p_brand || ' x ' || p_name || ' ' || p_type"
_BLOCKS = "' {{Infobox}}' || substr(text, 1, 40) || '{{a|b}}{{c}}' || substr(text, 41) || ' == References == gone'"


def _cleaned(text: str) -> str:
    cut = rf"regexp_replace(split_part(replace({text}, '\n', ''), '== References ==', 1), '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"
    marked = rf"regexp_replace({cut}, '\{{\{{.*?\}}\}}', chr(57344), 'gs')"
    return rf"replace(regexp_replace({marked}, '([^\s\x0b\x{{85}}\p{{Z}}\x{{e000}}])\x{{e000}}+', '\1 ', 'g'), chr(57344), '')"




def _prefix(size: int, text: str = "text") -> str:
    return f"left({text}, list_max(list_filter(range(0, {size} + 1), lambda k: strlen(left({text}, k)) <= {size})))"


def _windows(rows: str, words: list[str], budget: int) -> str:
    """index, record: the window about the first match of words in (index, text), grown by a token on each side in turn."""
    pattern = r"[^\p{L}\p{N}_]+".join(f"(?i:{w})" for w in words)
    return rf"""(
with recursive hits as (
  select index, regexp_extract(text, '^((?s:.*?)(?:^|[^\p{{L}}\p{{N}}_]))({pattern})((?:$|[^\p{{L}}\p{{N}}_])(?s:.*))$', ['before', 'hit', 'after']) as m
  from {rows} where regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_]){pattern}($|[^\p{{L}}\p{{N}}_])')),
sides as (
  select index, m.hit as hit, list_reverse(regexp_extract_all(m.before, '^\s+|\S+\s*')) as l, regexp_extract_all(m.after, '\s*\S+|\s+$') as r from hits),
grown as (
  select index, 0 as a, 0 as b, strlen(hit) as n, false as over, hit, l, r from sides where strlen(hit) <= {budget}
  union all
  select index, a2 as a, case when fits then b + 1 else b end as b, case when fits then n2 + strlen(r[b + 1]) else n2 end as n, a2 = a and not fits as over, hit, l, r from (
    select *, len(r) > b and n2 + strlen(r[b + 1]) <= {budget} as fits from (
      select *, case when left_fits then a + 1 else a end as a2, case when left_fits then n + strlen(l[a + 1]) else n end as n2 from (
        select *, len(l) > a and n + strlen(l[a + 1]) <= {budget} as left_fits from grown where not over))))
select index, array_to_string(list_reverse(l[1:a]), '') || hit || array_to_string(r[1:b], '') as record from grown where over)"""


SQL = {
    "find_word": f"select index from {_NUMBERED} where {_has('text', 'la')}",
    "find_phrase": f"select index from {_NUMBERED} where {_has('text', 'once was, and')}",
    "find_first": f"select index from {_NUMBERED} where {_has('text', 'museum')} order by index limit 7",
    "find_limit_zero": f"select index from {_NUMBERED} where {_has('text', 'museum')} order by index limit 1",
    "find_blank": f"select index from {_NUMBERED} where false",
    "get_record": f"select i.index, text, strlen(text) as n_bytes from (select unnest([0, 7, 100, 9223372036854775807]) as index) i left join {_NUMBERED} d on d.index = i.index",
    "list_range": f"select index, strlen(text)::int as n_bytes from {_NUMBERED} where index >= 50 and index < 90",
    "record_stats": "select corpus, count(*) as records, sum(n)::bigint as bytes, max(n)::bigint as largest, count(*) filter (n = 0) as empty from (select distinct index, corpus, octet_length(bytes) as n from records where bytes is not null) group by corpus",
    "text_paragraphs": f"select doc_id, n::int as n, paragraph from {_PARAGRAPHS}",
    "text_chunks": f"select doc_id, n::int as n, k::int as k, chunk from {_CHUNKS.replace('TARGET', '300')}",
    "text_records": f"select row_number() over (order by doc_id, n, k) - 1 as index, doc_id, strlen(chunk)::bigint as n_bytes from {_CHUNKS.replace('TARGET', '1024')}",
    "xml_records": "select c_nationkey, count(*) as records, count(*) - 1 as last from customer group by c_nationkey",
    "xml_decode": "select c_custkey, c_name, c_mktsegment from customer",
    "preview_xml": "select p_partkey as index, unnest([0, 1, 2])::int as n, unnest(['brand', 'empty', 'title']) as name, unnest([p_brand || 'x', '', p_name]) as text from part",
    "preview_entities": "select doc_id, md5(replace(replace(replace(text, '&', ''), '<', ''), '>', '')) as digest from documents where text is not null",
    "preview_text": "select doc_id, left(text, list_max(list_filter(range(0, 102), lambda k: strlen(left(text, k)) <= 101))) as text from documents where text is not null",
    "search_previews": f"select index from {_PREVIEWS} where {_HIT}",
    "spot_previews": f"select index, array_to_string(list_transform(elements, lambda e: '<' || e.name || '>: ' || e.text), chr(10)) as preview from {_PREVIEWS} where {_HIT} order by index limit 5",
    "preview_sizes": f"select index, coalesce(list_sum(list_transform(elements, lambda e: strlen(e.name) + strlen(e.text))), 0)::bigint as n_bytes, len(elements) as n_elements from {_PREVIEWS}",
    "preview_contains": f"select index from {_PREVIEWS} where len(list_filter(elements, lambda e: contains(e.text, 'oun'))) > 0",
    "evidence_text": rf"select index, md5(text) as digest from {_NUMBERED} where regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])(?i:once)[^\p{{L}}\p{{N}}_]+(?i:was)($|[^\p{{L}}\p{{N}}_])')",
    "evidence_window": f"select index, record from {_windows(_NUMBERED, ['once', 'was'], 80)}",
    "get_fragments": f"select i.index, record from (select unnest([0, 1, 2, 3, 50, 100, 9223372036854775807]) as index) i left join {_windows(f'(select * from {_NUMBERED} where index in (0, 1, 2, 3, 50, 100))', ['the'], 40)} w on w.index = i.index",
    "evidence_xml_window": f"select index, record from {_windows(f'(select p_partkey as index, {_PART_TEXT} as text from part)', ['text', 'brand'], 24)}",
    "search_to_windows": f"select w.index, record from {_windows(f'(select * from {_NUMBERED} where {_has(_prefix(300), _MUSEUM)} order by index limit 20)', ['museum'], 60)} w",
    "preview_at": f"select i.index, case when text is not null then 'text' end as name, {_prefix(50)} as text from (select unnest([-1, 0, 7, 100, 9223372036854775807]) as index) i left join {_NUMBERED} d on d.index = i.index",
    "preview_sample": f"select index, {_prefix(50)} as text from {_NUMBERED} where index < 3",
    "search_engine": f"select index, '<text>: ' || {_prefix(200)} as preview from {_NUMBERED} where {_has(_prefix(200), 'museum')} order by index limit 7",
    "find_prepared": f"select index, unnest(case when {_has(_prefix(200), 'museum')} then ['unprepared', 'prepared', 'records'] else ['unprepared', 'records'] end) as at from {_NUMBERED} where {_has('text', 'museum')}",
    "engine_life": f"""
with n as (select count(*) as n from {_NUMBERED})
select unnest(['interval', 'prepared before', 'count before', 'records', 'prep', 'told last', 'told in order', 'interval after', 'prepared', 'count', 'previews', 'text checkpoints', 'cleared', 'count cleared', 'children']) as name,
  unnest([100, 0, 0, n, n, n, 1, 7, 1, n, n, 0, 0, 0, 10]) as value from n""",
    "broken_bytes": f"select index, chr(65533) || 'museum' || chr(65533) || ' ' as text from {_NUMBERED} order by index limit 5",
    "evidence_xml": f"select p_partkey as index, {_PART_TEXT} as text from part",
    "search_to_fragment": f"select index, md5(text) as digest from {_NUMBERED} where {_has('text', 'harbour')} order by index limit 5",
    "clean_documents": f"select doc_id, {_cleaned(_BLOCKS)} as text from documents where text is not null",
    "clean_pages": "select doc_id as index, " + _cleaned(rf"regexp_replace(regexp_replace({_BLOCKS}, '[&<>]+([^\s\x0b\x{{85}}\p{{Z}}&<>])', ' \1', 'g'), '[&<>]+', '', 'g')") + " as text from documents where text is not null and doc_id is not null",
    "word_counts": r"select doc_id, len(w) as words, md5(array_to_string(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ')) as digest from (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') as w from documents where text is not null)",
    "file_ranges": "select min(index) as start_index, max(index) as end_index, filename from records where bytes is not null and filename is not null group by filename",
    "checkpoints": "select index + 1 as index, position::bigint as position from (select index, sum(n + 2) over (order by index) as position from (select index, octet_length(min(bytes)) as n from records where bytes is not null group by index)) where (index + 1) % 100 = 0",
    "file_checkpoints": "select filename, wanted, max(index) as index, arg_max(position, index) as position from (select distinct filename, (start_index + end_index) // 2 as wanted from file_ranges) join (select distinct filename, index, position from checkpoints where position is not null) using (filename) where index <= wanted group by filename, wanted",
}
