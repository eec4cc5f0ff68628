"""Queries of text quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import xml_elements
from ..session import map_arrow
from ..tables import load, records_with_form
from . import quality


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """index, text: whole texts, and abstracts of articles; ill-formed articles and those without an abstract are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if f == "txt":
                    out.append(b.decode("utf-8-sig", "replace"))
                else:
                    parts = xml_elements(b, ("abstract",))
                    out.append("\n".join(t for _, t in parts) if parts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["index", "text"])

    records = records_with_form(spark, folder, F.expr("form = 'txt' or form = 'xml' and record_element = 'article'"))
    return map_arrow(records.select("index", "bytes", "form"), read, "index bigint, text string").where("text is not null")


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Every statistic of every text, its kind, and the reasons for which it fails the published rules."""
    return quality.kinds(quality.statistics(_texts(spark, folder)))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that fail published rules and are named otherwise than prose."""
    return statistics(spark, folder).where("size(reasons) > 0 and kind <> 'prose'").select("index", "kind")


def reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of each kind fail each rule."""
    return statistics(spark, folder).select("kind", F.explode_outer("reasons").alias("reason")).groupBy("kind", "reason").agg(F.count("*").alias("texts"))


def preview_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Words, common words and lines of the abstracts as they stand in previews."""
    one = load(spark, folder, "previews").where("index is not null and elements is not null").groupBy("index").agg(F.min("elements").alias("elements"))
    texts = one.select("index", F.expr("filter(elements, e -> e.name = 'abstract' and e.text is not null).text").alias("texts")).where("size(texts) > 0").select("index", F.array_join("texts", "\n").alias("text"))
    return quality.statistics(texts).select("index", "words", "lines", F.round("mean_word", 6).alias("mean_word"))


QUERIES = {"p4_found": found, "p4_statistics": statistics, "p4_reasons": reasons, "p4_previews": preview_sizes}
_CLEAN = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '<[/!]?[A-Za-z][^<>]*>|\\(?:begin|end)\{[a-z*]+\}(?:\{[^{}]*\})?|\\(?:item|textbf|textit|emph|section|subsection|cite|ref|label)\b|&[a-z]+;', ' ', 'g')"
SQL = {
    "p4_previews": rf"""
with one as (select index, min(elements) as elements from previews where index is not null and elements is not null group by index),
own as (select index, list_filter(elements, lambda e: e.name = 'abstract' and e.text is not null) as found from one),
texts as (select index, array_to_string(list_transform(found, lambda e: e.text), chr(10)) as text from own where len(found) > 0),
cleaned as (select index, {_CLEAN} as t from texts where text is not null),
counted as (select index, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) as words, len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x, ' ')) > 0)) as lines,
  len(regexp_extract_all(t, '\p{{L}}')) + len(regexp_extract_all(t, '\p{{N}}')) as signs from cleaned)
select index, words, lines, round(case when words > 0 then signs / words else 0 end, 6) as mean_word from counted"""
}
