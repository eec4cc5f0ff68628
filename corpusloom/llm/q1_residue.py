"""Queries of markup residue."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import xml_elements
from ..session import map_arrow
from ..tables import load, once, placed, records_with_form, spread
from . import residue

#: Elements whose text is looked at, by record element.
ELEMENTS = {"page": ("text",), "article": ("title", "abstract")}


def _record_items(records: DataFrame) -> DataFrame:
    """src, item_id, host (corpus), text of form txt, page and article records; ill-formed ones are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, f, e in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if f == "txt":
                    out.append(b.decode("utf-8", "replace"))
                else:
                    parts = xml_elements(b, ELEMENTS[e])
                    out.append(None if parts is None else "\n\n".join(t for _, t in parts))
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(["records"] * n), batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["src", "item_id", "host", "text"])

    return map_arrow(records.select("index", "corpus", "bytes", "form", "record_element"), read, "src string, item_id bigint, host string, text string").where("text is not null")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return _record_items(records_with_form(spark, folder, F.expr("form = 'txt' or form = 'xml' and record_element in ('page', 'article')")))


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    own = placed(load(spark, folder, "fragments")).where("fragment_id is not null and record is not null").select("fragment_id", "record", "_place")
    return spread(once(own, "fragment_id", "record"), "fragment_id").select(F.lit("fragments").alias("src"), F.col("fragment_id").alias("item_id"), F.lit(None).cast("string").alias("host"), F.col("record").alias("text"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).unionByName(_fragments(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every item; records lose their corpus's template."""
    return residue.cleaned(_items(spark, folder))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of markup of every item, in what is kept of it and in what is deleted as its host's template."""
    return residue.markup(_items(spark, folder)).select("src", "item_id", F.explode(F.array_union("kept", "template")).alias("markup"))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """The template subtrees of every corpus."""
    return residue.templates(residue.parsed(_records(spark, folder), texts=False))


QUERIES = {"p1_found": found, "p1_clean": clean, "p1_templates": templates}
