"""Texts of records as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import record_text
from ..session import map_arrow


def record_texts(records: DataFrame, index: str = "index", data: str = "bytes", form: str = "form") -> DataFrame:
    """index, text of each record; null and ill-formed ones give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [record_text(b, f) for b, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["index", "text"])

    chosen = records.select(F.col(index).cast("bigint").alias("index"), F.col(data).cast("binary").alias("bytes"), F.col(form).alias("form"))
    return map_arrow(chosen.where("index is not null and bytes is not null"), read, "index bigint, text string").where("text is not null")
