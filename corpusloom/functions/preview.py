"""Previews: the first children of an XML record, or the beginning of a text, as named texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PreviewConfig
from ..errors import InvalidConfiguration, RecordError, XmlError
from ..session import map_arrow
from .xmltok import CDATA, EMPTY, END, START, TEXT, tokens_of

ELEMENTS = "array<struct<name string, text string>>"
_ELEMENTS = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))


def xml_preview(data: bytes, config: PreviewConfig) -> list[tuple[str, str]]:
    """Name and text of the root's children, until the target, the stop element or the number of children is reached.

    A child's text is all text and CDATA within it, joined as it stands; references add nothing.
    """
    out: list[tuple[str, str]] = []
    depth = kept = 0
    parts: list[bytes] = []

    def full(name: str, text: str) -> bool:
        nonlocal kept
        out.append((name, text))
        kept += len(name.encode()) + len(text.encode())
        return kept >= config.target_bytes or name == config.stop_element or len(out) >= config.max_children

    for kind, name, _, _ in tokens_of(data):
        if kind == START:
            depth += 1
            if depth == 2:
                parts = []
        elif kind == END:
            depth -= 1
            if depth == 1 and full(name.decode("utf-8", "replace"), b"".join(parts).decode("utf-8", "replace")):
                return out
        elif kind == EMPTY:
            if depth == 1 and full(name.decode("utf-8", "replace"), ""):
                return out
        elif depth >= 2 and kind in (TEXT, CDATA):
            parts.append(name)
    if depth >= 2:
        raise InvalidConfiguration("unexpected end of input while building record preview")
    return out


def text_prefix(text: str, target: int) -> str:
    """The longest prefix of whole characters within ``target`` bytes."""
    return text.encode()[:target].decode("utf-8", "ignore") if len(text) * 4 > target else text


def previews(records: DataFrame, config: PreviewConfig, form: str, done: Accumulator | None = None) -> DataFrame:
    """index, elements, error of (index, bytes); error is the kind and message, or null. ``done`` counts the records."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, errors = [], []
            for b in batch.column(1).to_pylist():
                try:
                    if form == "xml":
                        found = xml_preview(b, config)
                    else:
                        found = [("text", text_prefix(b.decode("utf-8", "replace"), config.target_bytes))]
                    elements.append([{"name": n, "text": t} for n, t in found])
                    errors.append(None)
                except RecordError as e:
                    elements.append(None)
                    errors.append(f"{'xml' if isinstance(e, XmlError) else 'invalid'}:{e.args[0]}")
            if done is not None:
                done.add(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(elements, _ELEMENTS), pa.array(errors, pa.string())], names=["index", "elements", "error"])

    return map_arrow(records.where("bytes is not null").select(F.col("index").cast("bigint"), "bytes"), build, f"index bigint, elements {ELEMENTS}, error string")


def retained_bytes(elements: Column) -> Column:
    return F.aggregate(elements, F.lit(0), lambda n, e: n + F.octet_length(e["name"]) + F.octet_length(e["text"]))


def formatted(elements: Column) -> Column:
    """``<name>: text``, a line for each element."""
    return F.array_join(F.transform(elements, lambda e: F.concat(F.lit("<"), e["name"], F.lit(">: "), e["text"])), "\n")


def contains_text(elements: Column, part: str) -> Column:
    return F.exists(elements, lambda e: F.contains(e["text"], F.lit(part)))
