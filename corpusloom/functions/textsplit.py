"""Paragraphs of a text, and chunks of bounded bytes; white space is Unicode's."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The characters with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_TOKEN = re.compile(f"[^{WHITE_SPACE}]*[{WHITE_SPACE}]|[^{WHITE_SPACE}]+$")
JAVA_SPACE = r"\p{IsWhite_Space}"


def trim(text: str) -> str:
    return text.strip(WHITE_SPACE)


def chunks(paragraph: str, target: int) -> list[str]:
    """Pieces that join to the paragraph: each ends after the last white space within ``target`` bytes, else after the next one."""
    if len(paragraph) * 4 <= target or len(paragraph.encode()) <= target:
        return [paragraph]
    out, held, size = [], [], 0
    pieces = [(t, len(t.encode())) for t in _TOKEN.findall(paragraph)]
    left = sum(n for _, n in pieces)
    for text, n in pieces:
        # what is left goes whole into the last chunk where it fits
        if held and size + n > target and not size + left <= target:
            out.append("".join(held))
            held, size = [], 0
        held.append(text)
        size += n
        left -= n
    if held:
        out.append("".join(held))
    return out


def paragraphs(lines: Iterator[str]) -> Iterator[str]:
    """Runs of lines that aren't blank, with their line ends."""
    held: list[str] = []
    for line in lines:
        if trim(line):
            held.append(line)
        elif held:
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


def paragraphs_column(text: Column) -> Column:
    """The paragraphs of a text as an array, by built-in functions: cut after the line end before a blank line."""
    blank = rf"(?<=\n)(?:[{JAVA_SPACE}&&[^\n]]*\n)+(?:[{JAVA_SPACE}&&[^\n]]*\z)?|\A(?:[{JAVA_SPACE}&&[^\n]]*\n)+|(?<=\n)[{JAVA_SPACE}&&[^\n]]+\z"
    return F.filter(F.split(F.regexp_replace(text, blank, ""), ""), lambda p: p.rlike(rf"[^{JAVA_SPACE}]"))


def chunks_column(paragraph: Column, target: int) -> Column:
    @pandas_udf("array<string>")
    def cut(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else chunks(t, target))

    return cut(paragraph)
