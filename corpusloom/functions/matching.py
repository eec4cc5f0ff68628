"""The two whole-word matchers: A, a literal phrase as a column expression, and B, a sequence of words with byte offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .textsplit import trim

JAVA_WORD_CHARACTER = r"[\p{IsAlphabetic}\p{Nd}\p{Nl}\p{No}_]"
_WORD = re.compile(r"\w+")


def contains_whole_words(text: Column, query: str) -> Column:
    """Whether the lower-cased text holds the trimmed, lower-cased query with no word character beside it.

    Hits are taken from left to right without overlap. A query of white space alone matches nothing.
    """
    q = trim(query).lower()
    if not q:
        return F.lit(False)
    # splitting at the literal gives the same hits; hit i lies between parts i and i + 1
    literal = "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(F.lower(text), literal, -1)
    first, last = (bool(_WORD.fullmatch(c)) for c in (q[0], q[-1]))

    def inside(i: Column) -> Column:
        before, after = F.get(parts, i), F.get(parts, i + 1)
        left = F.when(before == "", (i > 0) & F.lit(last)).otherwise(before.rlike(JAVA_WORD_CHARACTER + r"\z"))
        right = F.when(after == "", (i + 2 < F.size(parts)) & F.lit(first)).otherwise(after.rlike(r"\A" + JAVA_WORD_CHARACTER))
        return ~left & ~right

    return F.coalesce((F.size(parts) > 1) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), inside), F.lit(False))


def contains_whole_words_py(text: str, query: str) -> bool:
    """The same for one text, for use beside the byte-level operators."""
    q, t = trim(query).lower(), text.lower()
    at = t.find(q) if q else -1
    while at >= 0:
        end = at + len(q)
        if not (at and _WORD.fullmatch(t[at - 1])) and not (end < len(t) and _WORD.fullmatch(t[end])):
            return True
        at = t.find(q, end)
    return False


def _fold(word: str) -> str:
    return word.lower() if word.isascii() else "".join(c.lower() if c.isascii() else c for c in word)


def word_ranges(text: str) -> list[tuple[int, int, str]]:
    """Maximal runs of letters, digits and underscores with their character offsets, folded as ASCII."""
    return [(m.start(), m.end(), _fold(m.group())) for m in _WORD.finditer(text)]


def word_ranges_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, words (array of start, end, word) of each text; null texts give no rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))
        for batch in batches:
            found = [[{"start": a, "end": z, "word": w} for a, z, w in word_ranges(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "words"])

    chosen = texts.select(key, text).where(F.col(text).isNotNull())
    return map_arrow(chosen, find, f"{key} {texts.schema[key].dataType.simpleString()}, words array<struct<start int, `end` int, word string>>")


def first_match(text: str, query: str) -> tuple[int, int] | None:
    """Where the query's words first stand one after another in the text, whatever is between."""
    wanted = [w for _, _, w in word_ranges(query)]
    if not wanted:
        return None
    have = word_ranges(text)
    n = len(wanted)
    for k in range(len(have) - n + 1):
        if have[k][2] == wanted[0] and all(have[k + j][2] == wanted[j] for j in range(1, n)):
            return have[k][0], have[k + n - 1][1]
    return None
