"""Splitting oversized texts at natural boundaries, with balanced targets.

For a text over its limit the number of pieces that its length calls for is computed, equally spaced targets are placed, each is moved to
the strongest boundary near it, and a piece is added whenever one would pass the limit. Moving costs pieces: a packer that fills each piece
to its last word may need fewer.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfiguration
from ..session import map_arrow

DEFAULT_LIMIT = 4096
#: White space is ASCII. Bytes are searched, so texts need not be valid UTF-8.
_SPACE = b" \t\n\r\f\v"
_PARAGRAPH = re.compile(rb"\n[ \t\r\f\v]*\n[ \t\n\r\f\v]*")
_SENTENCE = re.compile(rb"(?<=[.!?])[ \t\n\r\f\v]+")
_LINE = re.compile(rb"[ \t\f\v]*[\n\r][ \t\n\r\f\v]*")
_WORD = re.compile(rb"[ \t\n\r\f\v]+")
LEVELS = ("paragraph", "sentence", "word", "none")

SCHEMA = "index bigint, piece bigint, pieces bigint, start bigint, `end` bigint, overlap bigint, cut string, needed int, piece_bytes binary"
_ARROW = pa.schema([("index", pa.int64()), ("piece", pa.int64()), ("pieces", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("overlap", pa.int64()), ("cut", pa.string()), ("needed", pa.int32()), ("piece_bytes", pa.binary())])


class _Units:
    """The paragraphs, sentences and words of a text, by where they start and end without outer white space."""

    def __init__(self, data: bytes) -> None:
        paragraphs = self._stripped(data, self._between(data, _PARAGRAPH, 0, len(data)))
        parts = [self._between(data, pattern, a, b) for pattern in (_SENTENCE, _WORD) for a, b in paragraphs]
        self.levels = [paragraphs, [u for p in parts[: len(paragraphs)] for u in p], [u for p in parts[len(paragraphs) :] for u in p]]

    @staticmethod
    def _between(data: bytes, pattern: re.Pattern[bytes], start: int, end: int) -> list[tuple[int, int]]:
        gaps = [m.span() for m in pattern.finditer(data, start, end)]
        return list(zip([start, *(b for _, b in gaps)], [*(a for a, _ in gaps), end], strict=True))

    @staticmethod
    def _stripped(data: bytes, units: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for a, b in units:
            part = data[a:b]
            inner = part.strip(_SPACE)
            a += len(part) - len(part.lstrip(_SPACE))
            out.append((a, a + len(inner)))
        return out

    def needed(self, cut: int, limit: int) -> int:
        """The first level at which a cut here parts no unit but such as would not fit by themselves, as a number in ``LEVELS``."""
        for level, units in enumerate(self.levels):
            k = bisect_left(units, (cut, -1)) - 1  # the last unit that starts before the cut
            if k < 0 or cut >= units[k][1] or units[k][1] - units[k][0] <= limit:
                return level
        return len(self.levels)


def _cuts(data: bytes) -> list[list[int]]:
    """Places where a piece may begin, by strength: after paragraphs, sentences, lines, words."""
    return [[m.end() for m in pattern.finditer(data) if 0 < m.end() < len(data)] for pattern in (_PARAGRAPH, _SENTENCE, _LINE, _WORD)]


CUT_NAMES = ("paragraph", "sentence", "line", "word", "character")


def _character(data: bytes, at: int) -> int:
    """The start of the character that holds byte ``at``; of invalid runs at most three bytes are stepped over."""
    for back in range(4):
        if at - back <= 0 or data[at - back] & 0xC0 != 0x80:
            return max(at - back, 0)
    return at


def split(data: bytes, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, end, bytes shared with the piece before, kind of cut at its new text) of each piece, each at most ``limit`` bytes.

    Cuts lie as near to equal distances as boundaries allow: the strongest within a fifth of the spacing, else the nearest of any
    strength inside what the limit leaves, else a character's start. The overlap is ``overlap`` bytes, up to three more
    where that would part a character, and none where that would leave less than four bytes of new text.
    """
    n = len(data)
    if n <= limit:
        return [(0, n, 0, "start")]
    if limit < 1 or overlap < 0:
        raise InvalidConfiguration("the limit must be positive, the overlap not negative")
    if overlap and limit - overlap - 3 < 4:
        overlap = 0
    step = limit - overlap - 3 * bool(overlap)
    levels = _cuts(data)
    pieces, start, cut_at, kind = [], 0, 0, "start"
    left = max(2, -(-(n - limit) // step) + 1)  # as many pieces as the length calls for; one more is taken when a cut falls short
    while n - start > limit:
        least = max(2, -(-(n - start - limit) // step) + 1)
        left = max(left, least)
        most = start + limit
        target = min(cut_at + (n - cut_at) // left, most)
        reach = max((n - cut_at) // left // 5, 1)
        # a cut before ``floor`` would need a further piece
        floor = max(cut_at + 1, n - (left - 2) * step - limit + (overlap + 3 if overlap else 0)) if left > least else cut_at + 1
        low, high = max(floor, target - reach), min(most, target + reach)
        best = None
        for level, places in enumerate(levels):
            best = _nearest(places, target, low, high)
            if best is not None:
                break
        if best is None:
            for level, places in enumerate(levels):
                best = _nearest(places, target, max(floor, target - 2 * reach), most)
                if best is not None:
                    break
        if best is None:
            level = 3
            best = _nearest(levels[3], target, cut_at + 1, most)
        if best is None:
            level, best = 4, _character(data, most)
            if best <= cut_at:
                best = most
        pieces.append((start, best, cut_at - start, kind))
        kind, cut_at = CUT_NAMES[level], best
        start = _character(data, max(best - overlap, 0)) if overlap else best
        left = max(left - 1, 1)
    pieces.append((start, n, cut_at - start, kind))
    return pieces


def _nearest(places: list[int], target: int, low: int, high: int) -> int | None:
    a, b = bisect_left(places, low), bisect_right(places, high)
    if a >= b:
        return None
    k = bisect_left(places, target, a, b)
    if k == a:
        return places[a]
    return places[k - 1] if k == b or target - places[k - 1] <= places[k] - target else places[k]


def limit_of(limit: Column) -> Column:
    """A null or non-positive limit is the default."""
    return F.when(limit > 0, limit).otherwise(DEFAULT_LIMIT).cast("bigint")


def boundaries(pieces: DataFrame) -> DataFrame:
    """index, boundary of each record that was cut: the first of ``LEVELS`` at which every unit fits, read off its cuts."""
    deepest = pieces.where("needed is not null").groupBy("index").agg(F.max("needed").alias("_n"))
    return deepest.select("index", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_n") + 1).alias("boundary"))


def oversized_pieces(records: DataFrame, index: str = "index", data: str = "bytes", limit: str = "target_record_bytes", overlap: str = "overlap_bytes") -> DataFrame:
    """The pieces of each record whose bytes exceed its limit; others give no rows.

    index, piece (from 0), pieces, start, end (bytes), overlap (bytes shared with the piece before), cut (kind of boundary where the new text begins),
    needed (null for the first piece), piece_bytes. ``needed`` is the first of ``LEVELS`` that the limit left the cut: whatever stronger units it parts are
    over the limit themselves. As no piece is over the limit, every unit that is over it has such a cut within, so the last of
    them tells how far down a record's boundaries had to be sought (see ``boundaries``).

    Joining the pieces without their overlaps gives the record's bytes back. A null or non-positive limit counts as 4096, a null overlap
    as 0, an overlap of more than half the limit as half of it. Null index or bytes give no rows; an
    index given more than once is split each time, so part repeated deliveries beforehand. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i, b, most, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = split(b, most, min(shared, most // 2))
                units = _Units(b)
                rows.extend((i, k, len(pieces), a, z, o, kind, units.needed(a + o, most) if k else None, b[a:z]) for k, (a, z, o, kind) in enumerate(pieces))
                held += len(b)
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    most = limit_of(F.col(limit))
    shared = F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)).cast("bigint")
    chosen = records.select(F.col(index).cast("bigint").alias("index"), F.col(data).cast("binary").alias("bytes"), most.alias("most"), shared.alias("shared"))
    return map_arrow(chosen.where("index is not null and bytes is not null and octet_length(bytes) > most"), cut, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
