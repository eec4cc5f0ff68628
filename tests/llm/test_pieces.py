import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.errors import InvalidConfiguration
from corpusloom.llm import pieces

TEXT = st.lists(st.sampled_from(["word", "é", "A sentence.", "Why?", " ", "\n", "\n\n", "\r\n\r\n", "x" * 30, "漢字", "\t"]), max_size=200).map("".join)


def rebuilt(data, parts):
    return b"".join(data[a + o : z] for a, z, o, _ in parts)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(16, 90), st.integers(0, 30))
def test_pieces_fit_overlap_and_join(text, limit, overlap):
    data, overlap = text.encode(), min(overlap, limit // 2 - 8 if limit > 24 else 0)
    overlap = max(overlap, 0)
    parts = pieces.split(data, limit, overlap)
    assert rebuilt(data, parts) == data
    for k, (a, z, o, _) in enumerate(parts):
        assert z - a <= limit
        data[a:z].decode()  # no character is parted
        assert k == 0 or overlap <= o <= overlap + 3 or a == 0
    if len(data) > limit:
        assert len(parts) >= -(-len(data) // limit)


def brute(data, limit):
    size = lambda units: max((len(u.strip(b" \t\n\r\f\v")) for u in units), default=0)
    paragraphs, current = [], []
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\r\f\v"):
            current.append(line)
        else:
            paragraphs.append(b"\n".join(current))
            current = []
    paragraphs.append(b"\n".join(current))
    if size(paragraphs) <= limit:
        return "paragraph"
    if size(s for p in paragraphs for s in re.split(rb"(?<=[.!?])(?=[ \t\n\r\f\v])", p)) <= limit:
        return "sentence"
    return "word" if size(re.split(rb"[ \t\n\r\f\v]+", data)) <= limit else "none"


@settings(max_examples=600, deadline=None)
@given(TEXT, st.integers(4, 60), st.integers(0, 30))
def test_cuts_tell_the_boundary(text, limit, overlap):
    data = text.encode()
    parts = pieces.split(data, limit, min(overlap, limit // 2))
    if len(data) > limit:
        units = pieces._Units(data)
        needed = [units.needed(a + o, limit) for a, _, o, _ in parts[1:]]
        assert pieces.LEVELS[max(needed)] == brute(data, limit)


def test_small_limits():
    for limit, overlap in ((10, 6), (3, 1), (1, 0)):  # no overlap that leaves no room for new text
        parts = pieces.split(b"x" * 100, limit, overlap)
        assert rebuilt(b"x" * 100, parts) == b"x" * 100 and all(z - a <= limit and o == 0 for a, z, o, _ in parts)
    with pytest.raises(InvalidConfiguration):
        pieces.split(b"x" * 100, 0, 0)


def test_operator_on_awkward_rows(spark):
    rows = [(1, None, 10, 0, "a"), (None, b"x" * 50, 20, 0, "b"), (2, b"", 10, 0, "c"), (3, b"word " * 40, None, None, "d"), (4, b"word " * 2000, None, None, "e"), (5, b"\xff\xfe" * 400, 100, 10, "f"), (5, b"\xff\xfe" * 400, 100, 10, "f")]
    df = spark.createDataFrame(rows, "index bigint, bytes binary, target_record_bytes bigint, overlap_bytes bigint, piece string")
    out = pieces.oversized_pieces(df).collect()
    assert {r["index"] for r in out} == {4, 5}
    assert sum(r["index"] == 5 and r["piece"] == 0 for r in out) == 2
    joined = b"".join(bytes(r["piece_bytes"])[r["overlap"] :] for r in sorted((r for r in out if r["index"] == 4), key=lambda r: r["piece"]))
    assert joined == b"word " * 2000
    assert {r["index"]: r["boundary"] for r in pieces.boundaries(pieces.oversized_pieces(df)).collect()} == {4: "word", 5: "none"}
    assert pieces.oversized_pieces(df.limit(0)).count() == 0 == pieces.boundaries(pieces.oversized_pieces(df.limit(0))).count()
