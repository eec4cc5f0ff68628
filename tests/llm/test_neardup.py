import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.words import words
from corpusloom.llm import neardup
from corpusloom.llm.neardup import NearConfig, allocate, missing, near_duplicates


def brute(rows, k, t, least):
    sets = {}
    for i, text in rows:
        w = words(text or "")
        if i is not None and len(w) >= max(k, least):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def edited(rng, w, times):
    w = list(w)
    for _ in range(times):
        at = rng.randrange(len(w))
        match rng.randrange(4):
            case 0:
                w[at] = f"new{rng.randrange(999)}"
            case 1:
                del w[at]
            case 2:
                w.insert(at, f"new{rng.randrange(999)}")
            case 3:
                w = w[at:] + w[:at]
        if not w:
            w = ["left"]
    return w


def corpus(seed, n=160, vocabulary=60):
    rng = random.Random(seed)
    rows, originals = [], []
    for i in range(n):
        if originals and rng.random() < 0.6:
            base = rng.choice(originals)
            w = edited(rng, base, rng.randrange(0, max(2, len(base) // 8)))
        else:
            w = [f"w{min(int(rng.expovariate(0.05)), vocabulary)}" for _ in range(rng.choice([3, 8, 20, 60, 300, 700]))]
            originals.append(w)
        rows.append((i, " ".join(w)))
    return rows


def test_equals_brute_force(spark):
    for seed, (k, t) in enumerate([(3, 0.6), (5, 0.8), (1, 0.5), (2, 0.3)]):
        rows = corpus(seed)
        rows += [(900, None), (None, "a b c d e f"), (901, ""), (902, "one two"), (903, rows[0][1]), (904, rows[0][1].upper())]
        df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "id bigint, text string, bits string, representative double")
        result = near_duplicates(df, NearConfig(words=k, threshold=t, least_words=3, sample=64))
        got = {(r["id_a"], r["id_b"]) for r in result.pairs().collect()}
        assert got == brute(rows, k, t, 3)
        documents = {r["id"]: r for r in result.documents().collect()}
        assert documents[903]["class_id"] == documents[0]["class_id"] == 0
        assert len(documents) == sum(i is not None and len(words(x or "")) >= max(3, k) for i, x in rows)


def test_joined_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MAX_BROADCAST", 0)
    rows = corpus(9)
    got = near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), NearConfig(words=3, threshold=0.6, sample=16)).pairs().collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == brute(rows, 3, 0.6, 1)


def test_long_texts_have_parted_partitions():
    rng = random.Random(2)
    for n in (400, 3000, 20_000):
        base = [f"w{rng.randrange(50)}" for _ in range(n)]
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in base], dtype=np.uint64)
        bits, first = np.unique(neardup._sequences(hashes, 3), return_index=True)
        keys = neardup.text_keys(bits, neardup._anchors(hashes, 3, np.empty(0, dtype=np.uint64))[first], 0.6, bits, np.full(len(bits), 9.0))
        assert len(keys.held) < 40 * n and keys.least >= 1


def test_empty_table(spark):
    result = near_duplicates(spark.createDataFrame([], "id bigint, text string"), NearConfig())
    assert result.pairs().count() == 0
    assert result.documents().count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9).map(float), max_size=4).map(sorted), max_size=6), st.integers(1, 12))
def test_allocation_is_optimal(costs, need):
    taken = allocate(costs, need)
    units = sorted(c for p in costs for c in p)
    assert sum(taken) == min(need, len(units))
    assert abs(sum(sum(c[:m]) for c, m in zip(costs, taken)) - sum(units[:need])) < 1e-9


def test_missing_bits_bound():
    for n in range(1, 60):
        for m in range(n, 90):
            for shared in range(n + 1):
                if shared >= 0.6 * (n + m - shared) - 1e-12:
                    assert n - shared <= missing(n, 0.6)
