"""Near-duplicate texts: an exact Jaccard join over word sequences by the generalised pigeonhole principle.

A text is a vector of bits, one for each sequence of k consecutive words that occurs anywhere. If two texts reach the
similarity t, then of the n bits of the smaller at most e = n - ceil(2t / (1 + t) n) are missing in the larger.

1. Bits are parted by how common they are in a sample. Rare ones make one partition, whose units are single bits. Common ones, which would meet
   too many texts one by one, are grouped with those they correlate with: sequences that overlap mostly hold the same rarest word, their anchor, and
   fall into one partition, whose units are disjoint pairs of bits.
2. A partition with threshold j - 1 is probed by j of its units, one of which is whole in every text that misses fewer than j of these bits. Dynamic
   programming chooses the thresholds so that all units come to e + m at the least estimated number of candidates; by the pigeonhole
   principle m of them are whole in every text that is similar, whatever the estimates, so pairs of texts that meet less often are rejected as chance. Where
   there are fewer units, m is less; where there are not even e + 1, common bits are probed one by one.
3. Texts no smaller hold keys for every pair of common bits of a partition, and for their first n - ceil(tn) + m rare bits by hash: texts are probed by their
   rare bits in that order too, so the first m that two texts share are among these. Pairs of texts that meet often enough are tested by bitmaps (two
   bitmaps never differ in more places than the sets do), and what is left is verified exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfiguration
from ..functions.words import words
from ..session import checkpoint, map_arrow, written


@dataclass(frozen=True)
class NearConfig:
    words: int = 5
    threshold: float = 0.8
    least_words: int = 1
    #: Texts from which frequent words and common bits are estimated; they bear on cost alone, never on the result.
    sample: int = 8192
    max_frequent_words: int = 4096
    max_common_bits: int = 262_144

    def __post_init__(self) -> None:
        if self.words < 1 or not 0 < self.threshold <= 1 or self.least_words < 1:
            raise InvalidConfiguration("words and least_words must be at least 1, the threshold in (0, 1]")


_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_LONGS = 6
#: Rows of about 50 bytes that are sent to every executor at most; more are joined.
MAX_BROADCAST = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M
    x = (x ^ (x >> _S)) * _N
    return x ^ (x >> _S)


class _Hashes(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return out


def _anchors(hashes: np.ndarray, k: int, frequent: np.ndarray) -> np.ndarray:
    """The anchor of each sequence: its rarest word as far as frequent ones are known, ties by hash."""
    order = hashes >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        order = order | ((frequent[at] == hashes).astype(np.uint64) << np.uint64(63))
    n = len(hashes) - k + 1
    out = order[:n].copy()
    for j in range(1, k):
        np.minimum(out, order[j : j + n], out=out)
    return out


def level(n: int) -> int:
    """How often the partitions of a text of n sequences are parted by eight, so that those of a long text stay small."""
    out = 0
    while n > 512 << 3 * out:
        out += 1
    return out


def _partitions(bits: np.ndarray, anchors: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits ordered by partition, and the partition of each."""
    # sequences of frequent words alone have few anchors: these are spread over eight partitions each
    deep = np.uint64(3 * depth)
    inside = np.where(anchors >> np.uint64(63) == 1, bits & ((np.uint64(8) << deep) - np.uint64(1)), bits & ((np.uint64(1) << deep) - np.uint64(1)))
    group = _mix(anchors + inside * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth + 1))
    order = np.lexsort((bits, group))
    return bits[order], group[order]


def _pairs(bits: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j of all pairs within a partition, and their keys."""
    left, right = [], []
    n, gap = len(bits), 1
    while gap < n:
        same = np.flatnonzero(group[gap:] == group[:-gap])
        if not len(same):
            break
        left.append(same)
        right.append(same + gap)
        gap += 1
    if not left:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0, dtype=np.uint64)
    i, j = np.concatenate(left), np.concatenate(right)
    return i, j, _mix(bits[i] * np.uint64(3) + _mix(bits[j] + group[j]))


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Which remainders the bits leave, as longs."""
    marks = np.zeros(64 * _LONGS, dtype=np.uint8)
    marks[(bits % np.uint64(64 * _LONGS)).astype(np.int64)] = 1
    return np.packbits(marks).view(np.int64)


def missing(n: int, t: float) -> int:
    """How many of the smaller text's n bits may be missing in the larger."""
    f = Fraction(t).limit_denominator(10**6)
    return n - ceil(2 * f / (1 + f) * n)


def allocate(costs: list[list[float]], need: int) -> list[int]:
    """Units to take of each partition, ``need`` in all, at the least sum of costs; ``costs[p]`` lists p's units, cheapest first.

    Dynamic programming over partitions; all units are taken where they don't suffice.
    """
    total = sum(map(len, costs))
    if total <= need:
        return [len(c) for c in costs]
    if total * need > 4_000_000:  # costs ascend within a partition, so the programme's optimum is a merge
        order = sorted((c, p) for p, units in enumerate(costs) for c in units)
        taken = Counter(p for _, p in order[:need])
        return [taken[p] for p in range(len(costs))]
    best = np.full(need + 1, np.inf)
    best[0] = 0
    choices = np.zeros((len(costs), need + 1), dtype=np.int32)
    for p, units in enumerate(costs):
        new, chosen, added = best.copy(), choices[p], 0.0
        for level, cost in enumerate(units[:need], 1):
            added += cost
            option = best[:-level] + added
            better = option < new[level:]
            new[level:][better] = option[better]
            chosen[level:][better] = level
        best = new
    out, left = [0] * len(costs), need
    for p in range(len(costs) - 1, -1, -1):
        out[p] = int(choices[p, left])
        left -= out[p]
    return out


@dataclass
class Keys:
    """What a text is held by, and looked up by: keys of rare bits and of pairs; and common bits where these don't suffice."""

    bits: int
    #: How many of the units asked are whole in every text that is similar and no smaller.
    least: int
    bitmap: np.ndarray
    held: np.ndarray
    asked: np.ndarray
    common: np.ndarray
    lone: np.ndarray


def meetings(n: int) -> int:
    """How many units two texts are to share, where the smaller has n bits; more for larger texts, which meet more often by chance."""
    return 1 + n // 64


def text_keys(bits: np.ndarray, anchors: np.ndarray, t: float, known: np.ndarray, counts: np.ndarray, unseen: float = 1.0) -> Keys:
    """The keys of a text from its sorted bits; ``known`` are the common bits, sorted, ``counts`` how many texts have each as an estimate."""
    n, f = len(bits), Fraction(t).limit_denominator(10**6)
    lost = missing(n, t)
    need = lost + meetings(n)
    if len(known):
        at = np.minimum(np.searchsorted(known, bits), len(known) - 1)
        is_common = known[at] == bits
    else:
        at, is_common = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    rare, common, cost = _mix(bits[~is_common] ^ _M), bits[is_common], counts[at[is_common]] if len(known) else np.empty(0)
    rare.sort()
    held, deepest = [rare[: n - ceil(f * n) + meetings(n)]], level(n)
    own: list[np.ndarray] = []
    if len(common) > 1:
        for depth in range(level(max(1, ceil(f * n))), deepest + 1):
            ordered, group = _partitions(common, anchors[is_common], depth)
            i, j, keys = _pairs(ordered, group)
            held.append(keys)
            own = [ordered, group, i, j, keys]
    asked, lone, units = rare[:need], np.empty(0, dtype=np.uint64), need
    if len(rare) < need:  # else rare bits, which no unit is cheaper than, are all it takes
        asked, lone, units = _allocated(rare, common, own, dict(zip(common.tolist(), cost.tolist(), strict=True)), lost, need, unseen)
    return Keys(n, units - lost, bitmap(bits), np.concatenate(held), asked, common, lone)


def _allocated(rare: np.ndarray, common: np.ndarray, pairs: list[np.ndarray], cost: dict[int, float], lost: int, need: int, unseen: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of ``need`` units, or as many as there are, at the least estimated cost; where that isn't more than ``lost``, common bits to be probed one by one; units in all."""
    if not pairs:
        lone = common[: max(0, lost + 1 - len(rare))]
        return rare, lone, len(rare) + len(lone)
    ordered, group, i, j, keys = pairs
    prices = np.array([cost[b] for b in ordered.tolist()])
    price = np.minimum(prices[i], prices[j])  # no more texts have both than have either
    used = bytearray(len(ordered))
    units: dict[int, list[tuple[float, int]]] = {}
    part = np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))).tolist()
    ci, cj, cp = i.tolist(), j.tolist(), price.tolist()
    for k in np.argsort(price, kind="stable").tolist():
        a, b = ci[k], cj[k]
        if not used[a] and not used[b]:
            used[a] = used[b] = 1
            units.setdefault(part[a], []).append((cp[k], k))
    groups = list(units)
    taken = allocate([[unseen] * len(rare), *([c for c, _ in units[g]] for g in groups)], need)
    chosen = [k for g, m in zip(groups, taken[1:], strict=True) for _, k in units[g][:m]]
    short = lost + 1 - taken[0] - len(chosen)
    lone = [p for p in range(len(ordered)) if not used[p]][: max(short, 0)]
    short -= len(lone)
    if short > 0:  # part pairs again: each counts one, its two bits count two
        for k in chosen[:short]:
            lone += [ci[k], cj[k]]
        chosen = chosen[short:]
    return np.concatenate((rare[: taken[0]], keys[chosen])), ordered[lone], taken[0] + len(chosen) + len(lone)


_TEXTS = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("words", pa.list_(pa.int64()))])


def word_hashes(texts: DataFrame, config: NearConfig, id: str = "id", text: str = "text") -> DataFrame:
    """id, same (equal for texts of equal bits), words (hashes, in order) of texts with at least ``least_words`` words and one sequence."""
    k, least = config.words, max(config.least_words, config.words)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(t)
                if len(found) < least:
                    continue
                hashes = np.fromiter((known[w] for w in found), dtype=np.uint64, count=len(found))
                rows.append((i, xxhash.xxh3_128_digest(np.unique(_sequences(hashes, k)).tobytes()), hashes.view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _TEXTS, strict=True)], schema=_TEXTS)

    chosen = texts.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return map_arrow(chosen, parse, "id bigint, same binary, words array<bigint>")


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    for row in column:
        yield row.values.to_numpy(zero_copy_only=False).view(np.uint64)


def common_bits(reps: DataFrame, config: NearConfig) -> tuple[np.ndarray, np.ndarray]:
    """Bits that at least two of a sample of texts have, sorted, and how many texts have each by that sample; at most ``max_common_bits``, the commonest."""
    k = config.words
    every = max(1, reps.count() // config.sample)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_sequences(w, k)) for w in _arrays(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["bit"])

    some = map_arrow(reps.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("words"), spell, "bit bigint")
    top = some.groupBy("bit").count().where("count > 1").orderBy(F.desc("count"), "bit").limit(config.max_common_bits).toPandas()
    bits, counts = top["bit"].to_numpy(dtype=np.int64).view(np.uint64), top["count"].to_numpy(dtype=np.float64) * every
    order = np.argsort(bits)
    return bits[order], counts[order]


def frequent_words(texts: DataFrame, config: NearConfig, text: str = "text") -> np.ndarray:
    """Sorted hashes of the words that many of the first ``sample`` texts hold (bounded, for anchors only)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total.update(set(words(t)))
        top = total.most_common(config.max_frequent_words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    some = texts.select(F.col(text).alias("text")).where("text is not null").limit(config.sample)
    rows = map_arrow(some, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(config.max_frequent_words).collect()
    # no word of fewer than one in a hundred texts is frequent; with few texts every common word still is
    least = max(2, config.sample // 100 if len(rows) >= config.max_frequent_words else max((r["n"] for r in rows), default=0) // 50)
    return np.sort(np.array([xxhash.xxh64_intdigest(r["word"]) for r in rows if r["n"] >= least], dtype=np.uint64))


@dataclass
class NearDuplicates:
    """members: id, representative (least id of its exact copies), copies. links: a, b (representatives, a < b), jaccard."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """id_a, id_b (id_a < id_b), jaccard of all pairs, copies expanded."""
        own = self.members.where("copies > 1").select(F.col("representative").alias("a"), F.col("representative").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
        m = self.members
        left = m.select(F.col("representative").alias("a"), F.col("id").alias("x"))
        right = m.select(F.col("representative").alias("b"), F.col("id").alias("y"))
        both = self.links.unionByName(own).join(left, "a").join(right, "b").where("a <> b or x < y")
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard")

    def documents(self) -> DataFrame:
        """id, class_id (of its exact copies), copies, links (other classes that are near it); one row per document."""
        ends = self.links.select(F.col("a").alias("representative")).unionByName(self.links.select(F.col("b").alias("representative")))
        degree = ends.groupBy("representative").agg(F.count("*").alias("links"))
        return self.members.join(degree, "representative", "left").select("id", F.col("representative").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def _keyed(reps: DataFrame, config: NearConfig, frequent: np.ndarray) -> DataFrame:
    """id, n (bits), least, m0 .. (bitmap), held, asked, common, lone of every text; see ``Keys``."""
    t, k = config.threshold, config.words
    sent = reps.sparkSession.sparkContext.broadcast(common_bits(reps, config))  # at most max_common_bits entries

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            found: list[Keys] = []
            for hashes in _arrays(batch.column(1)):
                bits, first = np.unique(_sequences(hashes, k), return_index=True)
                found.append(text_keys(bits, _anchors(hashes, k, frequent)[first], t, known, counts))
            maps = np.stack([f.bitmap for f in found]) if found else np.empty((0, _LONGS), dtype=np.int64)
            lists = [pa.array([getattr(f, c).view(np.int64) for f in found], pa.list_(pa.int64())) for c in _LISTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.bits for f in found], pa.int64()), pa.array([f.least for f in found], pa.int64()), *(pa.array(m) for m in maps.T), *lists], names=["id", "n", "least", *_MAP, *_LISTS])

    return map_arrow(reps.select("id", "words"), key, "id bigint, n bigint, least bigint, " + ", ".join(f"{m} bigint" for m in _MAP) + ", " + ", ".join(f"{c} array<bigint>" for c in _LISTS))


_MAP = [f"m{k}" for k in range(_LONGS)]
_LISTS = ["held", "asked", "common", "lone"]


def _verified(pairs: DataFrame, config: NearConfig) -> DataFrame:
    """a, b, jaccard of (a, b, words_a, words_b) whose similarity reaches the threshold."""
    t, k = config.threshold, config.words

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
                x, y = np.unique(_sequences(x, k)), np.unique(_sequences(y, k))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                values.append(shared / (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["a", "b", "jaccard"])

    return map_arrow(pairs.select("a", "b", "words_a", "words_b"), verify, "a bigint, b bigint, jaccard double").where(F.col("jaccard") >= t - 1e-12)


def near_duplicates(texts: DataFrame, config: NearConfig = NearConfig(), id: str = "id", text: str = "text") -> NearDuplicates:
    """All pairs of texts whose sets of ``words`` consecutive words have a Jaccard similarity of ``threshold`` or more.

    Exact copies (equal sets) are folded into one representative before any pair is formed. Rows with a null id or text, and texts of
    fewer than ``least_words`` or ``words`` words, take no part. An id given more than once must be parted beforehand. Other
    columns are ignored. An empty table gives empty results.
    """
    t = config.threshold
    sent = lambda df: F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df
    frequent = frequent_words(texts, config, text)
    hashed = written(word_hashes(texts, config, id, text))
    classes = hashed.groupBy("same").agg(F.min("id").alias("representative"), F.count("*").alias("copies"))
    members = checkpoint(hashed.select("id", "same").join(classes, "same").select("id", "representative", "copies"))
    reps = hashed.join(sent(members.where("id <> representative").select("id")), "id", "left_anti")
    keyed = written(_keyed(reps, config, frequent))

    def look_up(asked: str, held: str, few: bool = False) -> DataFrame:
        ask = keyed.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "least", F.explode(asked).alias("key"))
        hold = keyed.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.explode(held).alias("key"))
        return hold.join(F.broadcast(ask) if few else ask, "key").where(f"(n_b < n_a or n_b = n_a and b < a) and n_b >= {t} * n_a - 1e-9").select("a", "b", "least")

    # texts whose units don't suffice are few as a rule; where their common bits are many, they are joined as the keys are
    lone = keyed.agg(F.coalesce(F.sum(F.size("lone")), F.lit(0))).first()[0]
    met = look_up("asked", "held")
    if lone:
        met = met.unionByName(look_up("lone", "common", lone <= MAX_BROADCAST))
    maps = [keyed.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(m).alias(f"{m}_{x}") for m in _MAP]) for x in "ab"]
    differ = " + ".join(f"bit_count({m}_a ^ {m}_b)" for m in _MAP)
    allowed = f"n_a + n_b - 2 * ceil({t / (1 + t)} * (n_a + n_b) - 1e-6)"
    near = checkpoint(met.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("least").alias("least")).where("met >= least").select("a", "b").join(maps[0], "a").join(maps[1], "b").where(f"{differ} <= {allowed}").select("a", "b"))
    # only texts that are near another are moved, and only to these
    own = [hashed.select(F.col("id").alias(x), F.col("words").alias(f"words_{x}")).join(sent(near.select(x).distinct()), x, "left_semi") for x in "ab"]
    links = _verified(near.join(own[0], "a").join(own[1], "b"), config)
    return NearDuplicates(members, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard"))
