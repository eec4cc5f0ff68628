"""Scores of abusive, hateful and sexual language by class-conditional Kneser-Ney models.

Each category and ordinary language have an interpolated trigram model; the lowest order, continuation counts over all
classes together, is shared, so rare expressions are smoothed alike. A sentence's score is the difference of its length-normalised
log-likelihoods; a document's is its highest sentence's. Labels are of documents while a single sentence earns them, so the
sentences that carry a label are found in rounds: those far more likely under the category stay with it, the others count as ordinary.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfiguration
from ..session import map_arrow

CATEGORIES = ("abusive", "hateful", "sexual")
_ORDINARY = "clean"


@dataclass(frozen=True)
class AbuseConfig:
    #: Labelled documents the models are fitted on: at most so many of each category, and of clean ones.
    max_labelled: int = 4000
    #: Bytes of their texts in all, of which each category and clean have an even share; what is over is left out, whole documents at a time.
    max_bytes: int = 64 << 20
    rounds: int = 3
    #: Nats a word above which a sentence of a labelled document is taken for its cause.
    margin: float = 0.5
    #: Words of no weight that are added to a sentence's length, so that a chance meeting in two or three words counts little.
    padding: int = 5
    #: Longer sentences are scored in overlapping stretches of so many words.
    stretch: int = 40
    seed: int = 3

    def __post_init__(self) -> None:
        if self.max_labelled < 1 or self.max_bytes < 1 or self.stretch < 3:
            raise InvalidConfiguration("max_labelled and max_bytes must be positive, stretch at least 3")


#: The threshold where nothing is known, and for how many held-out cases it counts beside them: few cases tell little.
_PRIOR, _PRIOR_CASES = 1.5, 50
# Letters of other scripts, and signs, that are written for Latin letters.
_LOOKS = str.maketrans("аеорсухкмтвніјѕԁɡαεοριντκυ", "aeopcyxkmtbhijsdgaeopivtky")
_SIGNS = str.maketrans("013457$@", "oieastsa")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ ._*\-]){3,}[^\W_](?![^\W_])")
_SEPARATORS = re.compile(r"[ ._*\-]")
_JOINED = re.compile(r"(?<=[^\W\d_])_(?=[^\W\d_])")
_DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[\w$@*]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_DIGIT = re.compile(r"[\d$@]")
_LETTER = re.compile(r"[^\W\d_]")


def _token(token: str) -> str:
    if token.isalpha():
        return token
    if "*" in token:
        return "<mask>" if _LETTER.search(token) else "<num>"
    token = token.replace("_", "")
    if _DIGIT.search(token):
        read = token.translate(_SIGNS)
        return read if read.isalpha() and _LETTER.search(token) else "<num>"
    return token


class _Readings(dict):
    """How tokens are read, kept for those seen lately."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        value = self[token] = _token(_DRAWN_OUT.sub(r"\1", _JOINED.sub("", token)))
        return value


_READ = _Readings()


def sentences(text: str | None, stretch: int = 40) -> list[list[str]]:
    """Words of each sentence, as they are read: spelling tricks (look-alikes, signs for letters, letters set apart or drawn out) undone."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_LOOKS)
    else:
        text = text.lower()
    text = _SPACED.sub(lambda m: _SEPARATORS.sub("", m.group()), text)
    out: list[list[str]] = []
    for part in _SENTENCE.split(text):
        words = [_READ[t] for t in _TOKEN.findall(part)]
        if out and len(out[-1]) < 3:  # an exclamation or a heading of a word or two belongs to what follows
            words = out.pop() + words
        if len(words) <= stretch:
            out.append(words)
        else:
            # half of each stretch is in the next too, so that an expression across a cut is whole in one
            step = stretch // 2
            out += [words[k : k + stretch] for k in range(0, len(words) - stretch + step, step)]
    return [s for s in out if s]


class _Bag:
    """Sentences of documents as one array of word numbers; each sentence starts after two marks."""

    def __init__(self, documents: list[list[list[str]]], vocabulary: dict[str, int]) -> None:
        unknown = vocabulary["<unk>"]
        codes, self.lengths, owners = [], [], []
        for d, own in enumerate(documents):
            for words in own:
                codes += [0, 0, *(vocabulary.get(w, unknown) for w in words)]
                self.lengths.append(len(words))
                owners.append(d)
        self.codes = np.array(codes, dtype=np.int64)
        self.lengths = np.array(self.lengths, dtype=np.int64)
        self.owners = np.array(owners, dtype=np.int64)
        self.size = len(vocabulary)
        starts = np.cumsum(self.lengths + 2) - self.lengths  # of each sentence's first word
        n = int(self.lengths.sum())
        self.first = np.cumsum(self.lengths) - self.lengths
        place = np.arange(n) - np.repeat(self.first, self.lengths) + np.repeat(starts, self.lengths)
        c, v = self.codes, self.size
        self.trigrams = (c[place - 2] * v + c[place - 1]) * v + c[place] if n else np.empty(0, dtype=np.int64)

    def of(self, chosen: np.ndarray) -> np.ndarray:
        """Trigrams of the chosen sentences."""
        return self.trigrams[np.repeat(chosen, self.lengths)]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5


class _Order:
    """Counts of one order: of n-grams, and of their contexts (total, and distinct continuations)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, size: int) -> None:
        self.keys, self.counts, self.discount = keys, counts, _discount(counts)
        context = keys // size
        self.contexts, at, self.distinct = np.unique(context, return_index=True, return_counts=True)
        self.totals = np.add.reduceat(counts, at) if len(keys) else counts

    def mix(self, wanted: np.ndarray, size: int, lower: np.ndarray) -> np.ndarray:
        count = _lookup(self.keys, self.counts, wanted)
        total = _lookup(self.contexts, self.totals, wanted // size)
        distinct = _lookup(self.contexts, self.distinct, wanted // size)
        known = np.maximum(total, 1)
        return np.where(total > 0, (np.maximum(count - self.discount, 0) + self.discount * distinct * lower) / known, lower)


class _Model:
    """Interpolated Kneser-Ney trigrams of one class."""

    def __init__(self, trigrams: np.ndarray, size: int) -> None:
        keys, counts = np.unique(trigrams, return_counts=True)
        self.three = _Order(keys, counts, size)
        self.two = _Order(*np.unique(keys % (size * size), return_counts=True), size)

    def probability(self, trigrams: np.ndarray, size: int, shared: np.ndarray) -> np.ndarray:
        return self.three.mix(trigrams, size, self.two.mix(trigrams % (size * size), size, shared[trigrams % size]))


class Scorer:
    """The models of all classes over one vocabulary."""

    def __init__(self, vocabulary: dict[str, int], by_class: dict[str, np.ndarray], padding: int) -> None:
        self.vocabulary, self.size, self.padding = vocabulary, len(vocabulary), padding
        every = np.unique(np.concatenate([t % (self.size * self.size) for t in by_class.values()]))
        counts = np.bincount(every % self.size, minlength=self.size).astype(np.float64)
        self.shared = (counts + 0.5) / (counts.sum() + 0.5 * self.size)
        self.models = {c: _Model(t, self.size) for c, t in by_class.items()}
        self.categories = [c for c in CATEGORIES if c in self.models]
        self.thresholds = {c: _PRIOR for c in self.categories}

    def likelihoods(self, bag: _Bag, names: list[str]) -> np.ndarray:
        """(sentences x classes) padded mean of the log-likelihoods of words; empty sentences have -inf."""
        out = np.full((len(bag.lengths), len(names)), -np.inf)
        full = np.flatnonzero(bag.lengths)
        if len(full) and names:
            keys, inverse = np.unique(bag.trigrams, return_inverse=True)
            for k, c in enumerate(names):
                logs = np.log(self.models[c].probability(keys, self.size, self.shared))[inverse]
                out[full, k] = np.add.reduceat(logs, bag.first[full]) / (bag.lengths[full] + self.padding)
        return out

    def scores(self, bag: _Bag) -> np.ndarray:
        """(sentences x categories) nats a word by which a category is likelier than ordinary language; empty sentences have -inf."""
        found = self.likelihoods(bag, [_ORDINARY, *self.categories])
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(found[:, 1:]), found[:, 1:] - found[:, :1], -np.inf)

    def documents(self, bag: _Bag, number: int) -> np.ndarray:
        """(documents x categories) highest score; a sentence speaks for its likeliest category, and against the others by the distance."""
        out = np.full((number, len(self.categories)), -np.inf)
        scores = self.scores(bag)
        best = scores.max(axis=1, keepdims=True, initial=-np.inf)
        with np.errstate(invalid="ignore"):
            np.maximum.at(out, bag.owners, np.where(scores == best, scores, np.minimum(scores, scores - best)))
        return out


def _train(documents: list[list[list[str]]], labels: list[set[str]], config: AbuseConfig) -> Scorer | None:
    present = [c for c in CATEGORIES if any(c in x for x in labels)]
    if not present or not any(not x for x in labels):
        return None
    seen: Counter[str] = Counter(w for d in documents for w in {w for s in d for w in s})
    vocabulary = {"<s>": 0, "<unk>": 1} | {w: n for n, w in enumerate(sorted(w for w, n in seen.items() if n > 1), 2)}
    clean = _Bag([d for d, x in zip(documents, labels, strict=True) if not x], vocabulary)
    marked = [(d, x) for d, x in zip(documents, labels, strict=True) if x]
    bag = _Bag([d for d, _ in marked], vocabulary)
    belongs = np.stack([np.array([c in x for _, x in marked])[bag.owners] for c in present], axis=1)
    chosen = belongs.copy()
    half = np.random.default_rng(config.seed).permutation(len(marked))[bag.owners] % 2 == 0
    everything = np.ones(len(clean.lengths), dtype=bool)

    def scorer(among: np.ndarray, first: bool) -> Scorer:
        # documents of the first turn are not yet told apart from the sentences that earn their labels
        rest = bag.of(~chosen.any(axis=1) & among) if not first else bag.trigrams[:0]
        classes = {_ORDINARY: np.concatenate((clean.of(everything), rest)), **{c: bag.of(chosen[:, k] & among) for k, c in enumerate(present)}}
        return Scorer(vocabulary, {c: t for c, t in classes.items() if len(t) or c == _ORDINARY}, config.padding)

    for turn in range(config.rounds):
        # a sentence is judged by models that have not seen its document, else each would speak for itself
        scores = np.full(belongs.shape, -np.inf)
        ordinary = np.zeros(len(bag.lengths))
        for side in (half, ~half):
            other = scorer(~side, turn == 0)
            found = other.likelihoods(bag, [_ORDINARY, *other.categories])
            ordinary[side] = found[side, 0]
            for k, c in enumerate(other.categories):
                with np.errstate(invalid="ignore"):
                    scores[side, present.index(c)] = (found[:, k + 1] - found[:, 0])[side]
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        allowed = np.where(belongs, scores, -np.inf)
        winner = allowed.argmax(axis=1)
        new = np.zeros_like(chosen)
        for k in range(len(present)):
            keep = (winner == k) & (allowed[:, k] > config.margin)
            # a labelled document keeps at least one sentence: the likeliest, or where none is, the least ordinary
            own = np.flatnonzero(belongs[:, k] & (bag.lengths > 0))
            rank = np.where(scores[own, k] > config.margin / 2, 100 + scores[own, k], -np.where(bag.lengths[own] > 2, ordinary[own], 0))
            order = own[np.lexsort((-rank, bag.owners[own]))]
            best = order[np.concatenate(([True], bag.owners[order][1:] != bag.owners[order][:-1]))] if len(order) else order
            without = np.setdiff1d(bag.owners[best], bag.owners[keep])
            keep[best[np.isin(bag.owners[best], without)]] = True
            new[:, k] = keep
        chosen = new
    return scorer(np.ones(len(bag.lengths), dtype=bool), False)


#: Thresholds whose F1 on held-out documents is less than the best by no more than this are taken for as good.
_AS_GOOD = 0.01


def _threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """From the range of scores about the best F1 over held-out documents, from which on taking documents is as good, the place two thirds up, as the
    documents without labels are more varied than those with; drawn to ``_PRIOR``."""
    order = np.argsort(-scores, kind="stable")
    ranked, hits = scores[order], np.cumsum(truth[order])
    f = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    f[:-1][ranked[:-1] == ranked[1:]] = -1  # documents of one score are taken together
    good = f >= f.max() - _AS_GOOD
    first = last = int(f.argmax())
    while first > 0 and (good[first - 1] or f[first - 1] < 0):
        first -= 1
    while last + 1 < len(f) and (good[last + 1] or f[last + 1] < 0):
        last += 1
    low = ranked[last + 1] if last + 1 < len(ranked) else ranked[last] - 1
    cases = int(truth.sum())
    return float((cases * (2 * ranked[first] + low) / 3 + _PRIOR_CASES * _PRIOR) / (cases + _PRIOR_CASES))


def fit(labelled: list[tuple[str | None, set[str]]], config: AbuseConfig = AbuseConfig()) -> Scorer | None:
    """Models from (text, categories; none for clean) of labelled documents; None if clean or all other ones are missing.

    Thresholds are chosen on documents that the models they come from have not seen (two halves in turn).
    """
    documents = [sentences(t, config.stretch) for t, _ in labelled]
    labels = [x for _, x in labelled]
    final = _train(documents, labels, config)
    if final is None:
        return None
    half = np.random.default_rng(config.seed).permutation(len(labels)) % 2
    held: dict[str, list[tuple[float, bool]]] = {c: [] for c in final.categories}
    for side in (0, 1):
        inside, outside = np.flatnonzero(half == side), np.flatnonzero(half != side)
        scorer = _train([documents[n] for n in inside], [labels[n] for n in inside], config)
        if scorer is None:
            continue
        scores = scorer.documents(_Bag([documents[n] for n in outside], scorer.vocabulary), len(outside))
        for k, c in enumerate(scorer.categories):
            held[c] += [(s, c in labels[n]) for s, n in zip(scores[:, k].tolist(), outside.tolist(), strict=True)]
    for c, rows in held.items():
        kept = [(s, y) for s, y in rows if s > -np.inf]
        if any(y for _, y in kept):
            final.thresholds[c] = _threshold(np.array([s for s, _ in kept]), np.array([y for _, y in kept]))
    return final


def labelled_sample(documents: DataFrame, labels: DataFrame, config: AbuseConfig = AbuseConfig()) -> list[tuple[str | None, set[str]]]:
    """(text, categories) of labelled documents: all, up to ``max_labelled`` of each category and of clean ones, by a hash of their id.

    Labels are read without case and outer space; null and unknown ones are ignored. A document that is called clean and something
    else keeps the latter. Both bounds hold for every label by itself, in the order of the hash, so the driver gets a bounded sample of any table.
    """
    label = F.lower(F.trim("label"))
    own = labels.select("doc_id", label.alias("label")).where(F.col("label").isin(*CATEGORIES, _ORDINARY)).distinct()
    # a label that most rows have is ranked in parts first, of which each keeps no more than the whole may
    own = own.withColumns({"_hash": F.xxhash64("doc_id"), "_part": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))})
    for parts in ("label, _part", "label"):
        own = own.withColumn("_rank", F.expr(f"row_number() over (partition by {parts} order by _hash, doc_id)")).where(F.col("_rank") <= config.max_labelled)
    # at most four times max_labelled rows: the bounded side is sent to the documents, and what comes back is as bounded
    found = documents.select("doc_id", "text").join(F.broadcast(own.select("doc_id", "label", "_hash")), "doc_id").groupBy("doc_id", "label", "_hash").agg(F.min("text").alias("text"))
    size = "sum(coalesce(octet_length(text), 0)) over (partition by label order by _hash, doc_id)"
    kept = found.withColumn("_size", F.expr(size)).where(F.col("_size") <= config.max_bytes // (len(CATEGORIES) + 1))
    rows = kept.groupBy("doc_id").agg(F.min("text").alias("text"), F.collect_set("label").alias("labels")).orderBy("doc_id").collect()
    return [(r["text"], {x for x in r["labels"] if x != _ORDINARY}) for r in rows]


def score(documents: DataFrame, scorer: Scorer | None, config: AbuseConfig = AbuseConfig(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, category, score, flagged: a row for each document and category that could be learnt.

    Null and empty texts have a null score and are not flagged; a null id gives no rows; without a scorer there are none.
    Repeated rows are each scored. Other columns are ignored.
    """
    schema = "doc_id bigint, category string, score double, flagged boolean"
    spark = documents.sparkSession
    if scorer is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(scorer)  # counts of the bounded sample

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = own.categories
        least = np.array([own.thresholds[c] for c in names])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = own.documents(_Bag([sentences(t, config.stretch) for t in texts], own.vocabulary), len(texts))
            flat = scores.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(names))),
                    pa.array(names * len(texts), pa.string()),
                    pa.array(np.where(np.isfinite(flat), flat, 0.0), mask=~np.isfinite(flat)),
                    pa.array((scores >= least).ravel()),
                ],
                names=["doc_id", "category", "score", "flagged"],
            )

    chosen = documents.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return map_arrow(chosen, rate, schema)


def rates(scored: DataFrame, sources: DataFrame) -> DataFrame:
    """source, category, documents, flagged, rate: added up per source (null is a source), from scores and (doc_id, source)."""
    joined = scored.join(sources, "doc_id")
    out = joined.groupBy("source", "category").agg(F.count("*").alias("documents"), F.count(F.when(F.col("flagged"), 1)).alias("flagged"))
    return out.withColumn("rate", F.col("flagged") / F.col("documents"))
