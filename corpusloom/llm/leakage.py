"""Evaluation texts in a corpus, found by latent semantic retrieval.

Documents and items are cut into overlapping passages of words. A randomised singular value decomposition of TF-IDF passages,
its products summed over partitions, gives a latent space; passages near an item's passage by cosine are candidates for
paraphrases, and these are checked by their longest common subsequence and the item's answer. Common runs are found by hash in
all documents, since no cosine bounds them.

Terms are the words of items: others add nothing to any product with an item's passage.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfiguration
from ..functions.words import WORD
from ..session import checkpoint, map_arrow


@dataclass(frozen=True)
class LeakConfig:
    #: Consecutive words that make a leak for certain.
    words: int = 12
    #: Passages of two blocks of ``words`` words each, every block starting one: each run of ``words`` is whole in one.
    rank: int = 64
    oversampling: int = 16
    rounds: int = 2
    cosine: float = 0.5
    #: A paraphrase is a candidate of at least this cosine and share of common subsequence.
    paraphrase_cosine: float = 0.7
    paraphrase_share: float = 0.6
    #: Documents on which the decomposition is fitted; document frequencies count all of them.
    sample: int = 8192
    #: Items are a stated query set, held by every task in blocks of at most so many words (or one item); each block is one more pass over the documents.
    block_words: int = 200_000
    seed: int = 5

    def __post_init__(self) -> None:
        if self.words < 2 or min(self.rank, self.sample, self.block_words) < 1:
            raise InvalidConfiguration("words must be at least 2, rank, sample and block_words at least 1")


def normal_words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


class _Items:
    """The items' words as numbers, their passages and runs."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], size: int) -> None:
        self.ids = np.array([i for i, _, _ in rows], dtype=np.int64)
        texts = [normal_words(t) for _, t, _ in rows]
        answers = [normal_words(a) for _, _, a in rows]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for t in (*texts, *answers) for w in t}))}
        self.none = len(self.vocabulary)
        code = lambda t: np.array([self.vocabulary[w] for w in t], dtype=np.int32)
        self.words = [code(t) for t in texts]
        self.answers = [code(a) for a in answers]
        step = max(1, size // 2)
        #: Passages to be searched for
        self.passages = [(n, w[k : k + 2 * size]) for n, w in enumerate(self.words) for k in range(0, max(1, len(w) - 2 * size + step), step) if len(w)]
        runs = [(h, n, k) for n, w in enumerate(self.words) for k, h in enumerate(_runs(w, size, self.none).tolist())]
        runs.sort()
        self.run_hash = np.array([h for h, _, _ in runs], dtype=np.uint64)
        self.run_item = np.array([n for _, n, _ in runs], dtype=np.int64)
        self.run_at = np.array([k for _, _, k in runs], dtype=np.int64)


def _runs(codes: np.ndarray, size: int, none: int) -> np.ndarray:
    """Hash of the run of ``size`` words from each place."""
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    wide, out = codes.astype(np.uint64) + np.uint64(1), np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out ^ wide[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _dense(passages: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows over known words."""
    n = len(idf)
    lengths = np.array([len(p) for p in passages])
    rows, words = np.repeat(np.arange(len(passages)), lengths), np.concatenate(passages)
    known = words < n
    rows, words = rows[known], words[known]
    out = np.bincount(rows * n + words, weights=idf[words], minlength=len(passages) * n).reshape(len(passages), n).astype(np.float32)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size == 0, 1, size)


def _chunks(passages: list[np.ndarray], idf: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, 4_000_000 // max(len(idf), 1))
    for k in range(0, len(passages), step):
        yield _dense(passages[k : k + step], idf)


def encode(documents: DataFrame, items: _Items, id: str, text: str) -> DataFrame:
    """doc_id, codes: four bytes for each word, unknown ones as the size of the vocabulary."""
    vocabulary, none = items.vocabulary, items.none

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                if not t.isascii():
                    t = unicodedata.normalize("NFKC", t)
                out.append(np.array([get(w, none) for w in WORD.findall(t.lower())], dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "codes"])

    chosen = documents.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return map_arrow(chosen, code, "doc_id bigint, codes binary")


def _document_frequencies(encoded: DataFrame, n: int) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(n + 1, dtype=np.int64), 0
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total[np.unique(np.frombuffer(c, dtype=np.int32))] += 1
                documents += 1
        total[n] = documents
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total)], names=["code", "n"])

    rows = map_arrow(encoded.select("codes"), count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # as many rows as the items have words
    out = np.zeros(n + 1, dtype=np.int64)
    out[rows["code"]] = rows["n"]
    return out[:n], int(out[n])


#: Rows of a matrix that are added up together.
_ROWS = 1024


def latent_space(sample: DataFrame, items: _Items, idf: np.ndarray, config: LeakConfig) -> np.ndarray:
    """(words x rank) right singular vectors of the TF-IDF passages of ``sample`` and of all items.

    Each round sends a (words x rank) matrix to the tasks. What comes back is added up in blocks of rows by the tasks, so the driver gets one such matrix.
    """
    n, size, spark = len(idf), config.words, sample.sparkSession
    width = min(n, config.rank + config.oversampling)
    basis = np.linalg.qr(np.random.default_rng(config.seed).standard_normal((n, width)))[0].astype(np.float32)
    own = [p for _, p in items.passages]

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p) for p in parts["part"])
        return pd.DataFrame({"row": parts["row"][:1], "part": [total.tobytes()]})

    for _ in range(config.rounds):
        sent = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n, width), dtype=np.float64)
            for batch in batches:
                passages = [p for c in batch.column(0).to_pylist() for p in _cut(np.frombuffer(c, dtype=np.int32), size) if (p < n).sum() >= size]
                for a in _chunks(passages, idf):
                    out += a.T @ (a @ sent.value)
            rows = list(range(0, n, _ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([out[k : k + _ROWS].tobytes() for k in rows], pa.binary())], names=["row", "part"])

        parts = map_arrow(sample.select("codes").coalesce(16), multiply, "row bigint, part binary").groupBy("row").applyInPandas(add, "row bigint, part binary").collect()
        product = np.zeros((n, width))
        for r in parts:
            product[r["row"] : r["row"] + _ROWS] = np.frombuffer(bytes(r["part"])).reshape(-1, width)
        for a in _chunks(own, idf):
            product += a.T @ (a @ basis)
        left, _, _ = np.linalg.svd(product, full_matrices=False)
        basis = left.astype(np.float32)
    return basis[:, : config.rank]


def _cut(codes: np.ndarray, size: int) -> list[np.ndarray]:
    return [codes[k : k + 2 * size] for k in range(0, max(1, len(codes) - size), size)]


class _Search:
    """Passages of documents against those of items, in the latent space."""

    def __init__(self, items: _Items, idf: np.ndarray, basis: np.ndarray, config: LeakConfig) -> None:
        self.items, self.config = items, config
        self.places = np.concatenate((basis * idf[:, None], np.zeros((1, basis.shape[1])))).astype(np.float32)
        vectors = np.stack([self.places[p].sum(0) for _, p in items.passages])
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).T.copy()
        self.owner = np.array([n for n, _ in items.passages])
        # with fewer known words a passage can't share enough of any item's passage
        self.least_known = max(1, ceil(config.paraphrase_share * min(len(p) for _, p in items.passages)))

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """document, item, cosine, place of the document's passage, item's passage: the nearest of each document and item, and all that may be paraphrases.

        Rows of a document and item stand together, the nearest first.
        ``codes`` are the words of all documents, ``starts`` where each begins, and the end. None is empty.
        """
        size, known = self.config.words, codes < self.items.none
        lengths = np.diff(starts)
        blocks = np.maximum(1, -(-lengths // size))
        owner = np.repeat(np.arange(len(lengths)), blocks)
        first = np.concatenate(([0], np.cumsum(blocks)))
        at = starts[:-1][owner] + (np.arange(len(owner)) - first[:-1][owner]) * size
        count = np.add.reduceat(known.astype(np.int32), at)
        goes_on = np.concatenate((owner[1:] == owner[:-1], [False]))
        count = count + np.where(goes_on, np.concatenate((count[1:], [0])), 0)
        last = ~goes_on & np.concatenate(([False], owner[1:] == owner[:-1]))  # wholly in the passage before
        chosen = np.flatnonzero((count >= self.least_known) & ~last)
        found: list[tuple[np.ndarray, ...]] = []
        end = np.concatenate((at[1:], [len(codes)]))
        step = max(16, 4_000_000 // self.vectors.shape[1])  # products of a chunk take 16 MB
        for k in range(0, len(chosen), step):
            these = chosen[k : k + step]
            stop = np.where(goes_on[these], end[np.minimum(these + 1, len(end) - 1)], end[these])
            spans = stop - at[these]
            inside = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(at[these], spans)
            vectors = np.add.reduceat(self.places[codes[inside]], np.cumsum(spans) - spans, axis=0)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            product = vectors @ self.vectors
            near = np.flatnonzero((product >= self.config.cosine).ravel())
            a, b = near // product.shape[1], near % product.shape[1]
            found.append((owner[these][a], self.owner[b], product.ravel()[near], at[these][a], b))
        if not found:
            return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
        document, item, cosine, place, passage = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((-cosine, item, document))
        document, item, cosine, place, passage = document[order], item[order], cosine[order], place[order], passage[order]
        new = np.concatenate(([True], (document[1:] != document[:-1]) | (item[1:] != item[:-1])))[: len(document)]
        new |= cosine >= self.config.paraphrase_cosine
        return document[new], item[new], cosine[new], place[new], passage[new]

    def nearest(self, words: np.ndarray, item: int) -> tuple[float, int]:
        """The cosine of a passage and the nearest passage of an item, and which that is."""
        vector, own = self.places[words].sum(0), np.flatnonzero(self.owner == item)
        product = vector @ self.vectors[:, own] / max(float(np.linalg.norm(vector)), 1e-9)
        best = int(product.argmax())
        return float(product[best]), int(own[best])

    def longest_runs(self, codes: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """The longest run of common words, where it has ``words`` or more, of each document and item, and its place; whatever their cosine."""
        size, items = self.config.words, self.items
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(items.run_hash) or len(codes) < size:
            return out
        hashes = _runs(codes, size, items.none)
        strange = np.concatenate(([0], np.cumsum(codes == items.none)))
        places = np.flatnonzero(strange[size:] == strange[:-size])  # no word is unknown
        at = np.searchsorted(items.run_hash, hashes[places])
        at[at == len(items.run_hash)] = 0
        hit = items.run_hash[at] == hashes[places]
        places, at = places[hit], at[hit]
        owners = np.searchsorted(starts, places, "right") - 1
        for p, q, d in zip(places.tolist(), at.tolist(), owners.tolist(), strict=True):
            end = int(starts[d + 1])
            if p + size > end:
                continue
            while q < len(items.run_hash) and items.run_hash[q] == hashes[p]:
                n, k = int(items.run_item[q]), int(items.run_at[q])
                q += 1
                theirs = items.words[n]
                if np.array_equal(codes[p : p + size], theirs[k : k + size]):
                    most = min(end - p, len(theirs) - k)
                    differ = np.flatnonzero(codes[p : p + most] != theirs[k : k + most])
                    length = int(differ[0]) if len(differ) else most
                    if length > out.get((d, n), (0, 0))[0]:
                        out[d, n] = length, p
        return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _holds(codes: np.ndarray, part: np.ndarray) -> bool | None:
    if not len(part):
        return None
    n = len(codes) - len(part) + 1
    if n < 1:
        return False
    same = codes[:n] == part[0]
    for k in range(1, len(part)):
        same &= codes[k : k + n] == part[k]
    return bool(same.any())


SCHEMA = "doc_id bigint, item_id bigint, cosine double, near boolean, run bigint, subsequence double, answer boolean, kind string"


def leaks(documents: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, near, run, subsequence, answer, kind of every document that holds part of an item.

    ``kind`` is exact (``run``, the longest run of common words, has ``words`` or more) or paraphrase (no such run, but cosine and the share
    of the longest common subsequence of two passages reach their limits; the nearest such passages are shown). ``answer`` says whether the item's answer stands in the
    document; null without an answer. ``near`` says whether the cosine search found the pair, which shows its recall of the exact ones. Items are (item_id, text, answer); repeated ids count once. Rows with a null id or
    text give nothing; documents are told apart by row, so an id given twice may come twice. Other columns are ignored.
    """
    own = items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"), F.min("answer").alias("answer")).orderBy("item_id")
    out = documents.sparkSession.createDataFrame([], SCHEMA)
    for block in _blocks(own, config):
        known = _Items(block, config.words)
        if known.passages:
            out = out.unionByName(_leaks_of(documents, known, config, id, text))
    return out


def _blocks(items: DataFrame, config: LeakConfig) -> Iterator[list[tuple[int, str | None, str | None]]]:
    """Items in blocks of bounded size, read one partition at a time."""
    block, held = [], 0
    for r in items.toLocalIterator():
        size = len(r["text"] or "") // 4 + len(r["answer"] or "") // 4 + 1  # no fewer than its words, as a rule
        if block and held + size > config.block_words:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"], r["answer"]))
        held += size
    if block:
        yield block


def _leaks_of(documents: DataFrame, known: _Items, config: LeakConfig, id: str, text: str) -> DataFrame:
    spark, size = documents.sparkSession, config.words
    encoded = checkpoint(encode(documents, known, id, text))
    frequency, total = _document_frequencies(encoded, known.none)
    idf = np.log((total + 1) / (frequency + 1)).astype(np.float32) + np.float32(1e-3)
    every = max(1, total // config.sample)
    sample = encoded.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    basis = latent_space(sample, known, idf, config)
    sent = spark.sparkContext.broadcast(_Search(known, idf, basis, config))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = sent.value
        for batch in batches:
            kept = [(i, np.frombuffer(c, dtype=np.int32)) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(c)]
            out: list[tuple] = []
            if kept:
                starts = np.concatenate(([0], np.cumsum([len(c) for _, c in kept])))
                codes = np.concatenate([c for _, c in kept])
                document, item, cosine, place, passage = engine.candidates(codes, starts)
                runs = engine.longest_runs(codes, starts)
                pairs = list(zip(document.tolist(), item.tolist(), cosine.tolist(), place.tolist(), passage.tolist(), strict=True))
                near = {(d, n) for d, n, *_ in pairs}
                for (d, n), (_, p) in runs.items():
                    if (d, n) not in near:
                        p -= (p - int(starts[d])) % size
                        c, q = engine.nearest(codes[p : min(p + 2 * size, starts[d + 1])], n)
                        pairs.append((d, n, c, p, q))
                done: set[tuple[int, int]] = set()
                for d, n, c, p, q in pairs:
                    run = runs.get((d, n), (0, 0))[0]
                    if (d, n) in done or not run and c < config.paraphrase_cosine:
                        continue
                    theirs = engine.items.passages[q][1]
                    share = common_subsequence(codes[p : min(p + 2 * size, starts[d + 1])].tolist(), theirs.tolist()) / max(1, len(theirs))
                    if run or share >= config.paraphrase_share:
                        done.add((d, n))
                        answer = _holds(kept[d][1], engine.items.answers[n])
                        out.append((kept[d][0], int(engine.items.ids[n]), c, (d, n) in near, run, share, answer, "exact" if run else "paraphrase"))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "near", "run", "subsequence", "answer", "kind"])

    return map_arrow(encoded, search, SCHEMA)
