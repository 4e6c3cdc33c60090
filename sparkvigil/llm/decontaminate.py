"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose which tokens of a window are hashed and which are ignored, so
a hit survives substitutions at ignored places. Training and test windows with
equal hashes are joined; around each hit the two texts are compared word by word
on the hit's diagonal, and the longest run with at least `similarity` equal
words, less unequal ends, is an overlap if it has `least_words` words, or the
whole item where that is shorter. An insertion moves
the diagonal; each side of it is found on its own.

The masks miss no overlap at a similarity of 0.8 or more. A run of L words with s
unequal ones inside has a stretch of (L - s) / (s + 1) equal words, rounded up:
four, which the mask 1111 meets, but for 10, 11 and 15 words at the limit and items of
five or six words. There stretches of 2 or 3 words lie at one ignored word, which
11011 meets; an item of five words has masks of its own for its second and fourth word.

The test side is sent to all tasks only if its words, counted first, are at most
`broadcast_words`; a larger one is joined by hash in a shuffle, after windows
are reduced to distinct hashes of each document and with each document compared
only with the items it shares a hash with. Both ways give the same rows.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; null or
empty texts have no words and no overlaps; items of fewer than `seed_least`
words are ignored, items of fewer than four match by their whole sequence;
repeated items count as they are, a null doc_id or item_id is kept as null;
further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Words, mix, slices, text_bytes, trimmed
from .store import documents, written

#: 1: the token counts; 0: it is ignored.
MASKS = ("1111", "11011")
SHORT_MASKS = ("10111", "11101")  # for items of just their span
_U = np.uint64
_FOUND = "doc_id long, item_id long, start_word long, n_words long, n_matched long"


def masks(least: int) -> list[tuple[str, int, bool]]:
    """(mask, salt, whether it is for items of just its span) of items of at least `least` words."""
    out = [(m, i, False) for i, m in enumerate(MASKS)] + [(m, 50 + i, True) for i, m in enumerate(SHORT_MASKS) if len(m) >= least]
    return out + [("1" * n, 100 + n, True) for n in range(least, len(MASKS[0]))]


def seed_hashes(h: np.ndarray, first: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each whole window under a mask, and its first word."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, salt, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : i + m] * _U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
    at = np.arange(m)
    row = np.searchsorted(first, at, "right") - 1
    ok = at + len(mask) <= first[row + 1]
    return mix(out[ok]), at[ok]


class Items:
    """The test side: word hashes of each item, and its windows sorted by hash."""

    def __init__(self, ids: list, texts: pa.Array, least: int):
        data, off = text_bytes(texts)
        w = Words(data, off)
        self.ids, self.hash, self.first = ids, w.hash, w.first
        size = np.diff(w.first)
        self.masks = [(mask, salt, size == len(mask) if whole else size >= max(least, len(mask))) for mask, salt, whole in masks(least)]
        self.masks = [m for m in self.masks if m[2].any()]
        seeds, items, places = [], [], []
        for mask, salt, on in self.masks:
            s, at = seed_hashes(w.hash, w.first, mask, salt)
            row = np.searchsorted(w.first, at, "right") - 1 if len(at) else at
            keep = on[row] if len(at) else np.zeros(0, bool)
            seeds.append(s[keep])
            items.append(row[keep])
            places.append(at[keep] - w.first[row[keep]])
        seeds, items, places = seeds or [np.zeros(0, np.uint64)], items or [np.zeros(0, np.int64)], places or [np.zeros(0, np.int64)]
        seed = np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], np.concatenate(items)[order], np.concatenate(places)[order]
        self.kinds, self.begin = np.unique(self.seed, return_index=True)
        self.begin = np.append(self.begin, len(self.seed))

    def hits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (row, item, word of the row at which the item would start)."""
        found = []
        for mask, salt, _ in self.masks:
            s, at = seed_hashes(h, first, mask, salt)
            if not len(s) or not len(self.kinds):
                continue
            k = np.searchsorted(self.kinds, s)
            k[k == len(self.kinds)] = 0
            ok = self.kinds[k] == s
            k, at = k[ok], at[ok]
            many = self.begin[k + 1] - self.begin[k]
            src = np.arange(many.sum()) + np.repeat(self.begin[k] - np.cumsum(many) + many, many)
            at = np.repeat(at, many)
            row = np.searchsorted(first, at, "right") - 1
            found.append(np.unique(np.stack([row, self.item[src], at - first[row] - self.place[src]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _alike(h: np.ndarray, first: np.ndarray, items: Items, hits: np.ndarray, similarity: float, least_words: int, words: int = 1 << 20) -> np.ndarray:
    """The hits on whose diagonal enough words are equal for an overlap; some `words` words are compared at once."""
    row, item, shift = hits.T
    a, n = items.first[item], items.first[item + 1] - items.first[item]
    lo = np.maximum(0, -shift)
    size = np.minimum(n, first[row + 1] - first[row] - shift) - lo  # a hit has at least one word
    to = np.concatenate([[0], np.cumsum(size)])
    equal, i = np.zeros(len(hits), np.int64), 0
    while i < len(hits):
        j = max(i + 1, int(np.searchsorted(to, to[i] + words, "right")) - 1)
        at = np.arange(to[j] - to[i]) + np.repeat(lo[i:j] - to[i:j] + to[i], size[i:j])
        same = h[at + np.repeat(first[row[i:j]] + shift[i:j], size[i:j])] == items.hash[at + np.repeat(a[i:j], size[i:j])]
        equal[i:j] = np.add.reduceat(same, to[i:j] - to[i], dtype=np.int64)
        i = j
    return hits[equal >= similarity * np.minimum(least_words, n)]


def overlaps(h: np.ndarray, first: np.ndarray, items: Items, similarity: float, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, words, equal words) of the best overlap of each diagonal with a hit."""
    out = []
    price = round(100 * similarity)
    for row, item, shift in _alike(h, first, items, items.hits(h, first), similarity, least_words).tolist():
        a, n = int(items.first[item]), int(items.first[item + 1] - items.first[item])
        lo, hi = max(0, -shift), min(n, int(first[row + 1] - first[row]) - shift)
        base = int(first[row]) + shift
        equal = h[base + lo : base + hi] == items.hash[a + lo : a + hi]
        need = min(least_words, n)
        # the longest run whose share of equal words is at least the similarity
        gain = np.concatenate([[0], np.cumsum(np.where(equal, 100 - price, -price))])
        low = np.minimum.accumulate(gain)
        since = np.searchsorted(-low, -gain)
        end = int((np.arange(len(gain)) - since).argmax())
        run = np.flatnonzero(equal[since[end] : end]) + since[end]  # it starts and ends with an equal word
        if len(run) and run[-1] + 1 - run[0] >= need:
            out.append((row, item, shift + lo + int(run[0]), int(run[-1] + 1 - run[0]), len(run)))
    return out


def _rows(doc_ids: pa.Array, found: list, ids: list) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [()] * 5
    docs = doc_ids.take(pa.array(cols[0], pa.int64()))
    return pa.RecordBatch.from_arrays([docs, pa.array([ids[i] for i in cols[1]], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "item_id", "start_word", "n_words", "n_matched"])


def _scan(shared, least: int, similarity: float, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value, least)
        for batch, data, off in trimmed(slices(batches)):
            w = Words(data, off)
            yield _rows(batch.column(0), overlaps(w.hash, w.first, items, similarity, least_words), items.ids)

    return run


def _distinct_seeds(least: int):
    """(key, seed) with each seed of a row once, for the join by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in trimmed(slices(batches)):
            w = Words(data, off)
            for mask, salt, _ in masks(least):
                s, at = seed_hashes(w.hash, w.first, mask, salt)
                row = np.searchsorted(w.first, at, "right") - 1 if len(at) else at
                u = np.unique(np.stack([row.astype(np.uint64), s], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(u[:, 0].astype(np.int64))), pa.array(u[:, 1].copy().view(np.int64))], names=["key", "seed"])

    return run


def _compare(least: int, similarity: float, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                data, off = text_bytes(r.column("text"))
                w = Words(data, off)
                items = Items(r.column("item_id").to_pylist(), r.column("item_text"), least)
                yield _rows(r.column("doc_id"), overlaps(w.hash, w.first, items, similarity, least_words), items.ids)

    return run


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, least_words: int = 13, seed_least: int = 5, broadcast_words: int = 400_000) -> DataFrame:
    """Every overlap of a document with a test item: doc_id, item_id, start_word, n_words, n_matched."""
    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    words = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+")))).first()[0] or 0
    if words <= broadcast_words:
        rows = items.orderBy("item_id", "text").collect()  # at most broadcast_words words
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string())))
        return docs.mapInArrow(_scan(shared, seed_least, similarity, least_words), _FOUND)
    seeds = lambda df: df.mapInArrow(_distinct_seeds(seed_least), "key long, seed long")
    test = seeds(items).withColumnRenamed("key", "item_id")
    pairs = written(seeds(docs).withColumnRenamed("key", "doc_id").join(test, "seed").select("doc_id", "item_id").distinct(), "pairs")
    # null ids are ids here, and rows that share one are all compared, as in the other way
    p, i, d = pairs.alias("p"), items.withColumnRenamed("text", "item_text").alias("i"), docs.alias("d")
    both = p.join(i, F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).join(d, F.col("p.doc_id").eqNullSafe(F.col("d.doc_id"))).select("d.doc_id", "d.text", "i.item_id", "i.item_text")
    return both.mapInArrow(_compare(seed_least, similarity, least_words), _FOUND)


def leaks(found: DataFrame) -> DataFrame:
    """One row for each document and item: the number of overlaps and the words of the longest."""
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_overlaps"), F.max("n_words").alias("n_words"), F.max("n_matched").alias("n_matched"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and item_id of each document with a passage of a benchmark item; clean documents have no row."""
    return leaks(contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
