"""Language identification of mixed-language text by word scores and Viterbi.

Training counts, over all documents of the training side, the byte n-grams (2
to 4 bytes, with word edges) and whole words of each language, hashed into a
fixed number of buckets, and its letters by script. A word's script narrows the
candidates to the languages with a real share of their letters in it; its score
for a candidate is the sum of the log-probabilities of its n-grams. A Viterbi
path over the words of a text, with a penalty for each switch, labels spans; the
text's language is the one whose spans hold most letters, and the score their
share of all letters.

A text whose best single-language path cannot be improved by any switch (no
stretch of words gains another language more than half a penalty) is settled
from running sums; only the others go through the recursion, all texts of a
slice at a time. The result is the exact Viterbi path either way.

The model has languages x buckets counts, summed in tasks; at most
`MAX_LANGUAGES` languages are admitted, so what is sent out is bounded.

Defined results: null or empty text, or text without a letter, is `und` with
score 0; rows with a null language or null text teach nothing; a null doc_id
counts as an empty id; A-Z is read as a-z; ties go to the first language in
alphabetical order; further columns are ignored; without any training row every
text is `und`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, WS, Words, add_per_row, mapper, prefix_hash, slices, span_hash, trimmed
from .store import documents, written

BITS, BLOCK, MAX_LANGUAGES = 16, 4096, 128
#: Ends of code point ranges and their scripts; scripts not named share one.
SCRIPTS = (
    (0x0250, "Latin"), (0x0370, "Other"), (0x0400, "Greek"), (0x0530, "Cyrillic"), (0x0590, "Armenian"), (0x0600, "Hebrew"), (0x0780, "Arabic"),
    (0x0900, "Other"), (0x0980, "Devanagari"), (0x0A00, "Bengali"), (0x0A80, "Gurmukhi"), (0x0B00, "Gujarati"), (0x0B80, "Oriya"), (0x0C00, "Tamil"),
    (0x0C80, "Telugu"), (0x0D00, "Kannada"), (0x0D80, "Malayalam"), (0x0E00, "Sinhala"), (0x0E80, "Thai"), (0x0F00, "Lao"), (0x1000, "Tibetan"),
    (0x10A0, "Burmese"), (0x1100, "Georgian"), (0x1200, "Hangul"), (0x1380, "Ethiopic"), (0x1E00, "Other"), (0x1F00, "Latin"), (0x2000, "Greek"),
    (0x3040, "Other"), (0x3100, "Kana"), (0x3400, "Other"), (0xA000, "Han"), (0xAC00, "Other"), (0xD7B0, "Hangul"), (0x20000, "Other"), (0x30000, "Han"), (0x110000, "Other"),
)
_NAMES = sorted({s for _, s in SCRIPTS})
N_SCRIPTS = 64
_SIZE = (1 << BITS) + BLOCK  # the last block has the letters by script
_ENDS = np.array([e for e, _ in SCRIPTS])
_KIND = np.array([_NAMES.index(s) for _, s in SCRIPTS])


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte starts a letter, and the letter's script."""
    n = len(data)
    d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    a, b, c, e = d[:n], d[1 : n + 1] & 63, d[2 : n + 2] & 63, d[3 : n + 3] & 63
    cp = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | e)))
    start = (data & 0xC0) != 0x80
    letter = start & _is_letter()[np.minimum(cp, 0x10FFFF)]
    script = _KIND[np.minimum(np.searchsorted(_ENDS, cp, "right"), len(_KIND) - 1)]
    return letter, script


class Features:
    """Words of a slice, and its distinct words with the buckets of their n-grams."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.words = w = Words(data, off)
        _, pick, self.kind = np.unique(w.hash, return_index=True, return_inverse=True)
        letter, script = letters(w.data)
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum(letter, out=upto[1:])
        self.letters = upto[w.end] - upto[w.start]
        at = np.flatnonzero(letter)
        self.letter_row = np.searchsorted(off, at, "right") - 1
        self.letter_script = script[at]
        first_letter = np.searchsorted(at, w.start)
        self.script = np.where(self.letters > 0, self.letter_script[np.minimum(first_letter, max(len(at) - 1, 0))] if len(at) else 0, 0)
        # distinct words laid out with one blank before each and one at the end
        n, begin = len(pick), w.start[pick]
        size = w.end[pick] - begin + 1
        to = np.concatenate([[0], np.cumsum(size)])
        total = int(to[-1]) + 1
        flat = np.full(total, 0x20, np.uint8)
        src = np.arange(int(to[-1]) - n) + np.repeat(begin - (to[:-1] - np.arange(n)), size - 1)
        flat[np.arange(int(to[-1]) - n) + np.repeat(np.arange(1, n + 1), size - 1)] = LOWER[w.data[src]] if n else flat[:0]
        self.n, self.lettered = n, self.letters[pick] > 0
        of = np.repeat(np.arange(n), size)
        v = flat.astype(np.uint64)
        gram, self.grams = v[:-1], []
        for k in (2, 3, 4):
            m = total - k + 1
            if m <= 0 or not n:
                break
            gram = gram[:m] << np.uint64(8) | v[k - 1 :]
            inside = np.ones(m, bool)  # a blank stands at an end only
            for i in range(1, k - 1):
                inside &= flat[i : i + m] != 0x20
            p = np.flatnonzero(inside)
            word = of[np.minimum(p, int(to[-1]) - 1)]
            self.grams.append((self._bucket(gram[p], k), word))
        if n:
            h = span_hash(prefix_hash(flat), to[:-1] + 1, to[1:])
            self.grams.append((self._bucket(h, 9), np.arange(n)))

    @staticmethod
    def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
        return ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, block, counts) of a task's rows (doc_id, text, lang)."""
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            for b in range(_SIZE // BLOCK):
                part = c[b * BLOCK : (b + 1) * BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["lang", "block", "counts"])
        held.clear()

    for batch, data, off in trimmed(slices(batches)):
        f = Features(data, off)
        names = batch.column(2).to_pylist()
        row = np.repeat(np.arange(len(off) - 1), np.diff(f.words.first))
        code = {x: i for i, x in enumerate(sorted(set(names)))}
        of_row = np.array([code[x] for x in names])
        total = np.zeros((len(code), _SIZE), np.int64)
        for i in range(len(code)):
            times = np.bincount(f.kind[of_row[row] == i], minlength=f.n) * f.lettered
            for bucket, word in f.grams:
                total[i] += np.bincount(bucket, times[word], minlength=_SIZE).astype(np.int64)
        total += np.bincount(of_row[f.letter_row] * _SIZE + (1 << BITS) + f.letter_script, minlength=total.size).reshape(total.shape)
        for x, i in code.items():
            held[x] = held[x] + total[i] if x in held else total[i].copy()
        if len(held) > MAX_LANGUAGES:
            yield from rows()
    yield from rows()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds counts up by (lang, block) within a task, a row at a time."""
    held: dict[tuple, np.ndarray] = {}
    for b in batches:
        for lang, block, raw in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            c = np.frombuffer(raw, "<i8")
            held[lang, block] = held[lang, block] + c if (lang, block) in held else c
    for (lang, block), c in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["lang", "block", "counts"])


class Model:
    """Log-probabilities of buckets (bucket x language) and the candidates of each script."""

    def __init__(self, rows: list, penalty: float, least_share: float):
        self.langs = sorted({r[0] for r in rows})
        if len(self.langs) > MAX_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages; at most {MAX_LANGUAGES} are admitted")
        c = np.zeros((len(self.langs), _SIZE))
        for lang, block, raw in rows:
            c[self.langs.index(lang), block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, "<i8")
        grams, by_script = c[:, : 1 << BITS], c[:, 1 << BITS :][:, :N_SCRIPTS]
        p = (grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * (1 << BITS))
        self.log_p = np.ascontiguousarray(np.log(p).T.astype(np.float32))
        share = by_script / np.maximum(by_script.sum(1, keepdims=True), 1)
        on = share >= least_share
        on[:, ~on.any(0)] = True  # a script that none has: all are candidates
        self.bar = np.where(on.T, 0.0, -1e3)
        self.penalty = penalty

    def word_scores(self, f: Features) -> np.ndarray:
        """(word, language) scores; words without letters score 0 for all."""
        out = np.zeros((f.n, len(self.langs)))
        for bucket, word in f.grams:  # words ascend
            head = np.flatnonzero(np.diff(word, prepend=-1))
            if len(head):
                out[word[head]] += np.add.reduceat(self.log_p[bucket], head, axis=0)
        out -= out.max(1, keepdims=True) if f.n else 0
        out = out[f.kind] + self.bar[f.script]
        out[f.letters == 0] = 0
        return out

    def labels(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The Viterbi path: a language for each word, texts being words first[i]:first[i + 1]."""
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        total = np.stack([add_per_row(np.ascontiguousarray(e[:, s]), first) for s in range(e.shape[1])], axis=1)
        best = total.argmax(1)
        label = best[row]
        settled = np.ones(n, bool)
        begin = row * 1e7
        for s in range(e.shape[1]):
            gain = e[:, s] - e[np.arange(len(e)), label]
            up = np.cumsum(gain)
            before = up - gain
            low = np.minimum.accumulate(before - begin) + begin  # of this text: each starts far below the one before
            settled[np.unique(row[up - low > self.penalty / 2 - 1e-6])] = False
        for rows in [np.flatnonzero(~settled & (np.diff(first) > 0))]:
            if len(rows):
                self._path(e, first, rows, label)
        return label

    def _path(self, e: np.ndarray, first: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
        size = first[rows + 1] - first[rows]
        order = np.argsort(-size, kind="stable")
        rows, size = rows[order], size[order]
        # words by their place in the text, so each step reads one stretch
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        to = np.concatenate([[0], np.cumsum(live)])
        word = np.repeat(first[rows], size) + (step := np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        word = word[np.lexsort((np.repeat(np.arange(len(rows)), size), step))]
        score, back = e[word], np.zeros(e[word].shape, np.int8)
        k, edges = e.shape[1], to.tolist()
        own = np.arange(k, dtype=np.int8)
        v = score[: edges[1]].copy()
        for a, z in zip(edges[1:], edges[2:], strict=False):
            w = v[: z - a]
            jump = w.max(1, keepdims=True) - self.penalty
            back[a:z] = np.where(w >= jump, own, w.argmax(1)[:, None])
            v[: z - a] = np.maximum(w, jump) + score[a:z]
        state, path, flat, line = v.argmax(1), np.empty(len(word), np.int64), back.ravel(), np.arange(len(rows)) * k
        for a, z in zip(edges[-2::-1], edges[:0:-1], strict=True):
            m = z - a
            path[a:z] = state[:m]
            if a:
                state[:m] = flat[a * k + line[:m] + state[:m]]
        label[word] = path


def train(docs: DataFrame, penalty: float = 12.0, least_share: float = 0.01) -> Model:
    """The model of the rows (text, lang) of docs with neither null."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang").mapInArrow(_counts, "lang string, block int, counts binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "lang string, block int, counts binary"
    once = rows.withColumn("salt", F.spark_partition_id() % 32).repartition(parts, "lang", "block", "salt").select("lang", "block", "counts").mapInArrow(_sums, ddl)
    twice = written(once, "partial").repartition(parts, "lang", "block").mapInArrow(_sums, ddl)
    return Model([tuple(r) for r in twice.collect()], penalty, least_share)  # at most (MAX_LANGUAGES + 1) x 17 blocks pass


def _predict(shared):
    def work(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        model: Model = shared.value
        f = Features(data, off)
        first, n, k = f.words.first, len(off) - 1, max(1, len(model.langs))
        names = np.array([*model.langs, "und"], object)
        row = np.repeat(np.arange(n), np.diff(first))
        share = np.zeros((n, k))
        spans = np.zeros(n, np.int64)
        if model.langs and len(f.words):
            label = model.labels(model.word_scores(f), first)
            share = np.bincount(row * k + label, f.letters, minlength=n * k).reshape(n, k)
            change = np.ones(len(f.words), bool)
            change[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
            spans = add_per_row(change.astype(np.int64), first)
        total = share.sum(1)
        best = np.where(total > 0, share.argmax(1), len(model.langs))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": names[best].tolist(), "score": share.max(1) / np.maximum(total, 1), "n_spans": spans}

    return mapper(work, pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the number of one-language spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def with_fold(docs: DataFrame, modulus: int) -> DataFrame:
    """Adds held_out: crc32 of the doc_id as text leaves 2."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fold(documents(spark, sf_dir).select("doc_id", "text", "lang"), 4)
    return predict(docs, train(docs.where("not held_out")))


__all__ = ["Model", "op4_language_id", "predict", "train", "with_fold", "WS"]
