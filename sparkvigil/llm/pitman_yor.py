"""Language-model scores by a hierarchical Pitman-Yor model.

Two levels of restaurants over a uniform base. The root serves words to all; each
context, the word before a token, has a restaurant of its own, and these
restaurants share the root as parent. The start of a text is a context; the end
of a text is a token. Totals of frequent words' restaurants go to all tasks. These
words are those with at least so many occurrences that no more than `contexts`
words have them, so this is bounded. Totals of all other restaurants are added up
in buckets of contexts after each sweep, and go back to just those shards that
have dishes or tokens of them: the model is the same for any `contexts`.

The state of a dish in a restaurant is its number of tables t among its c
customers; given all else, t has the conditional of the Chinese restaurant,
  p(t) ~ S(c, t; d) * prod over i < t of (theta + d * (T + i)) * parent ** t,
with generalised Stirling numbers S, by recursion up to `KNOWN` customers, and
beyond by their saddle point, corrected by what it misses at `KNOWN`, where t
stands at the same share of c ** d. Dishes of up to `EXACT` customers are drawn
from it, larger ones moved by Metropolis steps. A sweep of Gibbs sampling draws all dishes given the totals of the sweep before (T, and the
root's customers and tables), then new totals are added up: these are exact, one
set for all tasks. Random numbers depend on (word, context, sweep) alone. So the
model is one model: it does not depend on the number of partitions, and in each
context the probabilities of all words and of the unseen class add up to 1. A
score averages the predictive probabilities of the sweeps kept. Discounts are
n1 / (n1 + 2 n2) of the training counts at each level; strengths are parameters.

Everything about a word lies in one shard (shards are dealt by word hash). The
texts are read three times: for the vocabulary, for the counts, which only the
dishes with two customers or more take into the sweeps (one customer has one
table), and to deal every token to its word's shard, where counts and scores
meet; a text's parts of its score come back as one row for each shard it has
tokens in, and are added up.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; null or
empty text is its end token alone; rows that share a doc_id stay rows of their
own (they are numbered inside); a null doc_id counts as an empty id; further
columns are ignored; with no training document counts are 0 and the score is
that of the base; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Words, mix, packed, slices, trimmed
from .language_id import with_fold
from .store import bucketed, documents, forgotten, written

EXACT, KNOWN, CHUNK = 40, 800, 1024
START, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x1D8AF066F0F0A5B3)
_U = np.uint64
FAR = _U(1 << 16)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash of each token, offsets): words of each text and its end."""
    w = Words(data, off)
    n = len(off) - 1
    to = w.first + np.arange(n + 1)
    h = np.full(to[-1], END, np.uint64)
    h[np.arange(len(w)) + np.repeat(np.arange(n), np.diff(w.first))] = w.hash
    return h, to


def contexts_of(h: np.ndarray, to: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Restaurant of each token: i + 1 is that of frequent[i]; those of other words have the word's hash, at least `FAR`."""
    before = np.full(len(h), START)
    before[1:] = h[:-1]
    before[to[:-1]] = START
    at = np.minimum(np.searchsorted(frequent, before), len(frequent) - 1)
    return np.where(frequent[at] == before, (at + 1).astype(np.uint64), np.maximum(before, FAR))


def _codes(names: np.ndarray) -> np.ndarray:
    """Restaurants in two bytes: 0 for those from `FAR` on, whose names lie apart."""
    return np.where(names < FAR, names, _U(0)).astype("<u2")


def _names(codes: np.ndarray, far: np.ndarray) -> np.ndarray:
    out = codes.astype(np.uint64)
    out[codes == 0] = far
    return out


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) % _U(shards)).astype(np.int64)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, head) if len(head) else values[:0]


# vocabulary


def _census(shards: int):
    """Words of the training texts with their counts in a slice, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in trimmed(slices(batches)):
            u, n = np.unique(tokens(data, off)[0], return_counts=True)
            s = _shard(u, shards)
            o = np.argsort(s, kind="stable")
            edge = np.searchsorted(s[o], np.arange(shards + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards), pa.int32()), packed(u[o].astype("<u8"), edge), packed(n[o].astype("<u4"), edge)], names=["shard", "words", "counts"])

    return run


def _octave(n: np.ndarray) -> np.ndarray:
    """Quarter of an octave that a count falls into."""
    return np.floor(4 * np.log2(n)).astype(np.int64)


def _census_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct words and their counts."""
    words, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def merged() -> None:
        nonlocal words, counts, held
        u, place = np.unique(np.concatenate(words), return_inverse=True)
        words, counts, held = [u], [np.bincount(place, np.concatenate(counts), minlength=len(u)).astype(np.int64)], 0

    for b in trimmed(batches):
        for w, n in zip(b.column(1), b.column(2), strict=True):
            words.append(np.frombuffer(w.as_buffer(), "<u8"))
            counts.append(np.frombuffer(n.as_buffer(), "<u4").astype(np.int64))
            held += len(words[-1])
        if held > 1 << 20:
            merged()
    merged()
    for at in range(0, len(words[0]), 1 << 16):
        w, n = words[0][at : at + (1 << 16)], counts[0][at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n), pa.array(_octave(n), pa.int32())], names=["word", "count", "octave"])


# counts and seating


def _deal(shards: int, frequent, rows: bool):
    """(context, word) pairs of a slice, packed by shard, with their counts, or the rows that have them; `part` flags training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in trimmed(slices(batches)):
            h, to = tokens(data, off)
            c = contexts_of(h, to, frequent.value)
            row = np.repeat(np.arange(len(off) - 1), np.diff(to))
            s = _shard(h, shards)
            o = np.lexsort((row, c, h, s)) if rows else np.lexsort((c, h, s))
            h, c, s = h[o], c[o], s[o]
            head = _heads(h, c)
            c = c[head]
            apart = c >= FAR
            size = np.diff(np.append(head, len(h)))
            edge = np.searchsorted(s, np.arange(shards + 1))
            kinds = np.searchsorted(head, edge)
            key, train = 0, b""
            nothing = packed(np.zeros(0, "<u2"), np.zeros(shards + 1, np.int64))
            if rows:
                key = batch.column(0)[0].as_py()  # the slice's first row number names it
                train = np.packbits(~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)).tobytes()
            at = packed(row[o].astype("<u2" if len(off) <= 1 << 16 else "<u4"), edge) if rows else nothing
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(shards), pa.int32()), pa.array([key] * shards, pa.int64()), at, packed(size.astype("<u4"), kinds), packed(_codes(c), kinds), packed(h[head].astype("<u8"), kinds), pa.array([train] * shards, pa.binary()), packed(c[apart].astype("<u8"), np.append(0, np.cumsum(apart))[kinds])],
                names=_PACK_NAMES,
            )
            if rows:  # the rows themselves go along to a shard
                ids = batch.column(3)
                flags = np.stack([batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)])
                told = [np.diff(to).astype("<u4"), np.zeros(0, "u1"), flags, pc.fill_null(ids, 0).to_numpy().astype("<i8"), np.zeros(0, "u1"), np.zeros(0, "u1")]
                yield pa.RecordBatch.from_arrays([pa.array([key % shards], pa.int32()), pa.array([key], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in told]], names=_PACK_NAMES)

    return run


_PACK = "shard int, batch long, row binary, size binary, context binary, word binary, part binary, far binary"
_PACK_NAMES = [x.split()[0] for x in _PACK.split(", ")]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows sorted by shard: each shard with its rows."""
    now, held = None, []
    for b in trimmed(batches):
        for shard, *x in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(x)
    if held:
        yield now, held


def _at(x, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _planes(values: np.ndarray) -> bytes:
    """Numbers of four bytes, first bytes first: small ones compress well so."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(x) -> np.ndarray:
    return np.ascontiguousarray(_at(x, "u1").reshape(4, -1).T).view("<u4").ravel()


def _merged(word: list, context: list, count: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of equal word and context added up, sorted by word and context."""
    word, context, count = np.concatenate(word), np.concatenate(context), np.concatenate(count)
    o = np.lexsort((context, word))
    word, context, count = word[o], context[o], count[o].astype(np.int64)
    head = _heads(word, context)
    return word[head], context[head], _sums(count, head)


class Totals:
    """What a task adds to the totals of the model, as rows of chunks: (chunk, sums)."""

    def __init__(self, restaurants: int):
        self.size = -(-restaurants // CHUNK) * CHUNK
        self.parts: dict[int, np.ndarray] = {}

    def add(self, kind: int, at: np.ndarray, value: np.ndarray | None = None) -> None:
        v = self.parts.setdefault(kind, np.zeros(self.size, np.int64))
        v += np.bincount(at, value, minlength=self.size).astype(np.int64)

    def rows(self) -> tuple[list[int], list[bytes]]:
        out = [(kind * (self.size // CHUNK) + i, part.tobytes()) for kind, v in self.parts.items() for i, part in enumerate(v.astype("<i8").reshape(-1, CHUNK)) if part.any()]
        return [k for k, _ in out], [b for _, b in out]


def _add_chunks(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for x in table.column("words"):
        total += _at(x, "<i8")
    return pa.table({"chunk": pa.array([table.column("at")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


#: Rows of a state, by kind: a shard's dishes; a chunk (`at`) of the totals of a task; restaurants from `FAR` on that a shard has dishes of, in bucket `at`.
DISHES, CHUNKS, RESTAURANTS = range(3)
_STATE = "shard int, kind int, at int, words binary, fixed binary, of binary, context binary, count binary, tables binary, root binary, far binary, alone binary"
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), *[pa.array(c, pa.binary()) for c in cols[3:]]], names=_STATE_NAMES)


def _totals_batch(totals: Totals, shard: int) -> pa.RecordBatch:
    keys, sums = totals.rows()
    return _state_batch([(shard, CHUNKS, k, b, *[b""] * 8) for k, b in zip(keys, sums, strict=True)])


def _far_batches(shard: int, shards: int, names: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the values (tables, customers, dishes with one customer) by restaurant, as rows by bucket."""
    u, place = np.unique(names, return_inverse=True)
    sums = [np.bincount(place, v, minlength=len(u)).astype("<u4") for v in values]
    s = _shard(u, shards)
    o = np.argsort(s, kind="stable")
    edge = np.searchsorted(s[o], np.arange(shards + 1))
    u, sums = u[o].astype("<u8"), [v[o] for v in sums]
    rows = []
    for k in np.flatnonzero(np.diff(edge)).tolist():
        i, j = edge[k], edge[k + 1]
        tables, customers, alone = (*(v[i:j].tobytes() for v in sums), b"", b"")[:3]
        rows.append((shard, RESTAURANTS, k, u[i:j].tobytes(), customers, b"", b"", b"", tables, b"", b"", alone))
    if rows:
        yield _state_batch(rows)


#: Kinds of totals: customers of restaurants, their dishes with one customer, tables of the others; and in the first places
#: of the last: the root's customers and tables, dishes with one and with two customers, words with one and with two.
CUSTOMERS, SINGLES, TABLES, ROOT = range(4)


def _seat(restaurants: int, shards: int):
    """The counts of a shard: its dishes of two customers or more, with one table each; of other dishes only the root's customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(restaurants)
        for shard, rows in _by_shard(batches):
            word, context, count = _merged([_at(x[4], "<u8") for x in rows], [_names(_at(x[3], "<u2"), _at(x[6], "<u8")) for x in rows], [_at(x[2], "<u4") for x in rows])
            if not len(word):
                continue
            head = _heads(word)
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(word))))
            code, one = _codes(context), count == 1
            near, many = code > 0, ~one
            totals.add(CUSTOMERS, code[near], count[near])
            totals.add(SINGLES, code[near & one])
            totals.add(TABLES, code[near & many])
            fixed = np.bincount(of, one, minlength=len(head)).astype(np.int64)
            guests = fixed + np.bincount(of[many], minlength=len(head))
            totals.add(ROOT, np.arange(6), np.array([guests.sum(), len(head), one.sum(), (count == 2).sum(), (guests == 1).sum(), (guests == 2).sum()]))
            tables = np.ones(int(many.sum()), "<u4")
            yield _state_batch([(shard, DISHES, -1, word[head].astype("<u8").tobytes(), fixed.astype("<u4").tobytes(), of[many].astype("<u4").tobytes(), code[many].tobytes(), count[many].astype("<u4").tobytes(), tables.tobytes(), np.ones(len(head), "<u4").tobytes(), context[many & ~near].astype("<u8").tobytes(), b"")])
            yield from _far_batches(shard, shards, context[~near], many[~near], count[~near], one[~near])
        if totals.parts:
            yield _totals_batch(totals, shard)

    return run


_NOTES = "shard int, names binary, tables binary, alone binary"
_NOTES_NAMES = [x.split()[0] for x in _NOTES.split(", ")]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of the restaurants of a bucket over all shards, for each shard that draws dishes of them; with them, after the seating, their dishes with one customer."""
    for _, rows in _by_shard(batches):
        u, place = np.unique(np.concatenate([_at(x[1], "<u8") for x in rows]), return_inverse=True)
        mine = np.concatenate([_at(x[2], "<u4") for x in rows])
        tables = np.bincount(place, mine, minlength=len(u)).astype("<u4")
        first = len(rows[0][3].as_buffer()) > 0
        alone = np.bincount(place, np.concatenate([_at(x[3], "<u4") for x in rows]), minlength=len(u)).astype("<u4") if first else tables[:0]
        at, out = 0, []
        for shard, names, *_ in rows:
            k = place[at : at + len(names.as_buffer()) // 8]
            k = k[mine[at : at + len(k)] > 0]
            at += len(names.as_buffer()) // 8
            if len(k):
                out.append((shard.as_py(), u[k].tobytes(), tables[k].tobytes(), alone[k].tobytes() if first else b""))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_NOTES_NAMES)


def _met(state: DataFrame, shards: int) -> DataFrame:
    """The dishes of a state, each shard with what its restaurants from `FAR` on hold in all; the state is not shuffled."""
    rows = state.where(F.col("kind") == RESTAURANTS).select("at", "shard", "words", "tables", "alone")
    notes = rows.repartition(shards, "at").sortWithinPartitions("at").mapInArrow(_meet, _NOTES)
    notes = notes.groupBy("shard").agg(*(F.collect_list(c).alias(f"{c}_met") for c in _NOTES_NAMES[1:]))
    return state.where(F.col("kind") == DISHES).drop("kind", "at").join(notes, "shard", "left")


@functools.cache
def log_stirling(n: int, discount: float) -> np.ndarray:
    """Logarithms of S(c, t; d) for c, t <= n: S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    for c in range(n):
        t = np.arange(1, c + 2)
        stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)) + out[c, t], -np.inf)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], stay)
    return out



def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithms of the gamma function for x > 0, by Stirling's series from x + 8."""
    y = x + 8.0
    shift = np.log(x)
    for i in range(1, 8):
        shift += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def saddle_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of S(c, t; d) up to a term of c alone, from the saddle point of their generating function ((1 - (1 - z)^d) / d)^t / t!."""
    c, t = c.astype(float), np.minimum(t, c - 1).astype(float)
    low, high = np.full(len(c), -25.0), np.full(len(c), 8.0)
    for _ in range(36):  # z = 1 - exp(-exp(x)), where z f'(z) / f(z) = c / t
        x = (low + high) / 2
        s = np.exp(x)
        up = d * -np.expm1(-s) * np.exp(s * (1 - d)) / -np.expm1(-d * s) < c / t
        low, high = np.where(up, x, low), np.where(up, high, x)
    s = np.exp((low + high) / 2)
    z, f = -np.expm1(-s), -np.expm1(-d * s) / d
    g = z * np.exp(s * (1 - d)) / f
    curve = t * (g + z * z * (1 - d) * np.exp(s * (2 - d)) / f - g * g)
    return -log_gamma(t + 1) + t * np.log(f) - c * np.log(z) - 0.5 * np.log(2 * math.pi * np.maximum(curve, 1e-300))


def log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of S(c, t; d), beyond `KNOWN` customers up to a term of c alone."""
    table = log_stirling(KNOWN, d)
    out = table[np.minimum(c, KNOWN), np.minimum(t, KNOWN)]
    far = np.flatnonzero(c > KNOWN)
    if len(far):
        k = np.arange(1, KNOWN)
        missed = table[KNOWN, k] - saddle_stirling(np.full(len(k), KNOWN), k, d)
        out[far] = saddle_stirling(c[far], t[far], d) + np.interp(np.log(t[far]) - d * np.log(c[far]), np.log(k) - d * math.log(KNOWN), missed)
    return out


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (mix(key + _U((0x9E3779B97F4A7C15 * (step + 1)) & (2**64 - 1))) >> _U(11)) * 2.0**-53


def sample_tables(c: np.ndarray, t: np.ndarray, others: np.ndarray, log_parent: np.ndarray, theta: float, d: float, key: np.ndarray, steps: int = 8, first: bool = False) -> np.ndarray:
    """New numbers of tables of dishes with c customers at t tables, `others` being the restaurant's tables without the dish's; key: 64 random bits each."""
    t = np.minimum(np.maximum(t, 1), c)
    stirling = log_stirling(KNOWN, d)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    for size in np.unique(c[few]).tolist():
        mine = few[c[few] == size]
        for i in np.array_split(mine, len(mine) // 50_000 + 1):
            k = np.arange(1, size + 1)
            w = stirling[size, 1 : size + 1] + np.cumsum(np.log(theta + d * (others[i, None] + k[None, :] - 1)), axis=1) + k * log_parent[i, None]
            w = np.exp(w - w.max(1, keepdims=True))
            up = np.cumsum(w, axis=1)
            t[i] = 1 + (up < _uniform(key[i], 0)[:, None] * up[:, -1:]).sum(1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, rest, parent, k = c[many], others[many] + theta / d, log_parent[many] + math.log(d), key[many]

        def weight(x: np.ndarray) -> np.ndarray:
            return log_seatings(n, x, d) + log_gamma(rest + x) + x * parent

        at = _expected_tables(n, rest * d, np.exp(log_parent[many]), d) if first else t[many]
        wide = 1 + np.sqrt(n.astype(float) ** d).astype(np.int64)
        now = weight(at)
        for step in range(steps):
            move = 1 + (_uniform(k, 3 * step) * (wide >> 2 * (step % 4))).astype(np.int64)  # long and short moves by turns
            to = at + np.where(_uniform(k, 3 * step + 1) < 0.5, -move, move)
            there = weight(np.clip(to, 1, n))
            go = (to >= 1) & (to <= n) & (np.log(np.maximum(_uniform(k, 3 * step + 2), 1e-300)) < there - now)
            at, now = np.where(go, to, at), np.where(go, there, now)
        t[many] = at
    return t


def _expected_tables(c: np.ndarray, theta: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
    """Where to start: tables when customers come in blocks of an eighth of those seated, each block opening its expected number."""
    seated, tables, size = np.ones(len(c)), np.ones(len(c)), c.astype(float)
    while (seated < size).any():
        block = np.minimum(np.maximum(1, seated / 8), size - seated)
        new = (theta + d * tables) * parent
        tables += block * new / (new + np.maximum(seated - d * tables, 1e-9))
        seated += block
    return np.clip(np.round(tables), 1, c).astype(np.int64)


class Model:
    """Totals of the restaurants after a sweep, and the parameters."""

    def __init__(self, sums: dict[int, bytes], restaurants: int, n_words: int, theta: tuple, before: Model | None = None):
        size = Totals(restaurants).size
        flat = np.zeros(4 * size, np.int64)
        for k, b in sums.items():
            flat[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(b, "<i8")
        self.customers, self.singles, tables, root = flat.reshape(4, size)
        if before is not None:  # what sweeps do not change
            self.customers, self.singles = before.customers, before.singles
        self.tables = self.singles + tables
        self.root_customers, self.root_tables = int(root[0]), int(root[1])
        kneser = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
        self.theta, self.d = theta, (kneser(root[4], root[5]), kneser(root[2], root[3])) if before is None else before.d
        self.base = 1.0 / (n_words + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words in the root; customers and tables of 0 give that of an unseen word."""
        if not self.root_customers:
            return np.full(len(customers), self.base)
        theta, d = self.theta[0], self.d[0]
        return (np.maximum(customers - d * tables, 0) + (theta + d * self.root_tables) * self.base) / (theta + self.root_customers)

    def predictive(self, context: np.ndarray, count: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probabilities of dishes with that count at so many tables."""
        return self.served(self.customers[context], self.tables[context], count, tables, parent)

    def served(self, customers: np.ndarray, held: np.ndarray, count: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The same in restaurants with so many customers at tables held in all."""
        theta, d = self.theta[1], self.d[1]
        return (np.maximum(count - d * tables, 0) + (theta + d * held) * parent) / (theta + customers)


def _sweep(shared, restaurants: int, shards: int, sweep: int, seed: int):
    """A Gibbs sweep over the dishes of the shards, given the totals before, and the totals after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, totals = shared.value, Totals(restaurants)
        turn = mix(np.array([seed * 1000 + sweep], np.uint64))
        shard = 0
        for b in trimmed(batches):
            for shard, *x in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
                word, fixed, of, code, count, tables, root, far, alone = (_at(y, k) for y, k in zip(x[:9], ("<u8", "<u4", "<u4", "<u2", "<u4", "<u4", "<u4", "<u8", "<u4"), strict=True))
                apart, held = np.flatnonzero(code == 0), m.tables[code]
                if len(apart):
                    names, met, single = (np.concatenate([_at(y, k) for y in z.values]) for z, k in zip(x[9:], ("<u8", "<u4", "<u4"), strict=True))
                    o = np.argsort(names)
                    k = o[np.searchsorted(names, far, sorter=o)]
                    if not len(alone):
                        alone = single[k]
                    held[apart] = met[k].astype(np.int64) + alone
                c, t, up = count.astype(np.int64), tables.astype(np.int64), root.astype(np.int64)
                guests = fixed + np.bincount(of, t, minlength=len(word)).astype(np.int64)
                p = m.parent(guests, up)
                key = mix(mix(word[of] ^ turn) + _names(code, far))
                t = sample_tables(c, t, np.maximum(held - t, 0), np.log(p[of]), m.theta[1], m.d[1], key, first=not sweep)
                guests = fixed + np.bincount(of, t, minlength=len(word)).astype(np.int64)
                up = sample_tables(guests, up, np.maximum(m.root_tables - up, 0), np.full(len(word), math.log(m.base)), m.theta[0], m.d[0], mix(word + turn), first=not sweep)
                near = code > 0
                totals.add(TABLES, code[near], t[near])
                totals.add(ROOT, np.arange(2), np.array([guests.sum(), up.sum()]))
                yield _state_batch([(shard, DISHES, -1, *[y.as_buffer().to_pybytes() for y in x[:5]], t.astype("<u4").tobytes(), up.astype("<u4").tobytes(), far.tobytes(), alone.astype("<u4").tobytes())])
                yield from _far_batches(shard, shards, far, t[apart])
        if totals.parts:
            yield _totals_batch(totals, shard)

    return run


def _collected(state: DataFrame) -> dict[int, bytes]:
    """The totals of a state: at most three times as many numbers as there are restaurants of frequent words."""
    sums = state.where(F.col("kind") == CHUNKS).select("at", "words").groupBy("at").applyInArrow(_add_chunks, "chunk int, sums binary")
    return {r.chunk: bytes(r.sums) for r in sums.collect()}


# scores

_PARTS = "batch long, rows binary, logs binary, known binary, counts binary"
_PARTS_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


#: Marks rows that tell a shard of restaurants from `FAR` on: names, customers, tables of each sweep kept.
TOLD = -1 << 40


def _asked(shards: int, frequent):
    """Restaurants from `FAR` on that the texts of a slice have tokens in, by bucket, and the shards of these tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in trimmed(slices(batches)):
            h, to = tokens(data, off)
            c = contexts_of(h, to, frequent.value)
            apart = c >= FAR
            c, s = c[apart], _shard(h[apart], shards)
            at = _shard(c, shards)
            o = np.lexsort((c, s, at))
            c, s, at = c[o], s[o], at[o]
            head = _heads(c, s)
            c, s, at = c[head], s[head], at[head]
            edge = np.searchsorted(at, np.arange(shards + 1))
            full = np.flatnonzero(np.diff(edge))
            none = pa.array([b""] * len(full), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), -1, np.int32)), *(packed(v, edge).take(pa.array(full)) for v in (c.astype("<u8"), s.astype("<u4"))), none, none], names=["at", "turn", "words", "shards", "fixed", "tables"])

    return run


def _tell(sweeps: int):
    """Customers, and tables after each sweep kept, of the restaurants of a bucket, for each shard that has tokens in them. Rows by turn: -1 asks, 0 is the seating, i the i-th sweep kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            turn = np.array([x[0].as_py() for x in rows])
            names = [_at(x[1], "<u8") for x in rows]
            seated = [i for i in range(len(rows)) if turn[i] == 0]
            if not seated:
                continue
            u = np.unique(np.concatenate([names[i] for i in seated]))
            customers, tables = np.zeros(len(u), np.int64), np.zeros((sweeps, len(u)), np.int64)
            for i, x in enumerate(rows):
                if turn[i] >= 0:
                    k = np.searchsorted(u, names[i])  # a shard has each restaurant once
                if turn[i] == 0:
                    customers[k] += _at(x[3], "<u4")
                    tables[:, k] += _at(x[5], "<u4")
                elif turn[i] > 0:
                    tables[turn[i] - 1, k] += _at(x[4], "<u4")
            shard = np.concatenate([_at(x[2], "<u4") if turn[i] < 0 else np.full(len(names[i]), int.from_bytes(x[2].as_buffer().to_pybytes(), "little"), "<u4") for i, x in enumerate(rows) if turn[i] <= 0])
            name = np.concatenate([names[i] for i in range(len(rows)) if turn[i] <= 0])
            k = np.minimum(np.searchsorted(u, name), len(u) - 1)
            on = u[k] == name
            k, shard = k[on], shard[on]
            o = np.lexsort((k, shard))
            k, shard = k[o], shard[o]
            head = _heads(k, shard)
            k, shard = k[head], shard[head]
            edge = np.append(_heads(shard), len(shard))
            out = [(int(shard[i]), TOLD, u[k[i:j]].tobytes(), _planes(customers[k[i:j]]), _planes(tables[:, k[i:j]].ravel()), b"", b"", b"") for i, j in zip(edge[:-1], edge[1:], strict=True)]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=_PACK_NAMES)

    return run


def _score(shared, sweeps: int):
    """Scores of the tokens of shards, added up by row: one row for each slice. Rows are sorted by shard; those with batch < 0 hold the seating of sweep -1 - batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            for batch, size, none, flags, ids, *_ in rows:
                if batch.as_py() >= 0 and not len(none.as_buffer()) and len(ids.as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py()]) if i == 0 else pa.array([x.as_py()], pa.binary()) for i, x in enumerate((batch, ids, none, size, flags))], names=_PARTS_NAMES)
            seats = {-1 - x[0].as_py(): x for x in rows if TOLD < x[0].as_py() < 0}
            yield from _score_shard([x for x in rows if x[0].as_py() >= 0 and len(x[2].as_buffer())], seats, [x for x in rows if x[0].as_py() == TOLD], shared.value, sweeps)

    return run


def _score_shard(blobs: list, seats: dict, told: list, models: list[Model], sweeps: int) -> Iterator[pa.RecordBatch]:
    def parts(b):
        size = _at(b[2], "<u4").astype(np.int64)
        row = np.frombuffer(b[1].as_buffer(), "<u2" if len(b[1].as_buffer()) == 2 * size.sum() else "<u4").astype(np.int64)
        return row, size, _names(_at(b[3], "<u2"), _at(b[6], "<u8")), _at(b[4], "<u8"), np.unpackbits(_at(b[5], np.uint8))

    if not blobs:
        return
    words, contexts, counts = [], [], []
    for b in blobs:
        row, size, context, word, train = parts(b)
        n = np.bincount(np.repeat(np.arange(len(size)), size), train[row], minlength=len(size)).astype(np.int64)
        on = n > 0
        words.append(word[on])
        contexts.append(context[on])
        counts.append(n[on])
    word, context, count = _merged(words, contexts, counts)
    del words, contexts, counts
    head = _heads(word)
    names = word[head]
    unigram = _sums(count, head)
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(word))))
    many = np.flatnonzero(count > 1)
    fixed = np.bincount(of, count == 1, minlength=len(head)).astype(np.int64)
    far = np.concatenate([np.zeros(0, "<u8"), *(_at(x[1], "<u8") for x in told)])
    holds = np.concatenate([np.zeros((1 + sweeps, 0), np.int64), *(np.concatenate([_unplaned(x[2]), _unplaned(x[3])]).reshape(1 + sweeps, -1) for x in told)], axis=1)
    o = np.argsort(far)
    far, holds = far[o], np.append(holds[:, o], np.zeros((1 + sweeps, 1), np.int64), axis=1)  # the last: a restaurant without customers
    tables, parent, unseen = [], [], []
    for s, m in enumerate(models):
        t = np.ones(len(word), np.int64)
        guests = fixed
        if s in seats:
            t[many] = _at(seats[s][4], "<u4")
            guests = fixed + np.bincount(of[many], t[many], minlength=len(head)).astype(np.int64)
        tables.append(t)
        parent.append(m.parent(guests, _at(seats[s][5], "<u4") if s in seats else guests))
        unseen.append(m.parent(np.zeros(1), np.zeros(1))[0])

    def place(names: np.ndarray) -> np.ndarray:
        """Where a restaurant's totals are."""
        at = _codes(names).astype(np.int64)
        apart = np.flatnonzero(at == 0)
        k = np.searchsorted(far, names[apart])
        k[np.append(far, _U(0))[k] != names[apart]] = len(far)
        at[apart] = int(FAR) + k
        return at

    def whole(near: np.ndarray, apart: np.ndarray) -> np.ndarray:
        return np.concatenate([near, np.zeros(int(FAR) - len(near), np.int64), apart])

    customers, held = [whole(m.customers, holds[0]) for m in models[:1]], [whole(m.tables, h) for m, h in zip(models, holds[1:], strict=True)]
    width = int(FAR) + holds.shape[1]
    pair = of * width + place(context)
    del context
    for b in blobs:
        row, size, context, w, _ = parts(b)
        k = np.minimum(np.searchsorted(names, w), max(len(names) - 1, 0))
        known = names[k] == w if len(names) else np.zeros(len(w), bool)
        at = place(context)
        want = k * width + at
        j = np.minimum(np.searchsorted(pair, want), max(len(pair) - 1, 0))
        seen = known & (pair[j] == want) if len(pair) else known
        p = np.zeros(len(w))
        for s, m in enumerate(models):
            up = np.where(known, parent[s][k], unseen[s]) if len(names) else np.full(len(w), unseen[s])
            n, t = (np.where(seen, x[j], 0) if len(pair) else np.zeros(len(w)) for x in (count, tables[s]))
            p += m.served(customers[0][at], held[s][at], n, t, up) / len(models)
        log_p, log_c = np.log10(p), np.log10((np.where(known, unigram[k], 0) if len(names) else np.zeros(len(w))) + 1)
        kind = np.repeat(np.arange(len(size)), size)
        rows = np.unique(row)
        where = np.searchsorted(rows, row)
        add = lambda v, where=where, kind=kind, rows=rows: np.bincount(where, v[kind], minlength=len(rows))
        yield pa.RecordBatch.from_arrays([pa.array([b[0].as_py()]), *[pa.array([x.tobytes()], pa.binary()) for x in (rows.astype("<u4"), add(log_p).astype("<f8"), add(known.astype(float)).astype("<u4"), add(log_c).astype("<f8"))]], names=_PARTS_NAMES)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by row over the shards; all parts of a slice are in one partition."""
    told, held = {}, {}
    for b in trimmed(batches):
        for batch, rows, logs, known, counts in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
            if not len(logs.as_buffer()):
                told[batch] = _at(rows, "<i8"), _at(known, "<u4"), _at(counts, "u1").reshape(2, -1).astype(bool)
                continue
            r = _at(rows, "<u4")
            n = int(r.max()) + 1
            mine = held.get(batch)
            if mine is None or mine.shape[1] < n:
                more = np.zeros((3, n - (0 if mine is None else mine.shape[1])))
                mine = held[batch] = more if mine is None else np.concatenate([mine, more], axis=1)
            for i, (x, kind) in enumerate(((logs, "<f8"), (known, "<u4"), (counts, "<f8"))):
                mine[i, r] += _at(x, kind)
    for batch, (ids, size, (out, null)) in told.items():
        x = held[batch]
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(out), pa.array(size.astype(np.int64)), pa.array(x[0]), pa.array(x[1].astype(np.int64)), pa.array(x[2])], names=["doc_id", "held_out", "n_tokens", "score", "n_known", "log_counts"])


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartition(shards, "shard").sortWithinPartitions("shard")


def pitman_yor_scores(docs: DataFrame, sweeps: int = 5, burn_in: int = 2, theta: tuple = (1.0, 2.0), contexts: int = 65_535, seed: int = 7, shard_tokens: int = 1 << 21) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), "text", "held_out", "doc_id")
    training = numbered.where("not held_out").select("number", "text")
    census = training.mapInArrow(_census(parts), "shard int, words binary, counts binary").repartition(parts, "shard")
    census = written(census.mapInArrow(_census_sums, "word long, count long, octave int"), "census")
    by_octave = sorted(tuple(r) for r in census.groupBy("octave").agg(F.count("*"), F.sum("count")).collect())  # at most 256 rows
    n_words, n_train = sum(r[1] for r in by_octave), sum(r[2] for r in by_octave)
    room, least = contexts - 1, 1 << 30
    for octave, n, _ in reversed(by_octave):
        room -= n
        if room < 0:
            break
        least = octave
    names = [r.word for r in census.where(F.col("octave") >= least).select("word").collect()]  # at most `contexts` words
    frequent = share(np.unique(np.append(np.array(names, np.int64).view(np.uint64), START)))
    restaurants, shards = len(frequent.value) + 1, max(parts, -(-n_train // shard_tokens))
    counted = training.mapInArrow(_deal(shards, frequent, False), _PACK)
    state = bucketed(_dealt(counted, shards).mapInArrow(_seat(restaurants, shards), _STATE), "shard", shards)
    forgotten(census)
    number = F.expr("reverse(unhex(lpad(hex(shard), 8, '0')))")  # little-endian
    of_far = lambda df, turn: df.where(F.col("kind") == RESTAURANTS).select("at", F.lit(turn).alias("turn"), "words", number.alias("shards"), "fixed", "tables", "alone")
    seated = written(of_far(state, 0), "restaurants")
    held = numbered.where("held_out").select("number", "text").mapInArrow(_asked(shards, frequent), "at int, turn int, words binary, shards binary, fixed binary, tables binary")
    told = [seated, held.withColumn("alone", F.lit(b""))]
    model, models, kept = Model(_collected(state), restaurants, n_words, theta), [], []
    for sweep in range(sweeps):
        before, state = state, bucketed(_met(state, shards).mapInArrow(_sweep(share(model), restaurants, shards, sweep, seed), _STATE), "shard", shards)
        forgotten(before)
        model = Model(_collected(state), restaurants, n_words, theta, model)
        if sweep >= burn_in:
            models.append(model)
            blank = F.lit(b"")
            seats = state.where(F.col("kind") == DISHES).select("shard", F.lit(-len(models)).cast("long"), blank, blank, blank, "tables", "root", blank).toDF(*_PACK_NAMES)
            kept.append(written(seats, "tables"))  # the words of a state are not kept with them
            told.append(written(of_far(state, len(models)), "restaurants"))
    forgotten(state)
    asked = functools.reduce(DataFrame.unionByName, told)
    kept.append(written(asked.repartition(shards, "at").sortWithinPartitions("at").mapInArrow(_tell(len(models)), _PACK), "restaurants"))
    del asked, held
    forgotten(*told)
    dealt = numbered.select("number", "text", "held_out", "doc_id").mapInArrow(_deal(shards, frequent, True), _PACK)
    for k in kept:
        dealt = dealt.unionByName(k)
    scored = _dealt(dealt, shards).mapInArrow(_score(share(models), len(models)), _PARTS)
    rows = scored.repartition(parts, "batch").mapInArrow(_gather, "doc_id long, held_out boolean, n_tokens long, score double, n_known long, log_counts double")
    out = written(rows, "scores")
    forgotten(*kept)
    floor = math.log10(n_train + n_words + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor_scores(with_fold(documents(spark, sf_dir).select("doc_id", "text"), 7))
