"""Arrow/numpy kernels shared by the text operators.

Texts of an Arrow batch are read as one UTF-8 buffer plus offsets, and every
kernel works on the whole buffer at once: no per-row Python in the hot path.
A null text counts as empty. Batches are cut into slices of bounded bytes, so
the memory of a task does not depend on the batch size Spark picks; a text
longer than a slice forms a slice of its own and is never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE, _QUAD = _U(0x9E3779B97F4A7C15 | 1), _U(0xD1342543DE82EF95)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, step: int = 1, n: int = 1 << 16) -> np.ndarray:
    """base^(step * i) modulo 2^64 for i < n."""
    a = np.full(n, pow(base, step, 1 << 64), np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


#: Powers by the low 16 bits of a place, and of its other bits by their number: no table grows with a text.
_LOW, _BITS = (1 << 16) - 1, 16
_POW, _INVERSE = _powers(int(_BASE)), _powers(int(_INV))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = pc.fill_null(column, "")
        column = column.cast(pa.large_string())
    else:
        column = pc.fill_null(column, b"").cast(pa.large_binary())
    n, at = len(column), column.offset
    off = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    return data, off - off[0]


#: What operators keep in a worker from task to task, by operator.
_kept: dict[str, dict] = {}


def kept_in_worker(owner: str) -> dict:
    """A dictionary that lives as long as the worker runs tasks of its owner: a task of another operator empties it."""
    return _kept.setdefault(owner, {})


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator, owner: str = "") -> Iterator:
    """The same batches; before them the worker drops what other operators kept, at their end it gives freed memory back to the system."""
    if stale := [d for name, d in _kept.items() if name != owner and d]:
        for d in stale:
            d.clear()
        trim()
    yield from batches
    trim()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches in pieces of about `limit` bytes of text."""
    for batch in batches:
        data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of T[data[k]] * P^k over k < i, modulo 2^64."""
    s = np.zeros(len(data) + 1, np.uint64)
    high, step = _U(1), _U(pow(int(_BASE), 1 << _BITS, 1 << 64))
    for at in range(0, len(data), _LOW + 1):
        part = data[at : at + _LOW + 1]
        s[at + 1 : at + 1 + len(part)] = _TABLE[part] * _POW[: len(part)] * high
        with np.errstate(over="ignore"):
            high *= step
    return np.cumsum(s, out=s)


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair, from prefix_hash()."""
    high = _powers(int(_INV), 1 << _BITS, (len(s) >> _BITS) + 1)
    return mix((s[end] - s[start]) * _INVERSE[start & _LOW] * high[start >> _BITS] + (end - start).astype(np.uint64) * _QUAD)


def rows_of(off: np.ndarray) -> np.ndarray:
    """Row index of each unit, for offsets of units."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: byte spans, first index of each row, hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True, hashed: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        non = ~WS[data]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        before = np.ones(n, bool)
        before[1:] = ~non[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~non[1:]
        self.start = np.flatnonzero(non & (before | cut[:-1]))
        self.end = np.flatnonzero(non & (after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.off = off
        if hashed:
            self.sums = prefix_hash(self.data)
            self.hash = span_hash(self.sums, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words that stay in a row, and the index of the first word of each.

    A row with fewer than k words, but at least one, gives its whole sequence as one.
    """
    n, q = len(hashes), 0x2545F4914F6CDD1D
    count = np.diff(first)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        m = n - i
        if m > 0:
            out[:m] += hashes[i:] * _U(pow(q, i + 1, 1 << 64))
    row = rows_of(first)
    whole = np.arange(n) + k <= first[1:][row]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at, m = first[:-1][short], count[short]
        total = m.astype(np.uint64) * _U(0x5851F42D4C957F2D)
        for i in range(k - 1):
            more = m > i
            total[more] += hashes[at[more] + i] * _U(pow(q, i + 1, 1 << 64))
        out[at] = total
        whole[at] = True
    keep = np.flatnonzero(whole)
    return mix(out[keep]), keep


def unique_per_row(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted within the row, and the offsets of the rows."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(n + 1))


def add_per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i."""
    s = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=s[1:])
    return s[off[1:]] - s[off[:-1]]


def min_per_row(values: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    out = np.full(len(off) - 1, empty, values.dtype)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.minimum.reduceat(values, off[:-1][full])
    return out


def mapper(work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict | None], schema: pa.Schema, text: str = "text", limit: int = SLICE_BYTES):
    """A function for mapInArrow that applies `work` to each slice and gives its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in trimmed(slices(batches, text, limit)):
            out = work(batch, data, off)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name] for f in schema], schema=schema)

    return run


def packed(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the bytes of values[off[i]:off[i+1]]; values may be 2-D bytes."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    raw = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * width).astype(np.int32).tobytes()), raw])
