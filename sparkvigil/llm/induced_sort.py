"""Suffix array and common prefixes by induced sorting, with bucket queues that spill to disk.

Suffix tuples (position, length of the prefix in common with the suffix before)
move through one queue for each first character: the sorted leftmost-S suffixes
induce the L suffixes in ascending order, these the S suffixes in descending
order (Nong, Zhang and Chan, 2009; with prefixes Fischer, 2011; external form by
Bingmann, Fischer and Osipov, 2013). What reaches a character's queue arrives in
its final order, so the priority queue is a monotone one: a run of blocks for
each character, kept in memory up to a limit and beyond it in an unnamed scratch
file that ends with the call. Two suffixes that one step sends to a queue one
after the other have one character more in common than the least value between
their sources; where the L suffixes of a character end and its S suffixes begin,
the shorter run of that character is what they share. Values are capped at the
depth asked for. Blocks are numpy arrays, so a step handles all suffixes of a
character at once. The leftmost-S substrings are sorted by the same induction,
named, and the reduced string is sorted in memory by doubling the length of
compared prefixes, up to the depth; prefixes of the leftmost-S suffixes alone are
compared directly.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .kernels import prefix_hash, span_hash

FULL = 255  # more than any depth


class BucketQueue:
    """First-in first-out runs of (position, common prefix) for each character; the largest go to disk beyond `limit` positions."""

    def __init__(self, characters: int, limit: int):
        self.runs: list[list] = [[] for _ in range(characters)]
        self.held, self.limit, self.file = 0, limit, None

    def push(self, positions: np.ndarray, characters: np.ndarray, shared: np.ndarray) -> None:
        """Appends tuples, in order and grouped by character, to their characters' runs."""
        cut = np.flatnonzero(np.diff(characters)) + 1
        heads = characters[np.concatenate([[0], cut])].tolist()
        for p, v, ch in zip(np.split(positions, cut), np.split(shared, cut), heads, strict=True):
            self.runs[ch].append((p, v))
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  no name: it ends with the queue
        for run in self.runs:
            for i, part in enumerate(run):
                if isinstance(part[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(part[0].tobytes() + part[1].tobytes())
                    run[i] = (at, len(part[0]), part[0].dtype)
        self.held = 0

    def take(self, character: int) -> tuple[np.ndarray, np.ndarray]:
        """All of a character's tuples so far; its run is empty then."""
        out = []
        for part in self.runs[character]:
            if isinstance(part[0], int):
                at, n, kind = part
                self.file.seek(at)
                raw = self.file.read(n * (kind.itemsize + 1))
                part = np.frombuffer(raw, kind, n), np.frombuffer(raw, np.uint8, n, n * kind.itemsize)
            else:
                self.held -= len(part[0])
            out.append(part)
        self.runs[character] = []
        if len(out) == 1:
            return out[0]
        return (np.concatenate([p for p, _ in out]), np.concatenate([v for _, v in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


def _s_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end is smaller than all."""
    n = len(t)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.where(t[:-1] < t[1:], 1, np.where(t[:-1] > t[1:], -1, 0))
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _run_lengths(t: np.ndarray, depth: int) -> np.ndarray:
    """How often the first character of each suffix is repeated at its start, up to the depth."""
    end = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t))
    at = np.arange(len(t))
    return np.minimum(end[np.searchsorted(end, at, "right")] - at, depth).astype(np.uint8)


class _Least:
    """Least values of ranges of an array, by a table of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step, top = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(top[:-step], top[step:]))

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Least of values[a:z] for each pair, FULL for an empty range."""
        out = np.full(len(a), FULL, np.uint8)
        size = z - a
        level = np.zeros(len(a), np.int64)
        some = np.flatnonzero(size > 0)
        level[some] = np.frexp(size[some].astype(float))[1] - 1
        for k in np.unique(level[some]).tolist():
            i = some[level[some] == k]
            out[i] = np.minimum(self.levels[k][a[i]], self.levels[k][z[i] - (1 << k)])
        return out


class _Sender:
    """Sends the suffixes before those of a sorted sequence, met part by part, to the queues of their characters."""

    def __init__(self, queue: BucketQueue, before: np.ndarray, characters: int, depth: int, carry: bool):
        self.queue, self.before, self.depth, self.carry = queue, before, depth, carry
        self.since = np.full(characters, FULL, np.uint8)  # least value after the last suffix that went to the character
        self.empty = np.ones(characters, bool)

    def step(self, batch: np.ndarray, shared: np.ndarray) -> None:
        c = self.before[batch]
        on = np.flatnonzero(c >= 0)
        if not self.carry:
            if len(on):
                on = on[np.argsort(c[on], kind="stable")]
                self.queue.push(batch[on] - batch.dtype.type(1), c[on].astype(np.int64), np.zeros(len(on), np.uint8))
            return
        all_least = shared.min() if len(shared) else FULL
        if not len(on):
            self.since = np.minimum(self.since, all_least)
            return
        on = on[np.argsort(c[on], kind="stable")]
        ch = c[on].astype(np.int64)
        first = np.ones(len(on), bool)
        first[1:] = ch[1:] != ch[:-1]
        least = _Least(shared)
        value = least.of(np.where(first, 0, np.concatenate([[0], on[:-1]]) + 1), on + 1)
        heads = ch[first]
        value[first] = np.minimum(value[first], self.since[heads])
        value = np.minimum(value, self.depth - 1) + np.uint8(1)
        value[np.flatnonzero(first)[self.empty[heads]]] = 0
        self.queue.push(batch[on] - batch.dtype.type(1), ch, value)
        last = np.append(first[1:], True)
        self.since = np.minimum(self.since, all_least)
        self.since[ch[last]] = least.of(on[last] + 1, np.full(int(last.sum()), len(batch)))
        self.empty[heads] = False


def _induce(t: np.ndarray, is_s: np.ndarray, starts: np.ndarray, shared: np.ndarray, characters: int, limit: int, depth: int, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and their common prefixes with the one before, from leftmost-S suffixes in order and their common prefixes; without `carry` the order alone."""
    kind = np.int32 if len(t) < 1 << 31 else np.int64
    # character of the position before, with L and S apart; none before the first
    before_l, before_s = np.full(len(t), -1, np.int16), np.full(len(t), -1, np.int16)
    wide = t.astype(np.int16)
    before_l[1:] = np.where(is_s[:-1], -1, wide[:-1])
    before_s[1:] = np.where(is_s[:-1], wide[:-1], -1)
    run = _run_lengths(t, depth)

    def rounds(c: int, sender: _Sender):
        """A character's run, and what it induces into its own character, until that is nothing."""
        while len((part := sender.queue.take(c))[0]):
            yield part
            sender.step(*part)

    def met(a: np.ndarray, b: np.ndarray) -> np.uint8:
        """What the last L and the first S suffix of a character share."""
        return min(run[a], run[b])

    seeds = BucketQueue(characters, limit)
    if len(starts):
        seeds.push(starts.astype(kind), t[starts].astype(np.int64), shared)
    lower = _Sender(BucketQueue(characters, limit), before_l, characters, depth, carry)
    end = np.array([len(t) - 1], kind)  # the end of the text comes first of all
    lower.queue.push(end, t[end].astype(np.int64), np.zeros(1, np.uint8))
    lower.empty[t[-1]] = False
    lower.since[t[-1]] = 0
    parts: list[list[tuple]] = [[] for _ in range(characters)]
    for c in range(characters):
        parts[c] = list(rounds(c, lower))
        batch, value = seeds.take(c)
        if len(batch):
            value = value.copy()
            value[0] = met(parts[c][-1][0][-1], batch[0]) if parts[c] else 0
            lower.step(batch, value)
    upper = _Sender(BucketQueue(characters, limit), before_s, characters, depth, carry)
    order: list[np.ndarray] = []
    values: list[np.ndarray] = []  # of each suffix with the next larger one
    for c in range(characters - 1, -1, -1):
        smallest = None
        for batch, value in rounds(c, upper):
            order.append(batch)
            values.append(value)
            smallest = batch[-1]
        for i in range(len(parts[c]) - 1, -1, -1):
            batch, value = parts[c][i]
            if i + 1 < len(parts[c]):
                after = parts[c][i + 1][1][0]
            else:
                after = met(batch[-1], smallest) if smallest is not None else 0
            down = np.append(value[1:], np.uint8(after))[::-1]
            order.append(batch[::-1])
            values.append(down)
            upper.step(order[-1], down)
        parts[c] = []
    whole, above = np.concatenate(order)[::-1], np.concatenate(values)[::-1]
    return whole, np.concatenate([np.zeros(1, np.uint8), above[:-1]])


def _shared_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to the depth, of each suffix in the given order with the one before it."""
    out = np.zeros(len(order), np.uint8)
    if len(order) < 2:
        return out
    wide = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    a, b = order[1:], order[:-1]
    most = np.minimum(depth, len(t) - np.maximum(a, b))
    size = np.full(len(a), depth, np.int64)
    live = np.arange(len(a))
    for at in range(0, depth, 8):
        x = np.ascontiguousarray(words[a[live] + at]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[b[live] + at]).view(np.uint64).ravel()
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        size[live[differ]] = at + (np.frexp(low.astype(float))[1] - 1) // 8  # the first byte is the lowest
        live = live[~differ]
        if not len(live):
            break
    out[1:] = np.minimum(size, most)
    return out


def suffixes(t: np.ndarray, depth: int, limit: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): all suffixes of a byte array sorted by their first `depth` bytes at least, and the common prefix of each with the one before, up to the depth."""
    n = len(t)
    if n < 2:
        return np.arange(n), np.zeros(n, np.uint8)
    is_s = _s_types(t)
    starts = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    nothing = np.zeros(len(starts), np.uint8)
    if not len(starts):
        return _induce(t, is_s, starts, nothing, 256, limit, depth)
    seeds = starts[np.argsort(t[starts], kind="stable")]
    order, _ = _induce(t, is_s, seeds, nothing, 256, limit, depth, carry=False)
    which = np.full(n, -1, np.int32)
    which[starts] = np.arange(len(starts), dtype=np.int32)
    order = which[order]
    order = order[order >= 0]  # by their substrings, up to and with the next leftmost-S position
    del which
    end = np.append(starts[1:] + 1, n)
    h, length = span_hash(prefix_hash(t), starts, end), end - starts
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (length[order[1:]] != length[order[:-1]])
    last = np.flatnonzero(order == len(starts) - 1)  # it ends with the text
    new[last] = True
    new[last[last + 1 < len(order)] + 1] = True
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    del h, length, order, new
    span = 1
    while span * 2 <= depth and len(rank) > 1:  # a name covers two bytes at least
        later = np.zeros(len(rank), np.int64)
        later[:-span] = rank[span:] if span < len(rank) else later[:-span]
        key = (rank.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        o = np.argsort(key, kind="stable")
        k = key[o]
        step = np.ones(len(o), np.int64)
        step[1:] = k[1:] != k[:-1]
        rank = np.empty(len(o), np.int64)
        rank[o] = np.cumsum(step)
        if rank.max() == len(rank):
            break
        span *= 2
    seeds = starts[np.argsort(rank, kind="stable")]
    return _induce(t, is_s, seeds, _shared_prefixes(t, seeds, depth), 256, limit, depth)


def suffix_array(t: np.ndarray, depth: int, limit: int = 8 << 20) -> np.ndarray:
    """Start positions of all suffixes of a byte array, sorted by their first `depth` bytes at least."""
    return suffixes(t, depth, limit)[0]


def repeats(t: np.ndarray, depth: int, limit: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): sorted suffixes, and the number of each one's class of equal `depth`-byte prefixes."""
    if depth >= FULL:
        raise ValueError(f"prefixes of at most {FULL - 1} bytes are carried")
    order, shared = suffixes(t, depth, limit)
    return order, np.cumsum(shared < depth, dtype=np.int32)
