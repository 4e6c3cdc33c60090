"""Distinct-segment encoding: cut texts at safe places, encode each distinct segment once.

A cut before a single space between two non-blank characters is safe for both
pre-tokenisations used here: a token starts at such a space, and none crosses it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .kernels import WS, prefix_hash, rows_of, span_hash

#: Lead bytes of the multi-byte characters among which Unicode has white space.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def segment_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions where segments start: texts, and safe spaces inside them."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        space = data == 0x20
        blank = WS[data] | ((data >= 0x1C) & (data <= 0x1F))
        tail = (data & 0xC0) == 0x80
        lead2 = np.zeros(n, bool)
        lead2[2:] = _LEAD[data[:-2]]
        lead3 = np.zeros(n, bool)
        lead3[3:] = _LEAD[data[:-3]]
        unsure = np.zeros(n, bool)  # the character before may be Unicode white space
        unsure[1:] = tail[:-1]
        unsure &= lead2 | lead3
        ok = space.copy()
        ok[1:] &= ~blank[:-1]
        ok[:-1] &= ~blank[1:] & ~_LEAD[data[1:]]
        ok[0] = ok[-1] = False
        cut = ok & ~unsure
        last = off[1:] - 1
        cut[last[last >= 0]] = False  # the next text is another one
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, from a function that encodes a list of strings; keeps the first `keep` segments it meets."""

    def __init__(self, encode: Callable[[list[str]], list], keep: int = 600_000):
        self.encode, self.keep, self.known = encode, keep, {}

    def distinct(self, data: np.ndarray, off: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """(value of each distinct segment, index of the value of each segment, first segment of each text)."""
        start = segment_starts(data, off)
        first = np.searchsorted(start, off)
        if not len(start):
            return [], np.zeros(0, np.int64), first
        end = np.append(start[1:], len(data))
        h = span_hash(prefix_hash(data), start, end)
        keys, at, which = np.unique(h, return_index=True, return_inverse=True)
        known = self.known
        values = list(map(known.get, keys.tolist()))
        miss = [i for i, v in enumerate(values) if v is None]
        if miss:
            raw = data.tobytes()
            texts = [raw[start[at[i]] : end[at[i]]].decode("utf-8", "replace") for i in miss]
            for i, v in zip(miss, self.encode(texts), strict=True):
                values[i] = v
            room = self.keep - len(known)
            for i in miss[: max(0, room)]:
                known[int(keys[i])] = values[i]
        return values, which, first

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts); values of encode are uint32 bytes."""
        values, which, first = self.distinct(data, off)
        size = np.array([len(v) // 4 for v in values], np.int64)
        flat = np.frombuffer(b"".join(values), np.uint32)
        return gather(flat, np.concatenate([[0], np.cumsum(size)]), which, first)


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the runs flat[at[w]:at[w + 1]] for w in which; offsets by `first` indexes of which."""
    size = np.diff(at)[which] if len(which) else np.zeros(0, np.int64)
    to = np.concatenate([[0], np.cumsum(size)])
    if not to[-1]:
        return flat[:0], to[first]
    src = np.arange(to[-1]) + np.repeat(at[:-1][which] - to[:-1], size)
    return flat[src], to[first]


__all__ = ["Encoder", "gather", "rows_of", "segment_starts"]
