"""A minimal perfect hash over distinct 128-bit keys, whose lookups are verified."""

from __future__ import annotations

import numpy as np

from .kernels import mix

_U = np.uint64


class Slots:
    """Slots 0 .. n-1 of distinct keys (a, b): at each level, keys alone at their place stay there, the others go on to the next."""

    def __init__(self, a: np.ndarray, b: np.ndarray, room: float = 2.0):
        left, taken, self.levels = np.arange(len(a)), 0, []
        slot = np.empty(len(a), np.int64)
        while len(left):
            size = max(8, int(room * len(left)))
            at = self._places(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = taken + np.cumsum(alone) - 1
            on = alone[at]
            slot[left[on]] = rank[at[on]]
            self.levels.append((size, alone, rank))
            taken, left = taken + int(on.sum()), left[~on]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + _U(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))) % _U(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where the key that the slot keeps is another."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._places(a[left], b[left], level, size)
            on = alone[at]
            out[left[on]] = rank[at[on]]
            left = left[~on]
        known = np.flatnonzero(out >= 0)
        wrong = (self.a[out[known]] != a[known]) | (self.b[out[known]] != b[known])
        out[known[wrong]] = -1
        return out
