"""CRC-32C (Castagnoli) of many byte runs at once, and its mask for record files.

The checksum is linear over GF(2): a byte at distance d from the end adds
shift^d(table[byte]). Runs are cut into blocks of 64 bytes from their end, so
one table row for each place in a block does the first step, and shifts by
whole blocks, in binary, the second.
"""

from __future__ import annotations

import numpy as np

_POLY, _BLOCK = 0x82F63B78, 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_T = _byte_table()


def _shift(x: np.ndarray) -> np.ndarray:
    return _T[x & 255] ^ (x >> np.uint32(8))


def _operators(bits: int = 40) -> list[np.ndarray]:
    """For each b, the images of the 4 x 256 byte values under 2^b shifts by one byte."""
    op = np.stack([_shift(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
    out = [op]
    for _ in range(bits):
        out.append(np.stack([_apply(out[-1], row) for row in out[-1]]))
    return out


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    return op[0][x & 255] ^ op[1][(x >> np.uint32(8)) & 255] ^ op[2][(x >> np.uint32(16)) & 255] ^ op[3][x >> np.uint32(24)]


_OPS = _operators()
_PLACES = np.empty((_BLOCK, 256), np.uint32)
_PLACES[_BLOCK - 1] = _T
for _i in range(_BLOCK - 2, -1, -1):
    _PLACES[_i] = _shift(_PLACES[_i + 1])


def _shifted(x: np.ndarray, n: np.ndarray, first: int = 0) -> np.ndarray:
    """x after n * 2^first byte shifts."""
    x, b = x.copy(), 0
    while len(n) and (n >> b).any():
        on = np.flatnonzero((n >> b) & 1)
        x[on] = _apply(_OPS[b + first], x[on])
        b += 1
    return x


def crc32c(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unsigned checksums of data[off[i]:off[i + 1]]."""
    size = np.diff(off)
    blocks = -(-size // _BLOCK)
    to = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(to[-1] * _BLOCK, np.uint8)
    end = to[1:] * _BLOCK
    padded[np.arange(off[-1] - off[0]) + np.repeat(end - size - (off[:-1] - off[0]), size)] = data[off[0] : off[-1]]
    grid = padded.reshape(-1, _BLOCK)
    part = np.zeros(len(grid), np.uint32)
    for i in range(_BLOCK):
        part ^= _PLACES[i][grid[:, i]]
    after = np.repeat(to[1:], blocks) - 1 - np.arange(to[-1])
    part = _shifted(part, after, first=6)
    out = np.zeros(len(size), np.uint32)
    full = blocks > 0
    if full.any():
        out[full] = np.bitwise_xor.reduceat(part, to[:-1][full])
    start = _shifted(np.full(len(size), 0xFFFFFFFF, np.uint32), size)
    return ~(out ^ start)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits, plus a constant: a checksum of data that holds checksums stays useful."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
