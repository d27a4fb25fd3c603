"""Vectorised work on the bytes of a slice of texts: words, their hashes, and pieces for tokenizers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.RandomState(20240613)
_TABLE = _RNG.randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_pow = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        _pow = np.full(max(n, 2 * len(_pow)), _BASE)
        _pow[0] = 1
        _pow = np.cumprod(_pow, dtype=np.uint64)
    return _pow


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, joined, and the rows' offsets in them. Null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    if data is None:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside 0x20 and 0x09-0x0D, and the row splits of the words."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_WS[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte codes, mixed with the length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    total = int(lens.sum())
    pos = np.arange(total) - np.repeat(at, lens)
    chars = data[np.repeat(starts, lens) + pos]
    h = np.add.reduceat(_TABLE[chars] * powers(int(lens.max()))[pos], at)
    return mix64(h ^ (lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words from the words' hashes; fewer words make one shingle, none make none."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k: len(h) - size + 1 + k] + np.uint64(size))
    return out
