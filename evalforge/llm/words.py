"""Words of many texts at once: byte tables, word bounds and 64-bit word hashes in NumPy.

Texts stay UTF-8 bytes. Every separator of the word definitions is ASCII, so bytes decide alone.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: True where a byte belongs to a word `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~SPACES
#: True where a byte belongs to a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BLOCK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_pow = _powers(int(_BASE), _BLOCK)
_inv = _powers(pow(int(_BASE), -1, 2**64), _BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one more at the end)."""
    inside = member[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, block by block so that memory stays small for long texts."""
    global _pow, _inv
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        seg = data[base : ends[j - 1]]
        if len(seg) > len(_pow):
            _pow, _inv = _powers(int(_BASE), len(seg)), _powers(pow(int(_BASE), -1, 2**64), len(seg))
        c = np.empty(len(seg) + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTES[seg] * _pow[: len(seg)], out=c[1:])
        s = starts[i:j] - base
        out[i:j] = (c[ends[i:j] - base] - c[s]) * _inv[s]
        i = j
    return mix(out)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by its first word; shorter by width - 1 than h."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(out)
