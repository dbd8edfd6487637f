"""Draws of a bootstrap: counts of n multinomial draws over n positions, which any task can make for its own positions.

Numbers come from a counter-based generator: three rounds of multiply and xor, each a bijection of 32 bits, over two keys of
(stream, replicate) and a counter (a, b). Counts come from binary splitting. The positions are cut into blocks of a power of
two (LEAF or more, by the bits of n) and a rest; each of a replicate's draws falls into a block by its share. A block halves
until it has LEAF positions, with the left half's count the number of ones among as many random bits as there are draws; in a
leaf each draw takes a position. `heads` goes down to nodes of an n-th of TOPS, once a replicate; below them the counts of a range
of positions need the bits of the nodes above it alone, and leaves are visited in order, so a node's bits are made once a
visit. No table of draws is joined. Only integer arithmetic below 2^63: SQL makes the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Streams of independent draws: clusters, seeds, maps and their components; those of strata and stored draws are above.
CLUSTERS, SEEDS, MAPS, MAP_COMPONENTS, COMPONENTS, STRATA = 1, 2, 3, 4, 5, 16
#: Odd multipliers of the generator (fixed values; those of products with a 32-bit number are below 2^31).
FIRST, SECOND, STEP, REPLICATE, SALT = 2146121005, 73244475, 2654435769, 2654435761, 1540483477
MASK = (1 << 32) - 1
#: Positions of a leaf, and what tells a leaf's counters from a node's.
LEAF, LEAF_MARK = 64, 1 << 31
#: Numbers that are made at once: they stay in a core's cache.
HELD = 1 << 17
#: Nodes that `heads` gives are at most an n-th of this, between one and two times as many.
TOPS = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(FIRST)
    x ^= x >> np.uint32(15)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def _u(x) -> np.ndarray:
    return np.asarray(np.asarray(x, np.int64) & MASK, np.uint32)


def keys(stream: int, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both keys of each replicate."""
    rep = np.atleast_1d(rep)
    return mix(mix(_u([stream])) ^ _u(rep)), mix(mix(_u([stream + SALT])) + _u(rep) * np.uint32(REPLICATE & MASK))


def words(key: tuple[np.ndarray, np.ndarray], a, b) -> np.ndarray:
    """32 random bits for each counter, keys along the first axis."""
    k1, k2 = key
    return mix(mix(k1 ^ _u(a)) + k2 + _u(b) * np.uint32(STEP & MASK))


def below(word: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n."""
    return ((word.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def blocks(n: int) -> list[tuple[int, int]]:
    """(first, size) of the blocks of n positions: powers of two, the greatest first, then fewer than LEAF."""
    out, at = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1 and 1 << bit >= LEAF:
            out.append((at, 1 << bit))
            at += 1 << bit
    return [*out, (at, n - at)] if at < n else out


def tops(n: int) -> list[tuple[int, int]]:
    """(first, size) of the nodes that `heads` counts, in order: blocks, and the greater ones halved."""
    most = max(LEAF, 1 << max(0, n.bit_length() - TOPS.bit_length()))
    return [(a, min(s, most)) for first, s in blocks(n) for a in range(first, first + s, min(s, most))]


def _split(key, first: int, size: int, m: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Draws of the nodes of at most `most` positions inside a node, in order."""
    if size <= most:
        yield m
        return
    half = size // 2
    left = _ones(key, first + half, m)
    yield from _split(key, first, half, left, most)
    yield from _split(key, first + half, half, m - left, most)


def heads(n: int, rep: np.ndarray, stream: int) -> np.ndarray:
    """How many draws of each replicate fall into each node of `tops`."""
    rep = np.asarray(rep)
    cuts, most = blocks(n), max((s for _, s in tops(n)), default=LEAF)
    if len(tops(n)) == 1:
        return np.full((len(rep), 1), n)
    at, (k1, k2) = np.zeros((len(rep), len(cuts)), np.int64), keys(stream, rep)
    if len(cuts) > 1:
        # a number x below n is floor(word * n / 2^32), so x < end where the word is below ceil(end * 2^32 / n)
        ends = [np.uint32(-(-((a + s) << 32) // n)) for a, s in cuts[:-1]]
        for r in range(len(rep)):
            for s in range(0, n, HELD):
                word = mix(mix(k1[r] ^ np.arange(s, min(n, s + HELD), dtype=np.uint32)) + k2[r])
                for k, end in enumerate(ends):  # a block has more than all after it: what is left halves
                    own = word < end
                    at[r, k] += np.count_nonzero(own)
                    word = word[~own]
                at[r, -1] += len(word)
    else:
        at[:] = n
    return np.stack([m for k, (first, size) in enumerate(cuts) for m in _split((k1, k2), first, size, at[:, k], most)], 1)


def _ones(key, middle: int, m: np.ndarray) -> np.ndarray:
    """Ones among m random bits, a replicate each: what of a node's draws goes left."""
    n, full = -(-int(m.max(initial=0)) // 32), int(m.min(initial=0)) // 32
    base = (mix(key[0] ^ _u(middle)) + key[1])[:, None]
    out, step = np.zeros(len(m), np.int64), max(1, HELD // max(1, len(m)))
    for s in range(0, n, step):
        k = np.arange(s, min(n, s + step))
        w = mix(base + _u(k + 1)[None, :] * np.uint32(STEP & MASK))
        if k[-1] >= full:
            w &= ((np.int64(1) << np.clip(m[:, None] - 32 * k[None, :], 0, 32)) - 1).astype(np.uint32)
        out += np.bitwise_count(w).sum(1, dtype=np.int64)
    return out


def _leaf(key, first: int, size: int, m: np.ndarray) -> np.ndarray:
    most, n = int(m.max(initial=0)), len(m)
    base = (mix(key[0] ^ _u(first + LEAF_MARK)) + key[1])[:, None]
    out, step = np.zeros((n, size + 1), np.int64), max(1, HELD // max(1, n))
    rows = (np.arange(n) * (size + 1))[:, None]
    for s in range(0, most, step):
        j = np.arange(s, min(most, s + step))
        w = mix(base + _u(j)[None, :] * np.uint32(STEP & MASK))
        at = (w >> np.uint32(32 - size.bit_length() + 1)).astype(np.int64) if size & (size - 1) == 0 and size > 1 else below(w, size)
        np.copyto(at, size, where=j[None, :] >= m[:, None])  # past a replicate's draws: a place that is left out
        at += rows
        out += np.bincount(at.ravel(), minlength=n * (size + 1)).reshape(n, size + 1)
    return out[:, :size]


def leaves(n: int, rep: np.ndarray, stream: int, head: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, counts) of the leaves that have positions in [low, high), in order, a row of counts a replicate."""
    key = keys(stream, rep)

    def down(first: int, size: int, m: np.ndarray):
        if first >= high or first + size <= low:
            return
        if size <= LEAF:
            yield first, _leaf(key, first, size, m)
            return
        half = size // 2
        left = _ones(key, first + half, m)
        yield from down(first, half, left)
        yield from down(first + half, half, m - left)

    for k, (first, size) in enumerate(tops(n)):
        yield from down(first, size, head[:, k])


def runs(n: int, rep: np.ndarray, stream: int, head: np.ndarray, low: int, high: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, counts) of stretches of [low, high) in order, of `step` positions or a leaf more at most. A tree is gone
    through once, so that the time is that of the draws; asking for a stretch at a time goes down from its top each time."""
    held, at, size = [], low, 0
    for first, counts in leaves(n, rep, stream, head, low, high):
        own = counts[:, max(first, low) - first : min(high - first, counts.shape[1])]
        held.append(own)
        size += own.shape[1]
        if size >= step:
            yield at, np.concatenate(held, 1)
            held, at, size = [], at + size, 0
    if held:
        yield at, np.concatenate(held, 1)


def weights(n: int, rep: np.ndarray, stream: int = CLUSTERS, head: np.ndarray | None = None, low: int = 0, high: int | None = None) -> np.ndarray:
    """How often each position in [low, high) is drawn in each of these replicates."""
    high = n if high is None else high
    rep = np.asarray(rep)
    out = np.zeros((len(rep), high - low), np.int64)
    for first, counts in leaves(n, rep, stream, heads(n, rep, stream) if head is None else head, low, high):
        a, b = max(first, low), min(first + counts.shape[1], high)
        out[:, a - low : b - low] = counts[:, a - first : b - first]
    return out


def choices(stream: int, rep: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """One of n for each (replicate, slot)."""
    return below(words(keys(stream, rep), slot, 0), n)
