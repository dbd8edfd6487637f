"""An FM-index over integer symbols: suffix array, wavelet matrix of the BWT, sampled suffix positions.

Symbol 0 separates runs. Separators sort by position and before all other symbols, so every suffix is distinct and
no match crosses one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; as many rounds as the log of the longest repeat inside a run."""
    n = len(seq)
    gaps = seq == 0
    k = int(gaps.sum())
    rank = np.where(gaps, np.cumsum(gaps), k + seq).astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        r = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])]) + 1
        if int(new[order[-1]]) == n:
            return order
        second = np.zeros(n, np.int64)
        second[: n - width] = new[width:] if width < n else 0
        rank = new * (n + 2) + second
        order = np.argsort(rank, kind="stable")
        width *= 2


class WaveletMatrix:
    """Rank and access over symbols below 2**levels: a packed bit vector a level and a running count a word."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.n, self.levels = len(seq), levels
        self.bits, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, start), self._ones(k, i)
            start = np.where(one, self.zeros[k] + a, start - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(k, i)
            symbol = symbol * 2 + one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return symbol


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int):
        """seq: int64, ends with 0; symbols: the number of symbols, 0 included."""
        self.n = len(seq)
        order = suffix_array(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.tree = WaveletMatrix(seq[order - 1], max(1, int(symbols - 1).bit_length()))
        run_start = np.zeros(self.n, bool)
        run_start[1:] = seq[:-1] == 0
        run_start[0] = True
        kept = (order % SAMPLE == 0) | run_start[order]  # a walk never has to cross a separator
        self.place = np.where(kept, np.cumsum(kept) - 1, -1)
        self.sampled = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each pattern; patterns stand at the right of their rows."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for step in range(width):
            on = live[lengths[live] > step]
            symbol = patterns[on, width - 1 - step]
            lo[on] = self.first[symbol] + self.tree.rank(symbol, lo[on])
            hi[on] = self.first[symbol] + self.tree.rank(symbol, hi[on])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back through the text until a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            at = self.place[rows]
            found = at >= 0
            out[todo[found]] = self.sampled[at[found]] + steps
            todo, rows = todo[~found], rows[~found]
            if len(todo):
                symbol = self.tree.access(rows)
                rows = self.first[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out
