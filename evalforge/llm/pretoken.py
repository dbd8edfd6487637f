"""Pre-tokens of the byte-level BPE split pattern, found for whole chunks of texts in NumPy.

The pattern takes a contraction ('s 't 're 've 'm 'll 'd) where a match starts on an apostrophe, else a run of
letters, of numbers or of other non-space characters, each with one space before it if there is one, else white
space (the last character of a run stays for what follows it). Which character belongs to which class is asked of
the tokenizer library itself, once per character, so its Unicode tables decide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
#: What follows an apostrophe in the pattern (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def library_classes(tokenizer) -> Callable[[str], int]:
    """The class of a character as the tokenizers library's byte-level pre-tokenizer sees it."""
    split = tokenizer.pre_tokenizer.pre_tokenize_str

    def of(c: str) -> int:
        for beside, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(split(beside + c)) == 1:
                return kind
        return SPACE

    return of


class Splitter:
    """Cuts texts into pre-tokens; classes are learned as characters turn up."""

    def __init__(self, of: Callable[[str], int]):
        self.of = of
        self.table = np.full(0x110000, UNKNOWN, np.uint8)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.table[codes]
        if (kinds == UNKNOWN).any():
            for c in np.unique(codes[kinds == UNKNOWN]):
                self.table[c] = self.of(chr(c))
            kinds = self.table[codes]
        return kinds

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start among the code points; first: where texts start (those with characters)."""
        n = len(codes)
        kind = self.classes(codes)
        text_start = np.zeros(n + 1, bool)
        text_start[first] = True
        text_start[n] = True
        start = text_start[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        ends = np.empty(n, bool)  # the last character of a run
        ends[:-1] = start[1:]
        ends[-1] = True
        before = ends & space & ~text_start[1:]  # a run of white space with something after it in its text
        start |= before  # its last character is taken for itself
        joins = np.zeros(n, bool)  # the run after a plain space starts with that space
        joins[1:] = (before & (codes == 0x20))[:-1]
        start &= ~joins
        quote = np.flatnonzero(start & ends & (codes == 0x27))
        quote = quote[~text_start[quote + 1]]
        if len(quote):
            self._contract(codes, kind, start, ends, quote)
        return np.flatnonzero(start)

    @staticmethod
    def _contract(codes, kind, start, ends, quote) -> None:
        n = len(codes)
        one = codes[np.minimum(quote + 1, n - 1)]
        has_two = ~ends[np.minimum(quote + 1, n - 1)] & (quote + 2 < n)
        two = codes[np.minimum(quote + 2, n - 1)]
        for suffix in CONTRACTIONS:
            hit = one == ord(suffix[0])
            if len(suffix) == 2:
                hit &= has_two & (two == ord(suffix[1]))
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + len(suffix)
            after = after[after < n]
            start[after] = True

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes where pre-tokens of a chunk start (one more at the end), and the first of each text (one more)."""
        if not len(data):
            return np.zeros(1, np.int32), np.zeros(len(offsets), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        cut = np.searchsorted(lead, offsets)
        nonempty = np.unique(cut[:-1][cut[1:] > cut[:-1]])
        byte_at = lead[self.starts(codes, nonempty)]
        return np.append(byte_at, len(data)).astype(np.int32 if len(data) < 2**31 else np.int64), np.searchsorted(byte_at, offsets)

    def coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The code of each pre-token of a chunk, the different ones by code, and the first of each text (one more)."""
        at, first = self.cuts(data, offsets)
        kind = pa.BinaryArray if at.dtype == np.int32 else pa.LargeBinaryArray
        held = kind.from_buffers(pa.binary() if at.dtype == np.int32 else pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        found = held.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False), found.dictionary, first


def special_cuts(data: np.ndarray, offsets: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Where a special token's string stands inside single texts: data and offsets of the texts cut there, and the
    text of each segment; None if there is none."""
    raw = data.tobytes()
    if special not in raw:
        return None
    keep = np.ones(len(raw), bool)
    edges, owner = [], []
    for k in range(len(offsets) - 1):
        at, end = int(offsets[k]), int(offsets[k + 1])
        edges.append(at)
        owner.append(k)
        while (hit := raw.find(special, at, end)) >= 0:
            keep[hit : hit + len(special)] = False
            at = hit + len(special)
            edges.append(at)
            owner.append(k)
    position = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], position[[*edges, len(raw)]], np.array(owner)
