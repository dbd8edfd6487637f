"""The byte-level BPE vocabulary of a .json file, piece by piece, through the tokenizers library."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .pretoken import Splitter, library_classes, special_cuts


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(library_classes(load(path)))


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[tuple[bytes, int], ...]:
    """Added tokens, whose strings the library takes out of a text before it splits."""
    return tuple((t.content.encode(), i) for i, t in sorted(load(path).get_added_tokens_decoder().items()) if not t.normalized)


#: Bytes of pieces that the library encodes as one text.
RUN = 1 << 16


@lru_cache(maxsize=4)
def _id_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id stands for (a character of a byte-level token is a byte)."""
    known = load(path).get_vocab(with_added_tokens=False)
    out = np.zeros(max(known.values()) + 1, np.int64)
    for token, i in known.items():
        out[i] = len(token)
    return out


def _joinable(pieces: list[bytes]) -> np.ndarray:
    """Which pieces are a space and a character that isn't white space: such ones, one after another, are split as they
    were. Bytes that white space beyond ASCII starts with are left out."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
    at = np.cumsum(size) - size
    second = data[at + 1]
    return (data[at] == 0x20) & (size > 1) & ((second > 0x20) & (second < 0x7F) | (second > 0xC2) & (second < 0xE0) | (second > 0xE3))


def _one_by_one(path: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    found = load(path).encode([p.decode() for p in pieces], is_pretokenized=True, add_special_tokens=False)
    ids = np.array(found.ids, np.int32)
    return ids, np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))


def _joined(path: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces that stand one after another in texts of RUN bytes; their ends tell whose ids are whose."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    cut = np.unique([0, *np.searchsorted(ends, np.arange(RUN, int(ends[-1]), RUN)).tolist(), len(pieces)])
    texts = [b"".join(pieces[a:b]).decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    ids = np.concatenate([np.array(e.ids, np.int32) for e in load(path).encode_batch_fast(texts, add_special_tokens=False)])
    until = np.cumsum(_id_bytes(path)[ids])
    last = np.searchsorted(until, ends)
    if until[-1] != ends[-1] or (until[last] != ends).any():  # an id over a border: never seen, and not relied on
        return _one_by_one(path, pieces)
    return ids, np.diff(np.concatenate([[-1], last]))


def encode_pieces(path: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after another, and the number of ids of each."""
    joins = _joinable(pieces)
    own = np.flatnonzero(joins)
    if not len(own):
        return _one_by_one(path, pieces)
    ids1, n1 = _joined(path, [pieces[k] for k in own.tolist()])
    rest = np.flatnonzero(~joins)
    if not len(rest):
        return ids1, n1
    ids2, n2 = _one_by_one(path, [pieces[k] for k in rest.tolist()])
    n = np.empty(len(pieces), np.int64)
    n[own], n[rest] = n1, n2
    of = np.repeat(joins, n)
    ids = np.empty(len(ids1) + len(ids2), np.int32)
    ids[of], ids[~of] = ids1, ids2
    return ids, n


class Pieces(NamedTuple):
    """The pieces of a chunk: a code for each, the different ones by code, the first piece of each text (one more at the
    end), and (text, piece before which it stands, id) of special tokens."""

    codes: np.ndarray
    distinct: pa.Array
    first: np.ndarray
    marks: list[tuple[int, int, int]]


def split(path: str, data: np.ndarray, offsets: np.ndarray) -> Pieces:
    marks: list[tuple[int, int, int]] = []
    known = specials(path)
    if len(known) > 1:
        raise ValueError("a vocabulary with several added tokens isn't supported")
    cut = special_cuts(data, offsets, known[0][0]) if known else None
    if cut is None:
        return Pieces(*splitter(path).coded(data, offsets), marks)
    data, edges, owner = cut
    codes, distinct, first = splitter(path).coded(data, edges)
    for k in range(1, len(owner)):
        if owner[k] == owner[k - 1]:
            marks.append((int(owner[k]), int(first[k]), known[0][1]))
    lead = np.searchsorted(owner, np.arange(len(offsets)))
    return Pieces(codes, distinct, first[lead], marks)


class PieceCache:
    """Ids of pieces seen so far, encoded once each; emptied when they hold too many bytes, so memory stays bounded."""

    LIMIT = 128 << 20

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.at, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look(self, pieces: Pieces) -> np.ndarray:
        """The place of each piece in the cache."""
        if self.held > self.LIMIT:
            self.clear()
        own = pieces.distinct.to_numpy(zero_copy_only=False).tolist()
        where = np.fromiter(map(self.places.get, own, repeat(-1)), np.int64, len(own))
        unknown = np.flatnonzero(where < 0)
        if len(unknown):
            new = [own[k] for k in unknown.tolist()]
            where[unknown] = np.arange(len(self.at), len(self.at) + len(new))
            self.places.update(zip(new, where[unknown].tolist()))
            ids, n = encode_pieces(self.path, new)
            self.held += sum(map(len, new)) + 100 * len(new) + 4 * len(ids)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.flat = np.concatenate([self.flat, ids])
        return where[pieces.codes]

    def ids(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, and the end of each piece among them."""
        n = self.length[where]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[where] - ends + n, n) + np.arange(total)], ends
