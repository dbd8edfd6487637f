"""Alignment of two tokenizers' tokens over the bytes of the same text: a byte-level BPE (A) and a sentencepiece model (B).

Both encode a space and the text, once, and the ids are written. A encodes pre-tokens, B segments that are cut before each
space after a character which isn't white space: no token runs over such a place (a vocabulary of B for which that doesn't
hold isn't cut), so each is encoded once and held in a bounded cache. Then token indices are repeated over the bytes they own,
for A and for B; each consecutive distinct pair of owners is an overlap (a link), and where both owners change a group ends.

Corpus-wide counts are summed in each task before they meet by pair. The most frequent pairs, TOP of them, are a bounded
table in every task, so hot pairs never reach the second shuffle; the rest join by shuffle as (row, pair, times).

Defined results: texts that are null or empty, or whose joined A or B bytes differ from space and text (U+2581 in a text, for
one), have no tokens: zeros and an empty groups_sha256; they don't count for others. Special tokens' strings are plain text.
Repeated rows and null doc_ids: a row each, and each row is a document that counts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import chunks, materialise, most_frequent, small_batches, take

#: Bytes of segments that are encoded as one text, and tokens of A that are aligned at once (or one text's).
RUN, AT_ONCE = 1 << 16, 1 << 18
#: Pairs that a task counts before it passes them on, and those of the table that every task holds.
HELD, TOP = 1 << 20, 1 << 20
SPACE, MARK = 0x20, "▁"


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[Callable[[list[bytes]], list[list[int]]], list[bytes], bool]:
    """How B encodes texts that start with a space, the bytes of its ids, and whether texts may be cut."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    names = own.id_to_piece(list(range(own.get_piece_size())))
    byte = re.compile(r"<0x([0-9A-F]{2})>")
    entries = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(MARK, " ").encode() for p in names]
    blank = [own.piece_to_id(MARK)]  # what a last space is; of an empty text the library says nothing

    def encode(texts: list[bytes]) -> list[list[int]]:
        return [ids if len(t) > 1 else blank for t, ids in zip(texts, own.encode([t[1:].decode() for t in texts], num_threads=1))]

    return encode, entries, not any(MARK in p.lstrip(MARK) for p in names)


@lru_cache(maxsize=2)
def sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of text each id stands for."""
    entries = pieces(b_path)[1]
    return tokens._id_bytes(a_path), np.fromiter(map(len, entries), np.int64, len(entries))


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets with a space before each text that has any."""
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], SPACE), np.concatenate([[0], np.cumsum(np.diff(offsets) + some)])


def _white(second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Whether a character's last byte, these before it, may be white space beyond ASCII."""
    return (second == 0xC2) | (third >= 0xE1) & (third <= 0xE3) & ((second == 0x9A) | (second == 0x80) | (second == 0x81))


def _solid(last: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Whether these are the last bytes of a character that is surely no white space."""
    return (last > 0x20) & (last < 0x7F) | (last >= 0x80) & ~_white(second, third)


def _before(data: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.zeros(k, np.uint8), data])[: len(data)]


def cuts(data: np.ndarray, offsets: np.ndarray, cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Where segments of spaced texts start (one more at the end), and the first segment of each text (one more)."""
    start = np.zeros(len(data) + 1, bool)
    if cut and len(data):
        start[:-1] = (data == SPACE) & _solid(*(_before(data, k) for k in (1, 2, 3)))
    start[offsets] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, offsets)


class Words:
    """Ids of B for segments seen so far; emptied when they hold too many bytes, so memory stays bounded."""

    LIMIT = 96 << 20

    def __init__(self, path: str):
        self.encode, self.entries, self.cuttable = pieces(path)
        self.sizes = np.fromiter(map(len, self.entries), np.int64, len(self.entries))
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.at, self.n, self.ok = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def look(self, own: list[bytes]) -> np.ndarray:
        """The place of each of these segments."""
        if self.held > self.LIMIT:
            self.clear()
        where = np.fromiter(map(self.places.get, own, repeat(-1)), np.int64, len(own))
        unknown = np.flatnonzero(where < 0)
        if len(unknown):
            new = [own[k] for k in unknown.tolist()]
            where[unknown] = np.arange(len(self.at), len(self.at) + len(new))
            self.places.update(zip(new, where[unknown].tolist()))
            ids, n, ok = self.encoded(new)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.n, self.ok = np.concatenate([self.ids, ids]), np.concatenate([self.n, n]), np.concatenate([self.ok, ok])
            self.held += sum(map(len, new)) + 180 * len(new) + 8 * len(ids)
        return where

    def encoded(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all segments one after another, how many each has, and whether their bytes are the segment's. Segments
        after which another may follow are encoded in texts of RUN bytes; their ends tell whose ids are whose."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        ends, data = np.cumsum(size), np.frombuffer(b"".join(segments), np.uint8)
        # a segment of fewer than three bytes looks back into the one before: its own first byte is a space
        solid = _solid(*(_before(data, k)[ends - 1] for k in (0, 1, 2))) & self.cuttable
        first = np.concatenate([[True], ~solid[:-1] | np.diff(np.concatenate([[0], ends[:-1]]) // RUN).astype(bool)])[: len(segments)]
        edge = [*np.flatnonzero(first).tolist(), len(segments)]
        found = self.encode([b"".join(segments[i:j]) for i, j in zip(edge, edge[1:])])
        ids, n, ok = [], np.zeros(len(segments), np.int64), np.zeros(len(segments), bool)
        for i, j, got in zip(edge, edge[1:], found):
            own = np.asarray(got, np.int64)
            until, want = np.cumsum(self.sizes[own]), ends[i:j] - (ends[i - 1] if i else 0)
            last = np.minimum(np.searchsorted(until, want), len(own) - 1)
            if len(own) and until[-1] == want[-1] and (until[last] == want).all() and b"".join(map(self.entries.__getitem__, got)) == b"".join(segments[i:j]):
                n[i:j], ok[i:j] = np.diff(np.concatenate([[-1], last])), True
                ids.append(own)
                continue
            for k in range(i, j):
                (one,) = self.encode([segments[k]])
                n[k], ok[k] = len(one), b"".join(map(self.entries.__getitem__, one)) == segments[k]
                ids.append(np.asarray(one, np.int64))
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), n, ok


def _spread(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of flat, n from at, one after another."""
    ends = np.cumsum(n)
    return flat[np.repeat(at - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    kind, name, width = (pa.BinaryArray, pa.binary(), np.int32) if len(data) < 2**31 else (pa.LargeBinaryArray, pa.large_binary(), np.int64)
    return kind.from_buffers(name, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, width)), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(maxsize=2)
def _caches(a_path: str, b_path: str) -> tuple[tokens.PieceCache, Words]:
    return tokens.PieceCache(a_path), Words(b_path)


def both_ids(a_path: str, b_path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A, their end in each text, ids of B, their end in each text; none of texts that a side doesn't give back."""
    a, b = _caches(a_path, b_path)
    data, full = spaced(data, offsets)
    codes, distinct, first = tokens.splitter(a_path).coded(data, full)
    ids_a, ends = a.ids(a.look(tokens.Pieces(codes, distinct, first, [])))
    ends_a = np.concatenate([[0], ends])[first]
    at, first = cuts(data, full, b.cuttable)
    held = _column(data, at).dictionary_encode()
    places = b.look(held.dictionary.to_numpy(zero_copy_only=False).tolist())[held.indices.to_numpy(zero_copy_only=False)]
    ids_b, ends_b = _spread(b.ids, b.at[places], b.n[places]), np.concatenate([[0], np.cumsum(b.n[places])])[first]
    bad = np.concatenate([[0], np.cumsum(~b.ok[places])])
    bytes_a = np.concatenate([[0], np.cumsum(tokens._id_bytes(a_path)[ids_a])])[ends_a]
    good = (bad[first[1:]] == bad[first[:-1]]) & (np.diff(bytes_a) == np.diff(full)) & (np.diff(full) > 0)
    n_a, n_b = np.diff(ends_a), np.diff(ends_b)
    return ids_a[np.repeat(good, n_a)], np.cumsum(np.where(good, n_a, 0)), ids_b[np.repeat(good, n_b)], np.cumsum(np.where(good, n_b, 0))


class Aligned(NamedTuple):
    """Tokens of texts against each other. Links and groups stand one after another: the tokens of A and B that a link ties,
    the group of each token, and the bytes before which groups end."""

    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    ends: np.ndarray


def align(size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Overlaps and groups of tokens of these sizes over the same bytes."""
    owner_a, owner_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    moves_a = np.concatenate([[True], owner_a[1:] != owner_a[:-1]])[: len(owner_a)]
    moves_b = np.concatenate([[True], owner_b[1:] != owner_b[:-1]])[: len(owner_b)]
    both = moves_a & moves_b
    group, at = np.cumsum(both) - 1, np.flatnonzero(moves_a | moves_b)
    return Aligned(owner_a[at], owner_b[at], group[moves_a], group[moves_b], np.append(np.flatnonzero(both), len(owner_a))[1:] if len(owner_a) else np.zeros(0, np.int64))


def group_bytes(found: Aligned, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` of all groups, and how many bytes each has."""
    n = len(found.ends)
    per_a, per_b = np.bincount(found.group_a, minlength=n), np.bincount(found.group_b, minlength=n)
    place_a = np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[found.group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(per_a)[found.group_b]
    value, mark, group = (np.empty(len(ids_a) + len(ids_b), t) for t in (np.int64, np.uint8, np.int64))
    value[place_a], value[place_b] = ids_a, ids_b
    group[place_a], group[place_b] = found.group_a, found.group_b
    mark[:] = ord(",")
    mark[place_a[np.cumsum(per_a) - 1]], mark[place_b[np.cumsum(per_b) - 1]] = ord("|"), ord(";")
    digits, power = np.ones(len(value), np.int64), 10
    while len(value) and (value >= power).any():
        digits += value >= power
        power *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    for k in range(int(digits.max(initial=0))):
        own = digits > k
        out[ends[own] - 2 - k] = 48 + value[own] // 10**k % 10
    return out, np.bincount(group, digits + 1, n).astype(np.int64)


def _dtype(a_path: str, b_path: str) -> str:
    return "<u2" if max(map(len, sizes(a_path, b_path))) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, a, b: the ids of every text as little-endian integers, written."""
    kind = _dtype(a_path, b_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch, data, offsets in chunks(batches):
            ids_a, ends_a, ids_b, ends_b = both_ids(a_path, b_path, data, offsets)
            width = np.dtype(kind).itemsize
            held = [_column(np.ascontiguousarray(i, kind).view(np.uint8), np.concatenate([[0], e]) * width).cast(pa.binary()) for i, e in ((ids_a, ends_a), (ids_b, ends_b))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), take(batch, "doc_id"), *held], ["row", "doc_id", "a", "b"])
            row += batch.num_rows

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(docs.mapInArrow(run, "row long, doc_id long, a binary, b binary"), "alignment-ids")


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    flat = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]].view(kind) if held else np.zeros(0, kind)
    return flat.astype(np.int64), (offsets - offsets[0]) // width


class Part(NamedTuple):
    """Rows of a batch with their ids, alignment, and which row each token of A is of."""

    batch: pa.RecordBatch
    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    found: Aligned
    text: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        return self.ids_a[self.found.link_a] << 32 | self.ids_b[self.found.link_b]

    @property
    def of(self) -> np.ndarray:
        return self.text[self.found.link_a]


def _parts(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[Part]:
    kind, (size_a, size_b) = _dtype(a_path, b_path), sizes(a_path, b_path)
    for batch in batches:
        if not batch.num_rows:
            continue
        (flat_a, all_a), (flat_b, all_b) = (_ids(take(batch, c), kind) for c in "ab")
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(all_a, all_a[at] + AT_ONCE, "right")) - 1)
            ids_a, ids_b = flat_a[all_a[at] : all_a[to]], flat_b[all_b[at] : all_b[to]]
            ends_a, ends_b = all_a[at : to + 1] - all_a[at], all_b[at : to + 1] - all_b[at]
            yield Part(batch.slice(at, to - at), ids_a, ids_b, ends_a, ends_b, align(size_a[ids_a], size_b[ids_b]), np.repeat(np.arange(to - at), np.diff(ends_a)))
            at = to


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, code = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pairs, np.bincount(code, np.concatenate([n for _, n in held]).astype(float), len(pairs)).astype(np.int64)


def _count(a_path: str, b_path: str):
    """(pair, n): in how many texts of a task each pair is linked; some HELD pairs are held at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays(list(map(pa.array, _summed(held))), ["pair", "n"])
        for part in _parts(batches, a_path, b_path):
            own, code = np.unique(part.pairs, return_inverse=True)
            if not len(own):
                continue
            once = np.zeros((len(part.ends_a) - 1) * len(own), bool) if (len(part.ends_a) - 1) * len(own) <= 1 << 26 else None
            both = part.of * len(own) + code
            if once is None:
                code = np.unique(both) % len(own)
            else:  # a flag for each text and pair is cheaper than sorting, where it is small
                once[both] = True
                code = np.flatnonzero(once) % len(own)
            held.append((own, np.bincount(code, minlength=len(own))))
            size += len(own)
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def pair_table(ids: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, best) of every pair that a document links: n documents, best if no other pair of its A id has more. A pair is
    the id of A times 2^32 plus that of B."""
    counted = ids.select("a", "b").mapInArrow(_count(a_path, b_path), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("a", F.shiftright("pair", 32).cast("int")), "alignment-pairs")
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # an entry of the vocabulary each: broadcast
    return counted.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _score(a_path: str, b_path: str, shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n, known_best = shared.value
        names = ["row", "doc_id", "pair", "times", *COLUMNS, "groups_sha256"]
        for part in _parts(batches, a_path, b_path):
            m, found, pairs, of = len(part.ends_a) - 1, part.found, part.pairs, part.of
            own, code = np.unique(pairs, return_inverse=True)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1) if len(known) else np.zeros(len(own), np.int64)
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            n, best = (np.where(hit, v[at], 0) if len(known) else np.zeros(len(own), np.int64) for v in (known_n, known_best))
            total = lambda x: pa.array(np.bincount(of, x[code].astype(float), m).astype(np.int64))  # noqa: B023, E731
            text, per = group_bytes(found, part.ids_a, part.ids_b)
            first = np.zeros(len(found.ends), np.int64)
            first[found.group_a] = part.text
            groups, edges = np.bincount(first, minlength=m), np.concatenate([[0], np.cumsum(np.bincount(first, per, m).astype(np.int64))]).tolist()
            raw = memoryview(np.ascontiguousarray(text))
            digests = [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edges, edges[1:])]
            rows, docs, zero = take(part.batch, "row"), take(part.batch, "doc_id"), pa.array(np.zeros(m, np.int64))
            counts = [np.diff(part.ends_a), np.diff(part.ends_b), groups, np.bincount(of, minlength=m)]
            alone = pa.array(-1 - rows.to_numpy())
            yield pa.RecordBatch.from_arrays([rows, docs, alone, zero, *(pa.array(c.astype(np.int64)) for c in counts), total(best), total(n), pa.array(digests, pa.string())], names)
            rest = np.flatnonzero(~hit[code])
            if len(rest):
                both, times = np.unique(of[rest] * len(own) + code[rest], return_counts=True)
                k, pair = np.divmod(both, len(own))
                zero = pa.array(np.zeros(len(k), np.int64))
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(k)), docs.take(pa.array(k)), pa.array(own[pair]), pa.array(times), *[zero] * 6, pa.nulls(len(k), pa.string())], names)

    return run


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = tokenised(docs, a_path, b_path)
    table = pair_table(ids, a_path, b_path)
    top = most_frequent(table, "n", TOP).select("pair", "n", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    kinds = ", ".join(f"{c} long" for c in COLUMNS)
    rows = ids.mapInArrow(_score(a_path, b_path, shared), f"row long, doc_id long, pair long, times long, {kinds}, groups_sha256 string")
    joined = rows.join(table, "pair", "left")
    more = {"n_best": F.col("times") * F.coalesce(F.col("best").cast("long"), F.lit(0)), "count_sum": F.col("times") * F.coalesce("n", F.lit(0))}
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(F.col(c) + more[c] if c in more else F.col(c)).alias(c) for c in COLUMNS), F.max("groups_sha256").alias("groups_sha256"))
    return summed.select("doc_id", *COLUMNS, "groups_sha256")


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, cuts (bytes of space and text before which a group ends) and links (places of overlapping tokens
    of A and B) of every row of docs (doc_id, text)."""
    kinds = "doc_id long, a_ids array<long>, b_ids array<long>, cuts array<long>, links array<struct<a: long, b: long>>"
    many, link = pa.list_(pa.int64()), pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("a_ids", many), ("b_ids", many), ("cuts", many), ("links", pa.list_(link))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = sizes(a_path, b_path)
        for batch, data, offsets in chunks(batches):
            ids_a, ends_a, ids_b, ends_b = both_ids(a_path, b_path, data, offsets)
            out = []
            for doc, a, b in zip(take(batch, "doc_id").to_pylist(), np.split(ids_a, ends_a[:-1]), np.split(ids_b, ends_b[:-1])):
                found = align(size_a[a], size_b[b])
                links = [{"a": x, "b": y} for x, y in zip(found.link_a.tolist(), found.link_b.tolist())]
                out.append({"doc_id": doc, "a_ids": a.tolist(), "b_ids": b.tolist(), "cuts": found.ends.tolist(), "links": links})
            yield pa.RecordBatch.from_pylist(out, schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)
