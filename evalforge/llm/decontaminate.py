"""Benchmark decontamination: an FM-index per training shard, searched backwards for every benchmark window.

The benchmark is the stated query set. Its words are the index's alphabet; any other word of a shard ends a run, and
a run shorter than the shortest window can hold none of them and isn't indexed. A shard is up to SHARD_BYTES of
whole texts of one task (a longer text alone is a shard). Windows are found by wavelet-matrix ranks, their
occurrences by sampled suffix positions; hits are held against the words themselves (the alphabet is by hash), and
their spans are merged.

The benchmark is searched in blocks of up to BLOCK_BYTES, each of which is broadcast; a block is a narrow stage of its
own that adds to what the stages before it found, so any number of blocks needs no shuffle. After CHAINED of them what
is found is written, so neither the driver nor a task holds more than so many at once.

Defined results: null or empty texts have no words and are never contaminated; an item without words has no window;
an item of fewer words than `window` is one window. Repeated rows are judged each. Extra columns are kept, those
named like a result (n_words, n_hit, n_items, items_sha256, contaminated, hits, items) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .fm_index import FMIndex
from .shared import chunks, materialise, small_batches, take

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Blocks that are searched in one job; what they found is written before the next ones.
CHAINED = 4
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items")


class Patterns:
    """The windows of a block of items over an alphabet of the block's words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(ids)}
        raw = [words.LOWER[np.frombuffer((t or "").encode(), np.uint8)] for _, t in items]
        spelled: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for (item, _), data in zip(items, raw):
            start, end, _ = words.bounds(data, np.array([0, len(data)]), words.ALNUM)
            text = data.tobytes()
            line = [spelled.setdefault(text[s:e], len(spelled) + 1) for s, e in zip(start.tolist(), end.tolist())]
            width = min(window, len(line))
            for k in range(len(line) - width + 1 if width else 0):
                found.setdefault(tuple(line[k : k + width]), set()).add(number[item])
        self.ids = ids
        self.words = [b""] + list(spelled)
        data = np.frombuffer(b"".join(spelled), np.uint8)
        edges = np.cumsum([0, *map(len, spelled)])
        h = words.hashes(data, edges[:-1], edges[1:])
        order = np.argsort(h)
        self.hash, self.symbol = h[order], order + 1
        self.length = np.array([len(w) for w in found], np.int64)
        self.table = np.zeros((len(found), window), np.int64)
        for k, w in enumerate(found):
            self.table[k, window - len(w) :] = w
        self.of = [np.array(sorted(v), np.int64) for v in found.values()]
        self.shortest = int(self.length.min()) if found else 0

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.symbol[at], 0)


class Shard:
    """Words of some texts; hits of the patterns as merged word spans and items a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.n = words.LOWER[data], len(offsets) - 1
        self.start, self.end, self.first = words.bounds(self.data, offsets, words.ALNUM)

    def find(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
        """(word, length) of every occurrence with its window, as columns word, window."""
        none = np.zeros(0, np.int64)
        if not len(self.start) or not len(patterns.length):
            return none, none
        symbol = patterns.symbols(words.hashes(self.data, self.start, self.end))
        fresh = np.zeros(len(symbol) + 1, bool)  # where a run can't go on from the word before
        fresh[self.first] = True
        fresh[0] = fresh[-1] = True
        fresh[:-1] |= symbol == 0
        fresh[1:] |= symbol == 0
        edge = np.flatnonzero(fresh)
        length = np.diff(edge)
        long = (length >= patterns.shortest) & (symbol[edge[:-1]] > 0)
        begin, length = edge[:-1][long], length[long]
        if not len(begin):
            return none, none
        ends = np.cumsum(length + 1)
        word = np.arange(int(ends[-1])) + np.repeat(begin - (ends - length - 1), length + 1)
        seq = symbol[np.minimum(word, len(symbol) - 1)]
        seq[ends - 1] = 0
        index = FMIndex(seq, len(patterns.words))
        lo, hi = index.search(patterns.table, patterns.length)
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        rows = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
        at = word[index.locate(rows)]
        return self._exact(patterns, at, which)

    def _exact(self, patterns: Patterns, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(at), bool)
        raw = self.data.tobytes() if len(at) else b""
        known: dict[int, bytes] = {}
        width = patterns.table.shape[1]
        for k, (a, w) in enumerate(zip(at.tolist(), which.tolist())):
            for j in range(patterns.length[w]):
                if a + j not in known:
                    known[a + j] = raw[self.start[a + j] : self.end[a + j]]
                if known[a + j] != patterns.words[patterns.table[w, width - patterns.length[w] + j]]:
                    keep[k] = False
                    break
        return at[keep], which[keep]


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint [start, end) pairs that cover the same words."""
    if len(spans) < 2:
        return spans.reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], 1)


def _ascii_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, _ = words.bounds(words.LOWER[data], np.array([0, len(data)]), words.ALNUM)
    return start, end


def cut_text(text: str, hits: list[int]) -> str:
    """The text without the hit words and what stands between words of one span."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end = _ascii_words(raw)
    out, at = [], 0
    for a, b in zip(hits[::2], hits[1::2]):
        out.append(raw[at : start[a]].tobytes())
        at = int(end[b - 1])
    out.append(raw[at:].tobytes())
    return b"".join(out).decode()


@lru_cache(maxsize=2)
def _patterns(key: int, shared) -> Patterns:
    return Patterns(*shared.value)


def _stage(shared, text: str, names: list[str], first: bool, cut: bool):
    def search(patterns: Patterns, batch, data, offsets):
        shard = Shard(data, offsets)
        at, which = shard.find(patterns)
        doc = np.searchsorted(shard.first, at, "right") - 1
        spans: list = [[] for _ in range(shard.n)]
        items: list = [[] for _ in range(shard.n)]
        before = None if first else (take(batch, "hits").to_pylist(), take(batch, "items").to_pylist())
        for d in np.unique(doc):
            own = doc == d
            a = at[own] - shard.first[d]
            got = np.stack([a, a + patterns.length[which[own]]], 1)
            spans[d] = got
            items[d] = {patterns.ids[i] for w in np.unique(which[own]).tolist() for i in patterns.of[w].tolist()}
        for d in range(shard.n):
            if before and len(before[0][d]):
                old = np.array(before[0][d], np.int64).reshape(-1, 2)
                spans[d] = np.concatenate([old, spans[d]]) if len(spans[d]) else old
                items[d] = set(before[1][d]) | set(items[d])
            spans[d] = merged(np.asarray(spans[d], np.int64).reshape(-1, 2)).ravel().tolist()
            items[d] = sorted(items[d])
        columns = [take(batch, n) for n in names]
        own = [d for d in range(shard.n) if spans[d]]
        if cut and own:
            at = names.index(text)
            mask = np.zeros(shard.n, bool)
            mask[own] = True
            columns[at] = pc.replace_with_mask(columns[at], pa.array(mask), pa.array([cut_text(columns[at][d].as_py(), spans[d]) for d in own], columns[at].type))
        n_words = pa.array(np.diff(shard.first), pa.int64())
        return pa.RecordBatch.from_arrays([*columns, n_words, pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "hits", "items"])

    def run(batches):
        patterns = _patterns(shared.id if hasattr(shared, "id") else id(shared), shared)
        for batch, data, offsets in chunks(batches, text, SHARD_BYTES):
            yield search(patterns, batch, data, offsets)

    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of up to `limit` bytes of text, one empty block if there are none. The driver holds one."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
    held, size, n = [], 0, 0
    for i, t in rows.toLocalIterator():
        held.append((i, t))
        size += len(t or "")
        if size > limit:
            yield held
            held, size, n = [], 0, n + 1
    if held or not n:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, cut: bool = False) -> DataFrame:
    """docs (or its columns `keep`) with n_words, hits (word spans start, end, ...; merged), items and what follows
    from them: n_hit, n_items, items_sha256, contaminated. With `cut` the spans are cut out of the texts."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in RESULTS]
    carried = list(dict.fromkeys([*keep, text]))
    docs = docs.select(*carried).withColumn(text, F.col(text).cast("string"))
    base = docs.schema.fields
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    todo = blocks(benchmark)
    block, k = next(todo), 0
    while block is not None:
        after = next(todo, None)
        if k and k % CHAINED == 0:
            docs = materialise(docs, "hits")
        shared = spark.sparkContext.broadcast((block, window))
        docs = docs.mapInArrow(_stage(shared, text, carried, k == 0, cut and after is None), T.StructType([*base, *added]))
        block, k = after, k + 1
    n_hit = F.aggregate(F.transform("hits", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select(
        *keep,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "hits",
        "items",
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """docs with the merged removal spans cut out of their texts; other rows as they are."""
    own = [f"own_{k}" for k in range(len(docs.columns))]  # columns named like a result are kept too
    found = find(docs.toDF(*own), benchmark, window, own[docs.columns.index(text)], cut=True)
    return found.select(*own).toDF(*docs.columns)
