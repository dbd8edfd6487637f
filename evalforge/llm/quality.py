"""Quality rules: base statistics of whole texts, and an isolation forest over what they say.

Documents that random splits isolate early are anomalous. The forest is grown on the driver on a bounded sample of
labelled rows that pass the base rules: of one half of them by a hash of doc_id, the FIT good ones (quality 1) with the
smallest hashes and at most BAD_SHARE times as many bad ones, which give the splits the room that good rows alone don't
span. The other half calibrates the threshold: the score that rejects most, a good row lost weighing as much as
GOOD_WEIGHT times its share of bad rows caught. Rows that fail the base rules are out in any case.

The forest sees shares that don't grow with a text, and that the base rules don't judge: code points a word, symbols a
word, and words that equal the one before them. (Repeated windows and lines, which good texts have with a licence or a
quotation, are left to the base rules: with them the forest loses 5 % of the good rows for the same bad ones.)

Defined results: null or empty text: zeros, base_failed. Without labelled rows of both kinds in the calibrating half no
score is out, and the base rules alone decide. Labels of unknown documents and null labels are ignored. Repeated rows: a
row each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import chunks, materialise, small_batches, take

WIDTH = 5
FIT, BAD_SHARE, TREES, SUBSAMPLE, SEED = 4096, 1 / 16, 100, 256, 7
GOOD_WEIGHT = 4.0
BINS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_doubled")


def _repeats(raw: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Words of each text in a window that it has twice or more. Equal hashes propose, the words decide."""
    n = len(first) - 1
    out = np.zeros(n, np.int64)
    win = words.windows(h, WIDTH)
    if not len(win):
        return out
    doc = np.repeat(np.arange(n), np.diff(first))
    inside = doc[: len(win)] == doc[WIDTH - 1 :]
    at = np.flatnonzero(inside)
    key = win[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    for d in np.unique(doc[at]).tolist():
        own = at[doc[at] == d]
        seen: dict[tuple, int] = {}
        line = {}
        tuples = []
        for a in own.tolist():
            for k in range(a, a + WIDTH):
                if k not in line:
                    line[k] = raw[start[k] : end[k]]
            t = tuple(line[k] for k in range(a, a + WIDTH))
            tuples.append(t)
            seen[t] = seen.get(t, 0) + 1
        hit = np.zeros(int(first[d + 1] - first[d]) + 1, np.int64)
        for a, t in zip((own - first[d]).tolist(), tuples):
            if seen[t] > 1:
                hit[a] += 1
                hit[a + WIDTH if a + WIDTH < len(hit) else -1] -= 1
        out[d] = int((np.cumsum(hit[:-1]) > 0).sum())
    return out


def _doubled(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before them, by their hashes."""
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    same[first[:-1]] = False
    return np.diff(np.concatenate([[0], np.cumsum(same[:-1])])[first])


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split(None, 1):
            seen.add(line)
    return n


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns STATS of a chunk's texts."""
    start, end, first = words.bounds(data, offsets, words.NOT_SPACE)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    raw = data.tobytes()
    dup = np.array([_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
    chars = per(words.NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    h = words.hashes(data, start, end)
    return [np.diff(first), chars, per(_SYMBOL[data]), dup, _repeats(raw, start, end, first, h), _doubled(h, first)]


def _measure(batches):
    for batch, data, offsets in chunks(batches):
        yield pa.RecordBatch.from_arrays([take(batch, "doc_id"), *(pa.array(c.astype(np.int64)) for c in statistics(data, offsets))], ["doc_id", *STATS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


def shares(stats: np.ndarray) -> np.ndarray:
    """What the forest looks at, from columns in the order of STATS."""
    n, chars, symbols, _, _, doubled = stats.astype(np.float64).T
    one = np.maximum(n, 1)
    return np.stack([chars / one, symbols / one, doubled / one], 1)


def _average_path(n: np.ndarray) -> np.ndarray:
    """The mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, left child (the right one follows it), path length at leaves."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    scale: float

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        limit = int(np.ceil(np.log2(max(2, size))))
        feature, split, child, depth, roots = [], [], [], [], []

        def node() -> int:
            for column, value in ((feature, -1), (split, 0.0), (child, -1), (depth, 0.0)):
                column.append(value)
            return len(feature) - 1

        for _ in range(trees):
            roots.append(node())
            todo = [(roots[-1], x[rng.choice(len(x), size, replace=False)], 0)]
            while todo:
                at, points, level = todo.pop()
                low, high = points.min(0), points.max(0)
                open_ = np.flatnonzero(high > low)
                if level >= limit or not len(open_):
                    depth[at] = level + float(_average_path(len(points)))
                    continue
                f = int(rng.choice(open_))
                s = float(rng.uniform(low[f], high[f]))
                feature[at], split[at], child[at] = f, s, node()
                node()
                left = points[:, f] <= s
                todo += [(child[at], points[left], level + 1), (child[at] + 1, points[~left], level + 1)]
        return cls(np.array(feature), np.array(split), np.array(child), np.array(depth), np.array(roots), max(1e-9, float(_average_path(size))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """From near 0 (ordinary) to 1 (isolated at once)."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            live = np.flatnonzero(self.feature[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = self.child[node] + (x[live, self.feature[node]] > self.split[node])
                live = live[self.feature[at[live]] >= 0]
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / self.scale)


def _scored(shared):
    def run(batches):
        forest = shared.value
        for b in batches:
            x = shares(np.stack([take(b, s).to_numpy(zero_copy_only=False) for s in STATS], 1)) if b.num_rows else np.zeros((0, 3))
            score = forest.score(x) if forest else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "anomaly"])

    return run


def threshold(good: np.ndarray, bad: np.ndarray, weight: float = GOOD_WEIGHT) -> float:
    """From counts by score bin: reject from this score on. The greatest gain in the share of bad rows over `weight`
    times the share of good ones, and of equal gains the greatest score; 1 if nothing is gained."""
    if not good.sum() or not bad.sum():
        return 1.0
    above = lambda n: np.append(np.cumsum(n[::-1])[::-1], 0) / n.sum()
    gain = above(bad) - weight * above(good)
    return (len(gain) - 1 - int(gain[::-1].argmax())) / len(good)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed, anomaly and kept of every row of docs, by the labels (doc_id, quality)."""
    spark = docs.sparkSession
    stats = materialise(measure(docs).withColumn("base_failed", base_failed()), "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    rows = stats.filter("not base_failed").join(known, "doc_id").withColumn("key", F.xxhash64("doc_id", F.lit(SEED)))
    grow = rows.filter("key % 2 = 0")
    least = lambda quality, n: grow.filter(F.col("quality") == quality).orderBy("key", "doc_id", *STATS).limit(n).select(*STATS).toPandas().to_numpy(np.int64)
    good = least(1, FIT)
    fit = np.concatenate([good, least(0, int(len(good) * BAD_SHARE))])
    shared = spark.sparkContext.broadcast(Forest.grow(shares(fit)) if len(good) else None)
    kind = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean"
    scored = stats.mapInArrow(_scored(shared), f"{kind}, anomaly double")
    held = rows.filter("key % 2 <> 0").select("doc_id", *STATS, "base_failed", "quality").mapInArrow(_scored(shared), f"{kind}, quality int, anomaly double")
    counts = held.groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "quality").count().collect()  # at most 2 * BINS rows
    seen = np.zeros((2, BINS), np.int64)
    for r in counts:
        seen[r["quality"], r["bin"]] += r["count"]
    cut = threshold(seen[1], seen[0])
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut if cut < 1 else F.lit(True)))
