"""A bootstrap of samples that are of few kinds (profiles), each treated alike by every cell.

A pass over ranges of units counts how often each replicate draws the samples of each profile; that is all that grows with the
samples. Cells are worked out from the counts, blocks of replicates at a time: sums are products with what a profile adds, and
the order of a cell by confidence is an order of its profiles, made once. Counts of a range are kept in as few bytes as they need.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import draws as D
from .graph import cut
from .resample import STRETCH, harmonic_span, head_table, positions

#: Profiles that are counted at most: the counts of a pass are held by a task.
MOST = 1 << 18
#: Replicates whose cells a task works out, replicates of a pass over a range (a multiple), and rows of a range at most.
BLOCK, PASS, ROWS = 50, 250, 1 << 22
#: Rows that are added at once, so that they stay in a core's cache.
HELD = 2048


def _gather(total: np.ndarray, place: np.ndarray, drawn: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
    """total[place] += drawn[at] * count, row by row: the first rows of all places, then the second ones."""
    order = np.argsort(place, kind="stable")
    place, at, count = place[order], at[order], count[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    nth = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
    rounds = np.argsort(nth, kind="stable")
    ends = np.searchsorted(nth[rounds], np.arange(nth.max(initial=-1) + 2))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        for s in range(a, b, HELD):
            own = rounds[s : min(b, s + HELD)]
            w, c = drawn[at[own]], count[own]
            total[place[own]] += w if (c == 1).all() else w * c[:, None].astype(w.dtype)


def drawn_counts(rows: DataFrame, unit: str, places: int, reps: int, stream: int = D.CLUSTERS, named: tuple[DataFrame, int] | None = None) -> DataFrame:
    """block, kind, counts: how often the replicates of a block (BLOCK of them, the last may have fewer) draw the samples of each
    place, as bytes of a (places, replicates) matrix of that kind of number; a row for each range of units, to be added up.
    rows are (unit, place, n); `named` are the units' positions, where they aren't those of rows."""
    spark = rows.sparkSession
    named, n = named or positions(rows, unit)
    placed = cut(rows.join(named, unit).select("_position", "place", "n"))
    parts = max(1, min(-(-n // D.LEAF), max(spark.sparkContext.defaultParallelism, -(-placed.count() // ROWS))))
    width = max(1, -(-n // parts))
    shared = spark.sparkContext.broadcast(head_table(spark, n, reps, stream))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        at, place, count = (np.concatenate(c) for c in zip(*held))
        held.clear()
        low = int(at[0]) // width * width
        high = min(n, low + width)
        for a in range(0, reps, PASS):
            rep = np.arange(a, min(reps, a + PASS))
            total = np.zeros((places, len(rep)), np.int32)
            for s, w in D.runs(n, rep, stream, shared.value[rep], low, high, STRETCH):
                i, j = np.searchsorted(at, [s, s + w.shape[1]])
                if j > i:
                    _gather(total, place[i:j], np.ascontiguousarray(w.T, np.int32), at[i:j] - s, count[i:j])
            for b in range(0, len(rep), BLOCK):
                own = total[:, b : b + BLOCK]
                own = own.astype(np.min_scalar_type(int(own.max(initial=0))))
                yield pa.RecordBatch.from_arrays([pa.array([(a + b) // BLOCK], pa.int32()), pa.array([own.dtype.str]), pa.array([own.tobytes()], pa.binary())], ["block", "kind", "counts"])

    dealt = placed.repartitionById(parts, F.floor(F.col("_position") / width).cast("int")).sortWithinPartitions("_position")
    return dealt.mapInArrow(run, "block int, kind string, counts binary")


def packed(cells: DataFrame, keys: Sequence[str], places: int, labels: int) -> DataFrame:
    """keys and, as bytes by place, pred (labels as bits), extra (the sizes of its intersection and union with clean, 32 times
    the former), label (as bits), and order (a tie's number by falling confidence, twice, and whether the prediction is wrong),
    from rows (keys, place, pred, clean, label, conf); a place that a cell hasn't is of no label."""
    kind = "<u1" if labels <= 8 else "<u4"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at = f["place"].to_numpy()
        pred, clean, label = (f[c].to_numpy() for c in ("pred", "clean", "label"))
        extra = np.bitwise_count(pred & clean).astype(np.int64) * 32 + np.bitwise_count(pred | clean)
        tie = np.unique(-f["conf"].to_numpy(), return_inverse=True)[1]

        def held(values, kind):
            out = np.zeros(places, kind)
            out[at] = values
            return out.tobytes()

        own = {k: [f[k].iloc[0]] for k in keys}
        return pd.DataFrame({**own, "pred": [held(pred, kind)], "extra": [held(extra, "<u2")], "label": [held(label, kind)], "order": [held(2 * tie + (pred != label), "<u4")]})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return cells.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pred binary, extra binary, label binary, order binary")


def curve(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Tie-averaged AURC of each replicate, from counts (place, replicate) and a cell's order, as `packed` has it."""
    by = np.argsort(order, kind="stable")
    by = by[counts[by].any(1)]
    if not len(by):
        return np.full(counts.shape[1], np.nan)
    found = order[by]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    total = np.zeros((int(found[-1]) // 2 * 2 + 2, counts.shape[1]), np.int64)
    total[found[first]] = np.add.reduceat(counts[by], first, axis=0)
    z = total[1::2]
    k = total[::2] + z
    own = k.any(1)
    z, k = z[own], k[own]
    before, errors = np.cumsum(k, 0) - k, np.cumsum(z, 0) - z
    span = harmonic_span(before, k)
    share = np.divide(z, k, out=np.zeros(k.shape), where=k > 0)
    return (errors * span + share * (k - before * span)).sum(0) / k.sum(0)


def macro_f1(weights: np.ndarray, pred: np.ndarray, label: np.ndarray, labels: int) -> np.ndarray:
    """Mean F1 of labels (0 of a label with none) in each replicate, from weights (replicate, place)."""
    bits = np.arange(labels)
    of = lambda x: (x[:, None] >> bits & 1).astype(float)
    common, own, its = (weights @ of(x) for x in (pred & label, pred, label))
    return np.divide(2 * common, own + its, out=np.zeros(common.shape), where=own + its > 0).mean(1)


def _cells(keys: Sequence[str], places: int, reps: int, labels: int, names: Sequence[str]):
    """metric, keys, rep, value of a block's replicates: names are those of F1, of flips or overlaps, and of AURC, if any."""
    kind = "<u1" if labels <= 8 else "<u4"

    def run(parts: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        block = int(parts["block"].iloc[0])
        rep = np.arange(block * BLOCK, min(reps, (block + 1) * BLOCK))
        counts = np.zeros((places, len(rep)), np.int32)
        for k, c in zip(parts["kind"], parts["counts"]):
            counts += np.frombuffer(c, k).reshape(counts.shape)
        weights = np.ascontiguousarray(counts.T, float)
        size, out = weights.sum(1), []
        for r in cells.itertuples(index=False):
            pred, extra, label = np.frombuffer(r.pred, kind), np.frombuffer(r.extra, "<u2"), np.frombuffer(r.label, kind)
            common, joint = extra >> 5, extra & 31
            if len(names) > 2:
                told = (common != joint).astype(float)  # a flip: some label differs
            else:
                told = np.divide(common, joint, out=np.ones(places), where=joint > 0)
            values = [macro_f1(weights, pred, label, labels), weights @ told / size]
            if len(names) > 2:
                values.append(curve(counts, np.frombuffer(r.order, "<u4").astype(np.int64)))
            for name, v in zip(names, values):
                out.append(pd.DataFrame({"metric": name, **{k: getattr(r, k) for k in keys}, "rep": rep, "value": v}))
        return pd.concat(out)

    return run


def evaluate(counts: DataFrame, cells: DataFrame, keys: Sequence[str], places: int, reps: int, labels: int, names: Sequence[str]) -> DataFrame:
    """metric, keys, rep, value of every cell in every replicate, from `drawn_counts` and `packed` cells. A block of replicates
    is a task, which gets all cells' profiles."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // BLOCK)))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    drop = [] if len(names) > 2 else ["order"]
    told = cells.drop(*drop).withColumn("at", blocks)
    run = _cells(list(keys), places, reps, labels, list(names))
    return counts.groupBy("block").cogroup(told.groupBy("at")).applyInPandas(run, "metric string, " + ", ".join(f"{k} {kinds[k]}" for k in keys) + ", rep long, value double")
