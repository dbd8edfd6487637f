"""Bootstrap evaluation: statistics are summed by unit before they are weighed, and weights are made where the units are.

Units (clusters, components) get positions; a task holds a range of positions with the sums of all cells and multiplies them by
the weights that `draws` gives for that range, blocks of replicates at a time. All cells share one pass of draws, no table of
draws is joined, and a cell is spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import draws as D
from .graph import cut
from .maps import ranked

#: Bytes of the table that a task multiplies, and positions of a range where that leaves room.
TABLE, RANGE = 128 << 20, 1024
#: Replicates and positions whose weights are multiplied at once.
REP_BLOCK, POSITIONS = 1000, 1024


def interval(rows: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and percentile bounds over replicates, by linear interpolation."""
    tail = (1 - level) / 2
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return rows.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), q(tail).alias("low"), q(1 - tail).alias("high"), F.count("*").alias("n_reps"))


def positions(units: DataFrame, unit: str) -> tuple[DataFrame, int]:
    """(unit, _position) in order of the units, written, and how many there are."""
    named = cut(ranked(units.select(unit).distinct(), [unit], F.floor(F.col(unit) / 4096), "_position"))
    return named, named.count()


def head_table(spark: SparkSession, n: int, reps: int, stream: int) -> np.ndarray:
    """Draws of each replicate by node of `draws.tops`, worked out by tasks: a row a replicate, twice TOPS numbers at most,
    however many units there are."""
    tops = len(D.tops(n))
    if tops < 2:
        return np.full((reps, tops), n)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rep = f["id"].to_numpy()
            yield pd.DataFrame({"rep": rep, "m": list(D.heads(n, rep, stream))})

    rows = spark.range(0, reps, 1, min(reps, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "rep long, m array<long>").collect()
    out = np.zeros((reps, tops), np.int64)
    for r in rows:
        out[r["rep"]] = r["m"]
    return out


def _sums(n: int, reps: int, stream: int, shared, width: int, cells: int, columns: int):
    """(rep, _cell, columns) summed over a range of positions, from rows (_range, _position, _cell, columns) sorted by range."""

    def out(at: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        head, low, high = shared.value, at * width, min(n, (at + 1) * width)
        for a in range(0, reps, REP_BLOCK):
            rep = np.arange(a, min(reps, a + REP_BLOCK))
            total = np.zeros((len(rep), table.shape[1]))
            for s, counts in D.runs(n, rep, stream, head[rep], low, high, POSITIONS):
                total += counts.astype(float) @ table[s - low : s - low + counts.shape[1]]
            flat = total.reshape(-1, columns)
            own = [pa.array(np.repeat(rep, cells)), pa.array(np.tile(np.arange(cells, dtype=np.int32), len(rep)))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(columns))], ["rep", "_cell", *(f"c{k}" for k in range(columns))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table = None, None
        for b in batches:
            values = [np.asarray(c) for c in b.columns]
            for at in np.unique(values[0]).tolist():
                if at != current:
                    if table is not None:
                        yield from out(current, table)
                    current, table = at, np.zeros((min(n, (at + 1) * width) - at * width, cells * columns))
                own = values[0] == at
                row, first = values[1][own] - at * width, values[2][own] * columns
                for k in range(columns):
                    table[row, first + k] = values[3 + k][own]
        if table is not None:
            yield from out(current, table)

    return run


def numbered(stats: DataFrame, keys: list[str]) -> DataFrame:
    """_cell, keys: the distinct keys, the cells of a study, which are few, with numbers; they are listed on the driver."""
    kinds = {f.name: f.dataType for f in stats.schema.fields}
    found = [tuple(r) for r in stats.select(*keys).distinct().collect()]
    return stats.sparkSession.createDataFrame([(k, *v) for k, v in enumerate(sorted(found, key=str))], "_cell int, " + ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys))


def vectorised(stats: DataFrame, unit: str, keys: list[str], columns: list[str], reps: int, stream: int = D.CLUSTERS, named: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(rep, keys, columns): sums of the statistics over the units of each replicate's draw, from one row a unit and key.

    A draw takes as many units, with replacement, as there are; all keys share it. `named` are the units' positions, where
    they aren't those of stats."""
    spark = stats.sparkSession
    stats = cut(stats.select(unit, *keys, *(F.col(c).cast("double").alias(c) for c in columns)))
    named, n = named or positions(stats, unit)
    cells = numbered(stats, keys)
    count = cells.count()
    width = max(1, min(RANGE if n <= RANGE * 64 else n // 64, TABLE // max(1, 8 * count * len(columns))))
    shared = spark.sparkContext.broadcast(head_table(spark, n, reps, stream))  # 2 * TOPS numbers a replicate at most
    placed = stats.join(F.broadcast(cells), keys).join(named, unit).select(F.floor(F.col("_position") / width).cast("long").alias("_range"), "_position", "_cell", *columns)
    dealt = placed.repartition(max(1, min(-(-n // width), 2000)), "_range").sortWithinPartitions("_range")
    made = dealt.mapInArrow(_sums(n, reps, stream, shared, width, count, len(columns)), "rep long, _cell int, " + ", ".join(f"c{k} double" for k in range(len(columns))))
    summed = made.groupBy("rep", "_cell").agg(*(F.sum(f"c{k}").alias(c) for k, c in enumerate(columns)))
    return summed.join(F.broadcast(cells), "_cell").select("rep", *keys, *columns)


def drawn(units: DataFrame, unit: str, reps: int, stream: int = D.CLUSTERS) -> DataFrame:
    """rep, unit, weight: the draws themselves, a row a replicate and drawn unit. For some dozens of replicates."""
    spark = units.sparkSession
    named, n = positions(units, unit)
    shared = spark.sparkContext.broadcast(head_table(spark, n, reps, stream))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for low in f["id"]:
                w = D.weights(n, np.arange(reps), stream, shared.value, int(low), min(n, int(low) + POSITIONS))
                rep, at = np.nonzero(w)
                yield pd.DataFrame({"rep": rep, "_position": at + int(low), "weight": w[rep, at]})

    rows = spark.range(0, n, POSITIONS).mapInPandas(run, "rep long, _position long, weight long")
    return rows.join(named, "_position").select("rep", unit, "weight")


def seed_slots(spark: SparkSession, reps: int, seeds: list[int]) -> DataFrame:
    """rep, slot, seed: as many seeds a replicate as there are, drawn with replacement from a stream of their own."""
    n = len(seeds)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rep, slot = np.divmod(f["id"].to_numpy(), n)
            yield pd.DataFrame({"rep": rep, "slot": slot, "seed": np.asarray(seeds)[D.choices(D.SEEDS, rep, slot, n)]})

    return spark.range(reps * n).mapInPandas(run, "rep long, slot long, seed int")


def seed_draws(spark: SparkSession, reps: int, seeds: list[int]) -> DataFrame:
    """rep, seed, times: each replicate's seeds, counted."""
    return seed_slots(spark, reps, seeds).groupBy("rep", "seed").agg(F.count("*").alias("times"))


# -- AURC in each replicate ------------------------------------------------------------------------------------------------

#: Rows (unit, confidence) of a part of a cell: the least that is worth draws of its own, and the most that a task holds.
SLICE_ROWS, MOST_ROWS = 1 << 16, 1 << 22
#: Replicates of a part that are summed at once, as far as its confidences leave room for so many sums, and the positions (a
#: multiple of a leaf's) whose rows are added at once.
CURVE_BLOCK, CURVE_SUMS, STRETCH = 500, 1 << 23, 4096
#: Replicates whose sums are added to at once, so that they stay in a core's cache.
CACHED = 64
EULER = 0.5772156649015329
_EXACT = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 257))])


def _tail(n: np.ndarray) -> np.ndarray:
    """H(n) - ln(n) - EULER for n of 256 or more."""
    return 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)


def harmonic_span(before: np.ndarray, n: np.ndarray) -> np.ndarray:
    """H(before + n) - H(before): a table below 257, the logarithm of a ratio and a short series above."""
    before, end = np.asarray(before, float), np.asarray(before, float) + n
    low = np.where(before < 256, _EXACT[np.minimum(before, 256).astype(int)], 0.0)
    start = np.maximum(before, 256)
    far = np.log1p((np.maximum(end, 256) - start) / start) + _tail(np.maximum(end, 256)) - _tail(start)
    near = _EXACT[np.minimum(end, 256).astype(int)] - low
    return np.where(before >= 256, far, np.where(end <= 256, near, _EXACT[256] - low + far))


def _add(total: np.ndarray, group: np.ndarray, drawn: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
    """total[group] += drawn[at] * count, row by row, rows sorted by group: the first rows of all groups at once, then the second
    ones, so that each addition meets a group once."""
    if not len(group):
        return
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(place.max() + 2))
    rounds = [(group[own], at[own], None if (count[own] == 1).all() else count[own, None].astype(total.dtype)) for own in np.split(order, ends[1:-1])]
    for a in range(0, total.shape[1], CACHED):
        sums, w = np.ascontiguousarray(total[:, a : a + CACHED]), np.ascontiguousarray(drawn[:, a : a + CACHED])
        for g, p, c in rounds:
            sums[g] += w[p] if c is None else w[p] * c
        total[:, a : a + CACHED] = sums


def _curve(n: int, reps: int, stream: int, shared, keys: list[str]):
    """Contributions of a part of a cell to its AURC, by replicate, from its rows and what stands before it.

    Draws are made once a part, in order of the units; rows of a stretch of units are added to the sums of their confidence and of
    whether they are wrong."""

    def run(rows: pd.DataFrame, prior: pd.DataFrame) -> pd.DataFrame:
        own = [rows[c].iloc[0] for c in keys]
        at, conf = rows["_position"].to_numpy(), rows["conf"].to_numpy()
        known, tie = np.unique(-conf, return_inverse=True)
        wrong, right = rows["z"].to_numpy(), (rows["n"] - rows["z"]).to_numpy()
        at, group, count = np.concatenate([at, at]), np.concatenate([2 * tie, 2 * tie + 1]), np.concatenate([right, wrong])
        order = np.lexsort((group, at // STRETCH))
        order = order[count[order] > 0]
        at, group, count = at[order], group[order], count[order]
        prior = prior.sort_values("rep")
        base, lost = prior["before"].to_numpy(float), prior["lost"].to_numpy(float)
        value, step = np.empty(reps), max(1, min(CURVE_BLOCK, CURVE_SUMS // len(known)))
        for a in range(0, reps, step):
            rep = np.arange(a, min(reps, a + step))
            total, most = np.zeros((2 * len(known), len(rep)), np.int32), 0
            for s, e, w in _blocks(n, rep, stream, shared.value[rep], at):
                most += int(w[0].max()) * int(count[s:e].sum())
                if most >> 31 and total.dtype == np.int32:
                    total = total.astype(np.int64)
                _add(total, group[s:e], w[0], at[s:e] - w[1], count[s:e])
            z = total[1::2].T.astype(np.int64)
            k = total[::2].T + z
            before = base[rep, None] + np.cumsum(k, 1) - k
            errors = lost[rep, None] + np.cumsum(z, 1) - z
            span = harmonic_span(before, k)
            share = np.divide(z, k, out=np.zeros(k.shape), where=k > 0)
            value[rep] = (errors * span + share * (k - before * span)).sum(1)
        return pd.DataFrame({"rep": np.arange(reps), **dict(zip(keys, own)), "value": value})

    return run


def _blocks(n: int, rep: np.ndarray, stream: int, head: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, int]]]:
    """(first row, end, (draws by position and replicate, first position)) of each stretch of STRETCH that has rows; `at` are
    the rows' positions, in order of the stretches."""
    stretch = at // STRETCH
    held, low = [], 0
    for first, counts in D.leaves(n, rep, stream, head, 0, n):
        held.append(np.ascontiguousarray(counts.T, np.int32))
        if first + counts.shape[1] - low >= STRETCH or first + counts.shape[1] >= n:
            s, e = np.searchsorted(stretch, [low // STRETCH, low // STRETCH + 1])
            if e > s:
                yield s, e, (np.concatenate(held), low)
            held, low = [], first + counts.shape[1]


def aurc(rows: DataFrame, unit: str, keys: list[str], reps: int, stream: int = D.CLUSTERS, named: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(rep, keys, value): tie-averaged AURC of each cell in each replicate, from samples (unit, keys, conf, error).

    A cell is cut by confidence into parts, as many in all cells as keep the cores busy, of SLICE_ROWS to MOST_ROWS rows or one
    slice; each makes the draws once, so their time grows with the units, not with units times parts. What stands before a
    part in a replicate is a sum that `vectorised` makes; given it, each part's share of the area stands alone, and shares are
    added up."""
    from .ranking import _slice

    spark = rows.sparkSession
    grouped = rows.groupBy(*keys, unit, "conf").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("z"))
    grouped = cut(grouped.withColumn("_slice", _slice()))
    named, n = named or positions(grouped, unit)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)  # thousands of slices a cell at most
    size = max(SLICE_ROWS, min(MOST_ROWS, grouped.count() // (4 * spark.sparkContext.defaultParallelism)))
    parts = grouped.groupBy(*keys, "_slice").agg(F.count("*").alias("_k")).select(*keys, "_slice", F.floor(F.sum("_k").over(before) / size).alias("_part"))
    placed = cut(grouped.join(parts, [*keys, "_slice"]).join(named, unit).drop("_slice"))
    sums = placed.groupBy(*keys, "_part", unit).agg(F.sum("n").alias("n"), F.sum("z").alias("z"))
    by = cut(vectorised(sums, unit, [*keys, "_part"], ["n", "z"], reps, stream, (named, n)))
    earlier = W.partitionBy("rep", *keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    prior = by.select("rep", *keys, "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)).alias("before"), F.coalesce(F.sum("z").over(earlier), F.lit(0.0)).alias("lost"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shared = spark.sparkContext.broadcast(head_table(spark, n, reps, stream))
    schema = ", ".join(["rep long", *(f"{k} {kinds[k]}" for k in keys), "value double"])
    own = placed.select(*keys, "_part", "_position", "conf", "n", "z").groupBy(*keys, "_part").cogroup(prior.groupBy(*keys, "_part"))
    shares = own.applyInPandas(_curve(n, reps, stream, shared, keys), schema)
    size = by.groupBy("rep", *keys).agg(F.sum("n").alias("_all"))
    return shares.groupBy("rep", *keys).agg(F.sum("value").alias("value")).join(size, ["rep", *keys]).select("rep", *keys, (F.col("value") / F.col("_all")).alias("value"))
