"""Measures of an order of samples by confidence: risk-coverage, AURC, AUROC, deciles.

No order is made over a whole cell at once. Equal confidences are summed first where ties are averaged; where each
row needs its place, rows are dealt by (cell, slice of the confidence range), ordered there, and set off by the
slices before, of which a cell has OCTAVES * (PARTS + 1) at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices of an octave of the distance from 1, and the octaves that are told apart.
PARTS, OCTAVES = 256, 50


def _slice(conf: str = "conf"):
    """Smaller for greater confidences in [0, 1]. Each halving of the distance from 1 has as many slices, so confidences
    that pile up near 1 are cut as finely as others."""
    far = F.least(F.greatest(1 - F.col(conf), F.lit(2.0**-OCTAVES)), F.lit(1.0))
    octave = F.floor(-F.log2(far))
    return ((OCTAVES - octave) * (PARTS + 1) + F.floor((far * F.pow(F.lit(2.0), octave + 1) - 1) * PARTS)).cast("int")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], slices: int = 1024) -> DataFrame:
    """keys, n and, for each name: share, the exact quantile of a column by linear interpolation; nulls don't count.

    Equal values are summed first; the others are placed by slices of each key's range, so no task orders a whole key."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    span = counted.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    at = F.least(F.coalesce(F.floor((F.col(value) - F.col("_lo")) * slices / width), F.lit(0)), F.lit(slices - 1))
    part = counted.join(F.broadcast(span), keys).withColumn("_s", at) if keys else counted.join(F.broadcast(span)).withColumn("_s", at)
    sums = part.groupBy(*keys, "_s").agg(F.sum("_n").alias("_k"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*keys, "_s", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_b"), F.sum("_k").over(W.partitionBy(*keys)).alias("_all"))
    inside = W.partitionBy(*keys, "_s").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    rows = part.withColumn("_i", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(base, [*keys, "_s"])
    first, last = F.col("_b") + F.col("_i"), F.col("_b") + F.col("_i") + F.col("_n")
    out = {}
    for name, share in shares.items():
        place = share * (F.col("_all") - 1)
        for end, ix in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            out[f"_{name}_{end}"] = F.max(F.when((first <= ix) & (ix < last), F.col(value)))
    found = rows.groupBy(*keys, "_all").agg(*(v.alias(n) for n, v in out.items()))
    mixed = lambda n, s: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * (s * (F.col("_all") - 1) - F.floor(s * (F.col("_all") - 1)))
    return found.select(*keys, F.col("_all").alias("n"), *(mixed(n, s).alias(n) for n, s in shares.items()))


def tie_groups(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, conf, n, z: (weighted) rows and errors by distinct confidence."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*keys, "conf").agg(F.sum(w.cast("long")).alias("n"), F.sum((w * F.col("error")).cast("long")).alias("z")).filter("n > 0")


def preceded(groups: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """groups with, for each name: column, the sum of that column over greater confidences, and its total of the cell."""
    part = groups.withColumn("slice", _slice())
    sums = part.groupBy(*keys, "slice").agg(*(F.sum(c).alias(f"_{n}") for n, c in columns.items()))
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    base = sums.select(*keys, "slice", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_base") for n in columns), *(F.sum(f"_{n}").over(every).alias(f"{n}_all") for n in columns))
    inside = W.partitionBy(*keys, "slice").orderBy(F.desc("conf")).rowsBetween(W.unboundedPreceding, -1)
    out = part
    for n, c in columns.items():
        out = out.withColumn(f"_{n}_in", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = out.join(base, [*keys, "slice"])
    return out.select(*groups.columns, *((F.col(f"_{n}_base") + F.col(f"_{n}_in")).alias(n) for n in columns), *(f"{n}_all" for n in columns))


#: Terms of a harmonic number that are added one by one; beyond, its series is exact to the last digits.
HARMONIC = 256


def harmonic_span(before, n):
    """H(before + n) - H(before): terms up to HARMONIC one by one, beyond by the logarithm of a ratio and a short series, so no
    array is longer than that, however large a tie group."""
    end, edge = before + n, F.lit(HARMONIC).cast("long")
    near = F.aggregate(F.sequence(before + 1, F.least(end, edge)), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    low, high = F.greatest(before, edge).cast("double"), F.greatest(end, edge).cast("double")
    tail = lambda x: 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    far = F.log1p((high - low) / low) + tail(high) - tail(low)
    return F.when(before < edge, near).otherwise(0.0) + F.when(end > edge, far).otherwise(0.0)


def aurc_tie_averaged(df: DataFrame, keys: list[str], weight: str | None = None, name: str = "aurc") -> DataFrame:
    """The mean risk over coverages, averaged over all orders of equal confidences."""
    g = preceded(tie_groups(df, keys, weight), keys, {"before": "n", "wrong": "z"})
    part = F.col("wrong") * harmonic_span(F.col("before"), F.col("n")) + F.col("z") / F.col("n") * (F.col("n") - F.col("before") * harmonic_span(F.col("before"), F.col("n")))
    return g.groupBy(*keys).agg((F.sum(part) / F.sum("n")).alias(name))


def ranked(df: DataFrame, keys: list[str], tie: str = "sample_ix") -> DataFrame:
    """df with rn (place by falling confidence, then tie), cum_error up to it, n of the cell."""
    part = df.withColumn("slice", _slice())
    sums = part.groupBy(*keys, "slice").agg(F.count("*").alias("_n"), F.sum("error").alias("_z"))
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*keys, "slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_z").over(before), F.lit(0)).alias("_z0"), F.sum("_n").over(W.partitionBy(*keys)).alias("n"))
    inside = W.partitionBy(*keys, "slice").orderBy(F.desc("conf"), tie)
    out = part.withColumn("_rn", F.row_number().over(inside)).withColumn("_cz", F.sum("error").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return out.join(base, [*keys, "slice"]).select(*df.columns, (F.col("_n0") + F.col("_rn")).alias("rn"), (F.col("_z0") + F.col("_cz")).alias("cum_error"), "n")


def risk_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    return ranked(df, keys).withColumn("risk", F.col("cum_error") / F.col("rn")).withColumn("coverage", F.col("rn") / F.col("n"))


def accepted(share: float = 0.9):
    """How many rows a coverage of `share` takes: at least one."""
    return F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n")))


def selective(curve: DataFrame, keys: list[str]) -> DataFrame:
    """aurc_stable, uar90, and error rates of the first and last tenth, from a risk curve."""
    tenth = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    mean = lambda c: F.avg(F.when(c, F.col("error").cast("double")))
    return curve.groupBy(*keys).agg(
        F.avg("risk").alias("aurc_stable"),
        F.max(F.when(F.col("rn") == accepted(), F.col("risk"))).alias("uar90"),
        mean(F.col("rn") <= tenth).alias("top_decile_error"),
        mean(F.col("rn") > F.col("n") - tenth).alias("bottom_decile_error"),
        F.avg(F.col("error").cast("double")).alias("error_rate"),
        F.count("*").alias("n"),
    )


def auroc(df: DataFrame, keys: list[str], name: str = "auroc") -> DataFrame:
    """Chance that a right sample has a greater confidence than a wrong one, ties a half; null if all are alike."""
    g = preceded(tie_groups(df, keys), keys, {"before": "n", "wrong": "z"})
    good = F.col("n") - F.col("z")
    below = F.col("wrong_all") - F.col("wrong") - F.col("z")
    pairs = F.sum(good * below + good * F.col("z") / 2)
    right, wrong = F.sum(good), F.sum("z")
    return g.groupBy(*keys).agg(F.when((right > 0) & (wrong > 0), pairs / (right * wrong)).alias(name))
