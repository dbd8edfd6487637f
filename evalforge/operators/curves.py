"""Curves over ordered levels: steps, bottlenecks, reversals, crossings, endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def steps(curve: DataFrame, keys: list[str], level: str, value: str, sign: float = 1.0) -> DataFrame:
    """curve with `step`: the signed change from the level before; null at the first."""
    return curve.withColumn("step", sign * (F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(level))))


def bottleneck(curve: DataFrame, keys: list[str], level: str, value: str, sign: float = 1.0) -> DataFrame:
    """The smallest step of each curve."""
    return steps(curve, keys, level, value, sign).groupBy(*keys).agg(F.min("step").alias("bottleneck"))


def no_reversal(curve: DataFrame, keys: list[str], level: str, value: str, sign: float = 1.0) -> DataFrame:
    """Whether no step goes the wrong way; equal values pass."""
    return steps(curve, keys, level, value, sign).groupBy(*keys).agg(F.coalesce(F.every(F.col("step") >= 0), F.lit(True)).alias("no_reversal"))


def crossings(points: DataFrame, keys: list[str], order: str, difference: str, tolerance: float = 1e-12) -> DataFrame:
    """How often a difference changes sign along `order`; points within the tolerance of zero don't count."""
    signs = points.withColumn("sign", F.when(F.col(difference) > tolerance, 1).when(F.col(difference) < -tolerance, -1)).filter("sign is not null")
    turned = signs.withColumn("before", F.lag("sign").over(W.partitionBy(*keys).orderBy(order)))
    return turned.groupBy(*keys).agg(F.sum((F.col("sign") != F.col("before")).cast("long")).alias("n")).select(*keys, F.coalesce("n", F.lit(0)).alias("n_crossings"))


def endpoints(curve: DataFrame, keys: list[str], level: str, value: str, first: int, last: int, sign: float = 1.0) -> DataFrame:
    at = lambda v: F.max(F.when(F.col(level) == v, F.col(value)))
    return curve.groupBy(*keys).agg((sign * (at(last) - at(first))).alias("effect"))


def dominance(curves: DataFrame, keys: list[str], side: str = "side", coverage: str = "coverage", risk: str = "risk", tolerance: float = 1e-12, slices: int = 4096) -> DataFrame:
    """keys, share_below, share_above, share_equal (of the coverage, by whether side 0 has less, more or as much risk as side 1)
    and n_intervals, the stretches between changes.

    Curves are step functions: the risk at a coverage is that of the curve's first point at or after it. They are merged over
    the union of their coverages. No curve is ordered by one task: points are dealt by slices of the coverage, and what a slice
    needs of those after and before it is a row a slice."""
    at = lambda n: F.max(F.when(F.col(side) == n, F.col(risk)))
    x = curves.groupBy(*keys, F.col(coverage).alias("_c")).agg(at(0).alias("_a"), at(1).alias("_b"))
    x = x.withColumn("_s", F.floor(F.col("_c") * slices))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_c")))
    edge = x.groupBy(*keys, "_s").agg(first("_a").alias("_fa"), first("_b").alias("_fb"), F.max("_c").alias("_top"))
    order = W.partitionBy(*keys).orderBy("_s")
    later = order.rowsBetween(1, W.unboundedFollowing)
    edge = edge.select(*keys, "_s", F.first("_fa", True).over(later).alias("_na"), F.first("_fb", True).over(later).alias("_nb"), F.coalesce(F.lag("_top").over(order), F.lit(0.0)).alias("_low"))
    inside = W.partitionBy(*keys, "_s").orderBy("_c")
    after = inside.rowsBetween(0, W.unboundedFollowing)
    x = x.join(edge, [*keys, "_s"])
    x = x.withColumn("_x", F.coalesce(F.first("_a", True).over(after), F.col("_na"))).withColumn("_y", F.coalesce(F.first("_b", True).over(after), F.col("_nb")))
    gap = F.col("_x") - F.col("_y")
    x = x.withColumn("_sign", F.when(F.abs(gap) <= tolerance, 0).otherwise(F.signum(gap)).cast("int")).withColumn("_w", F.col("_c") - F.coalesce(F.lag("_c").over(inside), F.col("_low")))
    x = x.withColumn("_was", F.lag("_sign").over(inside))
    share = lambda v: F.sum(F.when(F.col("_sign") == v, F.col("_w")).otherwise(0.0))
    part = x.groupBy(*keys, "_s").agg(share(-1).alias("_l"), share(1).alias("_h"), share(0).alias("_e"), F.sum((F.col("_sign") != F.col("_was")).cast("long")).alias("_n"), F.min_by("_sign", "_c").alias("_first"), F.max_by("_sign", "_c").alias("_last"))
    part = part.withColumn("_new", (F.col("_first") != F.lag("_last").over(order)).cast("long"))
    return part.groupBy(*keys).agg(F.sum("_l").alias("share_below"), F.sum("_h").alias("share_above"), F.sum("_e").alias("share_equal"), (F.sum(F.coalesce("_n", F.lit(0)) + F.coalesce("_new", F.lit(0))) + 1).alias("n_intervals"))
