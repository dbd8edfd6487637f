"""Checks of tables: expectations as rows, keyed comparisons, exclusions, partitions, allowlists, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check_name, failures, passed: one pass over df however many checks (true means the row fails)."""
    one = df.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"_{k}") for k, c in enumerate(checks.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"_{k}").alias("failures")) for k, n in enumerate(checks)))
    return one.select(F.inline(rows)).withColumn("passed", F.col("failures") == 0)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the greatest order: how a dictionary filled in that order ends."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def compare_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_both, n_left, n_right of distinct keys: one full join on the key."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer")
    count = lambda c, n: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n)
    return both.agg(count(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "n_both"), count(F.col("_b").isNull(), "n_left"), count(F.col("_a").isNull(), "n_right"))


def first_reason(df: DataFrame, reasons: list[tuple[str, Column]], otherwise: str = "kept") -> DataFrame:
    """df with `reason`: the first that holds, in this order."""
    out = reduce(lambda tail, r: F.when(r[1], F.lit(r[0])).otherwise(tail), reversed(reasons), F.lit(otherwise))
    return df.withColumn("reason", out)


def partition_cover(parts: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """n_missing, n_repeated, n_foreign: whether parts hold each key of the universe exactly once."""
    n = parts.groupBy(key).agg(F.count("*").alias("n"))
    both = universe.select(key).distinct().withColumn("_u", F.lit(1)).join(n, key, "full_outer")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return both.agg(count(F.col("n").isNull(), "n_missing"), count(F.col("n") > 1, "n_repeated"), count(F.col("_u").isNull(), "n_foreign"))
