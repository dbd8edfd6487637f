"""Metrics as aggregates over (keys, weight): a weight of 1 is a point estimate, a draw's count a resampled one.

Input rows are one per cell and sample with 0/1 arrays `target` and `pred`; label-level measures explode the arrays
and aggregate on the map side, so only a row per cell and label is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def predicted(df: DataFrame, threshold: float = 0.0, labels: int | None = None) -> DataFrame:
    return df.withColumn("pred", E.hard(F.col("logit"), threshold, labels))


def confusion(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """tp, fp, fn by keys and class_ix."""
    w = F.lit(1) if weight is None else weight
    rows = df.select(*keys, w.cast("long").alias("w"), F.posexplode(F.arrays_zip("target", "pred")).alias("class_ix", "label"))
    t, p = F.col("label.target") == 1, F.col("label.pred") == 1
    count = lambda c, n: F.sum(F.when(c, F.col("w")).otherwise(0)).alias(n)
    return rows.groupBy(*keys, "class_ix").agg(count(t & p, "tp"), count(~t & p, "fp"), count(t & ~p, "fn"))


def class_f1(counts: DataFrame, zero_division: float = 0.0) -> DataFrame:
    return counts.withColumn("f1", E.f1(F.col("tp"), F.col("fp"), F.col("fn"), zero_division))


def macro_f1(counts: DataFrame, keys: list[str], name: str = "macro_f1") -> DataFrame:
    """The mean F1 over labels."""
    return class_f1(counts).groupBy(*keys).agg(F.avg("f1").alias(name))


def micro_f1(counts: DataFrame, keys: list[str]) -> DataFrame:
    pooled = counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return pooled.select(*keys, E.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"))


def scored(df: DataFrame, temperature: float = 1.0, confidence: str = "max_probability") -> DataFrame:
    """df with pred, error (any label differs), conf."""
    df = predicted(df).withColumn("p", E.probabilities(F.col("logit"), temperature))
    state = E.state_probability(F.col("p"), F.col("pred"))
    return df.withColumn("error", E.any_mismatch(F.col("pred"), F.col("target"))).withColumn("conf", E.CONFIDENCES[confidence](F.col("p"), state))


def ece_bins(df: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Right-closed equal bins, the first closed on both sides; empty ones have no row."""
    edges = [k / bins for k in range(1, bins)]
    at = sum((F.col("conf") > F.lit(e)).cast("int") for e in edges)
    out = df.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg(1 - F.col("error").cast("double")).alias("accuracy"))
    return out


def ece(binned: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_conf")) * F.col("n")
    return binned.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))
