"""Clean against perturbed predictions of the same sample: flips and rationale overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def against_clean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Perturbed rows (level > 0) with the clean prediction of their (keys, sample) beside them as `clean`.

    The clean rows are one a sample and model; both sides are dealt by the same key, so Spark shuffles each once."""
    clean = df.filter("level = 0 and family = 0").select(*keys, "sample_ix", F.col("pred").alias("clean"))
    return df.filter("level > 0").join(clean, [*keys, "sample_ix"])


def mean(value: Column, weight: Column | None = None) -> Column:
    """The mean of the values that aren't null, each as often as weight says."""
    return F.avg(value) if weight is None else F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def flips(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    return pairs.groupBy(*keys).agg(mean(E.any_mismatch(F.col("pred"), F.col("clean")).cast("double"), weight).alias("flip_rate"))


def overlaps(pairs: DataFrame) -> DataFrame:
    """pairs with common and joint, the sizes of both label sets' intersection and union."""
    o = E.overlap(F.col("pred"), F.col("clean"))
    return pairs.withColumn("common", o["common"]).withColumn("joint", o["joint"])


def jaccard_parts(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Mean Jaccard, share of rows where both sets are empty, mean over the others (1 if there are none)."""
    j = E.jaccard(F.col("common"), F.col("joint"))
    return pairs.groupBy(*keys).agg(
        mean(j, weight).alias("jaccard"),
        mean((F.col("joint") == 0).cast("double"), weight).alias("empty_share"),
        F.coalesce(mean(F.when(F.col("joint") > 0, j), weight), F.lit(1.0)).alias("jaccard_nonempty"),
    )
