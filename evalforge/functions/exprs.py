"""Column builders over per-sample arrays: calibrated probabilities, predictions, confidences, set measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column, temperature: float = 1.0) -> Column:
    """Logistic of the scaled logit, which is held within 50 of zero."""
    z = logit / F.lit(float(temperature))
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-50.0)), F.lit(50.0))))


def probabilities(logits: Column, temperature: float = 1.0) -> Column:
    return F.transform(logits, lambda z: sigmoid(z, temperature))


def hard(logits: Column, threshold: float = 0.0, labels: int | None = None) -> Column:
    """1 where a logit (or probability) reaches the threshold. With the number of labels, a few of them, the expression is spelled
    out and compiled; a lambda isn't."""
    if labels is not None:
        return F.array(*((F.get(logits, F.lit(c)) >= threshold).cast("int") for c in range(labels)))
    return F.transform(logits, lambda z: (z >= threshold).cast("int"))


def total(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def mismatches(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), "int")


def any_mismatch(a: Column, b: Column) -> Column:
    """1 if any label differs: arrays of as many labels are compared as a whole, which is compiled."""
    return (a != b).cast("int")


def state_probability(p: Column, predicted: Column) -> Column:
    """p where the label is predicted, else 1 - p."""
    return F.zip_with(p, predicted, lambda q, h: F.when(h == 1, q).otherwise(1 - q))


def binary_entropy(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


#: Confidence of a sample from its probabilities and its predicted states, by name.
CONFIDENCES = {
    "max_probability": lambda p, s: F.array_max(p),
    "min_state": lambda p, s: F.array_min(s),
    "mean_state": lambda p, s: total(s) / F.size(s),
    "one_minus_entropy": lambda p, s: 1 - total(F.transform(p, binary_entropy)) / F.size(p),
}


def f1(tp: Column, fp: Column, fn: Column, zero_division: float = 0.0) -> Column:
    below = 2 * tp + fp + fn
    return F.coalesce((2 * tp) / F.when(below != 0, below).cast("double"), F.lit(float(zero_division)))


def overlap(a: Column, b: Column) -> Column:
    """struct(common, joint): sizes of the intersection and union of two 0/1 arrays."""
    pairs = lambda op: total(F.zip_with(a, b, op), "int")
    return F.struct(pairs(lambda x, y: F.least(x, y)).alias("common"), pairs(lambda x, y: F.greatest(x, y)).alias("joint"))


def jaccard(common: Column, joint: Column) -> Column:
    """Intersection over union; two empty sets are alike."""
    return F.when(joint == 0, F.lit(1.0)).otherwise(common / joint)


def r6(c: Column) -> Column:
    """Six decimals, as all reported metrics."""
    return F.round(c, 6)
