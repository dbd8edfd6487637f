"""Boxes (left, top, right, bottom), half-open, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L, T, R, B = "l", "t", "r", "b"


def area(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    return F.greatest(r - l, F.lit(0)) * F.greatest(b - t, F.lit(0))


def intersection(a: str, b: str) -> Column:
    """Area that boxes with these column prefixes share."""
    c = lambda p, x: F.col(f"{p}{x}")
    w = F.least(c(a, R), c(b, R)) - F.greatest(c(a, L), c(b, L))
    h = F.least(c(a, B), c(b, B)) - F.greatest(c(a, T), c(b, T))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def overlaps(a: str, b: str) -> Column:
    c = lambda p, x: F.col(f"{p}{x}")
    return (c(a, L) < c(b, R)) & (c(b, L) < c(a, R)) & (c(a, T) < c(b, B)) & (c(b, T) < c(a, B))


def cells(df: DataFrame, p: str, size: int) -> DataFrame:
    """df with a row for each grid cell that the box covers: cx, cy."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size))
    ok = df.filter((F.col(p + R) > F.col(p + L)) & (F.col(p + B) > F.col(p + T)))
    return ok.withColumn("cx", F.explode(span(p + L, p + R))).withColumn("cy", F.explode(span(p + T, p + B)))


def without_overlap(candidates: DataFrame, boxes: DataFrame, key: str, size: int = 64) -> DataFrame:
    """Candidates (key, cl, ct, cr, cb) that no box (dl, dt, dr, db) meets.

    Both sides are dealt by the grid cells they cover, so only boxes of one cell are compared: an equi-join, no
    product of the tables. Boxes in the same place are compared once, and a frame has so many places, however many boxes."""
    place = lambda p: [p + x for x in (L, T, R, B)]
    c, d = (cells(df.select(*place(p)).distinct(), p, size) for df, p in ((candidates, "c"), (boxes, "d")))
    hit = c.join(d, ["cx", "cy"]).filter(overlaps("c", "d")).select(*place("c")).distinct()
    return candidates.join(hit, place("c"), "left_anti")
