"""Boolean worlds: every assignment of bits, rules compiled to columns, attribution by deletion and insertion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 10
_TOKEN = re.compile(r"\s*(x\d+|AND|XOR|OR|NOT|MAJORITY|PARITY|[(),])")


def bit(row: Column, k: int) -> Column:
    return F.shiftright(row, k).bitwiseAND(F.lit(1))


def compile_rule(text: str, row: Column) -> Column:
    """A 0/1 column of a rule over bits x0, x1, ...: OR binds loosest, then XOR, then AND, then NOT; MAJORITY(...) is
    true for more than half (a tie is false), PARITY(...) for an odd number."""
    tokens = _TOKEN.findall(text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise ValueError(f"not a rule: {text}")
    at = 0

    def look() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal at
        if at >= len(tokens) or want and tokens[at] != want:
            raise ValueError(f"{want or 'more'} expected in: {text}")
        at += 1
        return tokens[at - 1]

    def chain(word: str, below, join) -> Column:
        out = below()
        while look() == word:
            take()
            out = join(out, below())
        return out

    def single() -> Column:
        word = take()
        if word == "NOT":
            return 1 - single()
        if word == "(":
            out = either()
            take(")")
            return out
        if word in ("MAJORITY", "PARITY"):
            take("(")
            parts = [either()]
            while look() == ",":
                take()
                parts.append(either())
            take(")")
            total = sum(parts[1:], parts[0])
            return (total * 2 > len(parts)).cast("int") if word == "MAJORITY" else total % 2
        if word[0] == "x":
            return bit(row, int(word[1:]))
        raise ValueError(f"unexpected {word} in: {text}")

    def both() -> Column:
        return chain("AND", single, lambda a, b: a * b)

    def differ() -> Column:
        return chain("XOR", both, lambda a, b: (a + b) % 2)

    def either() -> Column:
        return chain("OR", differ, lambda a, b: F.greatest(a, b))

    out = either()
    if at != len(tokens):
        raise ValueError(f"{look()} left over in: {text}")
    return out.cast("int")


def rows(spark: SparkSession, bits: int = BITS) -> DataFrame:
    return spark.range(1 << bits).select(F.col("id").cast("int").alias("row"))
