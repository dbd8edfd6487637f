"""URL filters: rules, and for other URLs the ratio of two character language models. DataFrame functions only.

The models are smoothed variable-order Markov models of accepted and of rejected URLs (those that the rules allow and
block), orders 0 to ORDER: a character's chance at each order is its count after the context plus WEIGHT times its
chance at the order below, over the context's count plus WEIGHT; below order 0 all of 256 are alike. A URL's score is
the mean over its characters (host and path, padded) of the difference of log chances. Of the URLs that rules decide,
parts 0 to 6 of PARTS by a hash of host and path make the models; parts 7 and 8 calibrate the cut, the one with the best
balanced accuracy over BINS bins of scores (half way in the gap below the bin); part 9 takes no part and is there to be
measured on.

Everything is counted by distinct (host, path), and chances are worked out once for each distinct gram of the corpus,
then joined with the URLs' grams.

Defined results: null URLs and those without "://" have an empty host and path, fit no rule and are blocked: there is
nothing to fetch. Where the calibrating parts lack URLs of either side, the model has no say and allows. Repeated rows: a row
each. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, materialise, most_frequent

ORDER, WEIGHT, BINS, SPAN = 3, 4.0, 400, 4.0
PARTS, CALIBRATING = 10, (7, 8)
ALLOW, BLOCK = "allow", "block"
#: Bytes that a gram and its ratio take in a broadcast table, at most.
GRAM_BYTES = 128
_PAD, _END = "\u0002", "\u0003"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """`block net/` or `allow example.net/en/`."""
    verdict, _, what = text.partition(" ")
    host, slash, path = what.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def part_of(host: Column, path: Column) -> Column:
    """Which of PARTS parts a host and path belong to."""
    return F.pmod(F.xxhash64(host, F.lit("part"), path), F.lit(PARTS))


def grams(text: Column) -> Column:
    """Every character of the padded text with the ORDER characters before it, in linear time for long texts."""
    chars = F.regexp_extract_all(F.concat(F.lit(_PAD * ORDER), text, F.lit(_END)), F.lit("(?s)."), F.lit(0))
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - (ORDER + 1)), lambda k: F.concat(*(F.get(c, k + j) for j in range(ORDER + 1))))
    return F.get(F.transform(F.array(chars), cut), F.lit(0))  # bound once: an expression inside a lambda is worked out anew for each element


def gram_ratios(counts: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(gram, n, ratio): log chance among accepted less that among rejected, from (gram, allow, block, n) counts."""
    size = ORDER + 1
    out = counts.select("gram", "n")
    chance = {k: F.lit(1 / 256) for k in (ALLOW, BLOCK)}
    for order in range(ORDER + 1):
        tail, context = F.substring("gram", size - order, order + 1), F.substring("gram", size - order, order)
        own = counts.groupBy(tail.alias("tail")).agg(*(F.sum(k).alias(f"{k}_{order}") for k in chance))
        out = out.withColumn("tail", tail).join(own, "tail").drop("tail")
        if order:
            after = counts.groupBy(context.alias("context")).agg(*(F.sum(k).alias(f"{k}_c{order}") for k in chance))
            out = out.withColumn("context", context).join(after, "context").drop("context")
        for k in chance:
            n = F.col(f"{k}_c{order}") if order else F.lit(totals[k])
            chance[k] = (F.col(f"{k}_{order}") + WEIGHT * chance[k]) / (n + WEIGHT)
    return out.select("gram", "n", (F.log(chance[ALLOW]) - F.log(chance[BLOCK])).alias("ratio"))


def rated(rows: DataFrame, ratios: DataFrame, most: int = BROADCAST_BYTES // GRAM_BYTES) -> DataFrame:
    """rows (gram, ...) with their ratio, from (gram, ratio, n). Up to `most` grams are broadcast. Of more, the most frequent
    ones are, among them those that start and end every URL, and the rest join by shuffle; each row is joined once."""
    if ratios.count() <= most:
        return rows.join(F.broadcast(ratios.drop("n")), "gram")
    few = most_frequent(ratios, "n", most).select("gram", "ratio")
    near = rows.join(F.broadcast(few), "gram", "left")
    far = near.filter(F.col("ratio").isNull()).drop("ratio").join(ratios.drop("n"), "gram")
    return near.filter(F.col("ratio").isNotNull()).unionByName(far)


def scores(urls: DataFrame) -> DataFrame:
    """(key, verdict, part, score) of distinct (key, host, path, verdict), verdict being a rule's or null."""
    rows = urls.select("key", "verdict", part_of(F.col("host"), F.col("path")).alias("part"), F.explode(grams(F.concat("host", "path"))).alias("gram"))
    is_ = lambda k: F.sum(((F.col("verdict") == k) & (F.col("part") < CALIBRATING[0])).cast("long"))
    counts = materialise(rows.groupBy("gram").agg(*(F.coalesce(is_(k), F.lit(0)).alias(k) for k in (ALLOW, BLOCK)), F.count("*").alias("n")), "grams")
    total = counts.agg(F.sum(ALLOW), F.sum(BLOCK)).first()
    ratios = materialise(gram_ratios(counts, {ALLOW: total[0] or 0, BLOCK: total[1] or 0}), "ratios")
    return rated(rows, ratios).groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("part").alias("part"), F.round(F.sum("ratio") / F.count("*"), 9).alias("score"))


def calibrate(scored: DataFrame) -> float | None:
    """The score from which URLs are allowed; None where the calibrating parts lack URLs of either side."""
    at = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS))
    own = scored.filter(F.col("verdict").isNotNull() & F.col("part").isin(*CALIBRATING))
    bins = own.groupBy(at.alias("bin")).agg(*(F.sum((F.col("verdict") == k).cast("long")).alias(k) for k in (ALLOW, BLOCK)))
    order, all_ = W.orderBy("bin"), W.partitionBy()  # of at most BINS + 1 rows
    below = order.rowsBetween(W.unboundedPreceding, -1)
    share = lambda k: F.try_divide(F.coalesce(F.sum(k).over(below), F.lit(0)), F.sum(k).over(all_))
    right = share(BLOCK) - share(ALLOW)  # null where a side has none
    edge = (F.coalesce(F.lag("bin").over(order) + 1, F.col("bin")) + F.col("bin")) / 2
    best = bins.select("bin", edge.alias("edge"), right.alias("gain")).agg(F.max_by("edge", F.struct("gain", -F.col("bin"))).alias("edge"), F.max("gain").alias("gain")).first()
    return None if best["gain"] is None else best["edge"] * 2 * SPAN / BINS - SPAN


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, score and cut of every row of pages (page_id, url)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = F.col("host"), F.col("path")
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", F.unhex(F.md5(F.concat("host", F.lit("\n"), "path").cast("binary"))))
    ruled = named.withColumn("by", rule_of(host, path, rules))
    distinct = named.filter("host <> '' or path <> ''").dropDuplicates(["host", "path"])
    scored = materialise(scores(distinct.withColumn("verdict", rule_of(host, path, rules)["verdict"])), "urls")
    cut = calibrate(scored)
    allowed = F.lit(True) if cut is None else F.col("score") >= cut
    model = F.when(F.col("score").isNull(), F.lit(BLOCK)).when(allowed, F.lit(ALLOW)).otherwise(F.lit(BLOCK))
    return ruled.join(scored.select("key", "score"), "key", "left").select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", model).alias("verdict"), "score", F.lit(cut).cast("double").alias("cut"))
