"""Boxes, time series, text rules, hashes, sampling and boolean worlds."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import geometry as G
from ..operators import maps as P
from ..operators import worlds as O
from ..operators.stretches import best_stretch
from ..sources import adapters as A
from .registry import query

FRAME_W, FRAME_H = 1280, 720
BOX_SQL = "box AS (SELECT p_partkey AS id, (p_partkey * 37) % 1200 AS l, (p_partkey * 91) % 640 AS t, (p_partkey * 37) % 1200 + 3 + p_partkey % 58 AS r, (p_partkey * 91) % 640 + 3 + (p_partkey * 7) % 58 AS b FROM part), det AS (SELECT s_suppkey AS did, (s_suppkey * 53) % 1200 AS dl, (s_suppkey * 29) % 640 AS dt, (s_suppkey * 53) % 1200 + 40 AS dr, (s_suppkey * 29) % 640 + 30 AS db FROM supplier)"


def boxes(spark, sf):
    k = F.col("p_partkey")
    left, top = k * 37 % 1200, k * 91 % 640
    return A.table(spark, sf, "part").select(k.alias("id"), left.alias("l"), top.alias("t"), (left + 3 + k % 58).alias("r"), (top + 3 + k * 7 % 58).alias("b"))


def detections(spark, sf):
    k = F.col("s_suppkey")
    left, top = k * 53 % 1200, k * 29 % 640
    return A.table(spark, sf, "supplier").select(k.alias("did"), left.alias("dl"), top.alias("dt"), (left + 40).alias("dr"), (top + 30).alias("db"))


@query(f"WITH {BOX_SQL} SELECT id, (r - l) * (b - t) AS area, greatest(0, least(r, 700) - greatest(l, 300)) * greatest(0, least(b, 500) - greatest(t, 100)) AS shared, round((l + r) / 2.0::DOUBLE / 1280, 9) AS cx, round((t + b) / 2.0::DOUBLE / 720, 9) AS cy, greatest(l - 8, 0) AS el, least(r + 8, 1280) AS er FROM box")
def box_geometry(spark, sf):
    zone = boxes(spark, sf).select("id", *(F.col(c).alias(f"x{c}") for c in "ltrb"), F.lit(300).alias("yl"), F.lit(100).alias("yt"), F.lit(700).alias("yr"), F.lit(500).alias("yb"))
    mid = lambda a, b, n: F.round((F.col(a) + F.col(b)) / 2.0 / n, 9)
    return zone.select("id", G.area(*(F.col(f"x{c}") for c in "ltrb")).alias("area"), G.intersection("x", "y").alias("shared"), mid("xl", "xr", FRAME_W).alias("cx"), mid("xt", "xb", FRAME_H).alias("cy"), F.greatest(F.col("xl") - 8, F.lit(0)).alias("el"), F.least(F.col("xr") + 8, F.lit(FRAME_W)).alias("er"))


CORRIDOR = "SELECT id, cx, y, 0.08::DOUBLE + 0.42::DOUBLE * y AS half FROM (SELECT id, (l + r) / 2560.0::DOUBLE AS cx, b / 720.0::DOUBLE AS y FROM box)"


@query(f"WITH {BOX_SQL} SELECT id, round(sqrt((r - l) * (b - t)) * (1 - abs(cx - 0.5::DOUBLE) / half), 6) AS score FROM ({CORRIDOR}) JOIN box USING (id) WHERE abs(cx - 0.5::DOUBLE) <= half")
def corridor_score(spark, sf):
    rows = boxes(spark, sf).withColumn("cx", (F.col("l") + F.col("r")) / 2560.0).withColumn("half", 0.08 + 0.42 * (F.col("b") / 720.0))
    off = F.abs(F.col("cx") - 0.5)
    return rows.filter(off <= F.col("half")).select("id", F.round(F.sqrt((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))) * (1 - off / F.col("half")), 6).alias("score"))


@query(f"WITH {BOX_SQL} SELECT id FROM box WHERE NOT EXISTS (SELECT 1 FROM det WHERE l < dr AND dl < r AND t < db AND dt < b)")
def box_overlap_antijoin(spark, sf):
    c = boxes(spark, sf).select("id", *(F.col(x).alias(f"c{x}") for x in "ltrb"))
    return G.without_overlap(c, detections(spark, sf), "id").select("id")


@query(f"WITH {BOX_SQL}, c AS (SELECT id % 50 AS scene, id, r - l AS w, (r - l) * (b - t) AS area, (id * 13) % 17 AS score FROM box) SELECT scene, arg_max(id, (score, w, -area, id)) AS best FROM c GROUP BY ALL")
def select_best_detection(spark, sf):
    rows = boxes(spark, sf).select((F.col("id") % 50).alias("scene"), "id", (F.col("r") - F.col("l")).alias("w"), ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).alias("area"), (F.col("id") * 13 % 17).alias("score"))
    return rows.groupBy("scene").agg(F.max_by("id", F.struct("score", "w", -F.col("area"), "id")).alias("best"))


CONTROL_SQL = "k AS (SELECT id % 50 AS scene, id, (l + r) // 2 AS cx, (t + b) // 2 AS cy, t * 1280 + l AS tie FROM box), crit AS (SELECT scene, arg_min(cx, id) AS kx, arg_min(cy, id) AS ky, min(id) AS kid FROM k GROUP BY ALL), cand AS (SELECT k.*, abs(cx - kx) AS dx, abs(cy - ky) AS dy FROM k JOIN crit USING (scene) WHERE id <> kid)"


def controls(spark, sf):
    """Candidates of each scene with their distances to its critical box (the one of the least id)."""
    k = boxes(spark, sf).select((F.col("id") % 50).alias("scene"), "id", F.floor((F.col("l") + F.col("r")) / 2).alias("cx"), F.floor((F.col("t") + F.col("b")) / 2).alias("cy"), (F.col("t") * FRAME_W + F.col("l")).alias("tie"))
    crit = k.groupBy("scene").agg(F.min_by("cx", "id").alias("kx"), F.min_by("cy", "id").alias("ky"), F.min("id").alias("kid"))
    return k.join(crit, "scene").filter("id <> kid").withColumn("dx", F.abs(F.col("cx") - F.col("kx"))).withColumn("dy", F.abs(F.col("cy") - F.col("ky")))


@query(f"WITH {BOX_SQL}, {CONTROL_SQL} SELECT scene, arg_min(id, (4 * dy + dx, dx * dx + dy * dy, tie, id)) AS control FROM cand WHERE dx * dx + dy * dy <= 250000 GROUP BY ALL")
def matched_control(spark, sf):
    far = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    return controls(spark, sf).filter(far <= 250000).groupBy("scene").agg(F.min_by("id", F.struct(4 * F.col("dy") + F.col("dx"), far, "tie", "id")).alias("control"))


@query(f"WITH {BOX_SQL}, {CONTROL_SQL} SELECT scene, arg_max(id, (dx * dx + dy * dy, -cx, -cy, -id)) AS control FROM cand GROUP BY ALL")
def farthest_control(spark, sf):
    far = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    return controls(spark, sf).groupBy("scene").agg(F.max_by("id", F.struct(far, -F.col("cx"), -F.col("cy"), -F.col("id"))).alias("control"))


@query(f"WITH {BOX_SQL} SELECT 'inverted' AS check_name, count(*) FILTER (r <= l OR b <= t) AS failures, count(*) FILTER (r <= l OR b <= t) = 0 AS passed FROM box UNION ALL SELECT 'outside', count(*) FILTER (l < 0 OR t < 0 OR r > 1280 OR b > 720), count(*) FILTER (l < 0 OR t < 0 OR r > 1280 OR b > 720) = 0 FROM box UNION ALL SELECT 'large', count(*) FILTER ((r - l) * (b - t) > 3000), count(*) FILTER ((r - l) * (b - t) > 3000) = 0 FROM box")
def mask_invariants(spark, sf):
    from ..operators.audit import expectations

    c = F.col
    return expectations(boxes(spark, sf), {"inverted": (c("r") <= c("l")) | (c("b") <= c("t")), "outside": (c("l") < 0) | (c("t") < 0) | (c("r") > FRAME_W) | (c("b") > FRAME_H), "large": (c("r") - c("l")) * (c("b") - c("t")) > 3000})


# -- time series and text -----------------------------------------------------------------------------------------------


@query("SELECT user_id, CAST(sum(CASE WHEN p AND NOT q THEN 1 ELSE 0 END) AS BIGINT) AS n_edges FROM (SELECT user_id, event_type = 'error' AS p, lag(event_type = 'error', 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events) GROUP BY ALL")
def rising_edges(spark, sf):
    rows = A.table(spark, sf, "events").withColumn("p", F.col("event_type") == "error")
    rows = rows.withColumn("q", F.lag("p", 1, False).over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.groupBy("user_id").agg(F.sum((F.col("p") & ~F.col("q")).cast("long")).alias("n_edges"))


@query("WITH e AS (SELECT user_id, sum(CASE WHEN p AND NOT q THEN 1 ELSE 0 END) AS seen FROM (SELECT user_id, event_type = 'error' AS p, lag(event_type = 'error', 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events) GROUP BY ALL), d AS (SELECT conv_id AS user_id, max(CAST(nullif(regexp_extract(text, '([0-9]{1,6})', 1), '') AS BIGINT)) AS declared FROM conversations GROUP BY ALL) SELECT count(*) AS n, count(declared) AS n_declared, CAST(sum(CASE WHEN declared = seen THEN 1 ELSE 0 END) AS BIGINT) AS n_equal FROM e LEFT JOIN d USING (user_id)")
def declared_vs_observed(spark, sf):
    said = A.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(F.max(F.nullif(F.regexp_extract("text", "([0-9]{1,6})", 1), F.lit("")).cast("long")).alias("declared"))
    both = rising_edges(spark, sf).join(said, "user_id", "left")
    return both.agg(F.count("*").alias("n"), F.count("declared").alias("n_declared"), F.sum(F.coalesce(F.col("declared") == F.col("n_edges"), F.lit(False)).cast("long")).alias("n_equal"))


#: Words that give an action away, by flag (fixed values; ASCII, so that engines agree on word ends).
LEXICON = {"licence": "licen[cs]e", "version": "version", "rights": "rights? reserved", "token": "token", "the": "(^|[^a-zA-Z])the([^a-zA-Z]|$)", "und": "(^|[^a-zA-Z])und([^a-zA-Z]|$)", "digits": "[0-9]{4}"}


@query("SELECT source, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}', 'i')) AS n_{k}" for k, p in LEXICON.items()) + " FROM documents GROUP BY ALL")
def lexicon_flags(spark, sf):
    return A.table(spark, sf, "documents").groupBy("source").agg(*(F.count_if(F.col("text").rlike(f"(?i){p}")).alias(f"n_{k}") for k, p in LEXICON.items()))


@query("SELECT o_orderkey, j, 0.25::DOUBLE + 0.5::DOUBLE * j AS at FROM orders, range(40) AS r(j) WHERE 1 + 2 * j < 4 * (o_orderkey % 17)")
def frame_schedule(spark, sf):
    # quarters of a second as integers: 1 + 2 j < 4 duration
    rows = A.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 17).alias("d")).filter("d > 0")
    return rows.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") * 2 - 1)).alias("j")).select("o_orderkey", "j", ((1 + 2 * F.col("j")) / 4.0).alias("at"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, regexp_matches(path, '(^|/)\\.\\.(/|$)') AS traversal, regexp_matches(path, '//') AS empty_part, regexp_matches(path, '[\\x00-\\x1f\\x7f]') AS control, regexp_matches(path, '(?i)(^|/)(con|prn|aux|nul|com[0-9]|lpt[0-9])(\\.|/|$)') AS device, strlen(path) > 255 AS too_long, regexp_matches(path, '/[^/]*:') AS stream, path <> nfc_normalize(path) AS not_composed FROM p")
def path_safety(spark, sf):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    checks = {"traversal": r"(^|/)\.\.(/|$)", "empty_part": "//", "control": r"[\x00-\x1f\x7f]", "device": r"(?i)(^|/)(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.|/|$)"}
    checks_ = [p.rlike(v).alias(k) for k, v in checks.items()]
    return A.table(spark, sf, "pages").select("page_id", *checks_, (F.octet_length(p) > 255).alias("too_long"), p.rlike("/[^/]*:").alias("stream"), (p != composed(p)).alias("not_composed"))


def composed(text):
    """Text in its composed form (NFC), which no built-in function makes."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return run(text)


PAIRS_SQL = "pairs AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_id, (event_id * 7919) % 9 AS hamming, 0.9::DOUBLE + ((event_id * 31) % 100) / 1000.0::DOUBLE AS ssim, CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS gap FROM events), "


def frame_pairs(spark, sf):
    """Frame pairs of each user in order: k, hamming, ssim, gap (1 where half a second isn't kept)."""
    rows = A.table(spark, sf, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return rows.select("user_id", "k", "event_id", (F.col("event_id") * 7919 % 9).alias("hamming"), (0.9 + F.col("event_id") * 31 % 100 / 1000.0).alias("ssim"), (F.col("event_id") % 23 == 0).cast("int").alias("gap"))


@query("WITH " + PAIRS_SQL + """ok AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY k) AS island FROM pairs WHERE hamming <= 7), isl AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, island ORDER BY k) AS run FROM ok),
  w AS (SELECT a.user_id, a.k AS s, b.k + 1 AS e, count(*) AS n, median(c.hamming) AS mh, median(c.ssim) AS ms FROM isl a JOIN isl b ON b.user_id = a.user_id AND b.island = a.island AND b.run = a.run AND b.k >= a.k + 5 JOIN isl c ON c.user_id = a.user_id AND c.island = a.island AND c.run = a.run AND c.k BETWEEN a.k AND b.k GROUP BY ALL),
  best AS (SELECT user_id, min((-n, mh, -ms, s, e)) AS x FROM w WHERE mh <= 4 AND ms >= 0.92::DOUBLE GROUP BY ALL) SELECT user_id, CAST(x[4] AS BIGINT) AS start_pair, CAST(x[5] AS BIGINT) AS end_pair, CAST(-x[1] AS BIGINT) AS pair_count, round(x[2], 6) AS median_hamming, round(-x[3], 6) AS median_ssim FROM best""")
def aligned_window_edge(spark, sf):
    """The longest, then best, stretch of six or more consecutive pairs in each user's series. Pairs that follow each other
    do so by half a second on both sides, so the time scale's slope is 1, within its bounds, wherever there is no gap.

    Runs are stretches without gaps or far pairs. A task goes through its users' near pairs in order and looks for the best
    window of a run, so neither a window nor a run becomes a row, and only runs that may beat the user's best are searched."""
    near = frame_pairs(spark, sf).filter("hamming <= 7 and user_id is not null").select("user_id", "k", "hamming", "ssim", "gap")
    best = near.repartition("user_id").sortWithinPartitions("user_id", "k").mapInArrow(_windows, "user_id long, s long, e long, n long, mh double, ms double")
    return best.select("user_id", F.col("s").alias("start_pair"), F.col("e").alias("end_pair"), F.col("n").alias("pair_count"), F.round("mh", 6).alias("median_hamming"), F.round("ms", 6).alias("median_ssim"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(user, first pair, hamming, ssim) of each run of near pairs: pairs of one user that follow each other, where none but the
    first has a gap before it. What is held is a batch, and a run that goes on in the next one."""
    held = []  # columns of an open run, a batch each
    whole = lambda: (int(held[0][0][0]), int(held[0][1][0]), *(np.concatenate([c[k] for c in held]) for k in (2, 3)))
    for b in batches:
        user, k, hamming, ssim, gap = (np.asarray(c) for c in b.columns)
        if not len(user):
            continue
        start = np.append(True, (user[1:] != user[:-1]) | (k[1:] != k[:-1] + 1)) | (gap == 1)
        if held and not gap[0] and (user[0], k[0]) == (held[-1][0][-1], held[-1][1][-1] + 1):
            start[0] = False
        cuts = [*np.flatnonzero(start).tolist(), len(user)]
        part = lambda a, e: (user[a:e], k[a:e], hamming[a:e], ssim[a:e])  # noqa: B023, E731
        if cuts[0]:
            held.append(part(0, cuts[0]))  # the open run goes on
        for a, e in zip(cuts[:-1], cuts[1:]):
            if held:
                yield whole()
            held = [part(a, e)]
    if held:
        yield whole()


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best window of each user that has one."""
    names = ["user_id", "s", "e", "n", "mh", "ms"]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 4 else pa.float64()) for n, c in enumerate(zip(*rows))], names)
    current, best, rows = None, None, []
    for user, first, hamming, ssim in _runs(batches):
        if user != current:
            if best is not None:
                rows.append((current, best[3], best[4], -best[0], best[1], -best[2]))
            current, best = user, None
            if len(rows) >= 1024:
                yield made(rows)
                rows = []
        shortest = 6 if best is None else -best[0]
        if len(hamming) < shortest:
            continue
        found = best_stretch(hamming.tolist(), ssim.tolist(), 4, 0.92, shortest)
        if found is not None:
            at, n, mh, ms = found
            own = (-n, mh, -ms, first + at, first + at + n)
            best = own if best is None else min(best, own)
    if best is not None:
        rows.append((current, best[3], best[4], -best[0], best[1], -best[2]))
    if rows:
        yield made(rows)


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), t AS (SELECT user_id, event_id, k - (n - 3) AS i FROM e WHERE k >= n - 3 AND n >= 3), h AS (SELECT user_id, event_id, k AS i FROM e WHERE k < 3),
  p AS (SELECT t.user_id, (t.event_id * 7919 + h.event_id * 31) % 9 AS hamming, 0.9::DOUBLE + ((t.event_id * 31 + h.event_id * 17) % 100) / 1000.0::DOUBLE AS ssim FROM t JOIN h ON h.user_id = t.user_id + 1 AND h.i = t.i)
  SELECT user_id, count(*) = 3 AND bool_and(hamming <= 7) AND median(hamming) <= 4 AND median(ssim) >= 0.92::DOUBLE AS matched FROM p GROUP BY ALL""")
def boundary_edge(spark, sf):
    """Whether a series goes on in the next one: the last three frames of the one against the first three of the other,
    pair by pair. All three are near, and their medians are close."""
    rows = A.table(spark, sf, "events").select("user_id", "event_id", "ts")
    place = lambda *o: F.row_number().over(W.partitionBy("user_id").orderBy(*o)) - 1
    head = rows.withColumn("i", place("ts", "event_id")).filter("i < 3").select((F.col("user_id") - 1).alias("user_id"), "i", F.col("event_id").alias("head"))
    last = rows.withColumn("j", place(F.desc("ts"), F.desc("event_id"))).filter("j < 3").select("user_id", (2 - F.col("j")).alias("i"), F.col("event_id").alias("tail"))
    whole = last.groupBy("user_id").count().filter("count = 3").select("user_id")
    pairs = last.join(whole, "user_id", "left_semi").join(head, ["user_id", "i"])
    pairs = pairs.select("user_id", ((F.col("tail") * 7919 + F.col("head") * 31) % 9).alias("hamming"), (0.9 + (F.col("tail") * 31 + F.col("head") * 17) % 100 / 1000.0).alias("ssim"))
    h = pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.every(F.col("hamming") <= 7).alias("near"), F.percentile("hamming", F.lit(0.5)).alias("mh"), F.percentile("ssim", F.lit(0.5)).alias("ms"))  # three values each
    return h.select("user_id", ((F.col("n") == 3) & F.col("near") & (F.col("mh") <= 4) & (F.col("ms") >= 0.92)).alias("matched"))


# -- hashes and sampling ----------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT o_orderkey, sha256('split|' || o_custkey) AS h FROM orders), u AS (SELECT o_orderkey, ('0x' || substr(h, 1, 15))::BIGINT AS x FROM h) SELECT CASE WHEN x < CAST(0.7::DOUBLE * 1152921504606846976 AS BIGINT) THEN 'train' WHEN x < CAST(0.9::DOUBLE * 1152921504606846976 AS BIGINT) THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM u GROUP BY ALL")
def hash_split(spark, sf):
    x = F.conv(F.substring(F.sha2(F.concat(F.lit("split|"), F.col("o_custkey")), 256), 1, 15), 16, 10).cast("long")
    rows = A.table(spark, sf, "orders").select(x.alias("x"))
    split = F.when(F.col("x") < int(0.7 * 2**60), "train").when(F.col("x") < int(0.9 * 2**60), "validation").otherwise("test")
    return rows.groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query("SELECT a.vec_id AS id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def phash_hamming(spark, sf):
    """Bits that differ between the 64-bit hash of a vector, the signs of its components, and that of the vector after it."""
    bit = lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.element_at(F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64))), i + 1)
    own = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.aggregate(F.transform("embedding", bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("hash"))
    other = own.select((F.col("id") - 1).alias("id"), F.col("hash").alias("next"))
    return own.join(other, "id").select("id", F.bit_count(F.col("hash").bitwiseXOR(F.col("next"))).cast("int").alias("distance"))


@query("WITH o AS (SELECT o_orderpriority AS stratum, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), g AS (SELECT DISTINCT stratum, k, CAST(round_even(k * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT) AS pos FROM o, range(10) AS r(k)) SELECT stratum, k, o_orderkey FROM o JOIN g USING (stratum, pos)")
def stratified_sample(spark, sf):
    rows = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stratum"), "o_orderkey", "o_totalprice")
    # places inside a stratum: by slices of the price, so a stratum isn't sorted by one task
    part = rows.withColumn("s", F.floor(F.col("o_totalprice") / 1000))
    sums = part.groupBy("stratum", "s").agg(F.count("*").alias("c"))
    base = sums.select("stratum", "s", F.coalesce(F.sum("c").over(W.partitionBy("stratum").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("c").over(W.partitionBy("stratum")).alias("n"))
    placed = part.withColumn("r", F.row_number().over(W.partitionBy("stratum", "s").orderBy("o_totalprice", "o_orderkey"))).join(base, ["stratum", "s"]).select("stratum", "o_orderkey", (F.col("b") + F.col("r") - 1).alias("pos"))
    want = sums.groupBy("stratum").agg(F.sum("c").alias("n")).select("stratum", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k")).select("stratum", "k", F.bround(F.col("k") * (F.col("n") - 1) / 9.0, 0).cast("long").alias("pos"))
    return placed.join(F.broadcast(want), ["stratum", "pos"]).select("stratum", "k", "o_orderkey")


# -- boolean worlds -------------------------------------------------------------------------------------------------------------

#: A bank of rules over ten bits (fixed values).
RULES = {"and": "x0 AND x1", "or_xor": "x0 OR x1 XOR x2", "majority": "MAJORITY(x0, x1, x2)", "tie": "MAJORITY(x0, x1)", "parity": "PARITY(x0, x1, x2, x3)", "nested": "(x0 OR NOT x4) AND (x5 XOR x6)", "mixed": "x0 AND x1 OR x2 AND NOT x3", "wide": "MAJORITY(x0, x1, x2, x3, x4) XOR x9"}
BIT = "(({0} >> {1}) & 1)"


def _b(k, row="row"):
    return BIT.format(row, k)


RULE_SQL = {
    "and": f"{_b(0)} * {_b(1)}",
    "or_xor": f"greatest({_b(0)}, ({_b(1)} + {_b(2)}) % 2)",
    "majority": f"CASE WHEN {_b(0)} + {_b(1)} + {_b(2)} >= 2 THEN 1 ELSE 0 END",
    "tie": f"CASE WHEN {_b(0)} + {_b(1)} > 1 THEN 1 ELSE 0 END",
    "parity": f"({_b(0)} + {_b(1)} + {_b(2)} + {_b(3)}) % 2",
    "nested": f"greatest({_b(0)}, 1 - {_b(4)}) * (({_b(5)} + {_b(6)}) % 2)",
    "mixed": f"greatest({_b(0)} * {_b(1)}, {_b(2)} * (1 - {_b(3)}))",
    "wide": f"((CASE WHEN {_b(0)} + {_b(1)} + {_b(2)} + {_b(3)} + {_b(4)} >= 3 THEN 1 ELSE 0 END) + {_b(9)}) % 2",
}
#: Assignments of ten bits are those of the orders' keys, so work and weights come from the table.
ROWS_SQL = "r AS (SELECT o_orderkey * 7919 % 1024 AS row, o_custkey * 104729 % 1024 AS mask FROM orders)"


def assignments(spark, sf):
    """row, mask: ten bits of an order, and ten more that tell which of them are flipped."""
    bits = lambda c, k: (F.col(c).cast("long") * k % (1 << O.BITS)).cast("int")
    return A.table(spark, sf, "orders").select(bits("o_orderkey", 7919).alias("row"), bits("o_custkey", 104729).alias("mask"))


def rule_rows(spark, sf):
    """row, rule, y of every order's assignment."""
    r = assignments(spark, sf)
    return r.select("row", F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), O.compile_rule(v, F.col("row")).alias("y")) for k, v in RULES.items()))))


@query(f"WITH {ROWS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(sum({v}) AS BIGINT) AS n_true, round(avg({v}), 6) AS prevalence FROM r" for k, v in RULE_SQL.items()))
def rule_prevalence(spark, sf):
    return rule_rows(spark, sf).groupBy("rule").agg(F.sum("y").alias("n_true"), F.round(F.avg("y"), 6).alias("prevalence"))


@query("WITH f AS (SELECT c_custkey AS world, k.bit, sha256('world|' || c_custkey || '|' || k.bit) AS h FROM customer, range(10) AS k(bit)), o AS (SELECT *, row_number() OVER (PARTITION BY world ORDER BY h, bit) - 1 AS rk FROM f) SELECT world, CAST(bit AS INTEGER) AS bit, CASE WHEN rk < 4 THEN 'causal' WHEN rk < 7 THEN 'proxy' ELSE 'nuisance' END AS role FROM o")
def boolean_worlds(spark, sf):
    """A world a customer: which of its ten bits are causal, proxies or nuisance, by the order of their hashes."""
    rows = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("world"), F.explode(F.sequence(F.lit(0), F.lit(O.BITS - 1))).alias("bit"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit("world"), "world", "bit"), 256)).withColumn("rk", F.row_number().over(W.partitionBy("world").orderBy("h", "bit")) - 1)
    return rows.select("world", "bit", F.when(F.col("rk") < 4, "causal").when(F.col("rk") < 7, "proxy").otherwise("nuisance").alias("role"))


@query("WITH o AS (SELECT c_nationkey AS world, c_custkey AS row, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('replace|' || c_nationkey || '|' || c_custkey), c_custkey) AS rk, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer) SELECT world, d.dose, count(*) AS n, CAST(sum(row) AS BIGINT) AS checksum FROM o, (VALUES (1), (2), (3), (4)) AS d(dose) WHERE rk <= floor(d.dose * 0.25::DOUBLE * size) GROUP BY ALL")
def replacement_prefix(spark, sf):
    """A world a nation: at each dose the first share of its customers in the order of their hashes. Places come from slices
    of the hash, so no task orders a nation."""
    rows = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("world"), F.col("c_custkey").alias("row"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit("replace"), "world", "row"), 256))
    o = P.ranked(rows, ["h", "row"], F.substring("h", 1, 3), "rk", ["world"]).join(F.broadcast(rows.groupBy("world").agg(F.count("*").alias("size"))), "world")  # a row a nation
    rows = o.withColumn("dose", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).filter(F.col("rk") < F.floor(F.col("dose") * 0.25 * F.col("size")))
    return rows.groupBy("world", "dose").agg(F.count("*").alias("n"), F.sum("row").alias("checksum"))


def _auc(insert: bool):
    """Mean response of each rule as bits are set to 0 (or restored) one after another, and the area below it."""

    def run(spark, sf):
        masks = [(1 << k) - 1 for k in range(O.BITS + 1)]
        r = assignments(spark, sf)
        step = lambda m: F.col("row").bitwiseAND(F.lit(m if insert else 1023 & ~m))
        cells = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(i).alias("step"), O.compile_rule(v, step(m)).alias("y")) for k, v in RULES.items() for i, m in enumerate(masks)))
        curve = r.select(F.inline(cells)).groupBy("rule", "step").agg(F.avg("y").alias("v"))
        pair = curve.withColumn("next", F.lead("v").over(W.partitionBy("rule").orderBy("step")))
        return pair.groupBy("rule").agg(F.round(F.sum((F.col("v") + F.col("next")) / 2) / O.BITS, 6).alias("auc"))

    return run


def _auc_sql(insert: bool) -> str:
    mask = "((1 << s.step) - 1)" if insert else "(1023 - ((1 << s.step) - 1))"
    rows = f"m AS (SELECT s.step, row & {mask} AS row FROM r, range(11) AS s(step))"
    curve = " UNION ALL ".join(f"SELECT '{k}' AS rule, step, avg({v}) AS v FROM m GROUP BY ALL" for k, v in RULE_SQL.items())
    return f"WITH {ROWS_SQL}, {rows}, c AS ({curve}), p AS (SELECT rule, v, lead(v) OVER (PARTITION BY rule ORDER BY step) AS nx FROM c) SELECT rule, round(sum((v + nx) / 2) / 10, 6) AS auc FROM p GROUP BY ALL"


query(_auc_sql(False), "deletion_auc")(_auc(False))
query(_auc_sql(True), "insertion_auc")(_auc(True))


#: The rules whose mean is the scalar that attributions explain.
ACTION_RULES = ("and", "or_xor", "majority", "parity")
_SCALAR_SQL = "(" + " + ".join(RULE_SQL[k] for k in ACTION_RULES) + f") / {len(ACTION_RULES)}.0::DOUBLE"
ATTRIBUTION_SQL = f"WITH {ROWS_SQL}, every AS (SELECT CAST(range AS BIGINT) AS row FROM range(1024)), f AS (SELECT row, {_SCALAR_SQL} AS f FROM every AS r), g AS (SELECT a.row, j.j, a.f - b.f AS g FROM f a, range({O.BITS}) AS j(j) JOIN f b ON b.row = xor(a.row, CAST(1 << j.j AS BIGINT)))"


def scalar(row):
    """The mean of ACTION_RULES at an assignment."""
    return sum(O.compile_rule(RULES[k], row) for k in ACTION_RULES) / float(len(ACTION_RULES))


def attributions(rows):
    """rows (row, ...) with f and g: the scalar, and by how much it exceeds that with each bit flipped."""
    row = F.col("row")
    return rows.withColumn("f", scalar(row)).withColumn("g", F.transform(F.array(*(scalar(row.bitwiseXOR(F.lit(1 << j))) for j in range(O.BITS))), lambda v: F.col("f") - v))


@query(ATTRIBUTION_SQL + ", k AS (SELECT row, mask, count(*) AS n FROM r GROUP BY ALL), d AS (SELECT k.row, k.mask, k.n, sum(CASE WHEN (k.mask >> j) & 1 = 1 THEN g ELSE 0 END) AS dot FROM k JOIN g ON g.row = k.row GROUP BY ALL) SELECT round(sum(n * (dot - (a.f - b.f)) ** 2) / sum(n), 6) AS infidelity FROM d JOIN f a ON a.row = d.row JOIN f b ON b.row = xor(d.row, d.mask)")
def infidelity(spark, sf):
    """How far the sum of the flipped bits' attributions is from the change they make, squared, over all orders."""
    t = attributions(assignments(spark, sf).groupBy("row", "mask").agg(F.count("*").alias("n")))
    dot = sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << j)) != 0, F.get("g", F.lit(j))).otherwise(0.0) for j in range(O.BITS))
    missed = dot - (F.col("f") - scalar(F.col("row").bitwiseXOR(F.col("mask"))))
    return t.agg(F.round(F.sum(F.col("n") * missed * missed) / F.sum("n"), 6).alias("infidelity"))


@query(ATTRIBUTION_SQL + f", s AS (SELECT a.row, n.j AS neighbour, max(abs(a.g - b.g)) AS d FROM g a, range({O.BITS}) AS n(j) JOIN g b ON b.row = xor(a.row, CAST(1 << n.j AS BIGINT)) AND b.j = a.j GROUP BY ALL) SELECT round(avg(d), 6) AS max_sensitivity FROM r JOIN (SELECT row, max(d) AS d FROM s GROUP BY ALL) USING (row)")
def max_sensitivity(spark, sf):
    """The greatest change of any attribution as one bit flips, averaged over all orders. Assignments are counted first, and
    each is compared with its ten neighbours."""
    t = assignments(spark, sf).groupBy("row").agg(F.count("*").alias("n"))
    near = t.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(O.BITS - 1)))).select("row", "n", F.col("row").bitwiseXOR(F.get(F.array(*(F.lit(1 << j) for j in range(O.BITS))), F.col("bit"))).alias("other"))
    own, other = attributions(near).drop("f"), F.col("other")
    both = attributions(own.select("row", "n", F.col("g").alias("own"), other.alias("at")).withColumnRenamed("row", "was").withColumnRenamed("at", "row"))
    change = F.array_max(F.zip_with("own", "g", lambda a, b: F.abs(a - b)))
    per = both.groupBy("was").agg(F.max(change).alias("d"), F.max("n").alias("n"))
    return per.agg(F.round(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 6).alias("max_sensitivity"))


# -- worlds x metrics x manipulations: validity of metrics ------------------------------------------------------------------

AXES = ("A", "R", "S", "C1")
#: A metric's value: it rises with quality, most along its own axis; the rest is noise by world.
CELLS_SQL = "cells AS (SELECT w.world, m.metric, x.axis, d.dose, (4 - dose) / 4.0::DOUBLE AS quality, CAST((4 - dose) * (CASE WHEN metric = axis THEN 25 ELSE 4 END) + (world * 7919 + axis * 104729 + metric * 1299709 + dose * 15485863) % 61 AS DOUBLE) / 100 AS value FROM (SELECT c_custkey AS world FROM customer) AS w, range(4) AS m(metric), range(4) AS x(axis), range(5) AS d(dose))"


def validity_cells(spark, sf):
    """world (a customer), metric, axis (the manipulated one), dose, quality = 1 - dose / 4, value."""
    rows = A.spread(A.table(spark, sf, "customer").select(F.col("c_custkey").alias("world")).withColumn("sample_ix", F.col("world")), 80).drop("sample_ix")
    for name, n in (("metric", 4), ("axis", 4), ("dose", 5)):
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    own = F.when(F.col("metric") == F.col("axis"), 25).otherwise(4)
    noise = (F.col("world") * 7919 + F.col("axis") * 104729 + F.col("metric") * 1299709 + F.col("dose") * 15485863) % 61
    return rows.select("world", "metric", "axis", "dose", ((4 - F.col("dose")) / 4.0).alias("quality"), (((4 - F.col("dose")) * own + noise).cast("double") / 100).alias("value"))


@query(f"WITH {CELLS_SQL} SELECT metric, axis, round(covar_samp(value, quality) / var_samp(quality) / stddev_samp(value), 6) AS slope FROM cells GROUP BY ALL")
def standardized_slope(spark, sf):
    """The slope of a metric by quality, in standard deviations of the metric."""
    return validity_cells(spark, sf).groupBy("metric", "axis").agg(F.round(F.covar_samp("value", "quality") / F.var_samp("quality") / F.stddev_samp("value"), 6).alias("slope"))


@query(f"WITH {CELLS_SQL}, p AS (SELECT a.world, a.metric, a.axis, sign(a.value - b.value) AS sx, sign(a.quality - b.quality) AS sy FROM cells a JOIN cells b ON a.world = b.world AND a.metric = b.metric AND a.axis = b.axis AND a.dose < b.dose), t AS (SELECT world, metric, axis, coalesce(sum(sx * sy) / sqrt(nullif(sum(abs(sx)) * sum(abs(sy)), 0)), 0) AS tau FROM p GROUP BY ALL),"
       + " m AS (SELECT metric, axis, avg(tau) AS tau FROM t GROUP BY ALL) SELECT metric, round(max(CASE WHEN metric = axis THEN tau END) - max(CASE WHEN metric <> axis THEN abs(tau) END), 6) AS gap FROM m GROUP BY ALL")
def mtmm_gap(spark, sf):
    """Tau-b of a metric with the quality it should follow, less the greatest with any other; in a world of equal values
    it is 0. Pairs are those of a world's five doses."""
    rows = validity_cells(spark, sf).filter("world is not null")
    doses = rows.groupBy("world", "metric", "axis").agg(F.collect_list(F.struct("dose", "quality", "value")).alias("doses"))  # five entries, so no join
    later = lambda x: F.filter("doses", lambda y: x["dose"] < y["dose"])
    pairs = F.flatten(F.transform("doses", lambda x: F.transform(later(x), lambda y: F.struct(F.signum(x["value"] - y["value"]).alias("x"), F.signum(x["quality"] - y["quality"]).alias("y")))))
    total = lambda of: E.total(F.transform("pairs", of))
    both = total(lambda p: F.abs(p["x"])) * total(lambda p: F.abs(p["y"]))
    t = doses.select("metric", "axis", pairs.alias("pairs")).select("metric", "axis", F.coalesce(total(lambda p: p["x"] * p["y"]) / F.sqrt(F.nullif(both, F.lit(0.0))), F.lit(0.0)).alias("tau"))
    m = t.groupBy("metric", "axis").agg(F.avg("tau").alias("tau"))
    return m.groupBy("metric").agg(F.round(F.max(F.when(F.col("metric") == F.col("axis"), F.col("tau"))) - F.max(F.when(F.col("metric") != F.col("axis"), F.abs("tau"))), 6).alias("gap"))


@query("WITH p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, CAST(floor(value) AS BIGINT) % 40 AS x, event_id % 13 AS y FROM events), c AS (SELECT a.event_type, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.event_type = b.event_type AND a.k < b.k), s AS (SELECT event_type, sum(sx * sy) AS num, sum(abs(sx)) AS nx, sum(abs(sy)) AS ny FROM c GROUP BY ALL) SELECT event_type, round(num / sqrt(CAST(nullif(nx * ny, 0) AS DOUBLE)), 6) AS tau_b FROM s")
def kendall_tau_b(spark, sf):
    """Tau-b of two ordered columns. Pairs are made of distinct (x, y) cells with their counts, of which there are as
    many as levels of x times levels of y, so rows and ties don't multiply."""
    rows = A.table(spark, sf, "events").select("event_type", (F.floor("value").cast("long") % 40).alias("x"), (F.col("event_id") % 13).alias("y"))
    c = rows.groupBy("event_type", "x", "y").agg(F.count("*").alias("n"))
    d = c.select("event_type", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    w, sx, sy = F.col("n") * F.col("n2"), F.signum(F.col("x") - F.col("x2")), F.signum(F.col("y") - F.col("y2"))
    s = c.join(d, "event_type").groupBy("event_type").agg(F.sum(w * sx * sy).alias("num"), F.sum(w * F.abs(sx)).alias("nx"), F.sum(w * F.abs(sy)).alias("ny"))
    return s.select("event_type", F.round(F.col("num") / F.sqrt(F.nullif(F.col("nx") * F.col("ny"), F.lit(0.0))), 6).alias("tau_b"))


