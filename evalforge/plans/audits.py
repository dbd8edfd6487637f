"""Manifest, join, set and population audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import audit as Q
from ..operators import ranking as R
from ..operators.digests import grouped
from ..sources import adapters as A
from ..streaming.inventory import inventory_counts
from .registry import query

# orders stand for images, lineitem for annotations: digit 5 has no action label, quantities stand for label counts
NOTES_SQL = """notes AS (SELECT l_orderkey, arg_max(l_quantity, o) AS quantity FROM (SELECT l_orderkey, l_quantity, l_linenumber * 1000000 + l_partkey AS o FROM lineitem) GROUP BY ALL),
  base AS (SELECT o_orderkey, o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit, quantity FROM orders LEFT JOIN notes ON l_orderkey = o_orderkey)"""


def noted(spark, sf):
    """Orders with the quantity of their last annotation: duplicate keys on the right, the last one wins."""
    lines = A.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"))
    last = lines.groupBy("l_orderkey").agg(F.max_by("quantity", "o").alias("quantity"))
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("digit"))
    return orders.join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("l_orderkey")


REASONS_SQL = "CASE WHEN quantity IS NULL THEN 'no_annotation' WHEN digit = 5 THEN 'no_action' WHEN quantity > 45 THEN 'label_dimension' ELSE 'valid' END"


@query(f"WITH {NOTES_SQL}, r AS (SELECT *, {REASONS_SQL} AS reason FROM base) SELECT reason, count(*) AS n, CAST(sum(CASE WHEN digit < 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM r GROUP BY ALL")
def manifest_validation(spark, sf):
    # positives are counted on all rows, those later rejected as well
    rows = Q.first_reason(noted(spark, sf), [("no_annotation", F.col("quantity").isNull()), ("no_action", F.col("digit") == 5), ("label_dimension", F.col("quantity") > 45)], "valid")
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum((F.col("digit") < 5).cast("long")).alias("n_positive"))


@query("WITH s AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS red, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS green FROM lineitem GROUP BY ALL) SELECT CASE WHEN red <> green THEN CASE WHEN red = 1 THEN 'red' ELSE 'green' END ELSE 'rejected' END AS state, count(*) AS n FROM s GROUP BY ALL")
def sole_target_state(spark, sf):
    flag = lambda v: F.max((F.col("l_returnflag") == v).cast("int"))
    s = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(flag("R").alias("red"), flag("A").alias("green"))
    state = F.when(F.col("red") != F.col("green"), F.when(F.col("red") == 1, "red").otherwise("green")).otherwise("rejected")
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 'finished' WHEN 'o' THEN 'open' WHEN 'p' THEN 'partial' ELSE 'unknown' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def normalize_codes(spark, sf):
    names = F.create_map(*(F.lit(x) for kv in {"f": "finished", "o": "open", "p": "partial"}.items() for x in kv))
    return A.table(spark, sf, "orders").groupBy(F.coalesce(names[F.lower(F.trim("o_orderstatus"))], F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


NAME = "concat('c', o_custkey, '_', o_orderkey % 3 + 1, '.jpg')"


def named(spark, sf):
    """Orders with an image name whose last digit is 1 to 3, and its clip: a trailing _1 or _3 of the stem is dropped."""
    rows = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("c"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey") % 3 + 1, F.lit(".jpg")).alias("name"))
    return rows.withColumn("clip", F.regexp_replace(F.regexp_replace("name", r"\.jpg$", ""), "_(?:1|3)$", ""))


CLIP_SQL = f"named AS (SELECT o_orderkey, o_custkey, {NAME} AS name, regexp_replace(regexp_replace({NAME}, '\\.jpg$', ''), '_(?:1|3)$', '') AS clip FROM orders)"


@query(f"WITH {CLIP_SQL} SELECT regexp_replace(name, '\\.jpg$', '') = clip AS keyframe, count(*) AS n FROM named GROUP BY ALL")
def keyframe_filter(spark, sf):
    return named(spark, sf).groupBy((F.regexp_replace("name", r"\.jpg$", "") == F.col("clip")).alias("keyframe")).agg(F.count("*").alias("n"))


@query(f"WITH {CLIP_SQL}, c AS (SELECT clip, min(o_orderkey) AS first, count(*) AS size FROM named GROUP BY ALL) SELECT clip, size, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS clip_id FROM c")
def clip_membership(spark, sf):
    # ids follow first occurrence: a clip's id is the number of clips that occur before it, added up by stretches
    c = named(spark, sf).groupBy("clip").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("size")).withColumn("part", F.floor(F.col("first") / 65536))
    before = c.groupBy("part").agg(F.count("*").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    inside = F.row_number().over(W.partitionBy("part").orderBy("first"))
    return c.withColumn("r", inside).join(before, "part").select("clip", "size", (F.col("base") + F.col("r") - 1).alias("clip_id"))


@query(f"WITH {CLIP_SQL}, c AS (SELECT clip, count(*) AS size FROM named GROUP BY ALL) SELECT size, count(*) AS n_clips FROM c GROUP BY ALL")
def cluster_size_histogram(spark, sf):
    return named(spark, sf).groupBy("clip").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clips"))


@query("""SELECT count(*) AS n_left, count(n) AS n_overlap, round(count(n) / CAST(count(*) AS DOUBLE), 6) AS rate, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey""")
def label_overlap(spark, sf):
    n = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    both = A.table(spark, sf, "orders").select("o_orderkey").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.agg(F.count("*").alias("n_left"), F.count("n").alias("n_overlap"), F.round(F.count("n") / F.count("*"), 6).alias("rate"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


EXCLUDE_SQL = "excluded_names AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 0), excluded_groups AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 29 = 0)"


@query(f"WITH {EXCLUDE_SQL} SELECT CASE WHEN o_orderkey IN (FROM excluded_names) THEN 'model_name' WHEN o_custkey IN (FROM excluded_groups) THEN 'prior_group' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY ALL")
def exclusion_flow(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    names = orders.filter("o_orderkey % 17 = 0").select("o_orderkey", F.lit(1).alias("by_name"))
    groups = orders.filter("o_custkey % 29 = 0").select("o_custkey").distinct().withColumn("by_group", F.lit(1))
    rows = orders.join(names, "o_orderkey", "left").join(groups, "o_custkey", "left")
    return Q.first_reason(rows, [("model_name", F.col("by_name").isNotNull()), ("prior_group", F.col("by_group").isNotNull())]).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 17 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 29 = 0)")
def confirmatory_anti_join(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    names, groups = orders.filter("o_orderkey % 17 = 0").select("o_orderkey"), orders.filter("o_custkey % 29 = 0").select("o_custkey")
    return orders.join(names, "o_orderkey", "left_anti").join(groups, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 17 = 0 UNION SELECT o_orderkey FROM orders WHERE o_custkey % 29 = 0)")
def exclusion_union(spark, sf):
    orders = A.table(spark, sf, "orders")
    return orders.filter("o_orderkey % 17 = 0").select("o_orderkey").union(orders.filter("o_custkey % 29 = 0").select("o_orderkey")).distinct().agg(F.count("*").alias("n"))


HASHED = "upper(sha256(concat(o_custkey, '|', o_orderpriority)))"


@query(f"WITH h AS (SELECT o_orderkey, {HASHED} AS h FROM orders) SELECT count(*) AS n FROM h WHERE o_orderkey % 2 = 1 AND h IN (SELECT h FROM h WHERE o_orderkey % 2 = 0)")
def hash_overlap_semi(spark, sf):
    rows = A.table(spark, sf, "orders").select("o_orderkey", F.upper(F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256)).alias("h"))
    return rows.filter("o_orderkey % 2 = 1").join(rows.filter("o_orderkey % 2 = 0").select("h"), "h", "left_semi").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey, digit, quantity FROM base), f AS (SELECT *, CASE WHEN quantity IS NULL THEN 'no_row' WHEN digit = 5 THEN 'state_mismatch' WHEN o_orderkey % 17 = 0 THEN 'excluded' ELSE 'eligible' END AS stage FROM b)
  SELECT stage, count(*) AS n, count(DISTINCT o_custkey) AS n_groups FROM f GROUP BY ALL""".replace("WITH b", f"WITH {NOTES_SQL}, b"))
def population_flow(spark, sf):
    rows = Q.first_reason(noted(spark, sf), [("no_row", F.col("quantity").isNull()), ("state_mismatch", F.col("digit") == 5), ("excluded", F.col("o_orderkey") % 17 == 0)], "eligible")
    return rows.groupBy(F.col("reason").alias("stage")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_groups"))


@query(f"WITH {NOTES_SQL}, e AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS g FROM base WHERE quantity IS NOT NULL AND digit < 5 AND o_orderkey % 17 <> 0) SELECT n >= 100 AS enough_rows, g >= 50 AS enough_groups, CASE WHEN n >= 100 AND g >= 50 THEN 'GO' ELSE 'NO_GO' END AS decision FROM e")
def population_gate(spark, sf):
    e = noted(spark, sf).filter("quantity is not null and digit < 5 and o_orderkey % 17 <> 0").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("g"))
    a, b = F.col("n") >= 100, F.col("g") >= 50
    return e.select(a.alias("enough_rows"), b.alias("enough_groups"), F.when(a & b, "GO").otherwise("NO_GO").alias("decision"))


WINDOWS_SQL = "w AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_type FROM events), a AS (SELECT DISTINCT user_id, day FROM w WHERE event_type = 'view'), l AS (SELECT DISTINCT user_id, day FROM w WHERE event_type = 'click'), j AS (SELECT a.user_id IS NOT NULL AS in_a, l.user_id IS NOT NULL AS in_l FROM a FULL JOIN l ON a.user_id = l.user_id AND a.day = l.day)"


def modal(spark, sf):
    """Keys (user, day) of two event types, joined: in_a, in_l."""
    w = A.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    side = lambda kind, n: w.filter(F.col("event_type") == kind).select("user_id", "day").distinct().withColumn(n, F.lit(True))
    return side("view", "in_a").join(side("click", "in_l"), ["user_id", "day"], "full_outer")


COUNT_MODAL = "count(*) FILTER (in_a AND in_l) AS n_paired, count(*) FILTER (in_a AND NOT in_l) AS n_action_only, count(*) FILTER (in_l AND NOT in_a) AS n_language_only"


@query(f"WITH {WINDOWS_SQL} SELECT {COUNT_MODAL}, round(count(*) FILTER (in_a AND in_l) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS completeness FROM j")
def cross_modal_join(spark, sf):
    a, b = F.col("in_a").isNotNull(), F.col("in_l").isNotNull()
    return modal(spark, sf).agg(F.count_if(a & b).alias("n_paired"), F.count_if(a & ~b).alias("n_action_only"), F.count_if(b & ~a).alias("n_language_only"), F.round(F.count_if(a & b) / F.nullif(F.count("*"), F.lit(0)), 6).alias("completeness"))


@query(f"WITH {WINDOWS_SQL}, c AS (SELECT {COUNT_MODAL} FROM j) SELECT n_paired >= 100 AS enough_pairs, n_paired >= 0.2::DOUBLE * (n_paired + n_action_only + n_language_only) AS complete, CASE WHEN n_paired >= 100 AND n_paired >= 0.2::DOUBLE * (n_paired + n_action_only + n_language_only) THEN 'FEASIBLE' ELSE 'NOT_FEASIBLE' END AS verdict FROM c")
def feasibility_gate(spark, sf):
    a, b = F.col("in_a").isNotNull(), F.col("in_l").isNotNull()
    c = modal(spark, sf).agg(F.count_if(a & b).alias("n"), F.count("*").alias("all"))
    enough, complete = F.col("n") >= 100, F.col("n") >= 0.2 * F.col("all")
    return c.select(enough.alias("enough_pairs"), complete.alias("complete"), F.when(enough & complete, "FEASIBLE").otherwise("NOT_FEASIBLE").alias("verdict"))


@query("WITH m AS (SELECT regexp_extract(url, '/([0-9]+)', 1) AS uuid FROM pages), c AS (SELECT uuid, count(*) AS n FROM m WHERE uuid <> '' GROUP BY ALL) SELECT CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'BOUND' END AS status, count(*) AS n_keys FROM (SELECT o_orderkey, n FROM orders LEFT JOIN c ON uuid = CAST(o_orderkey AS VARCHAR)) GROUP BY ALL")
def unique_binding(spark, sf):
    found = A.table(spark, sf, "pages").select(F.regexp_extract("url", "/([0-9]+)", 1).alias("uuid")).filter("uuid <> ''").groupBy("uuid").agg(F.count("*").alias("n"))
    keys = A.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("uuid"))
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "AMBIGUOUS").otherwise("BOUND")
    return keys.join(found, "uuid", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n_keys"))


@query("""WITH rules(event_type, need) AS (VALUES ('view', 0), ('click', 1), ('purchase', 2)), e AS (SELECT e.event_type, need, value, user_id FROM events e LEFT JOIN rules USING (event_type))
  SELECT event_type, CASE WHEN need IS NULL THEN 'NO_RULE' WHEN need >= 1 AND value IS NULL THEN 'INCOMPLETE' WHEN need >= 2 AND value < 10 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status, count(*) AS n FROM e GROUP BY ALL""")
def provenance_assessment(spark, sf):
    rules = spark.createDataFrame([("view", 0), ("click", 1), ("purchase", 2)], "event_type string, need int")
    rows = A.table(spark, sf, "events").join(F.broadcast(rules), "event_type", "left")
    bad = ((F.col("need") >= 1) & F.col("value").isNull()) | ((F.col("need") >= 2) & (F.col("value") < 10))
    status = F.when(F.col("need").isNull(), "NO_RULE").when(bad, "INCOMPLETE").otherwise("COMPLETE")
    return rows.groupBy("event_type", status.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_orderkey, max(l_linenumber) AS note FROM lineitem WHERE l_discount > 0.08 GROUP BY ALL) SELECT coalesce(note, 0) AS note, count(*) AS n FROM orders LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY ALL""")
def override_coalesce(spark, sf):
    over = A.table(spark, sf, "lineitem").filter(F.col("l_discount") > 0.08).groupBy("l_orderkey").agg(F.max("l_linenumber").alias("note"))
    rows = A.table(spark, sf, "orders").select("o_orderkey").join(over, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy(F.coalesce("note", F.lit(0)).alias("note")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS ordinal, sha256(CAST(o_custkey AS VARCHAR)) AS h FROM orders), r AS (SELECT o_orderkey AS ordinal, o_custkey AS path FROM orders WHERE o_orderkey % 101 <> 7)
  SELECT count(*) AS n_public, count(r.ordinal) AS n_restricted, count(*) FILTER (r.ordinal IS NULL) AS n_lead, count(*) FILTER (r.ordinal IS NOT NULL AND h <> sha256(CAST(path AS VARCHAR))) AS n_mismatched FROM p LEFT JOIN r USING (ordinal)""")
def lockstep_inventory(spark, sf):
    orders = A.table(spark, sf, "orders")
    public = orders.select(F.col("o_orderkey").alias("ordinal"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("h"))
    restricted = orders.filter("o_orderkey % 101 <> 7").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").cast("string").alias("path"))
    both = public.join(restricted, "ordinal", "left")
    return both.agg(F.count("*").alias("n_public"), F.count("path").alias("n_restricted"), F.count_if(F.col("path").isNull()).alias("n_lead"), F.count_if(F.col("path").isNotNull() & (F.col("h") != F.sha2("path", 256))).alias("n_mismatched"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 50 <> 3)
  SELECT 'missing' AS check_name, count(*) AS failures, count(*) = 0 AS passed FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'different', count(*), count(*) = 0 FROM a JOIN b USING (k) WHERE a.v <> b.v""")
def alignment_audit(spark, sf):
    a = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = a.filter("k % 50 <> 3").withColumnRenamed("v", "w").withColumn("there", F.lit(1))
    return Q.expectations(a.join(b, "k", "left"), {"missing": F.col("there").isNull(), "different": F.col("there").isNotNull() & (F.col("v") != F.col("w"))})


HALVES = "h AS (SELECT page_id % 2 AS half, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)"


def halves(spark, sf):
    rows = A.table(spark, sf, "pages").select((F.col("page_id") % 2).alias("half"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return rows.filter("half = 0"), rows.filter("half = 1")


@query(f"WITH {HALVES}, a AS (SELECT DISTINCT host FROM h WHERE half = 0), b AS (SELECT DISTINCT host FROM h WHERE half = 1) SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_left, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_right")
def path_set_compare(spark, sf):
    return Q.compare_sets(*halves(spark, sf), "host")


@query(f"WITH {HALVES}, a AS (SELECT DISTINCT host FROM h WHERE half = 0), b AS (SELECT DISTINCT host FROM h WHERE half = 1) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_mismatched")
def name_mismatch(spark, sf):
    return Q.compare_sets(*halves(spark, sf), "host").select((F.col("n_left") + F.col("n_right")).alias("n_mismatched"))


@query("WITH seen AS (SELECT DISTINCT event_type AS k FROM events), allowed(k) AS (VALUES ('view'), ('click'), ('purchase'), ('refund')) SELECT (SELECT count(*) FROM (FROM seen EXCEPT FROM allowed)) AS n_unknown, (SELECT count(*) FROM (FROM allowed EXCEPT FROM seen)) AS n_absent, (SELECT count(*) FROM (FROM seen EXCEPT FROM allowed)) + (SELECT count(*) FROM (FROM allowed EXCEPT FROM seen)) = 0 AS equal")
def allowlist_diff(spark, sf):
    allowed = spark.createDataFrame([("view",), ("click",), ("purchase",), ("refund",)], "k string")
    c = Q.compare_sets(A.table(spark, sf, "events").select(F.col("event_type").alias("k")), allowed, "k")
    return c.select(F.col("n_left").alias("n_unknown"), F.col("n_right").alias("n_absent"), ((F.col("n_left") + F.col("n_right")) == 0).alias("equal"))


@query("WITH parts AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1), n AS (SELECT k, count(*) AS n FROM parts GROUP BY ALL), u AS (SELECT o_orderkey AS k FROM orders) SELECT count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (u.k IS NULL) AS n_foreign FROM u FULL JOIN n ON u.k = n.k")
def partition_cover(spark, sf):
    parts = A.table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return Q.partition_cover(parts, A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k")


FORBIDDEN = [r"^https?://[^/]*adult", r"\?.*utm_source=", r"\.html$"]


@query("SELECT count(*) FILTER (regexp_matches(url, '^https?://[^/]*adult')) AS n_adult, count(*) FILTER (regexp_matches(url, '\\?.*utm_source=')) AS n_tracking, count(*) FILTER (regexp_matches(url, '\\.html$')) AS n_html, count(*) FILTER (regexp_matches(url, '^https?://[^/]*adult') OR regexp_matches(url, '\\?.*utm_source=') OR regexp_matches(url, '\\.html$')) AS n_any FROM pages")
def forbidden_paths(spark, sf):
    hits = [F.col("url").rlike(p) for p in FORBIDDEN]
    names = ("n_adult", "n_tracking", "n_html")
    return A.table(spark, sf, "pages").agg(*(F.count_if(h).alias(n) for h, n in zip(hits, names)), F.count_if(hits[0] | hits[1] | hits[2]).alias("n_any"))


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS lang, count(*) AS n, count(DISTINCT regexp_extract(url, '/([0-9]+)', 1)) AS n_windows FROM pages GROUP BY ALL""")
def repository_index_summary(spark, sf):
    u = lambda p: F.regexp_extract("url", p, 1)
    return A.table(spark, sf, "pages").groupBy(u("://([^/?#]*)").alias("host"), u("://[^/]*/([a-z]+)/").alias("lang")).agg(F.count("*").alias("n"), F.countDistinct(u("/([0-9]+)")).alias("n_windows"))


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS low, round(median(value), 6) AS mid, round(avg(value), 6) AS mean, round(max(value), 6) AS high FROM events WHERE value IS NULL OR isfinite(value) GROUP BY ALL")
def numeric_summary(spark, sf):
    ok = F.col("value").isNull() | (~F.isnan("value") & (F.abs("value") < float("inf")))
    r = lambda c: F.round(c, 6)
    rows = A.table(spark, sf, "events").filter(ok)
    mid = R.quantiles(rows, ["event_type"], "value", {"mid": 0.5}).select("event_type", r("mid").alias("mid"))
    sums = rows.groupBy("event_type").agg(F.count("value").alias("n"), r(F.min("value")).alias("low"), r(F.avg("value")).alias("mean"), r(F.max("value")).alias("high"))
    return sums.join(mid, "event_type", "left")


@query("SELECT l_returnflag, min(l_quantity) AS low, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95, max(l_quantity) AS high FROM lineitem GROUP BY ALL")
def distribution_summary(spark, sf):
    rows = A.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"))
    ends = A.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return ends.join(R.quantiles(rows, ["l_returnflag"], "l_quantity", {"p50": 0.5, "p95": 0.95}).drop("n"), "l_returnflag")


@query("""WITH s AS (SELECT l_returnflag AS stratum, round(avg(CASE WHEN l_discount <= 0.08 THEN 1.0::DOUBLE ELSE 0 END), 6) AS visible, round(avg(CASE WHEN l_tax <= 0.06 THEN 1.0::DOUBLE ELSE 0 END), 6) AS preserved FROM lineitem GROUP BY ALL)
  SELECT stratum, visible, preserved, visible >= 0.7::DOUBLE AND preserved >= 0.7::DOUBLE AS passed, bool_and(visible >= 0.7::DOUBLE AND preserved >= 0.7::DOUBLE) OVER () AS all_passed FROM s""")
def audit_pass_rates(spark, sf):
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    s = A.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("stratum")).agg(rate(F.col("l_discount") <= 0.08).alias("visible"), rate(F.col("l_tax") <= 0.06).alias("preserved"))
    ok = (F.col("visible") >= 0.7) & (F.col("preserved") >= 0.7)
    return s.withColumn("passed", ok).withColumn("all_passed", F.every("passed").over(W.partitionBy()))  # a row a stratum


@query("""SELECT name, failures, passed FROM (SELECT 'unique_key' AS name, count(*) - count(DISTINCT o_orderkey) AS failures, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders UNION ALL SELECT 'status_known', count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')), count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) = 0 FROM orders
  UNION ALL SELECT 'price_positive', count(*) FILTER (NOT o_totalprice > 0), count(*) FILTER (NOT o_totalprice > 0) = 0 FROM orders) ORDER BY 1""", name="closure_checks")
def closure_checks(spark, sf):
    orders = A.table(spark, sf, "orders")
    repeated = orders.groupBy("o_orderkey").agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("failures")).select(F.lit("unique_key").alias("check_name"), "failures", (F.col("failures") == 0).alias("passed"))
    others = Q.expectations(orders, {"status_known": ~F.col("o_orderstatus").isin("F", "O", "P"), "price_positive": ~(F.col("o_totalprice") > 0)})
    return repeated.union(others).withColumnRenamed("check_name", "name")


@query("""WITH g(gate, passed) AS (SELECT 'G' || (o_orderkey % 9), bool_and(o_totalprice > 0) FROM orders GROUP BY 1) SELECT CASE WHEN count(*) < 9 THEN 'INCONCLUSIVE' WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n_gates FROM g""")
def gate_verdict(spark, sf):
    g = A.table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 9).alias("gate")).agg(F.every(F.col("o_totalprice") > 0).alias("passed"))
    return g.agg(F.when(F.count("*") < 9, "INCONCLUSIVE").when(F.every("passed"), "PASS").otherwise("FAIL").alias("verdict"), F.count("*").alias("n_gates"))


@query("""SELECT o_orderkey % 64 AS shard, count(*) AS n_rows, upper(sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey))) AS sha256 FROM orders GROUP BY ALL""")
def hash_manifest_check(spark, sf):
    rows = A.table(spark, sf, "orders").select((F.col("o_orderkey") % 64).alias("shard"), "o_orderkey")
    return grouped(rows, "shard", [F.col("o_orderkey")], F.col("o_orderkey"))


@query("""WITH m AS (SELECT coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS archive, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS member FROM pages), k AS (SELECT archive, member, lower(member) AS folded, count(*) AS n FROM m GROUP BY ALL), f AS (SELECT archive, folded, count(*) AS names, sum(n) AS n FROM k GROUP BY ALL)
  SELECT archive, count(*) AS n_new, CAST(sum(n - names) AS BIGINT) AS n_duplicate, CAST(sum(names - 1) AS BIGINT) AS n_collision FROM f GROUP BY ALL""")
def member_inventory(spark, sf):
    """Of each host's pages how many paths are new, repeated, or differ from another in case alone; a stream with state gives
    the same counts (`inventory.inventory`)."""
    part = lambda p: F.regexp_extract("url", p, 1)
    rows = A.table(spark, sf, "pages").select(part("://([^/?#]*)").alias("host"), part("://[^/?#]*([^?#]*)").alias("path"))
    return inventory_counts(rows, "host", "path")
