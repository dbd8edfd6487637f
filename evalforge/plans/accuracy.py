"""Accuracy, confidence, calibration and selective-risk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import metrics as M
from ..operators import ranking as R
from ..sources import adapter_sql as S
from ..sources import adapters as A
from .registry import query

KEYS = ["seed", "model"]
CLEAN = S.with_(S.SAMPLES, S.pred())
PER = S.with_(S.SAMPLES, S.pred(), S.PER)
COUNTS = "counts AS (SELECT seed, model, class_ix, CAST(sum(CASE WHEN t = 1 AND z >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN t = 0 AND z >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t = 1 AND z < 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM pred GROUP BY ALL)"
F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
WITH_COUNTS = S.with_(S.SAMPLES, S.pred(), COUNTS)
WITH_RATIONALE = S.with_(S.SAMPLES, S.pred(head="rationale"), COUNTS)
SIG = "1 / (1 + exp(-least(greatest(z / {t}::DOUBLE, -50), 50)))"


def clean(spark: SparkSession, sf: str, head: str = "action") -> DataFrame:
    return M.predicted(A.actions(spark, sf, head=head))


@query(CLEAN + f"SELECT seed, model, sample_ix, class_ix, round({SIG.format(t=1.25)}, 6) AS p FROM pred")
def sigmoid_calibrated(spark, sf):
    rows = A.actions(spark, sf).withColumn("p", E.probabilities(F.col("logit"), 1.25))
    return rows.select(*KEYS, "sample_ix", F.posexplode("p").alias("class_ix", "p")).withColumn("p", E.r6(F.col("p")))


@query(CLEAN + "SELECT seed, model, class_ix, CAST(sum(CASE WHEN z >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_raw, CAST(sum(CASE WHEN 1 / (1 + exp(-z / 1.25::DOUBLE)) >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS n_calibrated FROM pred GROUP BY ALL")
def hard_predictions(spark, sf):
    rows = A.actions(spark, sf).withColumn("both", F.arrays_zip(E.hard(F.col("logit")).alias("raw"), E.hard(E.probabilities(F.col("logit"), 1.25), 0.5).alias("calibrated")))
    rows = rows.select(*KEYS, F.posexplode("both").alias("class_ix", "h"))
    return rows.groupBy(*KEYS, "class_ix").agg(F.sum("h.raw").alias("n_raw"), F.sum("h.calibrated").alias("n_calibrated"))


@query(CLEAN + "SELECT seed, model, class_ix, round(avg(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END), 6) AS mean_state FROM pred GROUP BY ALL")
def predicted_state_prob(spark, sf):
    rows = clean(spark, sf).withColumn("s", E.state_probability(E.probabilities(F.col("logit")), F.col("pred")))
    return rows.select(*KEYS, F.posexplode("s").alias("class_ix", "s")).groupBy(*KEYS, "class_ix").agg(E.r6(F.avg("s")).alias("mean_state"))


CONF_SQL = """conf AS (SELECT seed, model, sample_ix, max(p) AS max_probability, min(s) AS min_state, avg(s) AS mean_state, 1 - avg(-(q * log2(q) + (1 - q) * log2(1 - q))) AS one_minus_entropy,
  max(e) AS error FROM (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS q, CASE WHEN z >= 0 THEN p ELSE 1 - p END AS s, CASE WHEN (z >= 0) <> (t = 1) THEN 1 ELSE 0 END AS e
  FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM pred)) GROUP BY ALL)"""
LONG_CONF = "long AS (" + " UNION ALL ".join(f"SELECT seed, model, sample_ix, '{c}' AS definition, {c} AS conf, error FROM conf" for c in E.CONFIDENCES) + ")"


def confidences(spark, sf) -> DataFrame:
    """A row for each sample and confidence definition: definition, conf, error."""
    rows = clean(spark, sf).withColumn("p", E.probabilities(F.col("logit")))
    state = E.state_probability(F.col("p"), F.col("pred"))
    defs = F.array(*(F.struct(F.lit(k).alias("definition"), f(F.col("p"), state).alias("conf")) for k, f in E.CONFIDENCES.items()))
    return rows.select(*KEYS, "sample_ix", E.any_mismatch(F.col("pred"), F.col("target")).alias("error"), F.inline(defs))


@query(S.with_(S.SAMPLES, S.pred(), CONF_SQL, LONG_CONF) + "SELECT seed, model, definition, round(avg(conf), 6) AS mean_conf, round(min(conf), 6) AS min_conf, round(max(conf), 6) AS max_conf FROM long GROUP BY ALL")
def confidence_definitions(spark, sf):
    return confidences(spark, sf).groupBy(*KEYS, "definition").agg(*(E.r6(f("conf")).alias(f"{n}_conf") for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))))


@query(PER + "SELECT seed, model, sample_ix, e AS error FROM per")
def exact_set_errors(spark, sf):
    return clean(spark, sf).select(*KEYS, "sample_ix", E.any_mismatch(F.col("pred"), F.col("target")).alias("error"))


@query(PER + "SELECT seed, model, round(avg(e), 6) AS error_rate FROM per GROUP BY ALL")
def exact_set_error_rate(spark, sf):
    return clean(spark, sf).groupBy(*KEYS).agg(E.r6(F.avg(E.any_mismatch(F.col("pred"), F.col("target")).cast("double"))).alias("error_rate"))


@query(CLEAN + "SELECT seed, model, round(avg(v), 6) AS mean_probability, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_positive FROM (SELECT seed, model, sample_ix, sum(t / (1 + exp(-z))) / nullif(sum(t), 0) AS v FROM pred GROUP BY ALL) GROUP BY ALL")
def correct_action_probability(spark, sf):
    p, t = E.probabilities(F.col("logit")), F.col("target")
    n = E.total(t, "int")
    v = F.when(n > 0, E.total(F.zip_with(p, t, lambda a, b: a * b)) / n)
    return A.actions(spark, sf).select(*KEYS, v.alias("v")).groupBy(*KEYS).agg(E.r6(F.avg("v")).alias("mean_probability"), F.sum(F.col("v").isNull().cast("long")).alias("without_positive"))


@query(CLEAN + "SELECT seed, model, round(avg(v), 6) AS mean_probability FROM (SELECT seed, model, sample_ix, sum(m * CASE WHEN t = 1 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END) / nullif(sum(m), 0) AS v FROM (SELECT *, CASE WHEN (sample_ix + class_ix) % 3 > 0 THEN 1 ELSE 0 END AS m FROM pred) GROUP BY ALL) GROUP BY ALL")
def correct_state_probability(spark, sf):
    mask = F.array(*(((F.col("sample_ix") + c) % 3 > 0).cast("int") for c in range(A.ACTIONS)))
    state = E.state_probability(E.probabilities(F.col("logit")), F.col("target"))
    v = E.total(F.zip_with(state, mask, lambda a, m: a * m)) / E.total(mask, "int")
    return A.actions(spark, sf).groupBy(*KEYS).agg(E.r6(F.avg(v)).alias("mean_probability"))


@query(S.with_(S.SAMPLES, S.pred(levels=(0, 2, 4))) + """, v AS (SELECT seed, model, level, sample_ix, sum(t / (1 + exp(-z))) / nullif(sum(t), 0) AS p FROM pred GROUP BY ALL),
  w AS (SELECT seed, model, sample_ix, max(CASE WHEN level = 0 THEN p END) AS clean, max(CASE WHEN level = 4 THEN p END) AS critical, max(CASE WHEN level = 2 THEN p END) AS noncritical FROM v GROUP BY ALL)
  SELECT seed, model, round(avg(clean - critical), 6) AS critical_drop, round(avg(clean - noncritical), 6) AS noncritical_drop, round(avg((clean - critical) - (clean - noncritical)), 6) AS gap FROM w GROUP BY ALL""")
def causal_evidence_gap(spark, sf):
    p, t = E.probabilities(F.col("logit")), F.col("target")
    rows = A.actions(spark, sf, levels=(0, 2, 4)).select(*KEYS, "level", "sample_ix", (E.total(F.zip_with(p, t, lambda a, b: a * b)) / E.total(t, "int")).alias("p"))
    by = rows.groupBy(*KEYS, "sample_ix").agg(*(F.max(F.when(F.col("level") == v, F.col("p"))).alias(n) for v, n in ((0, "clean"), (4, "critical"), (2, "noncritical"))))
    a, b = F.col("clean") - F.col("critical"), F.col("clean") - F.col("noncritical")
    return by.groupBy(*KEYS).agg(E.r6(F.avg(a)).alias("critical_drop"), E.r6(F.avg(b)).alias("noncritical_drop"), E.r6(F.avg(a - b)).alias("gap"))


@query(WITH_COUNTS + "SELECT * FROM counts")
def confusion_counts(spark, sf):
    return M.confusion(clean(spark, sf), KEYS)


@query(WITH_COUNTS + f"SELECT seed, model, class_ix, round({F1}, 6) AS f1 FROM counts")
def per_class_f1(spark, sf):
    return M.class_f1(M.confusion(clean(spark, sf), KEYS)).select(*KEYS, "class_ix", E.r6(F.col("f1")).alias("f1"))


@query(WITH_COUNTS + f"SELECT seed, model, round(avg({F1}), 6) AS macro_f1 FROM counts GROUP BY ALL")
def action_macro_f1(spark, sf):
    return M.macro_f1(M.confusion(clean(spark, sf), KEYS), KEYS).withColumn("macro_f1", E.r6(F.col("macro_f1")))


@query(WITH_RATIONALE + f"SELECT seed, model, round(avg({F1}), 6) AS macro_f1 FROM counts GROUP BY ALL")
def rationale_macro_f1(spark, sf):
    return M.macro_f1(M.confusion(clean(spark, sf, "rationale"), KEYS), KEYS).withColumn("macro_f1", E.r6(F.col("macro_f1")))


@query(WITH_COUNTS + """SELECT seed, model, coalesce(class_ix, -1) AS class_ix, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  round(coalesce(2.0::DOUBLE * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS f1 FROM counts GROUP BY GROUPING SETS ((seed, model, class_ix), (seed, model))""")
def micro_f1(spark, sf):
    counts = M.confusion(clean(spark, sf), KEYS)
    sets = counts.groupingSets([["seed", "model", "class_ix"], ["seed", "model"]], "seed", "model", "class_ix").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return sets.withColumn("class_ix", F.coalesce("class_ix", F.lit(-1))).withColumn("f1", E.r6(E.f1(F.col("tp"), F.col("fp"), F.col("fn"))))


@query(WITH_COUNTS + "SELECT seed, model, class_ix, tp + fn AS n_target, tp + fp AS n_predicted FROM counts")
def positive_counts(spark, sf):
    return M.confusion(clean(spark, sf), KEYS).select(*KEYS, "class_ix", (F.col("tp") + F.col("fn")).alias("n_target"), (F.col("tp") + F.col("fp")).alias("n_predicted"))


BINS_SQL = "edges AS (SELECT CAST(k AS INTEGER) AS bin, k / 15.0::DOUBLE AS lo, (k + 1) / 15.0::DOUBLE AS hi FROM range(15) AS r(k)), bins AS (SELECT seed, model, bin, count(*) AS n, avg(conf) AS mean_conf, avg(1 - e) AS accuracy FROM per JOIN edges ON (conf > lo OR (bin = 0 AND conf >= lo)) AND conf <= hi GROUP BY ALL)"


@query(PER + f", {BINS_SQL} SELECT seed, model, bin, n, round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy FROM bins")
def ece_bins(spark, sf):
    return M.ece_bins(M.scored(A.actions(spark, sf)), KEYS).select(*KEYS, "bin", "n", E.r6(F.col("mean_conf")).alias("mean_conf"), E.r6(F.col("accuracy")).alias("accuracy"))


@query(PER + f", {BINS_SQL} SELECT seed, model, round(sum(abs(accuracy - mean_conf) * n) / sum(n), 6) AS ece FROM bins GROUP BY ALL")
def ece(spark, sf):
    return M.ece(M.ece_bins(M.scored(A.actions(spark, sf)), KEYS), KEYS).withColumn("ece", E.r6(F.col("ece")))


CURVE_SQL = "curve AS (SELECT *, sum(e) OVER w / CAST(row_number() OVER w AS DOUBLE) AS risk, row_number() OVER w AS rn, count(*) OVER (PARTITION BY seed, model) AS n FROM per WINDOW w AS (PARTITION BY seed, model ORDER BY conf DESC, sample_ix ROWS UNBOUNDED PRECEDING))"
CURVE = PER + ", " + CURVE_SQL
SELECTIVE_SQL = """sel AS (SELECT seed, model, avg(risk) AS aurc_stable, max(CASE WHEN rn = greatest(1, ceil(0.9::DOUBLE * n)) THEN risk END) AS uar90,
  avg(CASE WHEN rn <= greatest(1, n // 10) THEN e END) AS top_decile_error, avg(CASE WHEN rn > n - greatest(1, n // 10) THEN e END) AS bottom_decile_error, avg(e) AS error_rate, count(*) AS n FROM curve GROUP BY seed, model)"""


def curve(spark, sf) -> DataFrame:
    return R.risk_curve(M.scored(A.actions(spark, sf)), KEYS)


@query(CURVE + " SELECT seed, model, sample_ix, rn, round(risk, 6) AS risk, round(rn / CAST(n AS DOUBLE), 6) AS coverage FROM curve")
def risk_coverage_curve(spark, sf):
    return curve(spark, sf).select(*KEYS, "sample_ix", "rn", E.r6(F.col("risk")).alias("risk"), E.r6(F.col("coverage")).alias("coverage"))


@query(CURVE + f", {SELECTIVE_SQL} SELECT seed, model, round(aurc_stable, 6) AS aurc FROM sel")
def aurc_stable(spark, sf):
    return R.selective(curve(spark, sf), KEYS).select(*KEYS, E.r6(F.col("aurc_stable")).alias("aurc"))


@query(CURVE + f", {SELECTIVE_SQL} SELECT seed, model, round(uar90, 6) AS uar90 FROM sel")
def uar90(spark, sf):
    return R.selective(curve(spark, sf), KEYS).select(*KEYS, E.r6(F.col("uar90")).alias("uar90"))


@query(CURVE + f", {SELECTIVE_SQL} SELECT seed, model, round(top_decile_error, 6) AS top_decile_error, round(bottom_decile_error, 6) AS bottom_decile_error FROM sel")
def decile_error(spark, sf):
    return R.selective(curve(spark, sf), KEYS).select(*KEYS, *(E.r6(F.col(c)).alias(c) for c in ("top_decile_error", "bottom_decile_error")))


AUROC_SQL = "auc AS (SELECT seed, model, CASE WHEN sum(1 - e) > 0 AND sum(e) > 0 THEN (sum(CASE WHEN e = 0 THEN r END) - sum(1 - e) * (sum(1 - e) + 1) / 2) / (sum(1 - e) * sum(e)) END AS auroc FROM (SELECT *, rank() OVER (PARTITION BY seed, model ORDER BY conf) + (count(*) OVER (PARTITION BY seed, model, conf) - 1) / 2.0::DOUBLE AS r FROM per) GROUP BY seed, model)"


@query(PER + f", {AUROC_SQL} SELECT seed, model, round(auroc, 6) AS auroc FROM auc")
def correctness_auroc(spark, sf):
    return R.auroc(M.scored(A.actions(spark, sf)), KEYS).withColumn("auroc", E.r6(F.col("auroc")))


@query(CURVE + f", {SELECTIVE_SQL}, {AUROC_SQL} SELECT seed, model, round(aurc_stable, 6) AS aurc_stable, round(uar90, 6) AS uar90, round(top_decile_error, 6) AS top_decile_error, round(bottom_decile_error, 6) AS bottom_decile_error, round(error_rate, 6) AS error_rate, n, round(auroc, 6) AS auroc FROM sel JOIN auc USING (seed, model)")
def selective_bundle(spark, sf):
    rows = M.scored(A.actions(spark, sf))
    out = R.selective(R.risk_curve(rows, KEYS), KEYS).join(R.auroc(rows, KEYS), KEYS)
    return out.select(*KEYS, *(E.r6(F.col(c)).alias(c) for c in ("aurc_stable", "uar90", "top_decile_error", "bottom_decile_error", "error_rate", "auroc")), "n")


TIE_SQL = """tie AS (SELECT seed, model, avg(risk) AS aurc FROM (SELECT seed, model, (sum(e) OVER (PARTITION BY seed, model, conf) / CAST(count(*) OVER (PARTITION BY seed, model, conf) AS DOUBLE) * (row_number() OVER w - p) + u) / row_number() OVER w AS risk
  FROM (SELECT *, coalesce(count(*) OVER g - count(*) OVER (PARTITION BY seed, model, conf), 0) AS p, coalesce(sum(e) OVER g - sum(e) OVER (PARTITION BY seed, model, conf), 0) AS u FROM per WINDOW g AS (PARTITION BY seed, model ORDER BY conf DESC))
  WINDOW w AS (PARTITION BY seed, model ORDER BY conf DESC, sample_ix)) GROUP BY seed, model)"""


@query(PER + f", {TIE_SQL} SELECT seed, model, round(aurc, 6) AS aurc FROM tie")
def aurc_tie_averaged(spark, sf):
    return R.aurc_tie_averaged(M.scored(A.actions(spark, sf)), KEYS).withColumn("aurc", E.r6(F.col("aurc")))


@query(PER.replace("per AS (", "raw AS (") + f", per AS (SELECT * EXCLUDE (k) FROM (SELECT raw.*, unnest(range(sample_ix % 3)) AS k FROM raw)), {TIE_SQL} SELECT seed, model, round(aurc, 6) AS aurc FROM tie")
def aurc_weighted(spark, sf):
    rows = M.scored(A.actions(spark, sf)).withColumn("weight", F.col("sample_ix") % 3)
    return R.aurc_tie_averaged(rows, KEYS, "weight").withColumn("aurc", E.r6(F.col("aurc")))


@query(CURVE + f", {SELECTIVE_SQL}, {AUROC_SQL}, {TIE_SQL}, {BINS_SQL}, cal AS (SELECT seed, model, sum(abs(accuracy - mean_conf) * n) / sum(n) AS ece FROM bins GROUP BY ALL) SELECT seed, model, round(aurc_stable, 6) AS aurc_stable, round(aurc, 6) AS aurc_tie_averaged, round(uar90, 6) AS uar90, round(error_rate, 6) AS error_rate, round(auroc, 6) AS auroc, round(ece, 6) AS ece, round(top_decile_error, 6) AS top_decile_error, round(bottom_decile_error, 6) AS bottom_decile_error FROM sel JOIN auc USING (seed, model) JOIN tie USING (seed, model) JOIN cal USING (seed, model)")
def safety_diagnostics(spark, sf):
    rows = M.scored(A.actions(spark, sf))
    out = R.selective(R.risk_curve(rows, KEYS), KEYS).join(R.auroc(rows, KEYS), KEYS).join(R.aurc_tie_averaged(rows, KEYS, name="aurc_tie_averaged"), KEYS).join(M.ece(M.ece_bins(rows, KEYS), KEYS), KEYS)
    return out.select(*KEYS, *(E.r6(F.col(c)).alias(c) for c in ("aurc_stable", "aurc_tie_averaged", "uar90", "error_rate", "auroc", "ece", "top_decile_error", "bottom_decile_error")))


@query(PER + "SELECT seed, model, round(conf, 9) AS conf, count(*) AS n, CAST(sum(e) AS BIGINT) AS z, CAST(dense_rank() OVER (PARTITION BY seed, model ORDER BY round(conf, 9) DESC) - 1 AS BIGINT) AS tie_group FROM per GROUP BY seed, model, round(conf, 9)")
def tie_groups(spark, sf):
    rows = M.scored(A.actions(spark, sf)).withColumn("conf", F.round("conf", 9))
    g = R.preceded(R.tie_groups(rows, KEYS).withColumn("one", F.lit(1)), KEYS, {"tie_group": "one"})
    return g.select(*KEYS, "conf", "n", "z", F.col("tie_group").cast("long").alias("tie_group"))


@query("SELECT p, n, round((SELECT sum(1.0::DOUBLE / k) FROM range(p + 1, p + n + 1) AS r(k)), 9) AS span FROM (SELECT DISTINCT o_custkey % 200 AS p, o_orderkey % 40 + 1 AS n FROM orders)")
def harmonic_spans(spark, sf):
    rows = A.table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("p"), (F.col("o_orderkey") % 40 + 1).alias("n")).distinct()
    return rows.withColumn("span", F.round(R.harmonic_span(F.col("p"), F.col("n")), 9))


@query(S.with_(S.SAMPLES, S.pred(), CONF_SQL, LONG_CONF, "per AS (SELECT seed, model, definition, sample_ix, round(conf, 9) AS conf, error AS e FROM long)") + """, curve AS (SELECT *, sum(e) OVER w / CAST(row_number() OVER w AS DOUBLE) AS risk FROM per WINDOW w AS (PARTITION BY seed, model, definition ORDER BY conf DESC, sample_ix ROWS UNBOUNDED PRECEDING))
  SELECT seed, model, definition, round(avg(risk), 6) AS aurc FROM curve GROUP BY ALL""")
def confidence_sensitivity(spark, sf):
    keys = [*KEYS, "definition"]
    rows = confidences(spark, sf).withColumn("conf", F.round("conf", 9))
    return R.risk_curve(rows, keys).groupBy(*keys).agg(E.r6(F.avg("risk")).alias("aurc"))


@query(S.with_(S.SAMPLES, S.pred()) + f""", grid AS (SELECT k / 20.0::DOUBLE AS threshold FROM range(1, 20) AS r(k)), counts AS (SELECT seed, model, threshold, class_ix, sum(CASE WHEN t = 1 AND p >= threshold THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t = 0 AND p >= threshold THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN t = 1 AND p < threshold THEN 1 ELSE 0 END) AS fn FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM pred), grid GROUP BY ALL)
  SELECT seed, model, threshold, round(avg({F1}), 6) AS macro_f1, CAST(sum(tp + fp) AS BIGINT) AS n_predicted FROM counts GROUP BY ALL""")
def threshold_grid(spark, sf):
    # labels are counted by probability once for all thresholds: a row of counters each, no row explosion by threshold
    grid = [k / 20 for k in range(1, 20)]
    rows = A.actions(spark, sf).withColumn("p", E.probabilities(F.col("logit"))).select(*KEYS, F.posexplode(F.arrays_zip("target", "p")).alias("class_ix", "x"))
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    t, p = F.col("x.target") == 1, F.col("x.p")
    wide = rows.groupBy(*KEYS, "class_ix").agg(*(a for k, v in enumerate(grid) for a in (count(t & (p >= v), f"tp{k}"), count(~t & (p >= v), f"fp{k}"), count(t & (p < v), f"fn{k}"))))
    cells = F.array(*(F.struct(F.lit(v).alias("threshold"), *(F.col(f"{c}{k}").alias(c) for c in ("tp", "fp", "fn"))) for k, v in enumerate(grid)))
    counts = wide.select(*KEYS, "class_ix", F.inline(cells))
    return M.class_f1(counts).groupBy(*KEYS, "threshold").agg(E.r6(F.avg("f1")).alias("macro_f1"), F.sum(F.col("tp") + F.col("fp")).alias("n_predicted"))


@query(S.with_(S.SAMPLES, S.pred()) + """, per AS (SELECT seed, model, sample_ix, max(CASE WHEN (z >= 0) <> (t = 1) THEN 1 ELSE 0 END) AS e, max(z) AS a, max(z / 2.5::DOUBLE) AS b FROM pred GROUP BY ALL),
  c AS (SELECT seed, model, avg(sum_a / rn_a) AS raw, avg(sum_b / rn_b) AS scaled FROM (SELECT seed, model, sum(e) OVER wa AS sum_a, CAST(row_number() OVER wa AS DOUBLE) AS rn_a, sum(e) OVER wb AS sum_b, CAST(row_number() OVER wb AS DOUBLE) AS rn_b FROM per WINDOW wa AS (PARTITION BY seed, model ORDER BY a DESC, sample_ix ROWS UNBOUNDED PRECEDING), wb AS (PARTITION BY seed, model ORDER BY b DESC, sample_ix ROWS UNBOUNDED PRECEDING)) GROUP BY ALL)
  SELECT seed, model, round(raw, 6) AS aurc_raw, round(scaled, 6) AS aurc_scaled, abs(raw - scaled) < 1e-9 AS invariant FROM c""")
def temperature_invariance(spark, sf):
    a, b = (R.risk_curve(M.scored(A.actions(spark, sf), t), KEYS).groupBy(*KEYS).agg(F.avg("risk").alias(n)) for t, n in ((1.0, "aurc_raw"), (2.5, "aurc_scaled")))
    return a.join(b, KEYS).select(*KEYS, E.r6(F.col("aurc_raw")).alias("aurc_raw"), E.r6(F.col("aurc_scaled")).alias("aurc_scaled"), (F.abs(F.col("aurc_raw") - F.col("aurc_scaled")) < 1e-9).alias("invariant"))
