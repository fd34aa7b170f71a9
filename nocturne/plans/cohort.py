"""Queries on aggregation by subject and on metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nocturne.operators import cohort as C
from nocturne.operators import intervals as I
from nocturne.plans.base import DAY, EV, NIGHT, SC, ev, scored, t
from nocturne.plans.registry import query

r6 = lambda c: F.round(c, 6)


def rounded(df, *keep):
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in keep})


STATS = """count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), CASE WHEN count(v) = 1 THEN 0e0 END), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median,
 round(min(v), 6) AS min, round(max(v), 6) AS max, CASE WHEN count(v) >= 4 THEN round(quantile_cont(v, 0.25), 6) END AS p25, CASE WHEN count(v) >= 4 THEN round(quantile_cont(v, 0.75), 6) END AS p75,
 CASE WHEN count(v) >= 4 THEN round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) END AS iqr"""


@query("agg_stats", f"WITH {EV} SELECT pid, {STATS.replace('(v', '(value')} FROM ev GROUP BY pid")
def agg_stats(spark, sf):
    return rounded(ev(spark, sf).groupBy("pid").agg(*C.summary("value")))


@query(
    "agg_by_stage",
    f"""WITH {EV}, g AS (SELECT pid, value AS v, unnest(CASE stage WHEN 'N1' THEN ['all', 'nrem'] WHEN 'N2' THEN ['all', 'nrem', 'n2'] WHEN 'N3' THEN ['all', 'nrem', 'n3'] WHEN 'REM' THEN ['all', 'rem'] ELSE ['all'] END) AS grp FROM ev)
SELECT pid, grp, {STATS} FROM g GROUP BY ALL""",
)
def agg_by_stage(spark, sf):
    return rounded(C.by_stage_group(ev(spark, sf), "stage").groupBy("pid", "grp").agg(*C.summary("value")))


@query("agg_wide", f"WITH {EV}, g AS (SELECT pid, value AS v, stage FROM ev) SELECT pid, " + ", ".join(f"round(avg(v) FILTER (stage = '{s}'), 6) AS {s.lower()}_mean, count(v) FILTER (stage = '{s}') AS {s.lower()}_n" for s in ("N2", "N3", "REM")) + " FROM g GROUP BY pid")
def agg_wide(spark, sf):
    """The wide form at the edge: one column for each group and statistic."""
    p = ev(spark, sf).groupBy("pid").pivot("stage", ["N2", "N3", "REM"]).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))
    return p.select("pid", *[F.coalesce(f"{s}_n", F.lit(0)).alias(f"{s.lower()}_n") for s in ("N2", "N3", "REM")], *[F.col(f"{s}_mean").alias(f"{s.lower()}_mean") for s in ("N2", "N3", "REM")])


@query("stage_distribution", f"""WITH {EV} SELECT pid, {", ".join(f"count(*) FILTER (stage = '{s}') AS {s.lower()}_n, round(100e0 * count(*) FILTER (stage = '{s}') / count(*), 6) AS {s.lower()}_pct" for s in ("W", "N1", "N2", "N3", "REM"))},
 round(100e0 * count(*) FILTER (stage <> 'W') / count(*), 6) AS sleep_pct, round(100e0 * count(*) FILTER (stage IN ('N1', 'N2', 'N3')) / count(*), 6) AS nrem_pct FROM ev GROUP BY pid""")
def stage_distribution(spark, sf):
    s, n = F.col("stage"), F.count(F.lit(1))
    pct = lambda c: r6(100.0 * F.count_if(c) / n)
    aggs = [x for k in ("W", "N1", "N2", "N3", "REM") for x in (F.count_if(s == k).alias(f"{k.lower()}_n"), pct(s == k).alias(f"{k.lower()}_pct"))]
    return ev(spark, sf).groupBy("pid").agg(*aggs, pct(s != "W").alias("sleep_pct"), pct(s.isin("N1", "N2", "N3")).alias("nrem_pct"))


@query("missingness", """WITH l AS (SELECT l_suppkey, unnest(['a_q', 'a_d', 'b_t']) AS feature, unnest([CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_tax END]) AS v FROM lineitem),
r AS (SELECT l_suppkey, feature, avg(CAST(v IS NULL AS INTEGER)) AS null_ratio FROM l GROUP BY ALL)
SELECT l_suppkey, left(feature, 1) AS prefix, round(avg(null_ratio), 6) AS mean_missing, round(median(null_ratio), 6) AS median_missing FROM r GROUP BY ALL""")
def missingness(spark, sf):
    wide = t(spark, sf, "lineitem").selectExpr("l_suppkey", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS a_q", "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS a_d", "CASE WHEN l_linenumber > 4 THEN NULL ELSE l_tax END AS b_t")
    ratios = wide.groupBy("l_suppkey").agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in ("a_q", "a_d", "b_t")]).unpivot("l_suppkey", ["a_q", "a_d", "b_t"], "feature", "r")
    return rounded(ratios.groupBy("l_suppkey", F.substring("feature", 1, 1).alias("prefix")).agg(F.avg("r").alias("mean_missing"), F.median("r").alias("median_missing")))


THIRD = "CAST(least(greatest(floor(t * 3 / 2592000e0) + 1, 1), 3) AS INTEGER)"


@query("third_compare", f"""WITH {EV}, m AS (SELECT pid, avg(value) FILTER ({THIRD} = 1) AS t1, avg(value) FILTER ({THIRD} = 2) AS t2, avg(value) FILTER ({THIRD} = 3) AS t3 FROM ev GROUP BY 1)
SELECT pid, round(t1, 6) AS t1, round(t2, 6) AS t2, round(t3, 6) AS t3, round(t3 - t1, 6) AS d31, round(t2 - t1, 6) AS d21, round((t3 - t1) / nullif(abs(t1), 0), 6) AS rel FROM m
WHERE CAST(t1 IS NOT NULL AS INT) + CAST(t2 IS NOT NULL AS INT) + CAST(t3 IS NOT NULL AS INT) >= 2""")
def third_compare(spark, sf):
    from nocturne.operators.windows import night_part

    rows = ev(spark, sf).withColumn("total", F.lit(NIGHT))
    return rounded(C.third_compare(rows.withColumn("third", night_part("t", "total", 3)), "pid", "third", "value"))


@query("cycle_trend", f"""WITH {EV}, m AS (SELECT pid, CAST(floor(t / 604800e0) AS INTEGER) + 1 AS cycle, avg(value) AS m FROM ev GROUP BY ALL)
SELECT pid, {", ".join(f"round(max(m) FILTER (cycle = {k}), 6) AS c{k}" for k in (1, 2, 3, 4))}, round(CASE WHEN count(*) >= 3 THEN regr_slope(m, cycle) END, 6) AS slope,
 round(CASE WHEN count(*) >= 2 THEN arg_max(m, cycle) - arg_min(m, cycle) END, 6) AS change, round(CASE WHEN count(*) >= 2 THEN (arg_max(m, cycle) - arg_min(m, cycle)) / nullif(abs(arg_min(m, cycle)), 0) END, 6) AS rel FROM m GROUP BY pid""")
def cycle_trend(spark, sf):
    rows = ev(spark, sf).withColumn("cycle", F.floor(F.col("t") / 604800.0).cast("int") + 1)
    return rounded(C.cycle_trend(rows, "pid", "cycle", "value"))


@query("sleep_summary", f"""WITH {EV}, o AS (SELECT *, min(CASE WHEN stage <> 'W' THEN start_sec END) OVER (PARTITION BY pid) AS onset, coalesce(CAST(stage <> lag(stage) OVER (PARTITION BY pid ORDER BY start_sec, end_sec, stage) AS INTEGER), 0) AS ch FROM ev),
a AS (SELECT pid, max(end_sec) - min(start_sec) AS trt, sum(CASE WHEN stage <> 'W' THEN dur ELSE 0e0 END) AS tst, sum(dur) AS scored, max(onset) AS onset, min(CASE WHEN stage = 'REM' THEN start_sec END) AS rem,
 sum(CASE WHEN stage = 'W' AND start_sec > onset THEN dur ELSE 0e0 END) AS waso, sum(ch) AS ch, {", ".join(f"sum(CASE WHEN stage = '{s}' THEN dur ELSE 0e0 END) AS s_{s}" for s in ("W", "N1", "N2", "N3", "REM"))} FROM o GROUP BY pid)
SELECT pid, round(trt / 60, 6) AS trt_min, round(tst / 60, 6) AS tst_min, round(100e0 * tst / scored, 6) AS efficiency, {", ".join(f"round(s_{s} / 60, 6) AS {s.lower()}_min, round(100e0 * (s_{s} / nullif(tst, 0)), 6) AS {s.lower()}_pct" for s in ("W", "N1", "N2", "N3", "REM"))},
 round(onset / 60, 6) AS onset_min, round((rem - onset) / 60, 6) AS rem_latency_min, round(waso / 60, 6) AS waso_min, CAST(ch AS BIGINT) AS transitions, round(ch / nullif(tst / 3600, 0), 6) AS fragmentation FROM a""")
def sleep_summary(spark, sf):
    return rounded(C.sleep_summary(ev(spark, sf).withColumn("duration_sec", F.col("dur")), "pid"))


@query("event_index", f"""WITH {EV}, a AS (SELECT pid, sum(CASE WHEN stage <> 'W' THEN dur ELSE 0e0 END) / 3600 AS h, count(*) FILTER (event_type IN ('view', 'purchase', 'signup', 'error')) AS resp, count(*) FILTER (event_type = 'click') AS ar FROM ev GROUP BY pid),
b AS (SELECT pid, CASE WHEN h > 0 THEN resp / h ELSE 0e0 END AS ahi, CASE WHEN h > 0 THEN ar / h ELSE 0e0 END AS ai FROM a)
SELECT pid, round(ahi, 6) AS ahi, round(ai, 6) AS arousal_index, CASE WHEN ahi < 5 THEN 'normal' WHEN ahi < 15 THEN 'mild' WHEN ahi < 30 THEN 'moderate' ELSE 'severe' END AS category FROM b""")
def event_index(spark, sf):
    from nocturne.functions.scalar import AHI_LIMITS, severity

    h = F.sum(F.when(F.col("stage") != "W", F.col("dur")).otherwise(0.0)) / 3600
    a = ev(spark, sf).groupBy("pid").agg(h.alias("h"), F.count_if(F.col("event_type").isin("view", "purchase", "signup", "error")).alias("resp"), F.count_if(F.col("event_type") == "click").alias("ar"))
    per = lambda c: F.when(F.col("h") > 0, F.col(c) / F.col("h")).otherwise(0.0)
    return a.select("pid", per("resp").alias("ahi"), per("ar").alias("arousal_index")).select("pid", r6("ahi").alias("ahi"), r6("arousal_index").alias("arousal_index"), severity("ahi", AHI_LIMITS).alias("category"))


@query("global_features", f"""WITH {EV}, s AS (SELECT pid, sum(dur) AS total, sum(CASE WHEN stage IN ('N1', 'N2', 'N3') THEN dur ELSE 0 END) AS nrem, sum(CASE WHEN stage = 'N3' THEN dur ELSE 0 END) AS n3, sum(CASE WHEN stage = 'REM' THEN dur ELSE 0 END) AS rem FROM ev GROUP BY pid)
SELECT event_id, round(100e0 * nrem / nullif(total, 0), 6) AS nrem_pct, round(100e0 * n3 / nullif(nrem, 0), 6) AS deep_share, round(n3 / nullif(rem, 0), 6) AS n3_rem FROM ev JOIN s USING (pid)""")
def global_features(spark, sf):
    """A recording's summary on each of its rows."""
    rows, s = ev(spark, sf), F.col("stage")
    part = lambda c: F.sum(F.when(c, F.col("dur")).otherwise(0.0))
    g = rows.groupBy("pid").agg(F.sum("dur").alias("total"), part(s.isin("N1", "N2", "N3")).alias("nrem"), part(s == "N3").alias("n3"), part(s == "REM").alias("rem"))
    out = rows.join(g, "pid")
    return out.select("event_id", r6(F.try_divide(100.0 * F.col("nrem"), F.col("total"))).alias("nrem_pct"), r6(F.try_divide(100.0 * F.col("n3"), F.col("nrem"))).alias("deep_share"), r6(F.try_divide("n3", "rem")).alias("n3_rem"))


@query("epoch_vote", f"""WITH {EV}, v AS (SELECT pid, CAST(floor(t / 86400e0) AS BIGINT) AS epoch, CAST(round(value / 20) AS BIGINT) AS code, count(*) AS n FROM ev GROUP BY ALL)
SELECT pid, epoch, arg_max(code, [n, -code]) AS code FROM v GROUP BY ALL""")
def epoch_vote(spark, sf):
    """Most frequent rounded sample of each epoch; ties: the smallest."""
    v = ev(spark, sf).groupBy("pid", F.floor(F.col("t") / DAY).alias("epoch"), F.round(F.col("value") / 20).cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("pid", "epoch").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))


CONF = "count(*) FILTER (score > 0.5 AND y2 = 1) AS tp, count(*) FILTER (score > 0.5 AND y2 = 0) AS fp, count(*) FILTER (score <= 0.5 AND y2 = 1) AS fn, count(*) FILTER (score <= 0.5 AND y2 = 0) AS tn"
MEAS = """tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tn / nullif(tn + fn, 0), 6) AS npv,
 round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1, 6) AS youden,
 round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc, round(((tp + tn) / n - e) / nullif(1 - e, 0), 6) AS kappa,
 round((tp / nullif(tp + fn, 0)) / nullif(1 - tn / nullif(tn + fp, 0), 0), 6) AS lr_pos, round((1 - tp / nullif(tp + fn, 0)) / nullif(tn / nullif(tn + fp, 0), 0), 6) AS lr_neg, round(tp * tn / nullif(fp * fn, 0), 6) AS dor"""
WITHN = "n AS (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (CAST(tp + fp + fn + tn AS DOUBLE) * (tp + fp + fn + tn)) AS e FROM c)"


@query("confusion", f"WITH {SC}, c AS (SELECT {CONF} FROM sc), {WITHN} SELECT {MEAS} FROM n")
def confusion(spark, sf):
    return rounded(C.metrics(scored(spark, sf).agg(*C.confusion("y2", "score"))))


@query("score_losses", f"WITH {SC}, c AS (SELECT y2, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM sc) SELECT round(avg((p - y2) * (p - y2)), 6) AS brier, round(-avg(y2 * ln(p) + (1 - y2) * ln(1 - p)), 6) AS log_loss FROM c")
def score_losses(spark, sf):
    from nocturne.functions.scalar import clip

    c = scored(spark, sf).select("y2", clip(F.col("score"), 1e-7, 1 - 1e-7).alias("p"))
    y, p = F.col("y2"), F.col("p")
    return c.agg(r6(F.avg((p - y) * (p - y))).alias("brier"), r6(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


PAIRS = "a AS (SELECT * FROM sc WHERE y2 = 1), b AS (SELECT * FROM sc WHERE y2 = 0)"
WIN = "avg(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0e0 END)"


@query("auroc", f"WITH {SC}, {PAIRS} SELECT round({WIN}, 9) AS auroc FROM a, b")
def auroc(spark, sf):
    return C.auroc(scored(spark, sf), "y2", "score").select(F.round("auroc", 9).alias("auroc"))


@query("auprc", f"WITH {SC}, v AS (SELECT score, sum(y2) AS p, count(*) AS k FROM sc GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) / sum(k) OVER (ORDER BY score DESC) AS pr FROM v) SELECT round(sum(pr * p) / sum(p), 9) AS auprc FROM c")
def auprc(spark, sf):
    return C.auprc(scored(spark, sf), "y2", "score").select(F.round("auprc", 9).alias("auprc"))


@query("auroc_age", f"WITH {SC}, {PAIRS} SELECT round({WIN}, 9) AS auroc_age, count(*) AS pairs FROM a JOIN b ON abs(a.age - b.age) <= 2")
def auroc_age(spark, sf):
    return C.auroc_age(scored(spark, sf), "y2", "score", "age", 2).select(F.round("auroc_age", 9).alias("auroc_age"), "pairs")


@query("auroc_weighted", f"""WITH {SC}, {PAIRS}, g AS (SELECT k FROM range(40, 100) r(k)), c AS (SELECT k, {WIN} AS auc FROM g JOIN a ON abs(a.age - k) <= 2 JOIN b ON abs(b.age - k) <= 2 GROUP BY k),
w AS (SELECT c.k, auc, (SELECT count(*) FROM sc WHERE abs(age - c.k) <= 2) AS w FROM c) SELECT round(sum(auc * w) / sum(w), 9) AS auroc_weighted FROM w""")
def auroc_weighted(spark, sf):
    return C.auroc_age_weighted(scored(spark, sf), "y2", "score", "age", 2).select(F.round("auroc_weighted", 9).alias("auroc_weighted"))


PREV = "pv AS (SELECT x.age, greatest(sum(s.y2), 0.5) / count(*) AS prevalence, count(*) AS n FROM (SELECT DISTINCT age FROM sc) x JOIN sc s ON abs(s.age - x.age) <= 2 GROUP BY 1)"


@query("prevalence_band", f"WITH {SC}, {PREV} SELECT age, n, round(prevalence, 9) AS prevalence FROM pv")
def prevalence_band(spark, sf):
    b = I.band_counts(scored(spark, sf), "age", 2, {"k": F.col("y2"), "n": F.lit(1)})
    return b.select("age", "n", F.round(F.greatest(F.col("k").cast("double"), F.lit(0.5)) / F.col("n"), 9).alias("prevalence"))


def _with_prevalence(spark, sf):
    s = scored(spark, sf)
    b = I.band_counts(s, "age", 2, {"k": F.col("y2"), "n": F.lit(1)})
    p = F.greatest(F.col("k").cast("double"), F.lit(0.5)) / F.col("n")
    return s.join(F.broadcast(b.select("age", p.alias("p"))), "age")


@query("age_threshold", f"""WITH {SC}, {PREV}, o AS (SELECT doc_id, least(greatest(prevalence, 1e-6), 1 - 1e-6) AS thr, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM sc JOIN pv USING (age)), s AS (SELECT *, p / (1 - p) * (thr / (1 - thr)) / (0.2e0 / 0.8e0) AS odds FROM o)
SELECT doc_id, round(thr, 9) AS threshold, round(odds / (1 + odds), 9) AS shifted, CAST(odds / (1 + odds) > thr AS INTEGER) AS prediction FROM s""")
def age_threshold(spark, sf):
    """Threshold by age and the row-wise shift to it."""
    from nocturne.functions.scalar import clip, prior_shift

    rows = _with_prevalence(spark, sf).withColumn("threshold", clip(F.col("p"), 1e-6, 1 - 1e-6))
    rows = rows.withColumn("shifted", prior_shift(F.col("score"), F.lit(0.2), F.col("threshold")))
    return rows.select("doc_id", F.round("threshold", 9).alias("threshold"), F.round("shifted", 9).alias("shifted"), (F.col("shifted") > F.col("threshold")).cast("int").alias("prediction"))


@query("reward", f"""WITH {SC}, {PREV}, m AS (SELECT count(*) AS m FROM sc), q AS (SELECT y2, score > 0.5 AS hit, least(greatest(prevalence, 0.5 / m), 1 - 0.5 / m) AS p FROM sc JOIN pv USING (age), m)
SELECT round(avg(CASE WHEN hit AND y2 = 1 THEN 1 / p - 1 WHEN NOT hit AND y2 = 0 THEN 1 / (1 - p) - 1 ELSE -1e0 END), 6) AS reward FROM q""")
def reward(spark, sf):
    rows = _with_prevalence(spark, sf)
    m = rows.agg(F.count(F.lit(1)).alias("m"))
    rows = rows.crossJoin(F.broadcast(m)).withColumn("p", F.least(F.greatest("p", 0.5 / F.col("m")), 1 - 0.5 / F.col("m")))
    return rows.agg(r6(F.avg(C.reward(rows, "y2", F.col("score") > 0.5, "p"))).alias("reward"))


@query("age_table", f"""WITH {SC} SELECT age, count(*) AS n, count(*) FILTER (y2 = 1) AS n_pos, count(*) FILTER (y2 = 0) AS n_neg, count(*) FILTER (score > 0.5) AS pred_pos, count(*) FILTER (score <= 0.5) AS pred_neg, {CONF}, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM sc GROUP BY age""")
def age_table(spark, sf):
    y, s = F.col("y2"), F.col("score")
    out = scored(spark, sf).groupBy("age").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"), F.count_if(s > 0.5).alias("pred_pos"), F.count_if(s <= 0.5).alias("pred_neg"),
        *C.confusion("y2", "score"), F.avg(s).alias("mean_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
    )
    return rounded(out)


@query("threshold_sweep", f"""WITH {SC}, g AS (SELECT i * 5 / 100e0 AS threshold FROM range(1, 20) r(i)), c AS (SELECT threshold, {CONF.replace('0.5', 'threshold')} FROM sc, g GROUP BY 1), {WITHN} SELECT threshold, {MEAS} FROM n""")
def threshold_sweep(spark, sf):
    return rounded(C.threshold_sweep(scored(spark, sf), "y2", "score", [i * 5 / 100 for i in range(1, 20)]), "threshold")


@query("optimal_thresholds", f"""WITH {SC}, g AS (SELECT i * 5 / 100e0 AS threshold FROM range(1, 20) r(i)), c AS (SELECT threshold, {CONF.replace('0.5', 'threshold')} FROM sc, g GROUP BY 1), {WITHN}, m AS (SELECT threshold, {MEAS} FROM n)
SELECT arg_max(threshold, [f1, -threshold]) AS best_f1, arg_max(threshold, [youden, -threshold]) AS best_youden, arg_max(threshold, [balanced, -threshold]) AS best_balanced, arg_max(threshold, [specificity, -threshold]) FILTER (sensitivity >= 0.9) AS best_sens90 FROM m""")
def optimal_thresholds(spark, sf):
    m = rounded(C.threshold_sweep(scored(spark, sf), "y2", "score", [i * 5 / 100 for i in range(1, 20)]), "threshold")
    first = lambda c, ok=None: F.max_by("threshold", F.struct(F.col(c) if ok is None else F.when(ok, F.col(c)), -F.col("threshold")))
    ok = F.col("sensitivity") >= 0.9
    sens = F.max_by(F.when(ok, F.col("threshold")), F.when(ok, F.struct("specificity", -F.col("threshold"))))
    return m.agg(first("f1").alias("best_f1"), first("youden").alias("best_youden"), first("balanced").alias("best_balanced"), sens.alias("best_sens90"))


CAL = "b AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(score) AS confidence, avg(CAST(y2 AS DOUBLE)) AS rate FROM sc GROUP BY 1)"


@query("calibration_curve", f"WITH {SC}, {CAL} SELECT bin, n, round(confidence, 6) AS confidence, round(rate, 6) AS rate, round(abs(confidence - rate), 6) AS gap FROM b")
def calibration_curve(spark, sf):
    return rounded(C.calibration(scored(spark, sf), "y2", "score"))


@query("calibration_ece", f"WITH {SC}, {CAL} SELECT round(sum(n * abs(confidence - rate)) / sum(n), 6) AS ece, round(max(abs(confidence - rate)), 6) AS mce FROM b")
def calibration_ece(spark, sf):
    return C.calibration(scored(spark, sf), "y2", "score").agg(r6(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), r6(F.max("gap")).alias("mce"))


FAIR = f"WITH {SC}, c AS (SELECT grp, {CONF} FROM sc GROUP BY grp HAVING count(*) >= 5), f AS (SELECT grp, tp + fp + fn + tn AS n, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, (tp + fp) / (tp + fp + fn + tn) AS pr FROM c)"


@query("fairness_groups", FAIR + f", a AS (SELECT grp, tpr, fpr, pr, n FROM f), x AS (SELECT p.grp, avg(CASE WHEN p.score > q.score THEN 1e0 WHEN p.score = q.score THEN 0.5e0 ELSE 0e0 END) AS auc FROM sc p JOIN sc q ON p.grp = q.grp AND p.y2 = 1 AND q.y2 = 0 GROUP BY 1) SELECT a.grp, n, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(pr, 6) AS positive_rate, round(auc, 6) AS auroc FROM a LEFT JOIN x ON a.grp = x.grp")
def fairness_groups(spark, sf):
    s = scored(spark, sf)
    c = s.groupBy("grp").agg(*C.confusion("y2", "score"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    a = C.auroc(s, "y2", "score", ["grp"]).select("grp", "auroc")
    rates = c.join(a, "grp", "left")
    return rates.select("grp", "n", r6(F.try_divide("tp", F.col("tp") + F.col("fn"))).alias("tpr"), r6(F.try_divide("fp", F.col("fp") + F.col("tn"))).alias("fpr"), r6((F.col("tp") + F.col("fp")) / F.col("n")).alias("positive_rate"), r6("auroc").alias("auroc"))


@query("fairness_gaps", FAIR + " SELECT round(max(pr) - min(pr), 6) AS parity_gap, round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS odds_gap FROM f WHERE tpr IS NOT NULL AND fpr IS NOT NULL")
def fairness_gaps(spark, sf):
    c = scored(spark, sf).groupBy("grp").agg(*C.confusion("y2", "score"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    f = c.select(F.try_divide("tp", F.col("tp") + F.col("fn")).alias("tpr"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("fpr"), ((F.col("tp") + F.col("fp")) / F.col("n")).alias("pr")).where("tpr is not null and fpr is not null")
    gap = lambda c: F.max(c) - F.min(c)
    return f.agg(r6(gap("pr")).alias("parity_gap"), r6(gap("tpr")).alias("tpr_gap"), r6(gap("fpr")).alias("fpr_gap"), r6(F.greatest(gap("tpr"), gap("fpr"))).alias("odds_gap"))


@query("error_analysis", f"WITH {SC}, e AS (SELECT *, CAST(score > 0.5 AS INTEGER) <> y2 AS wrong, greatest(score, 1 - score) AS conf FROM sc) SELECT grp, count(*) AS n, count(*) FILTER (wrong) AS errors, round(avg(CAST(wrong AS INTEGER)) FILTER (conf >= 0.8), 6) AS high_conf_error, round(avg(CAST(wrong AS INTEGER)) FILTER (conf < 0.6), 6) AS low_conf_error FROM e GROUP BY grp")
def error_analysis(spark, sf):
    wrong = ((F.col("score") > 0.5).cast("int") != F.col("y2")).cast("int")
    e = scored(spark, sf).withColumn("wrong", wrong).withColumn("conf", F.greatest("score", 1 - F.col("score")))
    return e.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("errors"), r6(F.avg(F.when(F.col("conf") >= 0.8, F.col("wrong")))).alias("high_conf_error"), r6(F.avg(F.when(F.col("conf") < 0.6, F.col("wrong")))).alias("low_conf_error")
    )


@query("crosstab", "SELECT c_mktsegment, " + ", ".join(f"count(*) FILTER (c_nationkey % 3 = {k}) AS g{k}" for k in range(3)) + ", round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std FROM customer GROUP BY 1")
def crosstab(spark, sf):
    c = t(spark, sf, "customer")
    return c.groupBy("c_mktsegment").agg(*[F.count_if(F.col("c_nationkey") % 3 == k).alias(f"g{k}") for k in range(3)], r6(F.avg("c_acctbal")).alias("mean"), r6(F.stddev_samp("c_acctbal")).alias("std"))


@query("histogram", "SELECT CAST(least(floor((c_acctbal + 1000) / 550), 19) AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1")
def histogram(spark, sf):
    return t(spark, sf, "customer").groupBy(F.least(F.floor((F.col("c_acctbal") + 1000) / 550), F.lit(19)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2e0 AS b,
 rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2e0 AS c FROM lineitem) SELECT round(corr(a, b), 6) AS q_d, round(corr(a, c), 6) AS q_t, round(corr(b, c), 6) AS d_t FROM r""")
def spearman(spark, sf):
    """Rank correlations; ranks come from counts by distinct value, joined back."""
    rows = t(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    rows = C.with_mid_ranks(rows, {f"r_{c}": c for c in rows.columns})
    a, b, c = "r_l_quantity", "r_l_discount", "r_l_tax"
    return rows.agg(r6(F.corr(a, b)).alias("q_d"), r6(F.corr(a, c)).alias("q_t"), r6(F.corr(b, c)).alias("d_t"))


@query("cohens_d", f"WITH {SC}, g AS (SELECT avg(score) FILTER (y2 = 1) AS m1, avg(score) FILTER (y2 = 0) AS m0, var_samp(score) FILTER (y2 = 1) AS v1, var_samp(score) FILTER (y2 = 0) AS v0, count(*) FILTER (y2 = 1) AS n1, count(*) FILTER (y2 = 0) AS n0 FROM sc) SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM g")
def cohens_d(spark, sf):
    s = lambda k: F.when(F.col("y2") == k, F.col("score"))
    g = scored(spark, sf).agg(F.avg(s(1)).alias("m1"), F.avg(s(0)).alias("m0"), F.var_samp(s(1)).alias("v1"), F.var_samp(s(0)).alias("v0"), F.count(s(1)).alias("n1"), F.count(s(0)).alias("n0"))
    return g.selectExpr("round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d")


@query("mann_whitney", f"WITH {SC}, {PAIRS}, u AS (SELECT sum(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0e0 END) AS u FROM a, b), n AS (SELECT count(*) FILTER (y2 = 1) AS n1, count(*) FILTER (y2 = 0) AS n0 FROM sc) SELECT u, round(2 * u / (n1 * n0) - 1, 6) AS rank_biserial FROM u, n")
def mann_whitney(spark, sf):
    r = C.rank_tests(scored(spark, sf), "y2", "score")
    pick = lambda c, k: F.max(F.when(F.col("y2") == k, F.col(c)))
    g = r.agg(pick("n", 1).alias("n1"), pick("n", 0).alias("n0"), pick("rank_sum", 1).alias("r1"))
    return g.selectExpr("r1 - n1 * (n1 + 1) / 2 AS u", "n1", "n0").selectExpr("u", "round(2 * u / (n1 * n0) - 1, 6) AS rank_biserial")


@query("kruskal", f"WITH {SC}, r AS (SELECT grp, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM sc), g AS (SELECT grp, count(*) AS n, sum(r) AS s FROM r GROUP BY 1), n AS (SELECT count(*) AS n FROM sc), t AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM sc GROUP BY score)) SELECT round((12e0 / (n.n * (n.n + 1)) * (SELECT sum(s * s / n) FROM g) - 3 * (n.n + 1)) / (1 - t / (CAST(n.n AS DOUBLE) * n.n * n.n - n.n)), 6) AS h FROM n, t")
def kruskal(spark, sf):
    s = scored(spark, sf)
    r = C.rank_tests(s, "grp", "score").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("ss"))
    k = s.groupBy("score").agg(F.count(F.lit(1)).cast("double").alias("k")).agg(F.sum(F.expr("k * k * k - k")).alias("t"))
    return r.crossJoin(F.broadcast(k)).selectExpr("round((12.0D / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    """Interval of the mean score over Poisson replicates with a fixed seed."""
    b = C.poisson_bootstrap(scored(spark, sf).select("doc_id", "score"), "doc_id", 1000, 42)
    m = b.groupBy("replicate").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("m"))
    return m.agg(r6(F.percentile("m", F.lit(0.025))).alias("low"), r6(F.percentile("m", F.lit(0.975))).alias("high"), F.count(F.lit(1)).alias("replicates"))


@query("fold_summary", f"WITH {SC}, f AS (SELECT doc_id % 5 AS fold, avg(score) AS m FROM sc GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std_cv, round(stddev_samp(m), 6) AS std_folds FROM f")
def fold_summary(spark, sf):
    f = scored(spark, sf).groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg("score").alias("m"))
    return f.agg(r6(F.avg("m")).alias("mean"), r6(F.stddev_pop("m")).alias("std_cv"), r6(F.stddev_samp("m")).alias("std_folds"))


@query("circular_stats", f"WITH {EV}, a AS (SELECT pid, 2 * pi() * (t - floor(t / 86400e0) * 86400e0) / 86400e0 - pi() AS phi FROM ev), m AS (SELECT pid, count(*) AS n, avg(sin(phi)) AS s, avg(cos(phi)) AS c FROM a GROUP BY 1), r AS (SELECT *, sqrt(s * s + c * c) AS r FROM m) SELECT pid, round(atan2(s, c), 6) AS mean_phase, round(r, 6) AS mrl, round(sqrt(-2 * ln(r)), 6) AS circ_std, round(n * r * r, 6) AS rayleigh_z, round(exp(-n * r * r), 6) AS rayleigh_p FROM r")
def circular_stats(spark, sf):
    phi = 2 * F.pi() * (F.col("t") - F.floor(F.col("t") / DAY) * DAY) / DAY - F.pi()
    m = ev(spark, sf).select("pid", phi.alias("phi")).groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sin("phi")).alias("s"), F.avg(F.cos("phi")).alias("c"))
    m = m.withColumn("r", F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")))
    z = F.col("n") * F.col("r") * F.col("r")
    return m.select("pid", r6(F.atan2("s", "c")).alias("mean_phase"), r6("r").alias("mrl"), r6(F.sqrt(-2 * F.log("r"))).alias("circ_std"), r6(z).alias("rayleigh_z"), r6(F.exp(-z)).alias("rayleigh_p"))


@query("modulation_index", f"WITH {EV}, b AS (SELECT CAST(least(floor((t - floor(t / 86400e0) * 86400e0) / 4800e0), 17) AS BIGINT) AS bin, avg(value) AS m FROM ev GROUP BY 1), p AS (SELECT m / sum(m) OVER () AS p FROM b) SELECT round((ln(18) + sum(p * ln(p))) / ln(18), 9) AS mi FROM p")
def modulation_index(spark, sf):
    """18 phase bins, mean amplitude of each, distance from uniform over log n."""
    b = F.least(F.floor((F.col("t") - F.floor(F.col("t") / DAY) * DAY) / 4800.0), F.lit(17))
    m = ev(spark, sf).groupBy(b.alias("bin")).agg(F.avg("value").alias("m"))
    p = m.select((F.col("m") / F.sum("m").over(Window.partitionBy())).alias("p"))
    return p.agg(F.round((F.log(F.lit(18.0)) + F.sum(F.col("p") * F.log("p"))) / F.log(F.lit(18.0)), 9).alias("mi"))
