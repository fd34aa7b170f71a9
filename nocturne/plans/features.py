"""Queries on feature tables, channels, the odds ratio product and events of a night."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.operators import features as X
from nocturne.plans.base import EV, ev, t
from nocturne.plans.registry import query

r6 = lambda c: F.round(c, 6)

LABELS = "CASE s_suppkey % 6 WHEN 0 THEN ' Nasal Pressure' WHEN 1 THEN 'THOR effort' WHEN 2 THEN 'F3' WHEN 3 THEN 'Airflow' WHEN 4 THEN 'C3-M2' ELSE 'abdomen' END"


def channels(spark, sf):
    return t(spark, sf, "supplier").selectExpr("s_suppkey % 9 AS rec", "s_suppkey AS pos", f"{LABELS} AS label")


CH = f"ch AS (SELECT s_suppkey % 9 AS rec, s_suppkey AS pos, {LABELS} AS label FROM supplier)"


@query("breathing_names", f"WITH {CH} SELECT rec, pos, label, " + "CASE " + " ".join(f"WHEN contains(lower(trim(label)), '{n}') THEN '{n}'" for n in X.BREATHING_NAMES) + " END AS matched FROM ch WHERE matched IS NOT NULL")
def breathing_names(spark, sf):
    """Breathing channels by parts of their labels."""
    return X.breathing_channels(channels(spark, sf))


@query("first_channel", f"WITH {CH}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos) AS rn FROM ch WHERE lower(trim(label)) IN ('f3', 'airflow', 'c3-m2')) SELECT rec, pos, label FROM r WHERE rn = 1")
def first_channel(spark, sf):
    """The first channel in file order that one of the aliases names."""
    return X.first_channels(channels(spark, sf), "rec", "label", "pos", ["C3-M2", "F3 ", "airflow"]).select("rec", "pos", "label")


@query("two_derivations", f"WITH {CH}, d AS (SELECT DISTINCT rec, label FROM ch), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY CASE label WHEN 'C3-M2' THEN 0 WHEN 'F3' THEN 1 WHEN 'Airflow' THEN 2 ELSE 3 END, label) AS rn FROM d) SELECT rec, label FROM r WHERE rn <= 2")
def two_derivations(spark, sf):
    return X.by_priority(channels(spark, sf).select("rec", "label").distinct(), "rec", "label", ["C3-M2", "F3", "Airflow"])


@query("spindle_gate", f"WITH {EV} SELECT event_id, stage FROM ev WHERE stage IS NULL OR stage NOT IN ('W', 'REM')")
def spindle_gate(spark, sf):
    """Segments that spindles are looked for in."""
    return X.spindle_gate(ev(spark, sf), "stage").select("event_id", "stage")


@query("segment_stage_lookup", f"WITH {EV}, s AS (SELECT pid, event_id % 7 AS segment_idx, max(stage) AS dominant_stage FROM ev WHERE event_type <> 'click' GROUP BY ALL) SELECT c_custkey AS pid, k AS segment_idx, coalesce(dominant_stage, 'Unknown') AS dominant_stage FROM customer, range(0, 9) r(k) LEFT JOIN s ON s.pid = c_custkey AND s.segment_idx = k")
def segment_stage_lookup(spark, sf):
    """Segments with their dominant stage by key; none: Unknown."""
    s = ev(spark, sf).where("event_type <> 'click'").groupBy("pid", (F.col("event_id") % 7).alias("segment_idx")).agg(F.max("stage").alias("dominant_stage"))
    grid = t(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.explode(F.expr("sequence(0L, 8L)")).alias("segment_idx"))
    return X.with_stage(grid, s, ["pid", "segment_idx"]).select("pid", "segment_idx", "dominant_stage")


@query("frames_beside", "SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal, n.n AS n_parts FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) n ON n.l_suppkey = s_suppkey")
def frames_beside(spark, sf):
    """Frames side by side by key; a column that came before is not replaced."""
    s = t(spark, sf, "supplier")
    b = t(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n_parts")).withColumn("s_nationkey", F.lit(-1))
    return X.beside([s.select("s_suppkey", "s_nationkey"), s.select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal")), b], ["s_suppkey"])


@query("stage_defaults", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'N2' ELSE 'Unknown' END AS ann_dominant_stage, CASE WHEN s_suppkey % 3 = 0 THEN 0.5e0 ELSE 0e0 END AS ann_stage_stability, 0 AS ann_is_rem FROM supplier")
def stage_defaults(spark, sf):
    """Annotation columns, defaults where a segment has none."""
    s = t(spark, sf, "supplier").select("s_suppkey")
    found = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("N2").alias("ann_dominant_stage"), F.lit(0.5).alias("ann_stage_stability"))
    return X.annotation_features(s, found, ["s_suppkey"]).select("s_suppkey", "ann_dominant_stage", "ann_stage_stability", "ann_is_rem")


NAMES = ["eeg_delta_power_mean", "ecg_hrv_sdnn_std", "eeg_sample_entropy_mean", "rsa_resp_rate", "ahi", "age_x_bmi", "ann_sp_density", "eeg_swa_power", "other"]


@query("feature_groups", "WITH f AS (SELECT unnest(" + str(NAMES) + ") AS feature), g AS (" + " UNION ALL ".join(f"SELECT '{g}' AS grp, unnest({p.split()}) AS part" for g, p in X.FEATURE_GROUPS.items()) + ") SELECT DISTINCT feature, grp FROM f JOIN g ON contains(feature, part)")
def feature_groups(spark, sf):
    """The groups that a feature's name puts it in."""
    return X.feature_groups(spark.createDataFrame([(n,) for n in NAMES], "feature string"))


@query("selected_features", "SELECT l_orderkey AS segment_idx, l_linenumber, l_quantity AS quantity, l_tax AS tax, 1 AS x_sqi FROM lineitem WHERE l_orderkey < 100")
def selected_features(spark, sf):
    """The columns that selected features name, with keys and quality columns; meta columns are not aggregated."""
    wide = t(spark, sf, "lineitem").where("l_orderkey < 100").selectExpr("l_orderkey AS segment_idx", "l_linenumber", "l_quantity AS quantity", "l_tax AS tax", "l_discount AS discount", "1 AS x_sqi", "2 AS meta_version", "3 AS ann_ctx_trend")
    kept = X.selected_columns(wide.columns, ["eeg_quantity_mean", "ecg_tax_iqr", "ann_ctx_trend"], ("segment_idx", "l_linenumber"))
    return wide.select(*[c for c in kept if c in {"segment_idx", *X.aggregated_columns(kept)}])


@query("first_present_column", "SELECT p_partkey, coalesce(CAST(nullif(p_size, 7) AS VARCHAR), p_name) AS who FROM part")
def first_present_column(spark, sf):
    """The first alias that the table has and the row has a value for, regardless of case."""
    p = t(spark, sf, "part").withColumn("p_size", F.expr("nullif(p_size, 7)"))
    return p.select("p_partkey", X.coalesced(p, ["length", "P_SIZE", "p_name"]).alias("who"))


@query("default_k", "SELECT n, p, CAST(least(greatest(least(CAST(trunc(sqrt(n) * 3) AS BIGINT), 75, p), 10), p) AS BIGINT) AS k FROM (SELECT unnest([5, 50, 400, 10000]) AS n), (SELECT unnest([4, 30, 300]) AS p)")
def default_k(spark, sf):
    rows = [(n, p, X.default_k(n, p)) for n in (5, 50, 400, 10000) for p in (4, 30, 300)]
    return spark.createDataFrame(rows, "n int, p int, k long")


@query("orp_by_stage", f"""WITH {EV}, w AS (SELECT pid, stage, value / 40 AS orp FROM ev WHERE value < 90) SELECT pid, round(avg(orp) FILTER (stage IN ('N2', 'N3')), 6) AS orp_nrem, round(stddev_pop(orp) FILTER (stage IN ('N2', 'N3')), 6) AS orp_nrem_std, round(avg(orp) FILTER (stage = 'REM'), 6) AS orp_rem,
round(avg(orp) FILTER (stage = 'W'), 6) AS orp_wake, round(count(*) FILTER (stage IN ('N1', 'N2', 'N3', 'REM')) * 5 / 60e0 * (2.5 - avg(orp) FILTER (stage IN ('N1', 'N2', 'N3', 'REM'))), 6) AS csi FROM w GROUP BY pid""")
def orp_by_stage(spark, sf):
    """Means by stage and the cumulative sleep index."""
    w = ev(spark, sf).select("pid", "stage", (F.col("value") / 40).alias("orp"), (F.col("value") < 90).alias("clean"))
    out = X.orp_by_stage(w, "pid")
    return out.select("pid", *[r6(c).alias(c) for c in out.columns[1:]])


@query("orp_around_arousals", f"""WITH {EV}, w AS (SELECT pid, t AS a, t + 7200 AS b, value / 40 AS orp FROM ev WHERE event_type <> 'click' AND value < 90), e AS (SELECT DISTINCT pid, start_sec AS s, end_sec AS e FROM ev WHERE event_type = 'click'),
p AS (SELECT e.pid, s, e, max(orp) AS v FROM e JOIN w ON w.pid = e.pid AND a < e AND b > s GROUP BY ALL), n AS (SELECT e.pid, s, e, avg(orp) AS v FROM e JOIN w ON w.pid = e.pid AND a >= e AND a < e + 9000 GROUP BY ALL)
SELECT d.pid, round(x.v, 6) AS orp_apeak, round(y.v, 6) AS orp_a9 FROM (SELECT DISTINCT pid FROM e) d LEFT JOIN (SELECT pid, avg(v) AS v FROM p GROUP BY 1) x ON x.pid = d.pid LEFT JOIN (SELECT pid, avg(v) AS v FROM n GROUP BY 1) y ON y.pid = d.pid""")
def orp_around_arousals(spark, sf):
    """Greatest value about an arousal and mean after it: range joins."""
    rows = ev(spark, sf)
    w = rows.where("event_type <> 'click'").select("pid", F.col("t").alias("start_sec"), (F.col("value") / 40).alias("orp"), (F.col("value") < 90).alias("clean"))
    a = rows.where("event_type = 'click'").select("pid", "start_sec", "end_sec").distinct()
    out = X.orp_around_arousals(w, a, "pid", 7200.0, 9000.0, 7200.0)
    return out.select("pid", r6("orp_apeak").alias("orp_apeak"), r6("orp_a9").alias("orp_a9"))


TYPES = ["view", "purchase"]
IDX = ", ".join(
    f"coalesce(n_{k}, 0) AS {k}_count, round(CASE WHEN h > 0 THEN coalesce(n_{k}, 0) / h ELSE 0 END, 6) AS {k}_index, round(coalesce(m_{k}, 0), 6) AS {k}_mean_duration_sec, round(coalesce(x_{k}, 0), 6) AS {k}_max_duration_sec" for k in TYPES
)


@query(
    "event_indices",
    f"""WITH {EV}, nights AS (SELECT c_custkey AS pid, c_custkey % 5 * 1e0 AS h FROM customer), g AS (SELECT pid, count(*) FILTER (event_type IN ('view', 'signup')) AS ap, count(*) FILTER (event_type = 'error') AS ar,
{", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}, avg(dur) FILTER (event_type = '{k}') AS m_{k}, max(dur) FILTER (event_type = '{k}') AS x_{k}" for k in TYPES)} FROM ev GROUP BY pid)
SELECT nights.pid, {IDX}, round(CASE WHEN g.pid IS NULL THEN NULL WHEN h > 0 THEN ap / h ELSE 0 END, 6) AS ahi, round(CASE WHEN g.pid IS NULL THEN NULL WHEN h > 0 THEN ar / h ELSE 0 END, 6) AS arousal_index FROM nights LEFT JOIN g ON g.pid = nights.pid""",
)
def event_indices(spark, sf):
    """Counts, indices and durations of events of a night."""
    nights = t(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 5).cast("double").alias("h"))
    events = ev(spark, sf).select("pid", "event_type", F.col("dur").alias("duration_sec"))
    out = X.event_indices(nights, events, "pid", "h", TYPES, ["view", "signup"], "error")
    return out.select(*[r6(c).alias(c) if out.schema[c].dataType.typeName() == "double" else F.col(c) for c in out.columns])


@query("pipeline_stats", """WITH s AS (SELECT user_id AS pid, CASE WHEN event_type IN ('view', 'click') THEN 'eeg' ELSE 'ecg' END AS kind, value / 100 AS q, event_type AS ch FROM events) SELECT pid, count(*) AS total_segments, count(*) FILTER (kind = 'ecg' AND q >= 0.5) AS valid_ecg_segments,
count(*) FILTER (kind = 'ecg' AND q < 0.5) AS rejected_ecg_segments, round(avg(q) FILTER (kind = 'ecg'), 6) AS mean_ecg_sqi, count(*) FILTER (kind = 'eeg' AND q >= 0.5) AS valid_eeg_segments, count(*) FILTER (kind = 'eeg' AND q < 0.5) AS rejected_eeg_segments,
round(avg(q) FILTER (kind = 'eeg'), 6) AS mean_eeg_sqi, coalesce(string_agg(DISTINCT ch, ',' ORDER BY ch) FILTER (kind = 'eeg' AND q >= 0.5), '') AS eeg_channels_used FROM s GROUP BY pid""")
def pipeline_stats(spark, sf):
    """What came of each recording."""
    kind = F.when(F.col("event_type").isin("view", "click"), "eeg").otherwise("ecg")
    s = t(spark, sf, "events").select(F.col("user_id").alias("pid"), kind.alias("kind"), (F.col("value") / 100).alias("q"), F.col("event_type").alias("ch"))
    out = X.pipeline_stats(s, "pid", "kind", F.col("q") >= 0.5, "q", "ch")
    return out.select(*[r6(c).alias(c) if c.startswith("mean_") else F.col(c) for c in out.columns])
