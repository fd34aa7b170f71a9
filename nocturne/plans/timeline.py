"""Queries on intervals, windows and runs along the time axis of each recording."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nocturne.operators import intervals as I
from nocturne.operators import windows as W
from nocturne.plans.base import DAY, EV, NIGHT, SEG, STAGES, ev, seg, t
from nocturne.plans.registry import query

TYPES = sorted(STAGES)
NAMES = ["W", "N1", "N2", "N3", "REM"]
ORDER = ["t", "event_id"]
w = lambda: W.over("pid", *ORDER)  # noqa: E731  a window needs a session
r6 = lambda c: F.round(c, 6)

SQL_OVERLAP = f"""
WITH {EV}, {SEG}, p AS (
  SELECT seg.pid, segment_idx, seg.duration_sec, event_type, least(seg.end_sec, ev.end_sec) - greatest(seg.start_sec, ev.start_sec) AS sec
  FROM seg JOIN ev ON seg.pid = ev.pid AND seg.start_sec < ev.end_sec AND seg.end_sec > ev.start_sec
)"""


@query(
    "seg_event_overlap",
    SQL_OVERLAP
    + "SELECT seg.pid, seg.segment_idx, "
    + ", ".join(
        f"count(sec) FILTER (event_type = '{e}') AS {e}_count, round(coalesce(sum(sec) FILTER (event_type = '{e}'), 0e0), 6) AS {e}_duration, "
        f"CAST(count(sec) FILTER (event_type = '{e}') > 0 AS INTEGER) AS {e}_present, "
        f"round(count(sec) FILTER (event_type = '{e}') / (86400e0 / 60), 6) AS {e}_density"
        for e in TYPES
    )
    + " FROM seg LEFT JOIN p ON seg.pid = p.pid AND seg.segment_idx = p.segment_idx GROUP BY 1, 2",
)
def seg_event_overlap(spark, sf):
    out = I.event_measures(seg(spark, sf), ev(spark, sf), "pid", TYPES, DAY)
    rounded = {c: F.round(c, 6) for c in out.columns if c.endswith(("duration", "density"))}
    return out.withColumns(rounded)


@query(
    "seg_stage_fractions",
    f"""
WITH {EV}, {SEG}, p AS (
  SELECT seg.pid, segment_idx, stage, ev.start_sec AS s, ev.end_sec AS e,
    least(seg.end_sec, ev.end_sec) - greatest(seg.start_sec, ev.start_sec) AS sec
  FROM seg JOIN ev ON seg.pid = ev.pid AND seg.start_sec < ev.end_sec AND seg.end_sec > ev.start_sec AND ev.dur > 0
), c AS (
  SELECT *, coalesce(CAST(stage <> lag(stage) OVER (PARTITION BY pid, segment_idx ORDER BY s, e, stage) AS INTEGER), 0) AS ch FROM p
), g AS (
  SELECT pid, segment_idx, stage, sum(sec) AS sec, min(s) AS first, sum(ch) AS ch FROM c GROUP BY ALL
), b AS (
  SELECT pid, segment_idx, sum(sec) AS total, sum(ch) AS ch, max(sec) AS best, arg_max(stage, [sec, -first]) AS dom,
  {", ".join(f"sum(sec) FILTER (stage = '{s}') AS s_{s}" for s in NAMES)} FROM g GROUP BY ALL
)
SELECT seg.pid, seg.segment_idx, {", ".join(f"round(coalesce(s_{s}, 0e0) / 86400e0, 6) AS frac_{s.lower()}" for s in NAMES)},
  round(greatest(0e0, 1 - coalesce(total, 0e0) / 86400e0), 6) AS frac_unknown, coalesce(dom, 'Unknown') AS dominant_stage,
  round(coalesce(best / total, 0e0), 6) AS stability, CAST(coalesce(ch, 0) AS BIGINT) AS transitions
FROM seg LEFT JOIN b ON seg.pid = b.pid AND seg.segment_idx = b.segment_idx""",
)
def seg_stage_fractions(spark, sf):
    out = I.stage_fractions(seg(spark, sf), ev(spark, sf).where("dur > 0"), "pid", NAMES, DAY)
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith("frac_") or c == "stability"})


@query(
    "seg_boundaries",
    """
WITH u AS (SELECT DISTINCT user_id AS pid, 900e0 + 37 * (user_id % 9) AS total FROM events), g AS (
  SELECT pid, total, i AS segment_idx, i * 150e0 AS start_sec FROM u, range(40) r(i) WHERE i * 150 < total
), e AS (SELECT *, least(start_sec + 300, total) AS end_sec FROM g)
SELECT pid, segment_idx, start_sec, end_sec, end_sec - start_sec AS duration_sec, end_sec - start_sec >= 297 AS is_complete
FROM e WHERE end_sec - start_sec >= 150 OR segment_idx = 0""",
)
def seg_boundaries(spark, sf):
    users = t(spark, sf, "events").select(F.col("user_id").alias("pid")).distinct()
    users = users.withColumn("total", F.lit(900.0) + 37 * (F.col("pid") % 9))
    return I.segment_grid(users, "pid", "total", 300.0, 150.0).withColumn("segment_idx", F.col("segment_idx").cast("long"))


@query(
    "event_density",
    f"""
WITH {EV}, {SEG}, w AS (SELECT pid, segment_idx, start_sec + 43200 - 7200 AS a, start_sec + 43200 + 7200 AS b FROM seg)
SELECT w.pid, w.segment_idx, count(ev.pid) AS n, round(count(ev.pid) / 240e0, 6) AS density
FROM w LEFT JOIN ev ON w.pid = ev.pid AND w.a < ev.end_sec AND w.b > ev.start_sec GROUP BY 1, 2""",
)
def event_density(spark, sf):
    """Events that overlap a window around each segment's centre, a minute of the window."""
    grid = seg(spark, sf).select("pid", "segment_idx", (F.col("start_sec") + 43200 - 7200).alias("a"), (F.col("start_sec") + 43200 + 7200).alias("b"))
    pairs = I.interval_join(grid, ev(spark, sf).select("pid", "start_sec", "end_sec"), "pid", ("a", "b"), ("start_sec", "end_sec"), DAY)
    n = pairs.groupBy("pid", "segment_idx").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, ["pid", "segment_idx"], "left").select("pid", "segment_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("density", r6(F.col("n") / 240.0))


@query(
    "sleep_period_filter",
    f"""
WITH {EV}, {SEG}, o AS (
  SELECT pid, greatest(0e0, min(start_sec)) AS onset, max(end_sec) AS offset_ FROM ev WHERE stage <> 'W' GROUP BY pid
), k AS (
  SELECT seg.*, greatest(0e0, coalesce(onset, 0)) AS a, least(2592000e0, greatest(coalesce(onset, 0) + 1, coalesce(offset_, 2592000e0))) AS b
  FROM seg LEFT JOIN o ON seg.pid = o.pid
)
SELECT pid, segment_idx AS orig_segment_idx, row_number() OVER (PARTITION BY pid ORDER BY segment_idx) - 1 AS segment_idx
FROM k WHERE start_sec < b AND end_sec > a""",
)
def sleep_period_filter(spark, sf):
    """Segments within sleep onset and offset, renumbered, with the number they had."""
    o = ev(spark, sf).where("stage <> 'W'").groupBy("pid").agg(F.greatest(F.lit(0.0), F.min("start_sec")).alias("onset"), F.max("end_sec").alias("offset"))
    k = seg(spark, sf).join(o, "pid", "left").withColumn("onset", F.coalesce("onset", F.lit(0.0)))
    k = k.withColumn("offset", F.least(F.lit(NIGHT), F.greatest(F.col("onset") + 1, F.coalesce("offset", F.lit(NIGHT)))))
    kept = k.where((F.col("start_sec") < F.col("offset")) & (F.col("end_sec") > F.col("onset")))
    number = F.row_number().over(Window.partitionBy("pid").orderBy("segment_idx")) - 1
    return kept.select("pid", F.col("segment_idx").alias("orig_segment_idx"), number.cast("long").alias("segment_idx"))


@query(
    "asof_stage",
    f"""
WITH {EV}, {SEG}, c AS (SELECT pid, segment_idx, start_sec + 43200 AS t FROM seg), e AS (
  SELECT pid, t, max(stage) AS stage FROM ev GROUP BY pid, t
), f AS (SELECT pid, arg_min(stage, t) AS first_stage FROM e GROUP BY pid)
SELECT c.pid, c.segment_idx, coalesce(e.stage, first_stage) AS stage FROM c ASOF LEFT JOIN e ON c.pid = e.pid AND c.t >= e.t LEFT JOIN f ON f.pid = c.pid""",
)
def asof_stage(spark, sf):
    """The stage at the middle of each segment; before the first epoch, that of the first."""
    centres = seg(spark, sf).select("pid", "segment_idx", (F.col("start_sec") + 43200).alias("at"))
    return I.asof_backward(centres, ev(spark, sf), "pid", "at", "t", "stage", "stage").select("pid", "segment_idx", "stage")


@query(
    "dist_next_prev",
    f"""
WITH {EV}, {SEG}, e AS (SELECT * FROM ev WHERE event_type = 'click'), h AS (
  SELECT DISTINCT seg.pid, segment_idx FROM seg JOIN e ON seg.pid = e.pid AND seg.start_sec < e.end_sec AND seg.end_sec > e.start_sec
), d AS (
  SELECT seg.pid, segment_idx, (SELECT min(e.start_sec) FROM e WHERE e.pid = seg.pid AND e.start_sec >= seg.end_sec) - seg.end_sec AS n,
    seg.start_sec - (SELECT max(e.end_sec) FROM e WHERE e.pid = seg.pid AND e.end_sec <= seg.start_sec) AS p FROM seg
)
SELECT d.pid, d.segment_idx, round(least(coalesce(n, CASE WHEN h.pid IS NULL THEN 3600e0 ELSE 0e0 END), 3600e0), 6) AS next_dist,
  round(least(coalesce(p, CASE WHEN h.pid IS NULL THEN 3600e0 ELSE 0e0 END), 3600e0), 6) AS prev_dist
FROM d LEFT JOIN h ON d.pid = h.pid AND d.segment_idx = h.segment_idx""",
)
def dist_next_prev(spark, sf):
    events, grid = ev(spark, sf).where("event_type = 'click'"), seg(spark, sf)
    held = I.interval_join(grid, events.select("pid", F.col("start_sec").alias("a"), F.col("end_sec").alias("b")), "pid", ("start_sec", "end_sec"), ("a", "b"), DAY)
    out = I.nearest_events(grid, events, "pid", 3600.0, held)
    return out.withColumns({c: F.round(c, 6) for c in ("next_dist", "prev_dist")})


@query(
    "arousal_windows",
    f"""
WITH {EV}, c AS (SELECT pid, event_id, end_sec AS a, end_sec + 9000 AS b FROM ev WHERE event_type = 'click')
SELECT c.pid, c.event_id, count(ev.event_id) AS n, round(max(ev.value), 6) AS top
FROM c LEFT JOIN ev ON c.pid = ev.pid AND ev.event_type = 'view' AND ev.t >= c.a AND ev.t < c.b GROUP BY 1, 2""",
)
def arousal_windows(spark, sf):
    """Values whose time lies in [end, end + 9000) of an event: a range join of points."""
    all_ = ev(spark, sf)
    c = all_.where("event_type = 'click'").select("pid", "event_id", F.col("end_sec").alias("a"), (F.col("end_sec") + 9000).alias("b"))
    v = all_.where("event_type = 'view'").select("pid", F.col("t").alias("s"), F.col("t").alias("e"), "value")
    pairs = I.interval_join(c, v, "pid", ("a", "b"), ("s", "e"), 9000.0, touching=True).where("s < b")
    found = pairs.groupBy("pid", "event_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return c.join(found, ["pid", "event_id"], "left").select("pid", "event_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r6("top").alias("top"))


OVER = "OVER (PARTITION BY pid ORDER BY t, event_id{})"
ROWS = " ROWS BETWEEN {} AND {}"


def sql_over(frame: str = "") -> str:
    return OVER.format(frame)


CHANGED = f"coalesce(CAST(stage <> lag(stage) {sql_over()} AS INTEGER), 0)"
ISLANDS = f"isl AS (SELECT *, sum(ch) {sql_over(ROWS.format('UNBOUNDED PRECEDING', 'CURRENT ROW'))} AS island FROM (SELECT *, {CHANGED} AS ch FROM ev))"


@query("stage_changed", f"WITH {EV} SELECT event_id, {CHANGED} AS changed, coalesce(CAST(stage <> lead(stage) {sql_over()} AS INTEGER), 0) AS will_change FROM ev")
def stage_changed(spark, sf):
    return ev(spark, sf).select("event_id", W.changed("stage", w()).alias("changed"), W.will_change("stage", w()).alias("will_change"))


@query(
    "run_length",
    f"WITH {EV}, {ISLANDS} SELECT event_id, row_number() OVER (PARTITION BY pid, island ORDER BY t, event_id) * 300e0 AS in_stage_sec FROM isl",
)
def run_length(spark, sf):
    return W.run_length(ev(spark, sf), "pid", ORDER, "stage", "in_stage_sec", 300.0).select("event_id", "in_stage_sec")


@query(
    "islands_multiclass",
    f"""WITH {EV}, {ISLANDS} SELECT pid, stage, round(min(t), 6) AS start, round(max(end_sec), 6) AS "end", count(*) AS n
FROM isl GROUP BY pid, island, stage HAVING max(end_sec) - min(t) >= 1""",
)
def islands_multiclass(spark, sf):
    out = W.runs(ev(spark, sf), "pid", ORDER, "stage", "t", "end_sec", 1.0)
    return out.withColumns({"start": r6("start"), "end": r6("end")})


@query(
    "islands_binary",
    f"""WITH {EV}, b AS (SELECT *, value >= 50 AS high FROM ev), c AS (
  SELECT *, coalesce(CAST(high <> lag(high) {sql_over()} AS INTEGER), 0) AS ch FROM b
), i AS (SELECT *, sum(ch) {sql_over(ROWS.format('UNBOUNDED PRECEDING', 'CURRENT ROW'))} AS island FROM c)
SELECT pid, round(min(t), 6) AS start, round(max(end_sec), 6) AS "end", count(*) AS n FROM i WHERE high GROUP BY pid, island HAVING max(end_sec) - min(t) >= 1""",
)
def islands_binary(spark, sf):
    """Intervals in which a channel is at or above its threshold, those under a second left out."""
    rows = ev(spark, sf).withColumn("high", F.col("value") >= 50)
    out = W.runs(rows, "pid", ORDER, "high", "t", "end_sec", 1.0).where("high").drop("high")
    return out.withColumns({"start": r6("start"), "end": r6("end")})


@query(
    "longest_run",
    f"WITH {EV}, {ISLANDS}, r AS (SELECT pid, stage, island, count(*) AS n FROM isl GROUP BY ALL) SELECT pid, stage, max(n) AS longest FROM r GROUP BY ALL",
)
def longest_run(spark, sf):
    return W.runs(ev(spark, sf), "pid", ORDER, "stage", "t", "t").groupBy("pid", "stage").agg(F.max("n").alias("longest"))


@query(
    "time_since_to",
    f"""WITH {EV} SELECT event_id,
  round(t - last_value(CASE WHEN stage = 'W' THEN t END IGNORE NULLS) {sql_over(ROWS.format('UNBOUNDED PRECEDING', 'CURRENT ROW'))}, 6) AS since_wake,
  round(first_value(CASE WHEN stage = 'REM' THEN t END IGNORE NULLS) {sql_over(ROWS.format('CURRENT ROW', 'UNBOUNDED FOLLOWING'))} - t, 6) AS to_rem FROM ev""",
)
def time_since_to(spark, sf):
    return ev(spark, sf).select(
        "event_id",
        F.round(W.time_since(F.col("stage") == "W", "t", w()), 6).alias("since_wake"),
        F.round(W.time_to(F.col("stage") == "REM", "t", w()), 6).alias("to_rem"),
    )


FRAME = ROWS.format("3 PRECEDING", "3 FOLLOWING")


@query(
    "rolling_context",
    f"""WITH {EV} SELECT event_id, round(avg(value) {sql_over(FRAME)}, 6) AS mean7, round(stddev_samp(value) {sql_over(FRAME)}, 6) AS std7,
  round(value - lag(value) {sql_over()}, 6) AS diff, round(value - avg(value) {sql_over(FRAME)}, 6) AS dev FROM ev""",
)
def rolling_context(spark, sf):
    return ev(spark, sf).select(
        "event_id",
        r6(W.rolling_mean("value", w(), 3)).alias("mean7"),
        r6(W.rolling_std("value", w(), 3)).alias("std7"),
        r6(F.col("value") - F.lag("value").over(w())).alias("diff"),
        r6(F.col("value") - W.rolling_mean("value", w(), 3)).alias("dev"),
    )


@query(
    "rolling_trend",
    f"""WITH {EV}, v AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x FROM ev), l AS (
  SELECT event_id, list_filter(list(x) {sql_over(FRAME)}, lambda y: y IS NOT NULL) AS v FROM v
), s AS (SELECT event_id, len(v) AS n, list_sum(v) AS sy, list_sum(list_transform(v, lambda y, i: y * (i - 1))) AS sxy FROM l)
SELECT event_id, CASE WHEN n >= 3 THEN round((n * sxy - n * (n - 1) / 2 * sy) / (n * (n - 1) * n * (2 * n - 1) / 6 - (n * (n - 1) / 2) * (n * (n - 1) / 2)), 6) END AS slope FROM s""",
)
def rolling_trend(spark, sf):
    rows = ev(spark, sf).withColumn("x", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return rows.select("event_id", r6(W.rolling_slope("x", w(), 3)).alias("slope"))


@query(
    "above_average",
    f"""WITH {EV}, d AS (SELECT pid, CAST(floor(t / 86400e0) AS BIGINT) AS day, count(*) AS n FROM ev GROUP BY ALL)
SELECT pid, day, n, round(avg(n) OVER (PARTITION BY pid ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5,
  CAST(n > avg(n) OVER (PARTITION BY pid) AS INTEGER) AS above FROM d""",
)
def above_average(spark, sf):
    d = ev(spark, sf).groupBy("pid", F.floor(F.col("t") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    by_day = W.over("pid", "day")
    return d.select(
        "pid", "day", "n", r6(W.rolling_mean("n", by_day, 2)).alias("mean5"), (F.col("n") > F.avg("n").over(Window.partitionBy("pid"))).cast("int").alias("above")
    )


@query(
    "night_parts",
    f"""WITH {EV} SELECT event_id, CAST(least(greatest(floor(t * 3 / 2592000e0) + 1, 1), 3) AS INTEGER) AS third,
  CAST(least(greatest(floor(t * 4 / 2592000e0) + 1, 1), 4) AS INTEGER) AS quarter,
  round(greatest(0e0, t - min(CASE WHEN stage <> 'W' THEN t END) OVER (PARTITION BY pid)), 6) AS since_onset,
  round(least(1e0, greatest(0e0, t / 2592000e0)), 9) AS norm_time FROM ev""",
)
def night_parts(spark, sf):
    rows = ev(spark, sf).withColumn("total", F.lit(NIGHT))
    onset = F.min(F.when(F.col("stage") != "W", F.col("t"))).over(Window.partitionBy("pid"))
    since = F.when(onset.isNotNull(), F.greatest(F.lit(0.0), F.col("t") - onset)).otherwise(F.lit(0.0))
    return rows.select(
        "event_id",
        W.night_part("t", "total", 3).alias("third"),
        W.night_part("t", "total", 4).alias("quarter"),
        F.round(since, 6).alias("since_onset"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("t") / F.col("total"))), 9).alias("norm_time"),
    )


@query("stage_transitions", f"WITH {EV} SELECT pid, CAST(sum(ch) AS BIGINT) AS transitions FROM (SELECT pid, {CHANGED} AS ch FROM ev) GROUP BY pid")
def stage_transitions(spark, sf):
    return ev(spark, sf).withColumn("ch", W.changed("stage", w())).groupBy("pid").agg(F.sum("ch").alias("transitions"))


@query(
    "duration_from_next",
    f"""WITH {EV}, n AS (SELECT *, lead(t) {sql_over()} AS nt, lead(event_type) {sql_over()} AS ne FROM ev)
SELECT event_id, round(CASE WHEN ne = 'error' THEN nt - t WHEN event_type = 'click' THEN 3e0 WHEN event_type = 'view' THEN 10e0 ELSE 15e0 END, 6) AS duration FROM n""",
)
def duration_from_next(spark, sf):
    """Duration up to the next row if that is an end mark, else the default of the type."""
    default = F.when(F.col("event_type") == "click", 3.0).when(F.col("event_type") == "view", 10.0).otherwise(15.0)
    gap = F.when(F.lead("event_type").over(w()) == "error", F.lead("t").over(w()) - F.col("t"))
    return ev(spark, sf).select("event_id", F.round(F.coalesce(gap, default), 6).alias("duration"))


@query("successive_diffs", f"WITH {EV}, d AS (SELECT pid, value - lag(value) {sql_over()} AS d FROM ev) SELECT pid, round(sqrt(avg(d * d)), 6) AS rmssd, round(stddev_samp(d), 6) AS sdsd, round(100e0 * count(*) FILTER (abs(d) > 50) / count(d), 6) AS pnn50 FROM d GROUP BY pid")
def successive_diffs(spark, sf):
    d = ev(spark, sf).select("pid", (F.col("value") - F.lag("value").over(w())).alias("d"))
    return d.groupBy("pid").agg(
        r6(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmssd"), r6(F.stddev_samp("d")).alias("sdsd"), r6(100.0 * F.count_if(F.abs("d") > 50) / F.count("d")).alias("pnn50")
    )


@query(
    "peaks_to_cycles",
    f"""WITH {EV}, p AS (SELECT pid, t AS a, lead(t) {sql_over()} AS b, event_id FROM ev WHERE event_type = 'signup')
SELECT p.pid, p.event_id, count(*) AS beats, round(max(v.value) - min(v.value), 6) AS peak_valley
FROM p JOIN ev v ON p.pid = v.pid AND v.event_type <> 'signup' AND v.t >= p.a AND v.t < p.b GROUP BY ALL""",
)
def peaks_to_cycles(spark, sf):
    """Beats of each breathing cycle, from one peak to the next."""
    p = ev(spark, sf).where("event_type = 'signup'")
    p = p.select("pid", "event_id", F.col("t").alias("a"), F.lead("t").over(w()).alias("b")).where("b is not null")
    v = ev(spark, sf).where("event_type <> 'signup'").select("pid", F.col("t").alias("s"), F.col("t").alias("e"), "value")
    pairs = I.interval_join(p, v, "pid", ("a", "b"), ("s", "e"), DAY, touching=True).where("s < b")
    return pairs.groupBy("pid", "event_id").agg(F.count(F.lit(1)).alias("beats"), r6(F.max("value") - F.min("value")).alias("peak_valley"))
