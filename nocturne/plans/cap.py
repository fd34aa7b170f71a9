"""Queries on the cyclic alternating pattern.  A recording is a customer group, its seconds are its orders in order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nocturne.operators import cap
from nocturne.plans.base import t
from nocturne.plans.registry import query

r6 = lambda c: F.round(c, 6)

SEC = """sec AS (SELECT o_custkey % 40 AS pid, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS pos,
  CAST(CASE WHEN o_orderkey % 11 < 5 THEN 0 ELSE 1 + CAST(floor(o_totalprice) AS BIGINT) % 3 END AS INTEGER) AS code FROM orders)"""


def sec(spark, sf):
    o, pid = t(spark, sf, "orders"), (F.col("o_custkey") % 40)
    code = F.when(F.col("o_orderkey") % 11 < 5, 0).otherwise(1 + F.floor("o_totalprice").cast("long") % 3).cast("int")
    rows = o.select(pid.alias("pid"), "o_orderkey", code.alias("code"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("pid").orderBy("o_orderkey")).cast("long") - 1).drop("o_orderkey")


SMOOTH = f"""{SEC}, x AS (SELECT *, code > 0 AS up FROM sec), y AS (SELECT *, coalesce(CAST(up <> lag(up) OVER (PARTITION BY pid ORDER BY pos) AS INTEGER), 0) AS new FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY pid ORDER BY pos) AS run FROM y), m AS (SELECT pid, run, code, count(*) AS k FROM z GROUP BY ALL),
b AS (SELECT pid, run, code AS best, sum(k) OVER (PARTITION BY pid, run) AS n, row_number() OVER (PARTITION BY pid, run ORDER BY k DESC, code) AS rn FROM m),
sm AS (SELECT z.pid, z.pos, CAST(CASE WHEN z.code = 0 OR b.n = 1 THEN 0 ELSE best END AS INTEGER) AS code FROM z JOIN b ON z.pid = b.pid AND z.run = b.run AND b.rn = 1)"""


@query("cap_smoothing", f"WITH {SMOOTH} SELECT pid, pos, code FROM sm")
def cap_smoothing(spark, sf):
    """Labels of A-phases: single seconds are dropped, a run gets its most frequent code."""
    return cap.smooth_phases(sec(spark, sf), "pid", "pos", "code").select("pid", "pos", "code")


def _runs(source: str, name: str, code: str) -> str:
    return f"""{name}0 AS (SELECT pid, pos, {code} AS code, coalesce(CAST({code} <> lag({code}) OVER (PARTITION BY pid ORDER BY pos) AS INTEGER), 0) AS new FROM {source}),
{name}1 AS (SELECT *, sum(new) OVER (PARTITION BY pid ORDER BY pos) AS run FROM {name}0), {name} AS (SELECT pid, code, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM {name}1 WHERE code > 0 GROUP BY pid, run, code)"""


def _kind(k: int) -> str:
    n, d = f"count(*) FILTER (code = {k})", f"coalesce(sum(n) FILTER (code = {k}), 0)"
    return f"{n} AS n{k}, {d} AS d{k}"


def _kind_out(k: int) -> str:
    n, d = f"coalesce(n{k}, 0)", f"coalesce(d{k}, 0)"
    return (
        f"{n} AS cap_NRA{k}, CAST({d} AS BIGINT) AS cap_A{k}DUR, round(coalesce({d} / nullif({n}, 0), 0), 6) AS cap_AVGA{k}DUR, round(coalesce({n} / nullif(na, 0), 0), 6) AS cap_RA{k}APH, "
        f"round({d} / sl, 6) AS cap_RA{k}NRE, round({n} / sl * 3600e0, 6) AS cap_A{k}IND"
    )


@query(
    "cap_statistics",
    f"""WITH {SMOOTH}, {_runs("sm", "a", "CAST(code > 0 AS INTEGER)")}, {_runs("sm", "k", "code")},
sl AS (SELECT pid, count(*) + 13 AS sl FROM sm GROUP BY pid), na AS (SELECT pid, count(*) AS na, sum(n) AS da FROM a GROUP BY pid), nk AS (SELECT pid, {", ".join(_kind(k) for k in (1, 2, 3))} FROM k GROUP BY pid),
s0 AS (SELECT *, CAST(lag(stop) OVER (PARTITION BY pid ORDER BY start) IS NULL OR start - lag(stop) OVER (PARTITION BY pid ORDER BY start) - 1 > 3 AS INTEGER) AS new FROM a),
s1 AS (SELECT *, sum(new) OVER (PARTITION BY pid ORDER BY start) AS seq FROM s0), s2 AS (SELECT *, count(*) OVER (PARTITION BY pid, seq) AS size, lead(start) OVER (PARTITION BY pid, seq ORDER BY start) AS nx FROM s1),
s3 AS (SELECT *, coalesce(nx, stop) - start AS cyc, nx - stop AS b FROM s2 WHERE size >= 3), d AS (SELECT pid, seq, max(stop) - min(start) AS dur FROM s3 GROUP BY pid, seq),
c AS (SELECT pid, avg(cyc) AS cyc, avg(b) AS b FROM s3 GROUP BY pid), e AS (SELECT pid, count(*) AS nc, sum(dur) AS dc FROM d GROUP BY pid)
SELECT sl.pid, sl AS cap_SLDUR, coalesce(na, 0) AS cap_NRAPH, CAST(coalesce(da, 0) AS BIGINT) AS cap_APHDUR, round(coalesce(da / na, 0), 6) AS cap_AVGAPHDUR, round(coalesce(na, 0) / sl * 3600e0, 6) AS cap_NRAPHPH, round(coalesce(da, 0) / sl, 6) AS cap_RAPHSL,
{", ".join(_kind_out(k) for k in (1, 2, 3))}, coalesce(nc, 0) AS cap_NRCAP, CAST(coalesce(dc, 0) AS BIGINT) AS cap_CAPDUR, round(100 * coalesce(dc, 0) / sl, 6) AS cap_RCAPSL, round(coalesce(dc / nc, 0), 6) AS cap_AVGCAPDUR,
round(coalesce(cyc, 0), 6) AS cap_AVGCYCLEDUR, round(coalesce(b, 0), 6) AS cap_AVGBPHADUR FROM sl LEFT JOIN na USING (pid) LEFT JOIN nk USING (pid) LEFT JOIN c USING (pid) LEFT JOIN e USING (pid)""",
)
def cap_statistics(spark, sf):
    """The 30 statistics after smoothing; sequences bear gaps of 3."""
    out = cap.cap_statistics(cap.smooth_phases(sec(spark, sf), "pid", "pos", "code"), "pid", "pos", "code", gap=3)
    return out.select(*[r6(c).alias(c) if out.schema[c].dataType.typeName() == "double" else F.col(c) for c in out.columns])


def _hit(value: int, of: str) -> str:
    other = 1 - value
    lag = lambda k: f"lag({of}, {k}) OVER w"
    lead = lambda k: f"lead({of}, {k}) OVER w"
    single = f"{of} = {value} AND {lag(1)} = {other} AND {lead(1)} = {other}"
    pair = f"{of} = {value} AND (({lag(1)} = {other} AND {lead(1)} = {value} AND {lead(2)} = {other}) OR ({lag(1)} = {value} AND {lag(2)} = {other} AND {lead(1)} = {other}))"
    return single, pair


def _passes() -> str:
    out, source = [], "f0"
    for i, (value, which) in enumerate(((1, 0), (1, 1), (0, 0), (0, 1)), 1):
        out.append(f"f{i} AS (SELECT pid, pos, CASE WHEN {_hit(value, 'flag')[which]} THEN {1 - value} ELSE flag END AS flag FROM {source} WINDOW w AS (PARTITION BY pid ORDER BY pos))")
        source = f"f{i}"
    return ", ".join(out)


FLAGS = f"{SEC}, f0 AS (SELECT pid, pos, CAST(code IN (0, 3) AS INTEGER) AS flag FROM sec), {_passes()}"


@query("wake_rem_smoothing", f"WITH {FLAGS} SELECT pid, pos, flag FROM f4")
def wake_rem_smoothing(spark, sf):
    """Islands and gaps of one or two epochs removed, in four passes."""
    rows = sec(spark, sf).select("pid", "pos", F.col("code").isin(0, 3).cast("int").alias("flag"))
    return cap.smooth_flags(rows, "pid", "pos", "flag")


@query("wake_rem_distance", f"WITH {FLAGS} SELECT pid, pos, CAST(CASE WHEN flag = 1 THEN 0 ELSE coalesce((SELECT min(g.pos) FROM f4 g WHERE g.pid = f4.pid AND g.pos >= f4.pos AND g.flag = 1) - pos + 1, count(*) OVER (PARTITION BY pid)) END AS BIGINT) AS distance FROM f4")
def wake_rem_distance(spark, sf):
    """Seconds to the next wake or REM second, the length of the recording if none is ahead."""
    rows = sec(spark, sf).select("pid", "pos", F.col("code").isin(0, 3).cast("int").alias("flag"))
    rows = cap.smooth_flags(rows, "pid", "pos", "flag")
    return cap.distance_ahead(rows, "pid", "pos", F.col("flag") == 1).select("pid", "pos", "distance")
