"""Stand-ins on the star-schema tables: the recordings, epochs, events and cohorts that the operators work on.

A recording is a user; its time axis is the seconds since 2024-01-01; an event type is a
sleep stage; an event lasts props.k times 600 s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = {"click": "W", "view": "N1", "purchase": "N2", "signup": "N3", "error": "REM"}
DAY, NIGHT = 86_400.0, 2_592_000.0


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(c: str, origin: str = "2024-01-01") -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{origin} 00:00:00', {c}) / 1000000.0D")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, pid, t, stage, event_type, value, dur, start_sec, end_sec."""
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("double")
    rows = t(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("pid"), seconds("ts").alias("t"), stage[F.col("event_type")].alias("stage"), "event_type", "value", (k * 600.0).alias("dur")
    )
    return rows.withColumn("start_sec", F.col("t")).withColumn("end_sec", F.col("t") + F.col("dur"))


EV = """ev AS (
  SELECT event_id, user_id AS pid, (epoch_us(ts) - 1704067200000000) / 1e6 AS t,
    CASE event_type WHEN 'click' THEN 'W' WHEN 'view' THEN 'N1' WHEN 'purchase' THEN 'N2' WHEN 'signup' THEN 'N3' WHEN 'error' THEN 'REM' END AS stage,
    event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 600e0 AS dur,
    (epoch_us(ts) - 1704067200000000) / 1e6 AS start_sec,
    (epoch_us(ts) - 1704067200000000) / 1e6 + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 600e0 AS end_sec
  FROM events
)"""

#: 30 segments of a day for each user.
SEG = """seg AS (
  SELECT pid, segment_idx, segment_idx * 86400e0 AS start_sec, segment_idx * 86400e0 + 86400e0 AS end_sec, 86400e0 AS duration_sec
  FROM (SELECT DISTINCT user_id AS pid FROM events), range(30) r(segment_idx)
)"""


def seg(spark: SparkSession, sf: str) -> DataFrame:
    from nocturne.operators.intervals import segment_grid

    users = t(spark, sf, "events").select(F.col("user_id").alias("pid")).distinct().withColumn("total", F.lit(NIGHT))
    return segment_grid(users, "pid", "total", DAY).withColumn("segment_idx", F.col("segment_idx").cast("long"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, y, y2, score in (0, 1), age, grp: labelled rows with a score."""
    docs = t(spark, sf, "documents").select("doc_id", "n_chars", "source")
    rows = t(spark, sf, "labels").join(docs, "doc_id")
    return rows.select(
        "doc_id",
        F.col("quality").cast("int").alias("y"),
        F.col("toxic").cast("int").alias("y2"),
        (F.col("n_chars") % 97 / F.lit(97.0)).alias("score"),
        (F.col("doc_id") % 40 + 50).cast("int").alias("age"),
        F.col("source").alias("grp"),
    )


SC = """sc AS (
  SELECT doc_id, CAST(quality AS INTEGER) AS y, CAST(toxic AS INTEGER) AS y2, (n_chars % 97) / 97e0 AS score,
    CAST(doc_id % 40 + 50 AS INTEGER) AS age, source AS grp
  FROM labels JOIN documents USING (doc_id)
)"""
