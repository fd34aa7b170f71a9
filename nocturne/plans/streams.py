"""Streaming forms, replayed over the bounded event table.  Complete mode shows all windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.plans.base import t
from nocturne.plans.registry import query
from nocturne.streaming import windows as S


def source(spark, sf):
    """The event table as a stream with event time as a timestamp."""
    schema = t(spark, sf, "events").schema
    path = f"{sf}/events.parquet"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else sf_glob(path))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def sf_glob(path):
    """A streaming file source takes folders and globs; a glob that matches the one file."""
    return path[:-8] + "*.parquet"


DAYS = "epoch_us(time_bucket(INTERVAL 1 DAY, ts))"


@query("stream_tumbling", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    out = S.run_available(S.tumbling(source(spark, sf), "ts", "1 day", ["event_type"], "1 hour"), mode="complete")
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "WITH w AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) - 43200 * k + CASE WHEN hour(ts) >= 12 THEN 43200 ELSE 0 END AS start, value FROM events, range(2) r(k)) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1")
def stream_sliding(spark, sf):
    out = S.run_available(S.sliding(source(spark, sf), "ts", "1 day", "12 hours", [], "1 hour"), mode="complete")
    return out.select(F.unix_seconds("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def stream_session(spark, sf):
    out = S.run_available(S.sessions(source(spark, sf), "ts", "6 hours", ["user_id"], "1 hour"), mode="complete")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    """Keep-first by (user, type); the watermark is longer than the replay, so all repeats fall within it."""
    return S.run_available(S.dedupe(source(spark, sf), "ts", ["user_id", "event_type"], "365 days")).select("user_id", "event_type")


@query("stream_run_length", "WITH c AS (SELECT *, coalesce(CAST(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER), 0) AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM c) SELECT user_id, epoch_us(ts) AS \"at\", CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY ts) AS INTEGER) AS run FROM i")
def stream_run_length(spark, sf):
    return S.run_available(S.run_lengths(source(spark, sf), "user_id", "ts", "event_type")).where("not late").select("user_id", F.unix_micros("ts").alias("at"), "run")
