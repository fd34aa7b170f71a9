"""Streaming forms of the windowed operators.

Each takes a streaming (or batch) DataFrame with an event-time column and gives another,
so callers choose source, sink and trigger.  run_available() drains a source once and
gives the result as a table, which is how a bounded replay is tested.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, at: str, size: str, step: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, size, step), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def dedupe(df: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_lengths(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Stateful run lengths: state is the last value, the length of its run and its time, for each key.

    Rows of a trigger are put in order of time.  A row that comes in a later trigger than one
    with a later time is marked late, has no run and changes none.
    """

    def step(k, batches, state):
        import pandas as pd

        last, n, seen = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        times = rows[at].astype("datetime64[us]").astype("int64").tolist()
        out, late = [], []
        for v, t in zip(rows[value], times):
            late.append(seen is not None and t < seen)
            if late[-1]:
                out.append(None)
                continue
            n = n + 1 if v == last else 1
            last, seen = v, t
            out.append(n)
        state.update((last, n, seen))
        yield pd.DataFrame({key: rows[key].to_numpy(), at: rows[at].to_numpy(), value: rows[value].to_numpy(), "run": pd.array(out, "Int32"), "late": late})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = f"{key} {kinds[key]}, {at} {kinds[at]}, {value} {kinds[value]}, run int, late boolean"
    return df.select(key, at, value).groupBy(key).applyInPandasWithState(step, out, f"last {kinds[value]}, n int, seen long", "append", "NoTimeout")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="nocturne-stream-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def run_available(df: DataFrame, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Drain the source (availableNow) into Parquet in the shared folder and give it as a table.

    Append mode uses the file sink; in complete mode each batch replaces the table.  The
    checkpoint lies beside the table unless a folder is given.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    schema, out = df.schema, f"{base}/table"
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{base}/checkpoint")
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        spark.createDataFrame([], schema).write.parquet(out)
        q = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)
