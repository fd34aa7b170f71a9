"""Stateful run lengths over several triggers."""

import datetime as dt
import os
import time

from nocturne.streaming import windows as S


def test_run_lengths_go_on_and_late_rows_are_marked(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("a", at(3), "x"), ("a", at(1), "x"), ("b", at(2), "y")], [("a", at(2), "x"), ("a", at(4), "x"), ("a", at(5), "z"), ("b", at(9), "y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, t timestamp, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            os.utime(f, (time.time() + i, time.time() + i)) if i == 0 else None
        time.sleep(1.1)
    source = spark.readStream.schema("k string, t timestamp, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.run_available(S.run_lengths(source, "k", "t", "v"))
    got = sorted((r.k, r.t.minute, r.run, r.late) for r in out.collect())
    assert got == [("a", 1, 1, False), ("a", 2, None, True), ("a", 3, 2, False), ("a", 4, 3, False), ("a", 5, 1, False), ("b", 2, 1, False), ("b", 9, 2, False)]
