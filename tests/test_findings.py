"""Findings of the second round: rows on the edge of a rule, and work that must not grow with the square of a group."""

import re

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from nocturne.plans import registry

duckdb = pytest.importorskip("duckdb")
registry.load()


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL, as text, so that -0.0 is not 0.0."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]
    return sorted(map(repr, got)), sorted(map(repr, con.sql(registry.ORACLES[name]).fetchall()))


def test_longest_phase_and_tied_guard(spark, tmp_path):
    begin = pd.Timestamp("2024-01-01")
    phases = [(i, 1, 7.300001 + 70_000.1 * i, "view", 60) for i in range(40)]  # 36,000 s, at any fraction of a second
    tied = [(100 + i, 2, 1000.0 * i, "view", 1) for i in range(6)] + [(200, 2, 3000.0, "error", 1)]
    t = [(e, begin + pd.Timedelta(microseconds=round(s * 1e6)), u, k, 1.0, f'{{"k": {n}}}') for e, u, s, k, n in phases + tied]
    events = pa.Table.from_pandas(pd.DataFrame(t, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}))
    got, want = both(spark, tmp_path, "cap_sequences", events=events)
    assert got == want and len(want) == 3 and any(r.startswith("(1, ") and r.endswith(" 40)") for r in want)


def test_difference_near_zero(spark, tmp_path):
    rows = [[0.0, 1.0, 0.5, None], [1e-8, 1.0, 0.25, 2.0], None, [1.0], [3.0], [1.0, 2.0]]
    embeddings = pa.table({"vec_id": pa.array(range(6), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * 6, pa.int32())})
    got, want = both(spark, tmp_path, "rereference", embeddings=embeddings)
    assert got == want and "-0.0" in want[0]


def test_distance_ahead_grows_its_frame(spark):
    from pyspark.sql import functions as F

    from nocturne.operators import cap

    rows = spark.createDataFrame([(k, i, int(i % 7 == 3 and i < 20)) for k in (1, 2) for i in range(30)], "k int, i long, f int")
    out = cap.distance_ahead(rows, "k", "i", F.col("f") == 1)
    plan = out._jdf.queryExecution().analyzed().toString().lower()
    assert not re.search(r"(currentrow\$\(\)|\b0), unboundedfollowing", plan)
    flags = [i for i in range(20) if i % 7 == 3]
    want = {i: 0 if i in flags else min((j - i + 1 for j in flags if j > i), default=30) for i in range(30)}
    assert {(r.k, r.i): r.distance for r in out.collect()} == {(k, i): d for k in (1, 2) for i, d in want.items()}


def test_same_names_are_matched_once(spark, monkeypatch):
    from nocturne.operators import matching as M

    seen, real = [], M.score_files
    monkeypatch.setattr(M, "score_files", lambda s, f, key: seen.append((s.count(), f.count())) or real(s, f, key))
    subjects = [(i, None if i % 2 else "S1", "Sub-7", "1") for i in range(300)]
    files = [(i, "S1/Sub-7_ses-1.edf", [], 5, 9.0 if i in (20, 30) else 1.0) for i in range(200)] + [(500, "Sub-7_ses-1.edf", ["S1/Sub-7_ses-1"], 1, 0.0)]
    s, f = spark.createDataFrame(subjects, "key int, site string, bids string, session string"), spark.createDataFrame(files, "fid int, path string, ids array<string>, size int, mtime double")
    got = {r.key: (r.fid, r.score) for r in M.best_files(s, f, "key").collect()}
    assert seen == [(2, 2)]
    pairs = real(s, f, "key").collect()  # all of them
    best = {}
    for r in pairs:
        best[r.key] = max(best.get(r.key, (0,)), (r.score, r.mtime, r.size, -r.fid))
    assert got == {k: (-b[3], b[0]) for k, b in best.items()} and len(got) == 300
