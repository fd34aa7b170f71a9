"""Annotation channels and their fallback, broken files, manifests and lists."""

import numpy as np

from nocturne.sources import edf, tables


def test_annotation_channels(spark, tmp_path):
    folder = tmp_path / "S0002"
    folder.mkdir()
    stage = np.repeat([5.0, 3.0, 9.0, 4.0], 30)
    stage[33:40] = 1.0  # a minority of the second epoch
    stage[60:75], stage[75:90] = 2.0, 1.0  # a tie: the least value
    resp = np.zeros(125)
    resp[10:25], resp[25:30], resp[60:61], resp[80:82] = 2, 7, 1, 12
    arousal = np.zeros(125)
    arousal[5:9], arousal[100:125] = 1.0, 0.8
    stage = np.concatenate((stage, np.full(5, 5.0)))
    channels = {"Stage_CAISR": (1.0, stage), "resp-event": (1.0, resp), "arousal": (1.0, arousal), "prob_arousal": (1.0, arousal), "C3": (1.0, arousal * 30)}
    (folder / "b.edf").write_bytes(edf.to_edf(channels))
    (folder / "a.EDF").write_bytes(edf.to_edf({"stage": (1.0, stage)}, [(3.0, 1.5, "arousal"), (4.0, 1.0, "Lights off")]))
    got = edf.annotations_with_fallback(spark, str(tmp_path)).collect()
    assert [(r.record, r.onset, r.description) for r in got if r.how == "list"] == [("S0002/a", 3.0, "arousal")]
    rows = sorted((r.onset, r.duration, r.description) for r in got if r.how == "channel")
    assert rows == sorted([
        (0.0, 30.0, "W"), (30.0, 30.0, "N1"), (60.0, 30.0, "N3"), (90.0, 30.0, "REM"), (10.0, 15.0, "central_apnea"), (25.0, 5.0, "rera"), (60.0, 1.0, "obstructive_apnea"),
        (5.0, 4.0, "arousal"), (100.0, 25.0, "arousal"),
    ])
    assert [r.record for r in edf.discover(spark, str(tmp_path)).collect()] == ["S0002/a", "S0002/b"]
    look = {(r.record, r.name): r.n_samples for r in edf.lookup(edf.read_edf(spark, str(tmp_path)), [" Stage ", "c3"]).collect()}
    assert look == {("S0002/a", " Stage "): 125, ("S0002/a", "c3"): None, ("S0002/b", " Stage "): None, ("S0002/b", "c3"): 125}


def test_broken_files_are_reported_and_replaced(spark, tmp_path):
    for name, rows in (("p1", [("p1", 1.0)]), ("p2", [("p2", 2.0)])):
        spark.createDataFrame(rows, "patient_id string, a double").coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "p3.parquet").write_bytes(b"PAR1 broken")
    (tmp_path / "p3.csv").write_text("patient_id,a,b\np3,3.5,7\n")
    (tmp_path / "p4.parquet").write_bytes(b"junk")
    rows, report = tables.rescue_features(spark, str(tmp_path), ["patient_id", "a", "zz"])
    assert sorted((r.patient_id, r.a, r.zz) for r in rows.collect()) == [("p1", 1.0, None), ("p2", 2.0, None), ("p3", 3.5, None)]
    used = [(r.valid, r.used) for r in report.collect()]
    assert sorted(used) == [(False, "csv"), (False, "none"), (True, "parquet"), (True, "parquet")]
    info = [r for r in tables.inspect(spark, str(tmp_path)).collect() if r.valid]
    assert sorted((r.n_rows, r.ids, r.kind) for r in info) == [(1, ["p1"], "patient"), (1, ["p2"], "patient")]


def test_fallback_by_key(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cached, computed = spark.createDataFrame([("a", 1), ("x", 9)], "k string, v int"), spark.createDataFrame([("a", 5), ("b", 2)], "k string, v int")
    assert sorted((r.k, r.v, r.how) for r in tables.with_fallback(wanted, cached, computed, "k").collect()) == [("a", 1, "cached"), ("b", 2, "computed")]


def test_manifest_and_lists(spark, tmp_path):
    path = str(tmp_path / "m")
    first = spark.createDataFrame([("k1", "x", 1), ("k2", "y", 5)], "key string, path string, cached_at long")
    tables.write_manifest(first, path)
    out = tables.write_manifest(spark.createDataFrame([("k1", "z", 3), ("k2", "old", 2), ("k3", "n", 1)], first.schema), path)
    assert sorted(map(tuple, out.collect())) == [("k1", "z", 3), ("k2", "y", 5), ("k3", "n", 1)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["m"]
    df = spark.createDataFrame([(1, [1, 2], None)], "a int, b array<int>, c double")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "[1,2]"
    tables.write_feature_list(df, str(tmp_path / "list"))
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()][0] == "c\t1"
