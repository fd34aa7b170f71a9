"""Training against plain loops and made-up cohorts, segment features and matching."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.functions import spectral as S
from nocturne.operators import features as X
from nocturne.operators import learning as L
from nocturne.operators import matching as M
from nocturne.operators import training as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cohort(spark):
    """a tells the classes apart, b somewhat, c nothing; 1 in 5 is positive; some values are missing."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        y = float(i % 5 == 0)
        rows.append((i, y, rng.gauss(3 * y, 1), None if i % 17 == 0 else rng.gauss(y, 1), rng.gauss(0, 1), 50 + i % 30))
    return spark.createDataFrame(rows, "id long, label double, a double, b double, c double, age int").cache()


def test_holdout_and_prevalence(cohort):
    held = T.holdout(cohort, "id", "label")
    n = {(r.label, r.held): r["count"] for r in held.groupBy("label", "held").count().collect()}
    assert 50 <= n[0.0, True] <= 80 and 10 <= n[1.0, True] <= 25 and sum(n.values()) == 400
    out = T.prevalence_split(cohort, "id", "label", F.col("id") < 200, 0.05)
    n = {(r.label, r.held): r["count"] for r in out.groupBy("label", "held").count().collect()}
    assert n == {(0.0, True): 160, (1.0, True): 8, (0.0, False): 160, (1.0, False): 72}
    again = T.prevalence_split(cohort.repartition(7), "id", "label", F.col("id") < 200, 0.05)
    assert {r.id for r in out.where("held").collect()} == {r.id for r in again.where("held").collect()}


def test_folds_are_fitted_without_themselves(cohort):
    seen = []
    folds = T.cross_validate(cohort, "id", "label", lambda: L.pipeline("lr", FEATURES, "label"), {"auroc": T.auroc, "age": T.auroc_within_ages("age")}, k=3, resample=lambda d: (seen.append(d.count()), d)[1])
    assert len(folds) == 3 and all(f["auroc"] > 0.9 and 0 <= f["age"] <= 1 for f in folds) and sum(seen) == 800
    assert T.mean_metric([{"m": 1.0}, {"m": None}, {"m": 2.0}], "m") == 1.5 and T.mean_metric([], "m") == -math.inf


def test_search_and_choice(cohort):
    assert len(T.random_grid({"x": [1, 2, 3], "y": [1, 2]}, 4)) == 4 and len(T.random_grid({"x": [1, 2]}, 9)) == 2
    assert T.random_grid({"x": list(range(50))}, 5) == T.random_grid({"x": list(range(50))}, 5)
    found = T.search(cohort, "id", "label", FEATURES, "rf", {"maxDepth": [1, 3], "numTrees": [3]}, T.auroc, k=2)
    assert [r["metric"] for r in found] == sorted((r["metric"] for r in found), reverse=True) and len(found) == 2
    table, model = T.choose(cohort, "id", "label", FEATURES, ["lr", "rf"], {"auroc": T.auroc}, {"rf": {"numTrees": 3}})
    assert {r["model"] for r in table} == {"lr", "rf"} and table[0]["auroc"] >= table[1]["auroc"] > 0.8
    assert T.auroc(L.predict(model, cohort)) > 0.9


def test_stack_and_prediction(cohort):
    stack = T.Stack.fit(cohort, "id", "label", FEATURES, ["lr", "rf"], k=3)
    out = stack.predict(cohort)
    assert out.columns == [*cohort.columns, "p"] and T.auroc(out) > 0.9
    model = L.pipeline("lr", FEATURES, "label").fit(cohort)
    rows = T.predict_cohort(model, cohort.drop("c"), FEATURES, 0.2, 0.02).collect()
    assert all(r.p_shifted < r.p and r.positive == (r.p_shifted >= 0.5) for r in rows) and "c" not in rows[0].asDict()


def test_importance(cohort):
    model = L.pipeline("lr", FEATURES, "label").fit(cohort)
    drops = T.permutation_importance(model, cohort, "id", "label", FEATURES)
    assert drops[0]["feature"] == "a" and drops[0]["drop"] > 0.1 and abs({d["feature"]: d["drop"] for d in drops}["c"]) < 0.05
    total = T.linear_shap(cohort, "id", {"a": 2.0, "b": -1.0}).groupBy("feature").agg(F.sum("shap").alias("s")).collect()
    assert all(abs(r.s) < 1e-6 for r in total)


def test_resampling(cohort):
    n = lambda d: {r.label: r["count"] for r in d.groupBy("label").count().collect()}
    made = T.adasyn(cohort, "label", "id", FEATURES)
    assert n(made)[0.0] == 320 and 200 < n(made)[1.0] <= 400
    hard = {r.id: r.others for r in T.hardness(cohort, "id", "label", FEATURES, 1.0).collect()}
    extra = made.where("label = 1").groupBy("id").count().collect()
    assert all(hard[r.id] > 0 for r in extra if r["count"] > 1)
    links = T.tomek_links(cohort, "id", "label", FEATURES).collect()
    assert links and T.without_tomek(cohort, "id", "label", FEATURES).count() == 400 - 2 * len(links)
    assert n(T.smote_tomek(cohort, "label", "id", FEATURES))[1.0] > 200


def test_exact_medians_by_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.random(), float(rng.randint(0, 5))]), rng.gauss(0, 1), 7.0, None) for _ in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = [float(np.median([r[i] for r in rows if r[i] is not None])) if i < 3 else None for i in range(4)]
    for most in (1_000_000, 200, 20):
        got = L.exact_medians(df, list("abcd"), most)
        assert [got[c] for c in "abcd"] == pytest.approx(want)


def test_scores_of_files_by_loops(spark):
    rng = random.Random(4)
    subjects = [(i, f"S{rng.randint(1, 3)}", f"sub-{rng.randint(1, 30)}", str(rng.randint(1, 2))) for i in range(25)]
    names = [f"{s}/{b}_ses-{n}" for _, s, b, n in subjects]
    files = []
    for i in range(120):
        s, b, n = rng.choice(subjects)[1:]
        path = rng.choice([f"/data/{s}/{b}_ses-{n}/x.parquet", f"/data/{b}.PARQUET", f"/d a:t/{s}__{b}_ses-{n}.parquet", f"/other/{n}.parquet", f"/{s}/ses-{n}/y.parquet"])
        ids = rng.choice([[], [rng.choice(names)], [f"{b}_ses-{n}"], [f"x {b}_ses-{n} y", "z"], [f"{b} {n}"]])
        files.append((i, path, ids, float(rng.randint(0, 5)), rng.randint(1, 9)))
    safe = lambda t: t.replace("\\", "/").replace("/", "__").replace(":", "_").replace(" ", "_")
    want = {}
    for k, site, bids, ses in subjects:
        record = f"{bids}_ses-{ses}"
        pid = f"{site}/{record}"
        for f, path, ids, *_ in files:
            text = safe(path).lower()
            tokens = [(pid, 100), (safe(pid), 100), (record, 80), (safe(record), 80), (bids, 40), (site, 10), (f"ses-{ses}", 30), (ses, 5)]
            score = sum(p for t, p in tokens if safe(t).lower() in text or t.lower() in text)
            score += sum(200 if x == pid else 150 if x == record else 120 if record in x else 80 if bids in x and ses in x else 0 for x in ids)
            if score >= 70:
                want[k, f] = score
    a = spark.createDataFrame(subjects, "k int, site string, bids string, session string")
    b = spark.createDataFrame(files, "fid int, path string, ids array<string>, mtime double, size int")
    assert {(r.k, r.fid): r.score for r in M.score_files(a, b, "k").collect()} == want and len(want) > 100


def test_rereference(spark):
    rows = [("p", "F3", 2.0, [1.0, 2.0, 3.0]), ("p", " m2", 2.0, [0.5, 0.5]), ("p", "C4", 2.0, [1.0]), ("q", "F3-M2", 2.0, [9.0])]
    got = M.rereference(spark.createDataFrame(rows, "patient_id string, channel string, fs double, samples array<double>"))
    assert sorted((r.patient_id, r.channel, r.samples) for r in got.collect()) == [("p", "F3-M2", [0.5, 1.5]), ("q", "F3-M2", [9.0])]
    one = spark.range(1).select(M.against_mean(F.array(F.lit(4.0)), F.array(F.lit(1.0)), F.array(F.lit(3.0))).alias("x")).first().x
    assert one == [2.0]


def test_multitaper_and_entropy(spark):
    fs, t = 100.0, np.arange(3000) / 100.0
    rows, weight = S.tapers(500, 5.0)
    assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-8) and (weight > 0.9).all() and len(rows) >= 7
    f, p = S.multitaper(np.sin(2 * np.pi * 2 * t[:500]), fs, 2.0)
    assert p[(f >= 0.5) & (f <= 4)].sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.05)
    noise = np.random.default_rng(0).normal(size=200_000)
    f, p = S.welch(noise, fs, 400)
    parts = [S.multitaper(noise[k : k + 500], fs, 2.0)[1].mean() for k in range(0, 20_000, 500)]
    assert np.mean(parts) == pytest.approx(p.mean(), rel=0.05)
    x = 20 * np.sin(2 * np.pi * 1.5 * t)
    df = spark.createDataFrame([("p", c, fs, [float(v) for v in x]) for c in ("C3", "C4")], "patient_id string, channel string, fs double, samples array<double>")
    w = X.delta_windows(df)
    assert w.count() == 12 and w.where("clean and power > 0").count() == 12
    out = X.delta_entropy(w.withColumn("stage", F.when(F.col("window_idx") < 2, "W").otherwise("N2"))).first()
    assert out.delta_power_entropy is not None and X.delta_entropy(w.withColumn("stage", F.lit("W"))).first().delta_power_entropy is None
    assert S.gaussian(np.ones(30), 10.0) == pytest.approx(np.ones(30))


def test_segment_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 10, 1000)
    rows = [("p", "C3", i, 100.0, q, None if d is None else [float(v) for v in d]) for i, (q, d) in enumerate([(0.9, x), (0.3, x), (0.9, None), (None, x)])]
    df = spark.createDataFrame(rows, "patient_id string, channel string, segment_idx int, fs double, sqi double, data array<float>")
    got = {r.segment_idx: r for r in X.eeg_features(df).collect()}
    assert got[0].eeg_quality_ok and got[0].eeg_total > 0 and got[0].eeg_std == pytest.approx(x.std(), rel=1e-3) and got[0].eeg_hjorth_mobility > 1
    assert not got[1].eeg_quality_ok and got[1].eeg_std == pytest.approx(x.std(), rel=1e-3) and got[1].eeg_total is None
    assert got[2].eeg_std is None and got[3].eeg_total is None and got[3].eeg_std is not None
    few = X.eeg_features(df, wanted=["eeg_swa_power_mean", "eeg_std_median"])
    assert few.columns == ["patient_id", "channel", "segment_idx", "eeg_quality_ok", "eeg_std", "eeg_swa_power"]
    two = df.where("segment_idx = 0").unionByName(df.where("segment_idx = 0").withColumn("channel", F.lit("C4")))
    c = X.coherence(two, [("C3", "C4")]).first()
    assert c.total_coherence == pytest.approx(1.0) and c.delta_coherence == pytest.approx(1.0)


def test_settings_and_columns(spark):
    values = {"A": "Yes", "B": "12", "C": "x; y,z", "D": "?"}
    assert (X.setting(values, "A", False), X.setting(values, "B", 1), X.setting(values, "C", ["q"]), X.setting(values, "D", True), X.setting(values, "Z", 3), X.setting(values, "D", 4)) == (True, 12, ["x", "y", "z"], True, 3, 4)
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(3).alias("a"))
    assert tuple(X.distinct_columns(df).first()) == (1, 2)
    assert X.first_present(["x", "Onset"], ["start", "ONSET"]) == "Onset" and X.first_present(["x"], ["y"]) is None
    assert (X.default_k(400, 300), X.default_k(4, 300), X.default_k(10**6, 300), X.default_k(400, 5)) == (60, 10, 75, 5)


def test_ranks_by_ranges_are_those_of_one_window(spark, monkeypatch):
    from nocturne.operators import cohort as C
    from nocturne.operators import stats

    rng = random.Random(6)
    rows = [(rng.choice("ab"), float(rng.randint(0, 1)), rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3))]), rng.random()) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, y double, s double, v double")

    def all_():
        out = [C.auroc(df, "y", "s", g).collect() for g in ([], ["g"])]
        out += [C.auprc(df, "y", "s").collect(), stats.spearman_matrix(df, ["y", "s", "v"]).collect(), stats.effect_sizes(df, "y", ["s", "v"]).collect()]
        out += [stats.pairwise_mann_whitney(df, "g", "v", ["a", "b"]).collect(), stats.kruskal_wallis(df, "g", "s").collect(), stats.mann_whitney(df, "g", "s", "a", "b").collect()]
        return [sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in part) for part in out]

    one = all_()
    monkeypatch.setattr(C, "FEW", 10)
    assert all_() == one
