"""Heart, breathing and CAP kernels against plain loops and made-up signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.functions import cardiac as K
from nocturne.functions import spectral as S
from nocturne.operators import cap, cardiac

FS = 100.0


def heart(seconds, breath=0.25, seed=0):
    """(ecg, breathing, beat times): narrow beats at about 60 a minute, faster on inspiration."""
    rng = np.random.default_rng(seed)
    at, beats = 0.5, []
    while at < seconds - 0.5:
        beats.append(at)
        at += 1.0 + 0.06 * math.sin(2 * math.pi * breath * at)
    t = np.arange(int(seconds * FS)) / FS
    x = rng.normal(0, 0.01, len(t))
    for b in beats:
        x += np.exp(-(((t - b) / 0.015) ** 2))
    return x, np.sin(2 * math.pi * breath * t) + rng.normal(0, 0.02, len(t)), np.array(beats)


@pytest.fixture(scope="module")
def recordings(spark):
    x, y, _ = heart(900)
    rows = [("p", "ecg", FS, [float(v) for v in x]), ("p", "resp", FS, [float(v) for v in y])]
    return spark.createDataFrame(rows, "patient_id string, channel string, fs double, samples array<float>")


def test_beats_in_chunks_are_those_of_the_signal(spark, recordings):
    _, _, beats = heart(900)
    got = cardiac.beats(recordings.where("channel = 'ecg'"), seconds=100.0).first().peaks
    assert len(got) == len(beats) and np.abs(np.array(got) / FS - beats).max() <= 0.03


def test_chunks_cover_the_signal_once(recordings):
    ecg = recordings.where("channel = 'ecg'")
    back = cardiac.joined_chunks(cardiac.chunks(ecg, 77.0, 5.0)).first().samples
    assert np.allclose(back, ecg.first().samples)
    whole = S.filtfilt(S.butter_bandpass(0.5, 40.0, FS), np.asarray(ecg.first().samples, float))
    cleaned = np.array(cardiac.clean(ecg, seconds=200.0).first().samples)
    assert len(cleaned) == len(whole) and np.abs(cleaned - whole).max() < 0.01
    plain = np.array(cardiac.clean(recordings.where("channel = 'resp'").withColumn("samples", F.transform("samples", lambda v: v * 0 + 1)), notch=45.0).first().samples)
    assert np.abs(plain).max() < 1e-3  # a constant has nothing in the band


def test_quality_and_arrhythmia_by_segment(recordings):
    ecg, resp = recordings.where("channel = 'ecg'"), recordings.where("channel = 'resp'")
    parts = cardiac.peaks_by_segment(ecg, cardiac.beats(ecg))
    rows = {r.segment_idx: r for r in cardiac.ecg_quality(parts).collect()}
    assert sorted(rows) == [0, 1, 2] and all(r.template > 0.95 and r.contrast == 1.0 and r.sqi > 0.8 for r in rows.values())
    n = int(FS * 300)
    b = resp.select("patient_id", "fs", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("segment_idx"), "samples").withColumn("data", F.slice("samples", F.col("segment_idx") * n + 1, n))
    out = cardiac.sinus_arrhythmia(parts, b).collect()
    assert len(out) == 3
    for r in out:
        assert abs(r.rsa_resp_rate - 15) < 1.1 and 1 < r.rsa_peak_valley < 10 and r.rsa_coupling_strength > 0.8 and r.rsa_gates_mean > 3
    noise = K.ecg_quality(np.random.default_rng(1).normal(size=3000), np.array([100, 700, 720, 2000]), FS)
    assert noise["sqi"] < 0.6 and K.ecg_quality(np.zeros(10), np.zeros(0, int), FS)["sqi"] == 0.0


def test_quality_by_loops():
    rng = np.random.default_rng(3)
    x, peaks = rng.normal(size=2000), np.sort(rng.choice(2000, 25, replace=False))
    z = []
    for p in peaks:
        if p - 10 >= 0 and p + 10 < 2000:
            beat = x[p - 10 : p + 10]
            z.append((beat - beat.mean()) / beat.std())
    middle = np.median(z, axis=0)
    want = (np.mean([np.corrcoef(b, middle)[0, 1] for b in z]) + 1) / 2
    assert abs(K.template_match(x, peaks, FS) - want) < 1e-9
    near = np.zeros(2000, bool)
    for p in peaks:
        near[max(0, p - 5) : min(2000, p + 5)] = True
    assert abs(K.contrast(x, peaks, FS) - np.clip(((x[near] ** 2).mean() / (x[~near] ** 2).mean() - 1) / 4, 0, 1)) < 1e-12


def test_local_peaks():
    assert K.local_peaks(np.array([0, 2, 1, 3, 0, 1, 1, 1, 0.0]), 1).tolist() == [1, 3, 6]
    assert K.local_peaks(np.array([0, 2, 1, 3, 0, 1, 1, 1, 0.0]), 3).tolist() == [3, 6]
    assert K.local_peaks(np.arange(5.0), 1).tolist() == []


def test_spectrum_of_intervals(spark):
    rr = 1000 + 50 * np.sin(2 * math.pi * 0.25 * np.arange(300))
    out = K.hrv_spectrum(rr)
    assert abs(out["hf_peak_hz"] - 0.25) < 0.03 and out["hf_norm"] > 90 and abs(out["lf_norm"] + out["hf_norm"] - 100) < 1e-6
    df = spark.createDataFrame([(1, [float(v) for v in rr]), (2, [900.0] * 5)], "k int, rr_ms array<double>")
    got = {r.k: r for r in cardiac.hrv_spectrum(df).collect()}
    assert abs(got[1].hf - out["hf"]) < 1e-6 and got[2].hf is None


def test_cap_kernels_by_loops():
    rng = np.random.default_rng(5)
    fs, x = 20, rng.normal(size=20 * 40 + 7)
    assert np.allclose(cap.hjorth_activity(x, fs), [x[i * fs : i * fs + 3 * fs].var() for i in range((len(x) - 3 * fs) // fs + 1)])
    teo = [x[i + 1] ** 2 - x[i] * x[i + 2] for i in range(len(x) - 2)]
    assert np.allclose(cap.teager_energy(x, fs), [np.mean(teo[k * fs : (k + 1) * fs]) for k in range(len(teo) // fs)])
    entropy = []
    for i in range((len(x) - 2 * fs) // fs + 1):
        part = x[i * fs : i * fs + 2 * fs]
        edges = np.linspace(part.min(), part.max(), 33)
        counts = np.zeros(32)
        for v in part:
            counts[min(31, max(0, np.searchsorted(edges, v) - 1))] += 1
        p = counts / (len(part) * (edges[1] - edges[0])) + 1e-12
        p /= p.sum()
        entropy.append(-(p * np.log2(p)).sum())
    assert np.allclose(cap.histogram_entropy(x, fs), entropy, atol=0.06)
    power = [np.mean(x[k * fs : (k + 1) * fs] ** 2) for k in range(len(x) // fs)]
    ends = [power[1], power[0], *power, power[-1], power[-2]]
    assert np.allclose(cap.second_power(x, fs, 5), [np.mean(ends[k : k + 5]) for k in range(len(power))])
    m = cap.cap_matrix(x, fs, np.arange(99))
    assert m.shape[1] == 14 and len(m) == len(cap.hjorth_activity(x, fs))
    spans = cap.chunk_spans(9000, 3600, 120)
    assert [s[:2] for s in spans] == [(0, 3600), (3480, 7080), (6960, 9000)] and [s[2] for s in spans] == [0, 3600, 7080]


def test_labels_in_chunks_are_those_of_the_whole(spark):
    n = 500
    rng = np.random.default_rng(2)
    m = rng.normal(size=(n, 3))
    df = spark.createDataFrame([(k, int(i), *map(float, m[i])) for k in "ab" for i in range(n)], "patient_id string, at int, a double, b double, c double")
    network = lambda x: np.argmax(x, axis=1)
    want = network(cap.robust_rows(m)).tolist()
    for size, overlap in ((100, 20), (1000, 20), (125, 0)):
        got = cap.predict_in_chunks(df, "patient_id", network, size, overlap).orderBy("patient_id", "at").collect()
        assert [r.code for r in got] == want * 2
    assert cap.predict_in_chunks(df, "patient_id", None).where("code is not null").count() == 0


def test_cap_features_of_a_recording(spark):
    x = [float(v) for v in np.random.default_rng(1).normal(size=50 * 60)]
    df = spark.createDataFrame([("p", 50.0, x, [0.0] * 60)], "patient_id string, fs double, samples array<float>, distance array<double>")
    rows = cap.cap_features(df).orderBy("at").collect()
    assert [r.at for r in rows] == list(range(58)) and rows[0].wake_rem_distance == 0 and rows[5].power_delta > 0
