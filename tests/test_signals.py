import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.functions import spectral as S
from nocturne.operators import signals as G
from nocturne.sources import edf, tables

FS = 64.0
T = np.arange(int(60 * FS)) / FS


def test_welch_finds_a_sine():
    f, p = S.welch(10 * np.sin(2 * np.pi * 10 * T), FS, 256)
    assert f[np.argmax(p)] == 10
    assert S.band_power(f, p, 8, 12) == pytest.approx(50, rel=0.02)


def test_bandpass_keeps_its_band():
    own = S.filtfilt(S.butter_bandpass(8, 12, FS), np.sin(2 * np.pi * 10 * T))
    other = S.filtfilt(S.butter_bandpass(8, 12, FS), np.sin(2 * np.pi * 2 * T))
    middle = slice(len(T) // 4, -len(T) // 4)
    assert np.corrcoef(own[middle], np.sin(2 * np.pi * 10 * T)[middle])[0, 1] > 0.999
    assert own[middle].std() == pytest.approx(math.sqrt(0.5), rel=0.02)
    assert other[middle].std() < 0.01


def test_notch_removes_one_frequency():
    fs = 256.0
    t = np.arange(int(20 * fs)) / fs
    y = S.filtfilt(S.notch(60, fs), np.sin(2 * np.pi * 60 * t) + np.sin(2 * np.pi * 10 * t))[1000:-1000]
    assert np.abs(np.fft.rfft(y))[int(60 * len(y) / fs)] < 0.05 * np.abs(np.fft.rfft(y)).max()


def test_hilbert_envelope():
    assert np.allclose(np.abs(S.hilbert(3 * np.cos(2 * np.pi * 4 * T)))[50:-50], 3, atol=1e-6)


def test_complexity_of_noise_and_of_a_walk():
    noise = np.random.default_rng(1).normal(size=4000)
    assert S.dfa(noise)["dfa"] == pytest.approx(0.5, abs=0.1)
    assert S.dfa(np.cumsum(noise))["dfa"] == pytest.approx(1.5, abs=0.12)
    assert S.higuchi(noise)["higuchi_fd"] == pytest.approx(2.0, abs=0.05)
    assert S.sample_entropy(np.sin(T[:800]))["sample_entropy"] < S.sample_entropy(noise)["sample_entropy"]
    assert S.lempel_ziv(np.sin(T[:800]))["lempel_ziv"] < S.lempel_ziv(noise[:800])["lempel_ziv"]


def test_gaps():
    x = np.array([0.0, np.nan, 2.0] + [3.0] * 17)
    assert S.interpolate_gaps(x)[1] == 1.0
    assert S.interpolate_gaps(np.array([np.nan, 1.0, 2.0])) is None


def spikes(seconds=60, fs=FS, bpm=60):
    x = np.zeros(int(seconds * fs))
    x[:: int(fs * 60 / bpm)] = 100.0
    return x + np.random.default_rng(0).normal(0, 1, len(x))


@pytest.fixture(scope="module")
def recordings(spark):
    eeg = 40 * np.sin(2 * np.pi * 1.0 * T) + 5 * np.random.default_rng(3).normal(size=len(T))
    for k in range(4, 56, 4):
        at = slice(int(k * FS), int((k + 1) * FS))
        eeg[at] += 25 * np.sin(2 * np.pi * 13 * T[at])
    rows = [("p1", "eeg", FS, [float(v) for v in eeg]), ("p1", "flat", FS, [0.0] * len(T)), ("p1", "ecg", FS, [float(v) for v in spikes()])]
    return spark.createDataFrame(rows, "patient_id string, channel string, fs double, samples array<float>").cache()


def test_segments_and_quality(recordings):
    seg = G.eeg_quality(G.slice_segments(recordings, 20.0))
    q = {(r.channel, r.segment_idx): r.sqi for r in seg.collect()}
    assert len(q) == 9
    assert q["eeg", 0] > 0.8 and q["flat", 0] < 0.1
    assert {r.channel for r in G.good_channels(seg).collect()} == {"eeg", "ecg"}
    assert {r.channel for r in G.bad_channels(recordings).where("bad").collect()} == {"flat"}


def test_segments_with_gaps(spark):
    bad = [float("nan")] * 8 + [1.0] * 92
    worse = [float("nan")] * 20 + [1.0] * 80
    rows = spark.createDataFrame([("a", "x", 10.0, bad), ("a", "y", 10.0, worse)], "patient_id string, channel string, fs double, samples array<float>")
    got = {r.channel: r.data for r in G.slice_segments(rows, 10.0).collect()}
    assert got["x"] == [1.0] * 100 and got["y"] is None


def test_beats(recordings):
    beats = G.heart_beats(recordings.where("channel = 'ecg'"))
    rr = [r.rr_ms for r in beats.where("rr_valid").collect()]
    assert len(rr) > 55 and abs(np.mean(rr) - 1000) < 10
    freq = G.hrv_frequency(G.beats_by_segment(beats, 60.0)).first()
    assert freq.lf is not None and freq.lf >= 0


def test_detectors_and_coupling(recordings):
    seg = G.slice_segments(recordings.where("channel = 'eeg'"), 60.0)
    spindles, waves = G.detect(seg, "spindles"), G.detect(seg, "slow_waves")
    found = spindles.collect()
    assert len(found) >= 10 and all(12 <= r.freq_hz <= 15 for r in found)
    assert 50 <= waves.count() <= 61
    s = G.spindle_summary(spindles, 1.0).first()
    assert s.n == len(found) and s.density == s.n
    c = G.coupling(seg, spindles).first()
    assert 0 <= c.mrl <= 1 and c.quadrant in (1, 2, 3, 4)


def test_orp_with_a_given_table(spark, recordings):
    seg = G.slice_segments(recordings.where("channel = 'eeg'"), 60.0)
    steps = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]
    table = spark.range(10000).select(F.col("id").cast("int").alias("word"), (F.col("id") / 4000.0).alias("orp"))
    got = G.orp(seg, {b: steps for b in G.ORP_BANDS}, table).collect()
    assert got and all(0 <= r.word <= 9999 and r.orp == r.word / 4000 for r in got)


def test_edf_round_trip(spark, tmp_path):
    folder = tmp_path / "S0001"
    folder.mkdir()
    x = 50 * np.sin(2 * np.pi * 3 * T)
    (folder / "rec1.edf").write_bytes(edf.to_edf({"C3-M2": (FS, x), "Resp": (16.0, x[::4])}, [(3.0, 1.5, "arousal"), (5.0, 30.0, "Sleep stage N2")]))
    (folder / "broken.edf").write_bytes(b"not a recording")
    rows = {r.channel: r for r in edf.read_edf(spark, str(tmp_path)).collect()}
    assert set(rows) == {"C3-M2", "Resp"} and rows["C3-M2"].record == "S0001/rec1"
    assert np.allclose(rows["C3-M2"].samples, x, atol=0.01) and rows["Resp"].fs == 16
    notes = [(r.onset, r.duration, r.description) for r in edf.read_edf(spark, str(tmp_path), annotations=True).orderBy("onset").collect()]
    assert notes == [(3.0, 1.5, "arousal"), (5.0, 30.0, "Sleep stage N2")]
    spark.dataSource.register(edf.EdfSource)
    (folder / "broken.edf").unlink()
    assert spark.read.format("edf").load(str(folder)).count() == 2
    epochs = tables.epochs_of(edf.read_edf(spark, str(tmp_path), annotations=True), "record").collect()
    assert [(e.stage_label, e.stage_numeric) for e in epochs] == [("N2", 2)]


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.annot").write_text("onset\tduration\tdescription\n0\t30\tSleep stage W\n30\t30\tSleep stage N2\n")
    (tmp_path / "b.annot").write_text("12.5;3;Obstructive apnea\n20,arousal\nremark\n")
    (tmp_path / "c.annot").write_text("<X><ScoredEvent><EventConcept>Hypopnea</EventConcept><Start>7</Start><Duration>11</Duration></ScoredEvent></X>")
    got = tables.read_annotations(spark, str(tmp_path / "*.annot"))
    rows = sorted((r.onset, r.duration, r.description) for r in got.collect())
    assert rows == [(0.0, 30.0, "Sleep stage W"), (7.0, 11.0, "Hypopnea"), (12.5, 3.0, "Obstructive apnea"), (20.0, 30.0, "arousal"), (30.0, 30.0, "Sleep stage N2")]
    assert sorted(r.event_type for r in tables.events_of(got, "path").collect()) == ["arousal", "hypopnea", "obstructive_apnea"]


def test_feature_tables(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1.5, None), ("p2", float("nan"), 2.0)], "patient_id string, a double, b double")
    tables.write_features(df, str(tmp_path / "f"))
    back = tables.read_features(spark, str(tmp_path / "f"), ["patient_id", "a", "zz"])
    assert back.columns == ["patient_id", "a", "zz"] and back.count() == 2
    assert {r.column_name: r.nulls for r in tables.null_counts(df).collect()} == {"patient_id": 0, "a": 0, "b": 1}
    assert tables.manifest(spark, str(tmp_path)).count() >= 1
    tables.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).where("a is null").count() == 1
    (tmp_path / "d.csv").write_text("SiteID,BDSPPatientID,Age\nS0001,7,61\n")
    row = tables.read_cohort(spark, str(tmp_path / "d.csv")).first()
    assert row.Age == "61" and row.BMI is None
