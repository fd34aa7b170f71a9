"""Signals in segments: slicing, quality, beats, spectral features, spindles, slow waves and their coupling.

Rows are (patient_id, channel, fs, samples); a kernel sees one channel of one recording
or one segment, both bounded by a night, in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from nocturne.functions import arrays as A
from nocturne.functions import spectral as S

SPINDLE_HZ, SLOW_HZ = (12.0, 16.0), (0.3, 1.5)


def slice_segments(recordings: DataFrame, length: float, most_bad: float = 0.1) -> DataFrame:
    """(patient_id, channel, segment_idx, start_sec, fs, data): samples of each whole segment; too many bad samples: data is null."""
    n = F.floor(F.col("fs") * length).cast("int")
    rows = recordings.select("patient_id", "channel", "fs", n.alias("n"), F.col("samples").alias("s"))
    rows = rows.where("size(s) >= n").withColumn("segment_idx", F.explode(F.sequence(F.lit(0), F.floor(F.size("s") / F.col("n")).cast("int") - 1)))
    data = F.slice("s", F.col("segment_idx") * F.col("n") + 1, F.col("n"))
    rows = rows.select("patient_id", "channel", "fs", "segment_idx", (F.col("segment_idx") * length).alias("start_sec"), data.alias("data"))
    bad = F.size(F.filter("data", lambda x: x.isNull() | F.isnan(x)))

    @F.pandas_udf("array<float>")
    def fill(column: pd.Series) -> pd.Series:
        return column.map(lambda a: None if a is None else S.interpolate_gaps(np.asarray(a, float), 1.0).astype(np.float32))

    clean = F.when(bad == 0, F.col("data")).when(bad / F.size("data") <= most_bad, fill("data"))
    return rows.withColumn("data", clean)


def eeg_quality(segments: DataFrame) -> DataFrame:
    """Adds amp, flat, spec and sqi = .35 amp + .30 flat + .35 spec; segments without data have 0."""

    @F.pandas_udf("struct<flat double, spec double>")
    def parts(data: pd.Series, fs: pd.Series) -> pd.DataFrame:
        out = []
        for a, rate in zip(data, fs):
            if a is None or len(a) < 2 * rate:
                out.append((0.0, 0.0))
                continue
            x, size = np.asarray(a, float), int(rate)
            flat = 1 - float((x[: len(x) // size * size].reshape(-1, size).std(axis=1) < 0.5).mean())
            f, p = S.welch(x, rate, int(4 * rate))
            whole = p.sum()
            share = p[(f >= 0.5) & (f <= 30)].sum() / whole if whole > 0 else 0.0
            bands = np.array([S.band_power(f, p, *r) for r in S.BANDS.values()])
            q = bands[bands > 0] / bands.sum() if bands.sum() > 0 else np.zeros(0)
            out.append((flat, 0.5 * share + 0.5 * float(-(q * np.log2(q)).sum()) / math.log2(5)))
        return pd.DataFrame(out, columns=["flat", "spec"])

    amp = F.coalesce(F.size(F.filter("data", lambda x: F.abs(x).between(0.05, 200))) / F.size("data"), F.lit(0.0))
    rows = segments.withColumn("_q", parts("data", "fs")).withColumns({"amp": amp, "flat": F.col("_q.flat"), "spec": F.col("_q.spec")}).drop("_q")
    return rows.withColumn("sqi", F.least(F.lit(1.0), 0.35 * F.col("amp") + 0.30 * F.col("flat") + 0.35 * F.col("spec")))


def good_channels(segments: DataFrame, least_sqi: float = 0.5, least_share: float = 0.1) -> DataFrame:
    """(patient_id, channel, share) of channels with enough good segments."""
    share = F.avg((F.col("sqi") >= least_sqi).cast("int"))
    return segments.groupBy("patient_id", "channel").agg(share.alias("share")).where(F.col("share") > least_share)


def bad_channels(recordings: DataFrame, flat: float = 0.5, high: float = 200.0, most_high: float = 0.3) -> DataFrame:
    """(patient_id, channel, bad): nearly flat, or too often beyond the amplitude limit."""
    s = F.transform("samples", lambda x: x.cast("double"))
    rows = recordings.withColumn("_s", s).withColumn("_m", A.mean(F.col("_s")))
    sd = F.sqrt(A.moment(F.col("_s"), F.col("_m"), 2))
    over = F.size(F.filter("_s", lambda x: F.abs(x) > high)) / F.size("_s")
    return rows.select("patient_id", "channel", ((sd < flat) | (over > most_high)).alias("bad"))


def heart_beats(recordings: DataFrame, thin: float = 0.2) -> DataFrame:
    """(patient_id, peak_sec, rr_ms, rr_valid) of each beat but the last: fallback detector, 200 ms thinning, validity about the median."""

    @F.pandas_udf("array<double>")
    def peaks(data: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series([S.r_peaks(np.asarray(a, float), rate) / rate if a is not None and len(a) > rate else np.zeros(0) for a, rate in zip(data, fs)])

    rows = recordings.select("patient_id", A.thin_peaks(peaks("samples", "fs"), thin).alias("p"))
    rr = F.transform(A.diff(F.col("p")), lambda x: x * 1000)
    rows = rows.where("size(p) > 1").withColumn("rr", rr)
    inside = F.filter("rr", lambda x: x.between(300, 2000))
    rows = rows.withColumn("md", F.coalesce(A.median(inside), F.lit(800.0)))
    rows = rows.select("patient_id", "md", F.explode(F.arrays_zip(F.slice("p", 1, F.size("rr")).alias("peak_sec"), F.col("rr").alias("rr_ms"))).alias("b"))
    valid = F.col("b.rr_ms").between(300, 2000) & (F.abs(F.col("b.rr_ms") - F.col("md")) / F.col("md") < 0.2)
    return rows.select("patient_id", "b.peak_sec", "b.rr_ms", valid.alias("rr_valid"))


def beats_by_segment(beats: DataFrame, length: float) -> DataFrame:
    """(patient_id, segment_idx, rr_ms): an interval belongs to the segment of its first peak."""
    at = F.floor(F.col("peak_sec") / length)
    return beats.where("rr_valid").groupBy("patient_id", at.alias("segment_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("peak_sec", "rr_ms"))), lambda x: x["rr_ms"]).alias("rr_ms"))


def hrv_frequency(rr: DataFrame, least: int = 10) -> DataFrame:
    """vlf, lf, hf and lf_hf of each segment; null with fewer than ``least`` intervals."""

    @F.pandas_udf("struct<vlf double, lf double, hf double, lf_hf double>")
    def run(column: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("vlf", "lf", "hf", "lf_hf"), math.nan)
        return pd.DataFrame([S.hrv_freq(np.asarray(a, float)) if len(a) >= least else none for a in column], columns=list(none))

    return rr.withColumn("_f", run("rr_ms")).select(*[c for c in rr.columns if c != "rr_ms"], "_f.*")


@udtf(returnType="start_sec double, end_sec double, peak_sec double, freq_hz double, amplitude double")
class Spindles:
    """Bursts of 12-16 Hz: smoothed RMS over 1.2 deviations above its mean for .5 to 2 s, with a relative power over .15."""

    def eval(self, samples: list, fs: float):
        x = np.asarray(samples, float)
        if len(x) < 10 * fs:
            return
        y = S.filtfilt(S.butter_bandpass(*SPINDLE_HZ, fs), x)
        box = np.ones(int(0.2 * fs)) / int(0.2 * fs)
        rms = np.sqrt(np.convolve(y**2, box, "same"))
        wide = np.convolve(S.filtfilt(S.butter_bandpass(1.0, 30.0, fs), x) ** 2, box, "same")
        over = np.concatenate(([0], (rms > rms.mean() + 1.2 * rms.std()).astype(int), [0]))
        for a, b in zip(np.flatnonzero(np.diff(over) == 1), np.flatnonzero(np.diff(over) == -1)):
            if 0.5 <= (b - a) / fs <= 2.0 and rms[a:b].mean() ** 2 > 0.15 * wide[a:b].mean():
                turns = int((np.diff(np.signbit(y[a:b]).astype(int)) != 0).sum())
                yield float(a / fs), float(b / fs), float((a + np.argmax(np.abs(y[a:b]))) / fs), float(turns / 2 / ((b - a) / fs)), float(np.ptp(y[a:b]))


@udtf(returnType="start_sec double, end_sec double, trough_sec double, amplitude double")
class SlowWaves:
    """Negative half waves of .3-1.5 s, positive ones of .1-1.5 s after them, 20-500 from peak to peak."""

    def eval(self, samples: list, fs: float):
        x = np.asarray(samples, float)
        if len(x) < 10 * fs:
            return
        y = S.filtfilt(S.butter_bandpass(*SLOW_HZ, fs), x)
        neg = np.signbit(y).astype(int)
        down, up = np.flatnonzero(np.diff(neg) == 1) + 1, np.flatnonzero(np.diff(neg) == -1) + 1
        for a in down:
            b = up[np.searchsorted(up, a) :][:1]
            c = down[np.searchsorted(down, a, "right") :][:1]
            if len(b) and len(c) and 0.3 <= (b[0] - a) / fs <= 1.5 and 0.1 <= (c[0] - b[0]) / fs <= 1.5:
                size = float(y[b[0] : c[0]].max() - y[a : b[0]].min())
                if 20 <= size <= 500:
                    yield float(a / fs), float(c[0] / fs), float((a + np.argmin(y[a : b[0]])) / fs), size


def detect(segments: DataFrame, kind: str, view: str = "_segments_to_scan") -> DataFrame:
    """Rows of a detector, "spindles" or "slow_waves", for each segment with data."""
    spark = segments.sparkSession
    spark.udtf.register(kind, {"spindles": Spindles, "slow_waves": SlowWaves}[kind])
    segments.where("data is not null").createOrReplaceTempView(view)
    return spark.sql(f"SELECT s.patient_id, s.channel, s.segment_idx, d.* FROM {view} s, LATERAL {kind}(s.data, s.fs) d")


def spindle_summary(spindles: DataFrame, minutes: float) -> DataFrame:
    """Counts, slow (12-14 Hz) and fast (14-16 Hz) split, densities, and mean duration, frequency and amplitude."""
    slow, fast = F.col("freq_hz") < 14, F.col("freq_hz") >= 14
    n = F.count(F.lit(1))
    out = spindles.groupBy("patient_id", "channel", "segment_idx").agg(
        n.alias("n"), (n / minutes).alias("density"), F.count_if(slow).alias("n_slow"), F.count_if(fast).alias("n_fast"), F.avg(F.col("end_sec") - F.col("start_sec")).alias("duration"), F.avg("freq_hz").alias("freq"), F.avg("amplitude").alias("amplitude"),
    )
    return out.withColumn("fast_slow", F.try_divide("n_fast", "n_slow"))


def coupling(segments: DataFrame, spindles: DataFrame, least: int = 10) -> DataFrame:
    """Phase of the slow oscillation at spindle peaks: mean, resultant length, Rayleigh z and p, quadrant; at least ``least`` spindles."""

    @F.pandas_udf("array<double>")
    def phases(data: pd.Series, fs: pd.Series, peaks: pd.Series) -> pd.Series:
        out = []
        for a, rate, p in zip(data, fs, peaks):
            angle = np.angle(S.hilbert(S.filtfilt(S.butter_bandpass(*SLOW_HZ, rate), np.asarray(a, float))))
            out.append(angle[np.clip((np.asarray(p) * rate).astype(int), 0, len(angle) - 1)])
        return pd.Series(out)

    keys = ["patient_id", "channel", "segment_idx"]
    at = spindles.groupBy(*keys).agg(F.array_sort(F.collect_list("peak_sec")).alias("peaks")).where(F.size("peaks") >= least)
    rows = segments.where("data is not null").join(at, keys).select(*keys, F.explode(phases("data", "fs", "peaks")).alias("phi"))
    m = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.sin("phi")).alias("s"), F.avg(F.cos("phi")).alias("c"))
    m = m.withColumns({"mean_phase": F.atan2("s", "c"), "mrl": F.hypot("s", "c")}).withColumn("rayleigh_z", F.col("n") * F.col("mrl") * F.col("mrl"))
    q, pi = F.col("mean_phase"), math.pi
    quadrant = F.when((q >= -pi / 2) & (q < 0), 1).when((q >= 0) & (q < pi / 2), 2).when(q >= pi / 2, 3).otherwise(4)
    return m.withColumns({"rayleigh_p": F.exp(-F.col("rayleigh_z")), "quadrant": quadrant}).drop("s", "c")


#: Bands of the odds-ratio product.
ORP_BANDS = {"delta": (0.3, 2.3), "theta": (2.7, 6.3), "alpha_sigma": (7.3, 14.0), "beta": (14.3, 30.0)}


def orp(segments: DataFrame, thresholds: dict[str, list[float]], table: DataFrame, window: float = 5.0) -> DataFrame:
    """(patient_id, channel, segment_idx, window_idx, word, orp): band z-scores over a recording's clean windows, ranked in nine
    thresholds to a four-digit word, and the word's value in ``table`` (word, orp).

    A window is clean if its peak-to-peak amplitude is .5 to 200.  The table is not part
    of this package and is an input; its 10,000 words at most are broadcast.
    """
    bands = list(ORP_BANDS)

    @F.pandas_udf("array<struct<delta double, theta double, alpha_sigma double, beta double, clean boolean>>")
    def powers(data: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for a, rate in zip(data, fs):
            size = int(window * rate)
            x = np.asarray(a, float)
            rows = []
            for w in x[: len(x) // size * size].reshape(-1, size):
                f, p = S.welch(w, rate, size)
                own = {b: math.log10(S.band_power(f, p, *r) + 1e-10) for b, r in ORP_BANDS.items()}
                rows.append(own | {"clean": bool(0.5 <= np.ptp(w) <= 200)})
            out.append(rows)
        return pd.Series(out)

    rows = segments.where("data is not null").select("patient_id", "channel", "segment_idx", F.posexplode(powers("data", "fs")).alias("window_idx", "b")).select("*", "b.*").drop("b")
    stats = rows.where("clean").groupBy("patient_id", "channel").agg(*[F.avg(b).alias(f"m_{b}") for b in bands], *[F.stddev_pop(b).alias(f"s_{b}") for b in bands])
    rows = rows.where("clean").join(stats, ["patient_id", "channel"])
    word = F.lit(0)
    for i, b in enumerate(bands):
        z = F.coalesce(F.try_divide(F.col(b) - F.col(f"m_{b}"), F.col(f"s_{b}")), F.lit(0.0))
        word = word + sum((z > x).cast("int") for x in thresholds[b]) * 10 ** (3 - i)
    rows = rows.withColumn("word", word)
    return rows.join(F.broadcast(table), "word", "left").select("patient_id", "channel", "segment_idx", "window_idx", "word", "orp")


def asymmetry(features: DataFrame, pairs: list[tuple[str, str]], value: str) -> DataFrame:
    """(R - L) / (R + L) and the difference of logarithms for each pair of channels."""
    spark = features.sparkSession
    names = spark.createDataFrame(pairs, "left_ch string, right_ch string")
    left = features.select("patient_id", "segment_idx", F.col("channel").alias("left_ch"), F.col(value).alias("l"))
    right = features.select("patient_id", "segment_idx", F.col("channel").alias("right_ch"), F.col(value).alias("r"))
    both = left.join(F.broadcast(names), "left_ch").join(right, ["patient_id", "segment_idx", "right_ch"])
    return both.withColumns({"asym": F.try_divide(F.col("r") - F.col("l"), F.col("r") + F.col("l")), "log_diff": F.log(F.col("r") + 1e-10) - F.log(F.col("l") + 1e-10)})
