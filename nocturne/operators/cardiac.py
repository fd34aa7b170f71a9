"""Heart and breathing: cleaning and beats in chunks with a halo, quality of segments, variability, arrhythmia with breathing.

A recording's chunks are rows, so a long channel is spread over tasks; each chunk carries
the samples next to it as a halo, which is used and then cut off.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.functions import arrays as A
from nocturne.functions import cardiac as K
from nocturne.functions import spectral as S


def chunks(recordings: DataFrame, seconds: float, halo: float) -> DataFrame:
    """(patient_id, channel, fs, chunk, n_chunks, first, lead, core, data): samples of each chunk with ``halo`` seconds on both sides.

    ``first`` is the number of the chunk's first own sample, ``lead`` the samples of halo
    before it, ``core`` the number of its own.
    """
    size, side = F.greatest(F.lit(1), F.floor(F.col("fs") * seconds)).cast("int"), F.floor(F.col("fs") * halo).cast("int")
    rows = recordings.where(F.size("samples") > 0).select("patient_id", "channel", "fs", F.col("samples").alias("s"), size.alias("size"), side.alias("side"))
    rows = rows.withColumn("n_chunks", F.ceil(F.size("s") / F.col("size")).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).withColumn("first", F.col("chunk") * F.col("size"))
    lead = F.least("side", "first")
    core = F.least(F.col("size"), F.size("s") - F.col("first"))
    data = F.slice("s", F.col("first") - lead + 1, lead + core + F.col("side"))
    return rows.select("patient_id", "channel", "fs", "chunk", "n_chunks", "first", lead.alias("lead"), core.alias("core"), data.alias("data"))


def joined_chunks(parts: DataFrame, data: str = "data") -> DataFrame:
    """(patient_id, channel, fs, samples): the chunks' own samples put together again in order."""
    piece = F.struct("chunk", F.slice(F.col(data), F.col("lead") + 1, F.col("core")).alias("x"))
    out = parts.groupBy("patient_id", "channel", "fs").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return out.select("patient_id", "channel", "fs", F.flatten(F.transform("p", lambda p: p["x"])).alias("samples"))


def clean(recordings: DataFrame, low: float = 0.5, high: float = 40.0, order: int = 4, notch: float | None = None, seconds: float = 600.0, halo: float = 10.0) -> DataFrame:
    """Band-passed (and notch-filtered) channels, zero phase, in chunks of ``seconds`` with a halo; null samples are bridged."""

    @F.pandas_udf("array<float>")
    def run(data: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for a, rate in zip(data, fs):
            x = S.interpolate_gaps(np.asarray(a, float), 1.0) if np.isfinite(np.asarray(a, float)).any() else np.zeros(len(a))
            if len(x) > 1:
                x = S.filtfilt(S.butter_bandpass(low, high, rate, order), x)
                if notch is not None and notch < rate / 2:
                    x = S.filtfilt(S.notch(notch, rate), x)
            out.append(x.astype(np.float32))
        return pd.Series(out)

    return joined_chunks(chunks(recordings, seconds, halo).withColumn("data", run("data", "fs")))


def beats(recordings: DataFrame, seconds: float = 300.0, halo: float = 2.0, thin: float = 0.2) -> DataFrame:
    """(patient_id, channel, fs, peaks): sample numbers of R peaks, found in chunks with a halo, those of the core kept, 200 ms apart."""

    @F.pandas_udf("array<long>")
    def run(data: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series([S.r_peaks(np.asarray(a, float), rate).astype(np.int64) if len(a) >= 3 * rate else np.zeros(0, np.int64) for a, rate in zip(data, fs)])

    found = chunks(recordings, seconds, halo).withColumn("p", run("data", "fs"))
    low, high = F.when(F.col("chunk") == 0, 0).otherwise(F.col("first")), F.when(F.col("chunk") == F.col("n_chunks") - 1, 2**62).otherwise(F.col("first") + F.col("core"))
    own = F.filter(F.transform("p", lambda x: x + F.col("first") - F.col("lead")), lambda x: (x >= low) & (x < high))
    all_ = found.groupBy("patient_id", "channel", "fs").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("p"))
    kept = A.thin_peaks(F.transform("p", lambda x: x.cast("double")), F.floor(F.col("fs") * thin))
    return all_.select("patient_id", "channel", "fs", F.transform(kept, lambda x: x.cast("long")).alias("peaks"))


def peaks_by_segment(recordings: DataFrame, peaks: DataFrame, length: float = 300.0) -> DataFrame:
    """(patient_id, channel, fs, segment_idx, data, peaks): samples and local peaks of each started segment."""
    n = F.floor(F.col("fs") * length).cast("int")
    rows = recordings.where(F.size("samples") > 0).join(peaks, ["patient_id", "channel", "fs"], "left").withColumn("_n", n)
    rows = rows.withColumn("segment_idx", F.explode(F.sequence(F.lit(0), F.ceil(F.size("samples") / F.col("_n")).cast("int") - 1))).withColumn("_a", F.col("segment_idx") * F.col("_n"))
    local = F.transform(F.filter(F.coalesce("peaks", F.array().cast("array<bigint>")), lambda p: (p >= F.col("_a")) & (p < F.col("_a") + F.col("_n"))), lambda p: p - F.col("_a"))
    return rows.select("patient_id", "channel", "fs", "segment_idx", F.slice("samples", F.col("_a") + 1, F.col("_n")).alias("data"), local.alias("peaks"))


def ecg_quality(segments: DataFrame) -> DataFrame:
    """(patient_id, channel, segment_idx, sqi, template, regular, contrast, n_peaks) of segments with data and peaks."""

    @F.pandas_udf("sqi double, template double, regular double, contrast double")
    def run(data: pd.Series, peaks: pd.Series, fs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.ecg_quality(np.asarray(a, float), np.asarray(p, int), rate) for a, p, rate in zip(data, peaks, fs)], columns=["sqi", "template", "regular", "contrast"])

    return segments.withColumn("_q", run("data", "peaks", "fs")).select("patient_id", "channel", "segment_idx", "_q.*", F.size("peaks").alias("n_peaks"))


def breathing_channel(segments: DataFrame) -> DataFrame:
    """(patient_id, channel): the channel with most segments that have data, the first by name of equals."""
    n = segments.groupBy("patient_id", "channel").agg(F.count("data").alias("n"))
    w = Window.partitionBy("patient_id").orderBy(F.desc("n"), "channel")
    return n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and n > 0").select("patient_id", "channel")


def sinus_arrhythmia(heart: DataFrame, breathing: DataFrame) -> DataFrame:
    """The six measures of each segment; ``heart`` has peaks and fs, ``breathing`` data and fs, both by patient_id and segment_idx."""

    @F.pandas_udf(", ".join(f"{c} double" for c in K.RSA_FIELDS))
    def run(peaks: pd.Series, fs: pd.Series, data: pd.Series, other: pd.Series) -> pd.DataFrame:
        rows = [K.rsa(np.asarray(p, int), a, np.asarray(x, float), b) if p is not None and x is not None else dict.fromkeys(K.RSA_FIELDS, math.nan) for p, a, x, b in zip(peaks, fs, data, other)]
        return pd.DataFrame(rows, columns=list(K.RSA_FIELDS))

    b = breathing.where("data is not null").select("patient_id", "segment_idx", F.col("data").alias("_x"), F.col("fs").alias("_xfs"))
    both = heart.join(b, ["patient_id", "segment_idx"])
    return both.withColumn("_r", run("peaks", "fs", "_x", "_xfs")).select("patient_id", "segment_idx", "_r.*")


def hrv_spectrum(rr: DataFrame, column: str = "rr_ms", least: int = 10) -> DataFrame:
    """Nine spectral measures of each row's intervals; null with fewer than ``least``."""

    @F.pandas_udf(", ".join(f"{c} double" for c in K.HRV_FREQ_FIELDS))
    def run(values: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(K.HRV_FREQ_FIELDS, math.nan)
        return pd.DataFrame([K.hrv_spectrum(np.asarray(a, float)) if a is not None and len(a) >= least else none for a in values], columns=list(none))

    return rr.withColumn("_f", run(column)).select(*[c for c in rr.columns if c != column], "_f.*")


def hrv_time(rr: Column, bin_ms: float = 1000 / 128) -> dict[str, Column]:
    """Measures of variability in time of an array of intervals in ms; all native.

    hti is the number of intervals over the greatest count of a histogram of ``bin_ms``
    from the least interval on, in which the last bin holds its upper edge.
    """
    n, m, d = F.size(rr), A.mean(rr), A.diff(rr)
    sample_sd = lambda a: F.sqrt(A.moment(a, A.mean(a), 2) * F.size(a) / (F.size(a) - 1))
    share = lambda ms: 100.0 * F.size(F.filter(d, lambda x: F.abs(x) > ms)) / F.size(d)
    low, high = F.array_min(rr), F.array_max(rr)
    bins = F.greatest(F.lit(1), F.ceil((high - low + bin_ms) / bin_ms) - 1)  # edges go up to below high + bin_ms
    place = F.transform(rr, lambda x: F.least(F.floor((x - low) / bin_ms), bins - 1))
    counts = F.aggregate(F.array_sort(place), F.struct(F.lit(-1).cast("long").alias("v"), F.lit(0).alias("k"), F.lit(0).alias("best")), lambda s, v: F.struct(
        v.cast("long").alias("v"), F.when(v == s["v"], s["k"] + 1).otherwise(1).alias("k"), F.greatest(s["best"], F.when(v == s["v"], s["k"] + 1).otherwise(1)).alias("best")), lambda s: s["best"])
    hr = F.transform(rr, lambda x: 60000.0 / x)
    return {
        "n": n.cast("long"), "mean_nn": m, "median_nn": A.median(rr), "sdnn": sample_sd(rr), "rmssd": A.rms(d), "sdsd": sample_sd(d), "pnn50": share(50), "pnn20": share(20),
        "cvnn": sample_sd(rr) / m, "cvsd": A.rms(d) / m, "hti": n / counts, "hr_mean": A.mean(hr), "hr_std": F.sqrt(A.moment(hr, A.mean(hr), 2)), "hr_min": F.array_min(hr), "hr_max": F.array_max(hr),
        "hr_range": F.array_max(hr) - F.array_min(hr), "hr_median": A.median(hr),
    }


def hrv_nonlinear(rr: Column) -> dict[str, Column]:
    """SD1, SD2 (the deviation itself where the root has no value), their ratios and the log of their product."""
    d = A.diff(rr)
    var = lambda a: A.moment(a, A.mean(a), 2) * F.size(a) / (F.size(a) - 1)
    sd1, rest = F.sqrt(var(d) / 2), 2 * var(rr) - var(d) / 2
    sd2 = F.when(rest >= 0, F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(F.sqrt(var(rr)))
    return {"sd1": sd1, "sd2": sd2, "sd1_sd2": F.when(sd2 > 0, sd1 / sd2), "csi": F.when(sd1 > 0, sd2 / sd1), "cvi": F.when((sd1 > 0) & (sd2 > 0), F.log10(sd1 * sd2))}
