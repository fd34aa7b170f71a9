"""Cyclic alternating pattern: second-by-second features, smoothing of labels, distances, sequences and statistics.

A recording's seconds are rows (key, at, code); windows run over a recording, which a night
bounds.  The sequence network is not part of this package: predict_in_chunks() takes any
function of a matrix, and without one every label is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.functions import spectral as S

#: The network's bands in Hz, and the names of the features and of the statistics.
CAP_BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 25.0)}
CAP_FEATURES = (
    "hjorth_activity shannon_entropy teo_delta teo_theta teo_alpha teo_sigma teo_beta power_delta power_theta power_alpha power_sigma power_beta variance_diff wake_rem_distance"
).split()
PHASE_STATS = "NRA{k} A{k}DUR AVGA{k}DUR RA{k}APH RA{k}NRE A{k}IND"


# ---------------------------------------------------------------- kernels


def per_second(x: np.ndarray, fs: int) -> np.ndarray:
    """The whole seconds of a signal, a row each."""
    return x[: len(x) // fs * fs].reshape(-1, fs)


def hjorth_activity(x: np.ndarray, fs: int, window: int = 3) -> np.ndarray:
    """Variance of windows of ``window`` seconds, a second apart."""
    if len(x) < window * fs:
        return np.zeros(0)
    return np.lib.stride_tricks.sliding_window_view(x, window * fs)[::fs].var(axis=1)


def histogram_entropy(x: np.ndarray, fs: int, window: int = 2, bins: int = 32) -> np.ndarray:
    """Entropy in bits of a histogram over windows' own ranges; windows overlap by half.

    A value on an inner edge belongs to the bin below it, the least value to the first bin.
    """
    size = window * fs
    if len(x) < size:
        return np.zeros(0)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 2]
    low, high = parts.min(axis=1, keepdims=True), parts.max(axis=1, keepdims=True)
    width = np.where(high > low, high - low, 1e-12) / bins
    at = np.clip(np.ceil((parts - low) / width).astype(int) - 1, 0, bins - 1)
    counts = np.zeros((len(parts), bins))
    np.add.at(counts, (np.arange(len(parts))[:, None], at), 1.0)
    share = counts / (size * width) + 1e-12
    share /= share.sum(axis=1, keepdims=True)
    return -(share * np.log2(share)).sum(axis=1)


def teager_energy(x: np.ndarray, fs: int) -> np.ndarray:
    """Mean of x[n+1]^2 - x[n] x[n+2] in each second."""
    return per_second(x[1:-1] ** 2 - x[:-2] * x[2:], fs).mean(axis=1) if len(x) > 2 else np.zeros(0)


def second_power(x: np.ndarray, fs: int, smooth: int = 0) -> np.ndarray:
    """Mean square of each second, and on demand its running mean over ``smooth`` seconds with mirrored ends."""
    power = (per_second(x, fs) ** 2).mean(axis=1)
    if smooth and len(power):
        half = smooth // 2
        mirrored = np.pad(power, half, mode="symmetric")
        power = np.convolve(mirrored, np.ones(smooth) / smooth, "valid")
    return power


def variance_steps(x: np.ndarray, fs: int) -> np.ndarray:
    """Change of the variance from second to second, 0 for the first."""
    v = per_second(x, fs).var(axis=1)
    return np.diff(v, prepend=v[:1])


def cap_matrix(x: np.ndarray, fs: float, distance: np.ndarray) -> np.ndarray:
    """Seconds x 14 features, cut to the shortest; ``distance`` is that to the next wake or REM second."""
    x, rate = np.asarray(x, float), int(fs)
    band = {b: S.filtfilt(S.butter_bandpass(*hz, fs), x) for b, hz in CAP_BANDS.items()}
    columns = [hjorth_activity(band["delta"], rate), histogram_entropy(x, rate)]
    columns += [teager_energy(band[b], rate) for b in CAP_BANDS]
    columns += [second_power(band[b], rate, 0 if b == "delta" else 5) for b in CAP_BANDS]
    columns += [variance_steps(x, rate), np.asarray(distance, float)]
    n = min(map(len, columns))
    return np.column_stack([c[:n] for c in columns])


def robust_rows(m: np.ndarray) -> np.ndarray:
    """Each second's features less their median, over their interquartile range."""
    low, mid, high = np.percentile(m, [25, 50, 75], axis=1, keepdims=True)
    return (m - mid) / (high - low + 1e-8)


def chunk_spans(n: int, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, first kept) of chunks that overlap; the overlap at a chunk's begin warms up and is discarded."""
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        out.append((start, end, start + (overlap if start else 0)))
        if end == n:
            break
        start += max(1, size - overlap)
    return out


# ---------------------------------------------------------------- operators


def cap_features(recordings: DataFrame) -> DataFrame:
    """(patient_id, at, the 14 features) of each second; ``recordings`` has patient_id, fs, samples and distance (array)."""
    kind = recordings.schema["patient_id"].dataType.simpleString()
    schema = f"patient_id {kind}, at int, " + ", ".join(f"{c} double" for c in CAP_FEATURES)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                m = cap_matrix(np.asarray(r.samples, float), r.fs, np.asarray(r.distance, float))
                out = pd.DataFrame(m, columns=CAP_FEATURES)
                out.insert(0, "at", np.arange(len(m), dtype=np.int32))
                out.insert(0, "patient_id", r.patient_id)
                yield out

    return recordings.select("patient_id", "fs", "samples", "distance").mapInPandas(kernel, schema)


def predict_in_chunks(features: DataFrame, key: str, network: Callable[[np.ndarray], np.ndarray] | None, size: int = 3600, overlap: int = 120) -> DataFrame:
    """(key, at, code): labels of a network that sees at most ``size`` seconds at once; without a network the labels are null.

    Each chunk is a row group of its own: a second is dealt to its chunk and, in the overlap,
    to the next one too, so a long recording is spread over tasks.
    """
    if network is None:
        return features.select(key, "at", F.lit(None).cast("int").alias("code"))
    step = max(1, size - overlap)
    last = F.max("at").over(Window.partitionBy(key))
    own = F.floor(F.col("at") / step).cast("int")
    rows = features.withColumn("_last", last).withColumn("_chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("at") - size + 1) / step).cast("int")), own)))
    # A chunk exists only if the one before does not reach the end.
    rows = rows.where((F.col("_chunk") == 0) | ((F.col("_chunk") - 1) * step + size <= F.col("_last")))
    names = [c for c in features.columns if c not in (key, "at")]
    kind = features.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        codes = np.asarray(network(robust_rows(part[names].to_numpy(float)))).astype(np.int32)
        out = pd.DataFrame({key: part[key].to_numpy(), "at": part["at"].to_numpy(), "code": codes})
        return out.iloc[0 if part["_chunk"].iloc[0] == 0 else overlap :]

    return rows.drop("_last").groupBy(key, "_chunk").applyInPandas(run, f"{key} {kind}, at int, code int")


def smooth_phases(seconds: DataFrame, key: str, at: str, code: str) -> DataFrame:
    """Runs of codes above 0: a run of one second is dropped, any other gets its most frequent code, the least of equals.

    One pass reaches the state that further passes leave as it is.
    """
    w = Window.partitionBy(key).orderBy(at)
    on = F.col(code) > 0
    rows = seconds.withColumn("_on", on).withColumn("_new", F.coalesce((F.col("_on") != F.lag("_on").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_run")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(run), "_k": F.count(F.lit(1)).over(Window.partitionBy(key, "_run", code))})
    best = -F.max(F.struct("_k", (-F.col(code)).alias("c"))).over(run)["c"]
    smoothed = F.when(~F.col("_on") | (F.col("_n") == 1), 0).otherwise(best).cast("int")
    return rows.withColumn(code, smoothed).drop("_on", "_new", "_run", "_n", "_k")


def smooth_flags(epochs: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """A 0/1 flag without islands and gaps of one or two epochs: single ones, pairs of ones, single zeros, pairs of zeros, in turn."""
    w = Window.partitionBy(key).orderBy(at)
    out = epochs
    for value in (1, 0):
        x = F.col(flag)
        side = lambda k, v: F.coalesce((F.lag(flag, k).over(w) if k > 0 else F.lead(flag, -k).over(w)) == v, F.lit(False))
        out = out.withColumn(flag, F.when((x == value) & side(1, 1 - value) & side(-1, 1 - value), 1 - value).otherwise(x))
        pair = (side(1, 1 - value) & side(-1, value) & side(-2, 1 - value)) | (side(1, value) & side(2, 1 - value) & side(-1, 1 - value))
        out = out.withColumn(flag, F.when((x == value) & pair, 1 - value).otherwise(x))
    return out


def distance_ahead(seconds: DataFrame, key: str, at: str, flag: Column, name: str = "distance") -> DataFrame:
    """Seconds to the next flagged one, itself counted; 0 within, the recording's length if none is ahead."""
    # Backwards, so that the frame only grows; one that shrinks is gone through anew for every row.
    w = Window.partitionBy(key).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.min(F.when(flag, F.col(at))).over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return seconds.withColumn(name, F.when(flag, 0).otherwise(F.coalesce(ahead - F.col(at) + 1, n)).cast("long"))


def phases(seconds: DataFrame, key: str, at: str, code: str) -> DataFrame:
    """(key, code, start, stop, n) of each run of one code above 0; stop is its last second."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(code) != F.lag(code).over(w)).cast("int"), F.lit(0))
    rows = seconds.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where(F.col(code) > 0).groupBy(key, "_run", code).agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count(F.lit(1)).alias("n"))
    return out.drop("_run")


def phase_sequences(runs: DataFrame, key: str, gap: float = 60, longest: float = 60, least: int = 3) -> DataFrame:
    """Phases with the number of their sequence: phases no longer than ``longest``, each within ``gap`` seconds of the one before; ``least`` of them."""
    w = Window.partitionBy(key).orderBy("start")
    long = F.col("stop") - F.col("start") > longest
    rows = runs.withColumn("_long", long).withColumn("_cut", F.sum(F.col("_long").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not _long")
    new = F.lag("stop").over(w).isNull() | (F.col("start") - F.lag("stop").over(w) - 1 > gap) | (F.lag("_cut").over(w) != F.col("_cut"))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(key, "seq"))).where(F.col("_size") >= least).drop("_long", "_cut", "_new", "_size")


def cap_statistics(seconds: DataFrame, key: str, at: str, code: str, gap: float = 60, extra: int = 13) -> DataFrame:
    """The 30 statistics of each recording, zero where there is nothing to count.

    An A-phase is a run of codes above 0 of any kind, and of a kind for the kind's own
    counts; the sleep duration is the number of labels and ``extra`` seconds.  A cycle goes
    from one A-phase of a sequence to the next, the last one to the sequence's end; a
    B-phase lies between two.
    """
    any_ = phases(seconds.withColumn(code, (F.col(code) > 0).cast("int")), key, at, code)
    kinds = phases(seconds, key, at, code)
    total = seconds.groupBy(key).agg((F.count(F.lit(1)) + extra).alias("cap_SLDUR"))
    a = any_.groupBy(key).agg(F.count(F.lit(1)).alias("cap_NRAPH"), F.sum("n").alias("cap_APHDUR"))
    k = kinds.groupBy(key).agg(*[x for c in (1, 2, 3) for x in (F.count_if(F.col(code) == c).alias(f"cap_NRA{c}"), F.sum(F.when(F.col(code) == c, F.col("n"))).alias(f"cap_A{c}DUR"))])
    w = Window.partitionBy(key, "seq").orderBy("start")
    seq = phase_sequences(any_, key, gap).withColumns({"_next": F.lead("start").over(w)})
    seq = seq.withColumns({"_cycle": F.coalesce(F.col("_next"), F.col("stop")) - F.col("start"), "_b": F.col("_next") - F.col("stop")})
    each = seq.groupBy(key, "seq").agg((F.max("stop") - F.min("start")).alias("_dur"), F.sum("_cycle").alias("_cycle"), F.count("_cycle").alias("_cycles"), F.sum("_b").alias("_b"), F.count("_b").alias("_bs"))
    c = each.groupBy(key).agg(F.count(F.lit(1)).alias("cap_NRCAP"), F.sum("_dur").alias("cap_CAPDUR"), (F.sum("_cycle") / F.sum("_cycles")).alias("cap_AVGCYCLEDUR"), (F.sum("_b") / F.sum("_bs")).alias("cap_AVGBPHADUR"))
    out = total.join(a, key, "left").join(k, key, "left").join(c, key, "left").na.fill(0)
    div = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0))
    hours = lambda x: F.col(x) / F.col("cap_SLDUR") * 3600.0
    columns = {
        "cap_SLDUR": F.col("cap_SLDUR"), "cap_NRAPH": F.col("cap_NRAPH"), "cap_APHDUR": F.col("cap_APHDUR"), "cap_AVGAPHDUR": div("cap_APHDUR", "cap_NRAPH"),
        "cap_NRAPHPH": hours("cap_NRAPH"), "cap_RAPHSL": div("cap_APHDUR", "cap_SLDUR"),
    }
    for n in (1, 2, 3):
        number, length = f"cap_NRA{n}", f"cap_A{n}DUR"
        values = (F.col(number), F.col(length), div(length, number), div(number, "cap_NRAPH"), div(length, "cap_SLDUR"), hours(number))
        columns |= {f"cap_{name}": v for name, v in zip(PHASE_STATS.format(k=n).split(), values)}
    columns |= {
        "cap_NRCAP": F.col("cap_NRCAP"), "cap_CAPDUR": F.col("cap_CAPDUR"), "cap_RCAPSL": div("cap_CAPDUR", "cap_SLDUR") * 100, "cap_AVGCAPDUR": div("cap_CAPDUR", "cap_NRCAP"),
        "cap_AVGCYCLEDUR": F.col("cap_AVGCYCLEDUR").cast("double"), "cap_AVGBPHADUR": F.col("cap_AVGBPHADUR").cast("double"),
    }
    return out.select(key, *[v.alias(n) for n, v in columns.items()])
