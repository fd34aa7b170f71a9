"""Feature tables: which columns and channels take part, per-segment kernels in one pass, odds-ratio-product summaries, events of a night."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.functions import cardiac as K
from nocturne.functions import spectral as S
from nocturne.operators.intervals import interval_join

# Names that breathing channels hold, columns that are not aggregated, suffixes of aggregates, gates.
BREATHING_NAMES = "airflow nasal oral thorax abdomen chest abdo flow thermistor cannula resp respiratory effort".split()
NOT_AGGREGATED = (
    "meta_ ann_global_ patient_id segment_idx _ctx_ ann_time_sec ann_time_min ann_time_hours ann_time_normalized ann_night_third ann_night_quartile ann_cycle_number ann_cycle_position_pct"
).split()
AGGREGATES = ("_mean", "_std", "_median", "_iqr")
ALWAYS_KEPT = ("_quality_ok", "_strategy", "_sqi")
LEAST_SQI = 0.5
NO_SPINDLES = ("W", "REM")

#: Groups of features by the names they hold.
FEATURE_GROUPS = {
    "hrv_time_domain": "hrv_sdnn hrv_rmssd hrv_pnn50 hrv_pnn20 hrv_sdsd hrv_mean_nn hrv_cv_nn hrv_hti",
    "hrv_frequency_domain": "hrv_vlf_power hrv_lf_power hrv_hf_power hrv_lf_hf_ratio hrv_lf_norm hrv_hf_norm hrv_total_power",
    "hrv_nonlinear": "hrv_sd1 hrv_sd2 hrv_sd1_sd2_ratio hrv_sample_entropy hrv_dfa_alpha1 hrv_csi hrv_cvi",
    "cardiac_autonomic": "rsa_p2t_mean rsa_coupling_strength rsa_resp_rate hr_mean hr_cv",
    "eeg_spectral": "delta_power theta_power alpha_power sigma_power beta_power spectral_entropy",
    "eeg_sleep_markers": "swa_power spindle_power_total spindle_prominence slow_spindle_power fast_spindle_power",
    "eeg_slowing": "theta_alpha_ratio delta_alpha_ratio slowing_ratio dar dtabr",
    "eeg_complexity": "sample_entropy permutation_entropy higuchi_fd dfa_alpha lzc hjorth_complexity",
    "spindle_detection": "_sp_density _sp_count _sp_amplitude_mean _sp_amplitude_std _sp_duration_mean _sp_duration_std _sp_frequency_mean _sp_frequency_std _sp_rms_mean _sp_slow_density _sp_fast_density "
    "_sp_fast_slow_ratio _sp_symmetry_mean _sp_rel_power_mean _sp_oscillations_mean",
    "slow_oscillation": "_so_density _so_count _so_ptp_amplitude_mean _so_ptp_amplitude_std _so_neg_peak_mean _so_neg_peak_std _so_pos_peak_mean _so_duration_mean _so_duration_std _so_slope_mean _so_slope_std _so_frequency_mean",
    "so_spindle_coupling": "_coup_count _coup_rate _coup_mrl _coup_mean_phase_rad _coup_mean_phase_deg _coup_phase_std_rad _coup_rayleigh_z _coup_rayleigh_p _coup_preferred_phase_quadrant _coup_pac_mi",
    "sleep_architecture": "sleep_efficiency tst_min waso_min n3_pct rem_pct sol_min rem_latency_min",
    "sleep_fragmentation": "arousal_index transition_index fragmentation_index stage_stability",
    "respiratory_events": "ahi central_apnea_index obstructive_apnea_index hypopnea_index apnea_burden",
    "demographics": "age sex bmi",
    "temporal_dynamics": "third_diff cycle_trend ctx_trend",
    "cap_parameters": "cap_CAPR cap_AVGCAPDUR cap_AVGCYCLEDUR cap_NCAPSEQ cap_CAPDUR cap_AVGBPHDUR cap_NRAPH cap_APHDUR cap_AVGAPHDUR cap_NRA1PH cap_NRA2PH cap_NRA3PH cap_A1PHDUR cap_A2PHDUR cap_A3PHDUR cap_SLDUR cap_RAPHSL",
    "delta_power_entropy": "Delta_Power_Entropy",
}


# ---------------------------------------------------------------- columns and channels


def selected_columns(columns: Iterable[str], selected: Iterable[str], keys: Iterable[str] = ("segment_idx",)) -> list[str]:
    """Columns that a selected feature, its aggregate taken off, ends with; keys and quality columns stay."""
    bare = {next((f[: -len(s)] for s in AGGREGATES if f.endswith(s)), f) for f in selected}
    return [c for c in columns if c in set(keys) or c.endswith(ALWAYS_KEPT) or any(f.endswith(c) for f in bare)]


def aggregated_columns(columns: Iterable[str]) -> list[str]:
    """Columns without any of the parts that are not aggregated."""
    return [c for c in columns if not any(p in c for p in NOT_AGGREGATED)]


def distinct_columns(df: DataFrame) -> DataFrame:
    """The first of columns with one name, names compared as they are."""
    seen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c, i)
    if len(seen) == len(df.columns):
        return df
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(c) for c, i in seen.items()])


def first_present(columns: Iterable[str], aliases: Iterable[str]) -> str | None:
    """The column that the first alias names, as it is or regardless of case."""
    columns = list(columns)
    lower = {c.lower(): c for c in reversed(columns)}
    return next((a if a in columns else lower[a.lower()] for a in aliases if a in columns or a.lower() in lower), None)


def coalesced(df: DataFrame, aliases: Iterable[str], kind: str = "string") -> Column:
    """The first alias of ``df`` that has a value in the row; null if no column is there."""
    found = [first_present(df.columns, [a]) for a in aliases]
    columns = [F.col(f"`{c}`").cast(kind) for c in dict.fromkeys(found) if c]
    return F.coalesce(*columns) if columns else F.lit(None).cast(kind)


def default_k(rows: int, columns: int) -> int:
    """Number of features to select: 3 roots of the rows, at most 75 and at least 10, and no more than there are."""
    return min(max(min(int(math.sqrt(rows) * 3), 75, columns), 10), columns)


def setting(values: dict[str, str], name: str, default):
    """A setting as the default's type: words for booleans, lists at commas and semicolons; what can't be read is the default."""
    given = values.get(name)
    if given is None:
        return default
    text = str(given).strip()
    if isinstance(default, bool):
        return True if text.lower() in {"1", "true", "t", "yes", "y", "on"} else False if text.lower() in {"0", "false", "f", "no", "n", "off"} else default
    if isinstance(default, int):
        return int(text) if text.lstrip("+-").isdigit() else default
    if isinstance(default, list):
        return [x.strip() for x in text.replace(";", ",").split(",") if x.strip()] or default
    return text


def breathing_channels(channels: DataFrame, label: str = "label", names: Iterable[str] = BREATHING_NAMES) -> DataFrame:
    """Channels whose label holds one of the names, with the first such name in list order."""
    text = F.lower(F.trim(label))
    name = F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in names])
    return channels.withColumn("matched", name).where(F.col("matched").isNotNull())


def first_channels(channels: DataFrame, record: str, label: str, position: str, targets: list[str]) -> DataFrame:
    """One channel for each record: the first in file order whose label, bare and in lower case, is one of the targets."""
    wanted = [t.lower().strip() for t in targets]
    rows = channels.where(F.lower(F.trim(label)).isin(wanted))
    w = Window.partitionBy(record).orderBy(position, label)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def by_priority(channels: DataFrame, record: str, label: str, priority: list[str], most: int = 2) -> DataFrame:
    """At most ``most`` derivations of each record, in order of a list; those that it lacks come last, by name."""
    place = F.coalesce(*[F.when(F.col(label) == p, F.lit(i)) for i, p in enumerate(priority)], F.lit(len(priority)))
    w = Window.partitionBy(record).orderBy(place, label)
    return channels.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def feature_groups(features: DataFrame, name: str = "feature") -> DataFrame:
    """(feature, grp) for each group that has a part of the feature's name; a feature may be in several."""
    tags = [F.when(F.exists(F.array(*[F.lit(p) for p in parts.split()]), lambda p: F.contains(F.col(name), p)), F.lit(g)) for g, parts in FEATURE_GROUPS.items()]
    return features.select(name, F.explode(F.array_compact(F.array(*tags))).alias("grp"))


def beside(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames of one segment grid side by side, joined on their keys and not by position; a column that came before stays."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(*keys, *[c for c in f.columns if c not in out.columns]), keys, "left")
    return out


def with_stage(segments: DataFrame, stages: DataFrame, keys: list[str], stage: str = "dominant_stage") -> DataFrame:
    """Segments with their dominant stage, Unknown where there is none."""
    return segments.join(stages.select(*keys, stage), keys, "left").withColumn(stage, F.coalesce(stage, F.lit("Unknown")))


def spindle_gate(segments: DataFrame, stage: str = "dominant_stage") -> DataFrame:
    """Segments that spindles and slow waves are looked for in: not awake and not REM; unknown stages are."""
    return segments.where(~F.coalesce(F.col(stage).isin(*NO_SPINDLES), F.lit(False)))


#: What a segment without annotations has.
EMPTY_STAGES = {
    "ann_dominant_stage": "Unknown", "ann_dominant_stage_numeric": 0, "ann_stage_stability": 0.0, "ann_n_stage_transitions": 0, "ann_n1_fraction": 0.0, "ann_n2_fraction": 0.0, "ann_n3_fraction": 0.0,
    "ann_rem_fraction": 0.0, "ann_w_fraction": 0.0, "ann_is_w": 0, "ann_is_n1": 0, "ann_is_n2": 0, "ann_is_n3": 0, "ann_is_rem": 0, "ann_sleep_depth": 0, "ann_is_sleep": 0, "ann_is_nrem": 0, "ann_stage_changed": 0,
    "ann_stage_will_change": 0, "ann_stage_duration_segments": 0, "ann_stage_duration_sec": 0.0, "ann_time_since_transition_sec": 0.0, "ann_time_to_transition_sec": 0.0,
}


def annotation_features(segments: DataFrame, stages: DataFrame | None, keys: list[str]) -> DataFrame:
    """Segments with the columns of EMPTY_STAGES: those of ``stages`` where it has them, defaults elsewhere."""
    have = [c for c in EMPTY_STAGES if stages is not None and c in stages.columns]
    out = segments.join(stages.select(*keys, *have), keys, "left") if have else segments
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in EMPTY_STAGES.items()})


# ---------------------------------------------------------------- segments of EEG

BASIC = ("mean", "std", "range", "skew", "kurtosis", "rms", "abs_mean", "duration_sec")


def basic_stats(x: np.ndarray, fs: float) -> dict[str, float]:
    d = x - x.mean()
    v = (d**2).mean()
    return dict(zip(BASIC, (x.mean(), math.sqrt(v), np.ptp(x), (d**3).mean() / v**1.5 if v > 0 else math.nan, (d**4).mean() / v**2 - 3 if v > 0 else math.nan, math.sqrt((x**2).mean()), np.abs(x).mean(), len(x) / fs)))


def hjorth(x: np.ndarray, fs: float) -> dict[str, float]:
    d = np.diff(x)
    va, vd, ve = x.var(), d.var(), np.diff(d).var()
    mobility = math.sqrt(vd / va) if va > 0 else math.nan
    return {"hjorth_activity": va, "hjorth_mobility": mobility, "hjorth_complexity": math.sqrt(ve / vd) / mobility if vd > 0 and va > 0 else math.nan}


def shape(x: np.ndarray, fs: float) -> dict[str, float]:
    """Zero crossings and peaks (100 ms apart) a second, line length, variation of energy over ten parts, interquartile range."""
    seconds = len(x) / fs
    energy = (x[: len(x) // 10 * 10].reshape(10, -1) ** 2).sum(axis=1) if len(x) >= 10 else np.zeros(1)
    line = np.abs(np.diff(x)).sum()
    return {
        "zero_crossings_per_sec": float((np.diff(np.signbit(x - x.mean()).astype(int)) != 0).sum()) / seconds, "line_length": line, "line_length_norm": line / len(x),
        "peaks_per_sec": len(K.local_peaks(x, max(1, int(0.1 * fs)))) / seconds, "energy_cv": energy.std() / energy.mean() if energy.mean() > 0 else math.nan, "iqr": float(np.subtract(*np.percentile(x, [75, 25]))),
    }


EEG_KERNELS = {
    "basic": basic_stats, "psd": S.psd_bandpower, "spectral": S.spectral_entropy_sef, "sleep": S.sleep_bands, "hjorth": hjorth, "shape": shape,
    "sampen": S.sample_entropy, "apen": S.approximate_entropy, "higuchi": S.higuchi, "dfa": S.dfa, "lzc": S.lempel_ziv,
}
_PROBE = np.sin(np.arange(400) * 0.7) + np.cos(np.arange(400) * 0.13)
EEG_FIELDS = {k: list(f(_PROBE, 100.0)) for k, f in EEG_KERNELS.items()}


def eeg_features(segments: DataFrame, prefix: str = "eeg", wanted: Iterable[str] | None = None) -> DataFrame:
    """A row of features for each segment, all kernels in one pass over the samples.

    ``segments`` has patient_id, channel, segment_idx, fs, sqi and data.  Below LEAST_SQI only
    the basic statistics are worked out, without data none; what isn't is null.  With
    ``wanted`` (selected features) only the kernels that give one of them run.
    """
    names = {k: [f"{prefix}_{c}" for c in fields] for k, fields in EEG_FIELDS.items()}
    if wanted is not None:
        names = {k: selected_columns(v, wanted, ()) for k, v in names.items()}
    names = {k: v for k, v in names.items() if v}
    columns = [c for v in names.values() for c in v]

    @F.pandas_udf(", ".join(f"`{c}` double" for c in columns))
    def run(data: pd.Series, fs: pd.Series, sqi: pd.Series) -> pd.DataFrame:
        rows = []
        for a, rate, q in zip(data, fs, sqi):
            row = dict.fromkeys(columns, math.nan)
            x = S.interpolate_gaps(np.asarray(a, float)) if a is not None and len(a) >= 2 * rate else None
            for k in names if x is not None else ():
                if k == "basic" or q >= LEAST_SQI:
                    found = {f"{prefix}_{c}": v for c, v in EEG_KERNELS[k](x, rate).items()}
                    row |= {c: found[c] for c in names[k]}
            rows.append(row)
        return pd.DataFrame(rows, columns=columns)

    keys = ["patient_id", "channel", "segment_idx"]
    ok = F.coalesce((F.col("sqi") >= LEAST_SQI) & F.col("data").isNotNull(), F.lit(False)).alias(f"{prefix}_quality_ok")
    return segments.withColumn("_f", run("data", "fs", F.coalesce("sqi", F.lit(0.0)))).select(*keys, ok, "_f.*")


def coherence(segments: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(patient_id, segment_idx, left_ch, right_ch, a coherence for each band, total) of pairs of channels, 4 s windows."""
    bands = [*S.BANDS, "total"]

    @F.pandas_udf(", ".join(f"{b}_coherence double" for b in bands))
    def run(left: pd.Series, right: pd.Series, fs: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, rate in zip(left, right, fs):
            n = min(len(a), len(b))
            f, c = K.coherence(np.asarray(a, float)[:n], np.asarray(b, float)[:n], rate, int(4 * rate))
            spans = [*S.BANDS.values(), (0.5, 35.0)]
            rows.append([c[(f >= low) & (f <= high)].mean() if ((f >= low) & (f <= high)).any() else math.nan for low, high in spans])
        return pd.DataFrame(rows, columns=[f"{b}_coherence" for b in bands])

    names = segments.sparkSession.createDataFrame(pairs, "left_ch string, right_ch string")
    rows = segments.where("data is not null")
    left = rows.select("patient_id", "segment_idx", "fs", F.col("channel").alias("left_ch"), F.col("data").alias("l")).join(F.broadcast(names), "left_ch")
    both = left.join(rows.select("patient_id", "segment_idx", F.col("channel").alias("right_ch"), F.col("data").alias("r")), ["patient_id", "segment_idx", "right_ch"])
    return both.withColumn("_c", run("l", "r", "fs")).select("patient_id", "segment_idx", "left_ch", "right_ch", "_c.*")


def delta_windows(recordings: DataFrame, window: float = 5.0, bandwidth: float = 2.0, band: tuple[float, float] = (0.5, 4.0), limits: tuple[float, float] = (0.5, 200.0)) -> DataFrame:
    """(patient_id, channel, window_idx, start_sec, power, clean) of each whole window: summed multitaper density of a band, and whether the amplitude is within limits in some channel."""
    low, high = band

    @F.pandas_udf("array<struct<power double, span double>>")
    def run(samples: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for a, rate in zip(samples, fs):
            size = int(window * rate)
            x = np.asarray(a, float)
            parts = x[: len(x) // size * size].reshape(-1, size)
            rows = []
            for part in parts:
                f, p = S.multitaper(part, rate, bandwidth)
                rows.append({"power": float(p[(f >= low) & (f <= high)].sum()), "span": float(np.ptp(part))})
            out.append(rows)
        return pd.Series(out)

    rows = recordings.select("patient_id", "channel", F.posexplode(run("samples", "fs")).alias("window_idx", "w"))
    rows = rows.select("patient_id", "channel", "window_idx", (F.col("window_idx") * window).alias("start_sec"), "w.*")
    fine = F.max(F.col("span").between(*limits)).over(Window.partitionBy("patient_id", "window_idx"))
    return rows.withColumn("clean", fine).drop("span")


def delta_entropy(windows: DataFrame, key: str = "patient_id") -> DataFrame:
    """(key, delta_power_entropy): mean over channels of the spectrum entropy of the smoothed delta power of a night.

    ``windows`` has key, channel, window_idx, power, clean and stage; windows that aren't
    clean and those awake or in N1 count as 0.  A channel's windows, which a night bounds,
    are one array.
    """

    @F.pandas_udf("double")
    def run(powers: pd.Series) -> pd.Series:
        out = []
        for p in powers:
            x = S.gaussian(np.asarray(p, float), 10.0)
            if not x.sum() > 0:
                out.append(None)
                continue
            f = np.abs(np.fft.fft(x / x.sum())[: len(x) // 2])
            f = f[f > 0]
            out.append(float(-(f * np.log2(f)).sum()))
        return pd.Series(out)

    power = F.when(F.col("clean") & ~F.col("stage").isin("W", "N1"), F.col("power")).otherwise(0.0)
    rows = windows.groupBy(key, "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("window_idx", power.alias("p")))), lambda x: x["p"]).alias("p"))
    return rows.withColumn("_e", run("p")).groupBy(key).agg(F.avg("_e").alias("delta_power_entropy"))


# ---------------------------------------------------------------- odds ratio product, events


def orp_by_stage(windows: DataFrame, key: str, window: float = 5.0) -> DataFrame:
    """(key, nrem mean and deviation, rem, wake, csi) over clean windows; nrem is N2 and N3.

    The cumulative sleep index is minutes of clean sleep times (2.5 - mean of sleep).
    """
    rows = windows.where("clean")
    own = lambda *s: F.when(F.col("stage").isin(*s), F.col("orp"))
    asleep = ("N1", "N2", "N3", "REM")
    minutes = F.count_if(F.col("stage").isin(*asleep)) * F.lit(window / 60.0)
    return rows.groupBy(key).agg(
        F.avg(own("N2", "N3")).alias("orp_nrem"), F.stddev_pop(own("N2", "N3")).alias("orp_nrem_std"), F.avg(own("REM")).alias("orp_rem"), F.avg(own("W")).alias("orp_wake"),
        (minutes * (2.5 - F.avg(own(*asleep)))).alias("csi"),
    )


def orp_around_arousals(windows: DataFrame, arousals: DataFrame, key: str, window: float = 5.0, after: float = 9.0, width: float = 300.0) -> DataFrame:
    """(key, orp_apeak, orp_a9): mean over arousals of the greatest value in windows that overlap one, and of the mean of windows that start within ``after`` seconds of its end."""
    rows = windows.where("clean").select(key, F.col("start_sec").alias("w_start"), (F.col("start_sec") + window).alias("w_end"), "orp")
    events = arousals.select(key, F.col("start_sec").alias("a_start"), F.col("end_sec").alias("a_end"))
    one = [key, "a_start", "a_end"]
    peak = interval_join(events, rows, key, ("a_start", "a_end"), ("w_start", "w_end"), width).groupBy(*one).agg(F.max("orp").alias("v"))
    late = events.withColumn("a_stop", F.col("a_end") + after)
    points = rows.select(key, "w_start", F.col("w_start").alias("w_same"), "orp")
    nine = interval_join(late, points, key, ("a_end", "a_stop"), ("w_start", "w_same"), width, touching=True).where("w_start < a_stop").groupBy(*one).agg(F.avg("orp").alias("v"))
    a, b = (x.groupBy(key).agg(F.avg("v").alias(n)) for x, n in ((peak, "orp_apeak"), (nine, "orp_a9")))
    return events.select(key).distinct().join(a, key, "left").join(b, key, "left")


def event_indices(nights: DataFrame, events: DataFrame, key: str, hours: str, types: list[str], apneas: list[str], arousal: str) -> DataFrame:
    """Per night and type: count, events an hour, mean and greatest duration (0 without events); ahi and arousal_index, null for a night without any event.

    ``nights`` has the key and the hours asleep; with none of these an index is 0.
    """
    own = lambda t: F.col("event_type") == t
    aggs = [F.count(F.lit(1)).alias("_all"), F.count_if(F.col("event_type").isin(*apneas)).alias("_apneas"), F.count_if(own(arousal)).alias("_arousals")]
    for t in types:
        aggs += [F.count_if(own(t)).alias(f"{t}_count"), F.avg(F.when(own(t), F.col("duration_sec"))).alias(f"{t}_mean_duration_sec"), F.max(F.when(own(t), F.col("duration_sec"))).alias(f"{t}_max_duration_sec")]
    out = nights.select(key, F.col(hours).alias("_h")).join(events.groupBy(key).agg(*aggs), key, "left")
    index = lambda c: F.when(F.col("_h") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("_h")).otherwise(0.0)
    columns = []
    for t in types:
        columns += [F.coalesce(f"{t}_count", F.lit(0)).cast("long").alias(f"{t}_count"), index(f"{t}_count").alias(f"{t}_index")]
        columns += [F.coalesce(f"{t}_{m}_duration_sec", F.lit(0.0)).alias(f"{t}_{m}_duration_sec") for m in ("mean", "max")]
    whole = lambda c: F.when(F.col("_all").isNotNull(), index(c))
    return out.select(key, *columns, whole("_apneas").alias("ahi"), whole("_arousals").alias("arousal_index"))


def pipeline_stats(segments: DataFrame, key: str, kind: str, valid: Column, quality: str, channel: str) -> DataFrame:
    """What came of each recording: segments in all, valid and rejected ones of each kind (ecg, eeg), mean quality, channels used."""
    aggs = [F.count(F.lit(1)).alias("total_segments")]
    for k in ("ecg", "eeg"):
        own = F.col(kind) == k
        aggs += [F.count_if(own & valid).alias(f"valid_{k}_segments"), F.count_if(own & ~valid).alias(f"rejected_{k}_segments"), F.avg(F.when(own, F.col(quality))).alias(f"mean_{k}_sqi")]
    aggs.append(F.array_join(F.array_sort(F.collect_set(F.when((F.col(kind) == "eeg") & valid, F.col(channel)))), ",").alias("eeg_channels_used"))
    return segments.groupBy(key).agg(*aggs)
