"""Spectral, complexity and filter kernels in NumPy, and their Arrow-batched UDFs.

Conventions: Welch with a Hann window, half overlap, constant detrend and one-sided
density scaling; zero-phase filtering runs forward and backward over odd extensions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# EEG bands in Hz, both ends inclusive, and HRV bands, half open.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 30.0)}
HRV_BANDS = {"vlf": (0.003, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4)}


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    size = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = max(1, size - size // 2)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    parts = (parts - parts.mean(axis=1, keepdims=True)) * window
    power = np.abs(np.fft.rfft(parts, axis=1)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power.mean(axis=0)


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float, closed: bool = True) -> float:
    inside = (f >= low) & ((f <= high) if closed else (f < high))
    return float(np.trapezoid(p[inside], f[inside])) if inside.sum() > 1 else 0.0


def psd_bandpower(x: np.ndarray, fs: float) -> dict[str, float]:
    f, p = welch(x, fs, int(4 * fs))
    whole = band_power(f, p, 0.5, 35.0)
    out = {f"{b}_abs": band_power(f, p, *r) for b, r in BANDS.items()}
    out |= {f"{b}_rel": out[f"{b}_abs"] / whole if whole > 0 else math.nan for b in BANDS}
    inside = (f >= 0.5) & (f <= 35)
    out["total"] = whole
    out["peak_hz"] = float(f[inside][np.argmax(p[inside])]) if inside.any() else math.nan
    out["centroid"] = float((f[inside] * p[inside]).sum() / p[inside].sum()) if p[inside].sum() > 0 else math.nan
    return out


def spectral_entropy_sef(x: np.ndarray, fs: float) -> dict[str, float]:
    f, p = welch(x, fs, int(4 * fs))
    inside = (f >= 0.5) & (f <= 35)
    f, p = f[inside], p[inside]
    if not len(p) or p.sum() <= 0:
        return {"entropy": math.nan, "sef50": math.nan, "sef95": math.nan}
    share = p / p.sum()
    positive = share[share > 0]
    cumulative = np.concatenate(([0.0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(f))))
    edge = lambda q: float(f[np.searchsorted(cumulative, q * cumulative[-1])])
    return {"entropy": float(-(positive * np.log2(positive)).sum() / np.log2(len(share))), "sef50": edge(0.5), "sef95": edge(0.95)}


def sleep_bands(x: np.ndarray, fs: float) -> dict[str, float]:
    """Slow-wave, slow and fast spindle power, prominence of the spindle band among its neighbours, and ratios of bands."""
    f, p = welch(x, fs, int(4 * fs))
    b = {n: band_power(f, p, *r) for n, r in BANDS.items()}
    div = lambda a, c: a / c if c > 0 else math.nan
    swa, beside = band_power(f, p, 0.5, 2.0), (b["theta"] + b["beta"]) / 2
    slowing = div(b["delta"] + b["theta"], b["alpha"] + b["beta"])
    return {
        "swa_power": swa, "swa_power_log": math.log10(swa + 1e-10), "slow_spindle_power": band_power(f, p, 12.0, 14.0), "fast_spindle_power": band_power(f, p, 14.0, 16.0), "spindle_power_total": b["sigma"],
        "spindle_prominence": b["sigma"] / (beside if beside > 0 else 1.0), "alpha_theta_ratio": div(b["alpha"], b["theta"]), "theta_alpha_ratio": div(b["theta"], b["alpha"]), "delta_alpha_ratio": div(b["delta"], b["alpha"]),
        "delta_beta_ratio": div(b["delta"], b["beta"]), "slowing_ratio": slowing, "dar": b["delta"] / (b["alpha"] + 1e-10) if b["alpha"] > 0 else math.nan, "dtabr": slowing,
    }


_TAPERS: dict[tuple[int, float], tuple[np.ndarray, np.ndarray]] = {}


def tapers(n: int, half: float) -> tuple[np.ndarray, np.ndarray]:
    """(Slepian sequences of unit energy, a row each, their weights) for a time half-bandwidth product; kept for the next call.

    They are the eigenvectors with the largest eigenvalues of a tridiagonal matrix; a
    weight is the share of a sequence's energy within the band, and those below 0.9 are left out.
    """
    key = (n, half)
    if key not in _TAPERS:
        at, w = np.arange(n), half / n
        side = at[1:] * (n - at[1:]) / 2.0
        matrix = np.diag(((n - 1) / 2.0 - at) ** 2 * np.cos(2 * np.pi * w)) + np.diag(side, 1) + np.diag(side, -1)
        rows = np.linalg.eigh(matrix)[1][:, ::-1][:, : max(1, int(2 * half) - 1)].T
        lag = np.arange(1, n)
        kernel = np.concatenate(([2 * w], np.sin(2 * np.pi * w * lag) / (np.pi * lag)))
        share = []
        for v in rows:
            auto = np.correlate(v, v, "full")[n - 1 :]
            share.append(kernel[0] * auto[0] + 2 * (kernel[1:] * auto[1:]).sum())
        share = np.array(share)
        keep = share > 0.9 if (share > 0.9).any() else np.arange(len(share)) == 0
        _TAPERS[key] = rows[keep], share[keep]
    return _TAPERS[key]


def multitaper(x: np.ndarray, fs: float, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided density), the tapers' spectra averaged by their weights, the mean taken off first."""
    rows, weight = tapers(len(x), bandwidth * len(x) / fs / 2)
    spectra = np.abs(np.fft.rfft((x - x.mean()) * rows, axis=1)) ** 2 / fs
    p = (spectra * weight[:, None]).sum(axis=0) / weight.sum()
    p[1 : (-1 if len(x) % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(len(x), 1 / fs), p


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing cut at 4 deviations, the ends mirrored with the edge sample repeated."""
    half = int(4 * sigma + 0.5)
    at = np.arange(-half, half + 1)
    weight = np.exp(-0.5 * (at / sigma) ** 2)
    return np.convolve(np.pad(x, half, mode="symmetric"), weight / weight.sum(), "valid") if len(x) else x


def dfa(x: np.ndarray, fs: float = 1.0) -> dict[str, float]:
    """Exponent of the mean residual of linear fits against box size, 20 log-spaced sizes from 4 to n/4."""
    y = np.cumsum(x - x.mean())
    sizes = np.unique(np.logspace(np.log10(4), np.log10(max(4, len(x) // 4)), 20).astype(int))
    points = []
    for n in sizes:
        boxes = y[: len(y) // n * n].reshape(-1, n)
        t = np.arange(n) - (n - 1) / 2
        slope = boxes @ t / (t @ t)
        rest = boxes - boxes.mean(axis=1, keepdims=True) - slope[:, None] * t
        points.append(np.sqrt((rest**2).mean(axis=1)).mean())
    points = np.array(points)
    ok = points > 0
    return {"dfa": float(np.polyfit(np.log(sizes[ok]), np.log(points[ok]), 1)[0]) if ok.sum() >= 4 else math.nan}


def higuchi(x: np.ndarray, fs: float = 1.0, k_max: int = 10) -> dict[str, float]:
    n, lengths, ks = len(x), [], []
    for k in range(1, min(k_max, n // 2) + 1):
        own = []
        for m in range(k):
            part = x[m::k]
            if len(part) > 1:
                own.append(np.abs(np.diff(part)).sum() * (n - 1) / ((len(part) - 1) * k) / k)
        if own and np.mean(own) > 0:
            lengths.append(np.log(np.mean(own)))
            ks.append(np.log(1 / k))
    return {"higuchi_fd": float(np.polyfit(ks, lengths, 1)[0]) if len(ks) > 1 else math.nan}


def lempel_ziv(x: np.ndarray, fs: float = 1.0) -> dict[str, float]:
    """Number of phrases of the signal cut at its median, over n / log2 n."""
    bits = "".join("1" if v > np.median(x) else "0" for v in x)
    at, phrases, n = 0, 0, len(bits)
    while at < n:
        size = 1
        while at + size <= n and bits[at : at + size] in bits[: at + size - 1]:
            size += 1
        phrases += 1
        at += size
    return {"lempel_ziv": phrases * math.log2(n) / n if n > 1 else math.nan}


def strided(x: np.ndarray, most: int = 5000) -> np.ndarray:
    """The whole signal, at a stride that leaves about ``most`` samples of it."""
    return x[:: len(x) // most] if len(x) > most else x


def sample_entropy(x: np.ndarray, fs: float = 1.0, m: int = 2, r: float = 0.2) -> dict[str, float]:
    """-log of the share of template matches that last one sample longer; tolerance r times the deviation, strict.

    Long signals are taken at a stride over their whole length.
    """
    x = strided(x)
    limit, n = r * x.std(), len(x) - m
    if n < 2 or limit == 0:
        return {"sample_entropy": math.nan}
    short = longer = 0
    for lag in range(1, n):  # pairs of templates that lie ``lag`` apart, for all places at once
        near = np.abs(x[lag:] - x[:-lag]) < limit
        both = near[: n - lag].copy()
        for k in range(1, m):
            both &= near[k : k + n - lag]
        short += int(both.sum())
        longer += int((both & near[m : m + n - lag]).sum())
    return {"sample_entropy": -math.log(longer / short) if longer and short else math.nan}


def approximate_entropy(x: np.ndarray, fs: float = 1.0, m: int = 2, r: float = 0.2) -> dict[str, float]:
    """Drop of the mean log share of templates within the tolerance, from m to m + 1 samples; long signals at a stride over their whole length."""
    x = strided(x)
    limit = r * x.std()

    def phi(size: int) -> float:
        t = np.lib.stride_tricks.sliding_window_view(x, size)
        share = [(np.abs(t - v).max(axis=1) <= limit).mean() for v in t]
        return float(np.log(share).mean())

    return {"approx_entropy": phi(m) - phi(m + 1) if len(x) > m + 1 and limit > 0 else math.nan}


def butter_bandpass(low: float, high: float, fs: float, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a Butterworth band-pass by the bilinear transform."""
    low, high = np.clip([low / (fs / 2), high / (fs / 2)], 0.001, 0.999)
    a, b = 4 * np.tan(np.pi * low / 2), 4 * np.tan(np.pi * high / 2)  # at a sampling rate of 2
    width, centre = b - a, math.sqrt(a * b)
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    scaled = proto * width / 2
    root = np.sqrt(scaled**2 - centre**2)
    poles = np.concatenate((scaled + root, scaled - root))
    z = (4 + poles) / (4 - poles)
    gain = (width**order * np.real(np.prod(4.0 - np.zeros(order)) / np.prod(4 - poles))) ** (1 / order)
    upper = sorted((p for p in z if p.imag > 0), key=lambda p: abs(p))
    return [(np.array([1.0, 0.0, -1.0]) * gain, np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in upper]


def notch(freq: float, fs: float, q: float = 30.0) -> list[tuple[np.ndarray, np.ndarray]]:
    w = 2 * np.pi * freq / fs
    beta = 1 / (1 + math.tan(w / q / 2))
    return [(beta * np.array([1.0, -2 * math.cos(w), 1.0]), np.array([1.0, -2 * beta * math.cos(w), 2 * beta - 1]))]


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray, block: int = 128) -> np.ndarray:
    """One second-order section, started in the steady state of the first sample.

    The state (z1, z2) goes on from block to block: within a block the output is a
    triangular matrix times the block plus a matrix times the state at its start.
    """
    total = b.sum() / a.sum()
    state = np.array([(total - b[0]) * x[0], (b[2] - a[2] * total) * x[0]])
    # y = b0 v + z1; z1' = (b1 - a1 b0) v - a1 z1 + z2; z2' = (b2 - a2 b0) v - a2 z1
    move, feed = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    n = len(x)
    block = min(block, n)
    powers = np.empty((block + 1, 2, 2))  # of move
    powers[0] = np.eye(2)
    for i in range(block):
        powers[i + 1] = powers[i] @ move
    response = np.concatenate(([b[0]], powers[: block - 1, 0, :] @ feed))
    at = np.arange(block)
    inner = np.where(at[:, None] >= at[None, :], response[np.maximum(at[:, None] - at[None, :], 0)], 0.0)
    whole = n // block
    out = np.empty(n)
    if whole:
        parts = x[: whole * block].reshape(whole, block)
        own = parts @ inner.T
        gain = parts @ (powers[block - 1 - at] @ feed)  # what a block adds to the state at its end
        states = np.empty((whole, 2))
        for k in range(whole):
            states[k] = state
            state = powers[block] @ state + gain[k]
        out[: whole * block] = (own + states @ powers[:block, 0, :].T).reshape(-1)
    rest = x[whole * block :]
    if len(rest):
        out[whole * block :] = inner[: len(rest), : len(rest)] @ rest + powers[: len(rest), 0, :] @ state
    return out


def filtfilt(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])) if pad > 0 else x
    for _ in range(2):
        for b, a in sections:
            y = _section(b, a, y)
        y = y[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def hilbert(x: np.ndarray) -> np.ndarray:
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def band_phase(x: np.ndarray, fs: float) -> dict[str, float]:
    """Share of variance, mean envelope and last phase of the delta band, after zero-phase filtering."""
    y = filtfilt(butter_bandpass(0.5, 4.0, fs), x)
    analytic = hilbert(y)
    return {"delta_share": float(y.var() / x.var()) if x.var() > 0 else math.nan, "envelope": float(np.abs(analytic).mean()), "phase": float(np.angle(analytic[-1]))}


def hrv_freq(rr: np.ndarray, fs: float = 4.0) -> dict[str, float]:
    """LF, HF and their ratio from intervals in ms, resampled at 4 Hz."""
    at = np.cumsum(rr) / 1000
    grid = np.arange(at[0], at[-1], 1 / fs)
    f, p = welch(np.interp(grid, at, rr), fs, 256)
    out = {b: band_power(f, p, *r, closed=False) for b, r in HRV_BANDS.items()}
    out["lf_hf"] = out["lf"] / out["hf"] if out["hf"] > 0 else math.nan
    return out


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Peaks of the squared, smoothed signal above mean + deviation, 300 ms apart, moved to the largest sample within 50 ms."""
    x = np.asarray(x, float) - np.mean(x)
    box = max(1, int(0.12 * fs))
    power = np.convolve(x**2, np.ones(box) / box, "same")
    limit = power.mean() + power.std()
    tops = np.flatnonzero((power[1:-1] > limit) & (power[1:-1] >= power[:-2]) & (power[1:-1] > power[2:])) + 1
    kept: list[int] = []
    for p in tops:
        if not kept or p - kept[-1] >= 0.3 * fs:
            kept.append(int(p))
    reach = int(0.05 * fs)
    fine = [max(0, p - reach) + int(np.argmax(np.abs(x[max(0, p - reach) : p + reach + 1]))) for p in kept]
    return np.array(sorted(set(fine)), int)


def interpolate_gaps(x: np.ndarray, most: float = 0.1) -> np.ndarray | None:
    """Linear interpolation of bad samples; null if over ``most`` are bad."""
    bad = ~np.isfinite(x)
    if not bad.any():
        return x
    if bad.mean() > most:
        return None
    at = np.arange(len(x))
    return np.interp(at, at[~bad], x[~bad])


KERNELS = {
    "psd_bandpower": psd_bandpower, "spectral_entropy_sef": spectral_entropy_sef, "sleep_bands": sleep_bands, "dfa": dfa, "higuchi": higuchi, "lempel_ziv": lempel_ziv,
    "sample_entropy": sample_entropy, "approximate_entropy": approximate_entropy, "band_phase": band_phase,
}
_PROBE = np.sin(np.arange(64) * 0.7) + np.cos(np.arange(64) * 0.13)
SCHEMAS = {name: list(f(_PROBE, 64.0)) for name, f in KERNELS.items()}


def arrow_kernel(name: str, fs: float):
    """A pandas UDF over arrays of samples that gives a struct; bad or short signals give nulls."""
    kernel, fields = KERNELS[name], SCHEMAS[name]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in fields])

    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for a in column:
            x = interpolate_gaps(np.asarray(a, float)) if a is not None and len(a) >= 8 else None
            rows.append(kernel(x, fs) if x is not None else dict.fromkeys(fields, math.nan))
        return pd.DataFrame(rows, columns=fields)

    return F.pandas_udf(run, schema)
