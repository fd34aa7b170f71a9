"""Kernels on arrays of samples as higher-order functions: they stay in the JVM and need no explode."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def moment(a: Column, m: Column, k: int) -> Column:
    """Central moment of order k about ``m``."""

    def power(x: Column) -> Column:
        d = x - m
        out = d
        for _ in range(k - 1):
            out = out * d
        return out

    return F.aggregate(a, F.lit(0.0), lambda s, x: s + power(x)) / F.size(a)


def diff(a: Column, step: int = 1) -> Column:
    n = F.size(a) - step
    return F.zip_with(F.slice(a, step + 1, n), F.slice(a, 1, n), lambda x, y: x - y)


def rms(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a))


def line_length(a: Column) -> Column:
    return F.aggregate(diff(a), F.lit(0.0), lambda s, x: s + F.abs(x))


def zero_crossings(a: Column, m: Column) -> Column:
    """Sign changes of the samples about ``m``."""
    n = F.size(a) - 1
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: ((x - m) * (y - m) < 0).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def percentile(a: Column, p: float) -> Column:
    """Linear interpolation between order statistics."""
    s, at = F.array_sort(a), (F.size(a) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    return F.get(s, low) + (at - low) * (F.get(s, F.least(low + 1, F.size(a) - 1)) - F.get(s, low))


def energy_cv(a: Column, parts: int) -> Column:
    """Variation of the energy over equal parts: population deviation over mean."""
    n = F.floor(F.size(a) / parts).cast("int")
    energy = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.aggregate(F.slice(a, k * n + 1, n), F.lit(0.0), lambda s, x: s + x * x))
    m = total(energy) / parts
    sd = F.sqrt(F.aggregate(energy, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / parts)
    return F.try_divide(sd, m)


def permutation_entropy(a: Column) -> Column:
    """Order 3, delay 1, in bits over log2 6; ties keep their order of time."""
    n = F.size(a) - 2
    le = lambda x, y: (x <= y).cast("int")
    code = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: le(F.get(a, i), F.get(a, i + 1)) * 4 + le(F.get(a, i), F.get(a, i + 2)) * 2 + le(F.get(a, i + 1), F.get(a, i + 2)),
    )
    share = F.transform(F.array(*[F.lit(k) for k in range(8)]), lambda k: F.size(F.filter(code, lambda c: c == k)) / n)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, -p * F.log2(p)).otherwise(0.0)) / math.log2(6)


def longest_true(a: Column) -> Column:
    out = F.aggregate(
        a, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, x: F.struct(F.when(x, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(x, s["run"] + 1).otherwise(0)).alias("best")),
        lambda s: s["best"],
    )
    return out


def thin_peaks(at: Column, least: float) -> Column:
    """Greedy thinning: a peak stays if it is ``least`` or more after the last one kept."""
    none = F.expr("cast(array() as array<double>)")
    return F.aggregate(at, none, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= least), F.concat(kept, F.array(x))).otherwise(kept))
