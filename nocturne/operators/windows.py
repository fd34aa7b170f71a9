"""Window operators over ordered rows of a key: runs, distances, rolling frames, position in the night."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def over(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def changed(c: str, w: WindowSpec) -> Column:
    """1 where the value differs from the row before; the first row: 0."""
    return F.coalesce((F.col(c) != F.lag(c).over(w)).cast("int"), F.lit(0))


def will_change(c: str, w: WindowSpec) -> Column:
    return F.coalesce((F.col(c) != F.lead(c).over(w)).cast("int"), F.lit(0))


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def onward(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(0, Window.unboundedFollowing)


def islands(df: DataFrame, key: str, order: list[str], c: str, name: str = "island") -> DataFrame:
    """Number of the run of equal values that each row is in."""
    w = over(key, *order)
    return df.withColumn("_c", changed(c, w)).withColumn(name, F.sum("_c").over(upto(w))).drop("_c")


def run_length(df: DataFrame, key: str, order: list[str], c: str, name: str, step: float = 1.0) -> DataFrame:
    """Rows of the current run so far, times ``step``."""
    df = islands(df, key, order, c, "_island")
    w = Window.partitionBy(key, "_island").orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) * F.lit(step)).drop("_island")


def time_since(flag: Column, at: str, w: WindowSpec) -> Column:
    """Distance from the last flagged row, 0 at a flag, null before the first."""
    return F.col(at) - F.last(F.when(flag, F.col(at)), ignorenulls=True).over(upto(w))


def time_to(flag: Column, at: str, w: WindowSpec) -> Column:
    return F.first(F.when(flag, F.col(at)), ignorenulls=True).over(onward(w)) - F.col(at)


def rolling_mean(c: str, w: WindowSpec, half: int) -> Column:
    return F.avg(c).over(w.rowsBetween(-half, half))


def rolling_std(c: str, w: WindowSpec, half: int) -> Column:
    """Sample deviation of the frame, null with fewer than 2 values."""
    frame = w.rowsBetween(-half, half)
    return F.when(F.count(c).over(frame) >= 2, F.stddev_samp(c).over(frame))


def rolling_slope(c: str, w: WindowSpec, half: int) -> Column:
    """Least-squares slope of the frame's values against 0, 1, 2, ..., nulls left out; null with fewer than 3."""
    values = F.collect_list(c).over(w.rowsBetween(-half, half))
    n = F.size(values).cast("double")
    sums = F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("y"), F.lit(0.0).alias("xy")),
        lambda a, v: F.struct((a["i"] + 1).alias("i"), (a["y"] + v).alias("y"), (a["xy"] + a["i"] * v).alias("xy")),
    )
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    return F.when(n >= 3, (n * sums["xy"] - sx * sums["y"]) / (n * sxx - sx * sx))


def night_part(t: str, total: str, parts: int) -> Column:
    """clip(floor(t / T * parts) + 1, 1, parts): the third or quarter of the night; not ntile."""
    return F.least(F.greatest(F.floor(F.col(t) * parts / F.col(total)) + 1, F.lit(1)), F.lit(parts)).cast("int")


def runs(df: DataFrame, key: str, order: list[str], code: str, start: str, end: str, least: float = 0.0) -> DataFrame:
    """(key, code, start, end, n) of each run of equal codes that lasts ``least`` or more."""
    df = islands(df, key, order, code, "_island")
    out = df.groupBy(key, "_island", code).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("end") - F.col("start") >= least).drop("_island")
