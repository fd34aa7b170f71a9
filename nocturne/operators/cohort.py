"""Aggregation by subject, and metrics of scores against labels.

All of it is grouping, ranking by window, or a pre-aggregation that is spread over a band
of ages; no pairs of positives and negatives are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANGES = 64
FEW = 100_000  # distinct values that one task may rank, and that may be broadcast


def running(df: DataFrame, value: str, sums: dict[str, str], down: bool = False, groups: list[str] = ()) -> DataFrame:
    """``df`` (a row for each distinct ``value`` of each group) with the running totals of columns before each row, in order of ``value``.

    ``sums`` maps new names to columns.  The values are cut into RANGES ranges at
    approximate quantiles of all of them; a window runs within a group's range, and a range's
    total is carried over the table of ranges, so no task holds all values.  Up to FEW rows
    are one range.
    """
    g = list(groups)
    kind = df.schema[value].dataType.typeName()
    numeric = kind in ("double", "float", "integer", "long", "short", "byte") or kind.startswith("decimal")
    q = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 2000) if numeric else F.lit(None)
    n, cuts = df.select(F.count(F.lit(1)), q).first()
    cuts = sorted(set(cuts or [])) if n > FEW else []
    rows = df.withColumn("_range", sum(((F.col(value) > F.lit(x)).cast("int") for x in cuts), F.lit(0)))
    within = Window.partitionBy(*g, "_range").orderBy(F.desc(value) if down else value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({c: F.coalesce(F.sum(x).over(within), F.lit(0)) for c, x in sums.items()})
    if not cuts:
        return rows.drop("_range")
    total = rows.groupBy(*g, "_range").agg(*[F.sum(x).alias(f"_{c}") for c, x in sums.items()])
    order = Window.partitionBy(*g).orderBy(F.desc("_range") if down else "_range").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*g, "_range", *[F.coalesce(F.sum(f"_{c}").over(order), F.lit(0)).alias(f"_{c}") for c in sums])
    rows = rows.join(base if g else F.broadcast(base), [*g, "_range"])  # without groups a row for each range
    return rows.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_range", *[f"_{c}" for c in sums])


def summary(c: str, prefix: str = "") -> list[Column]:
    """mean, std (0 for one value), median, min, max; p25, p75, iqr from 4 values on."""
    n = F.count(c)
    q = lambda p: F.when(n >= 4, F.percentile(c, F.lit(p)))
    return [
        n.alias(prefix + "n"),
        F.avg(c).alias(prefix + "mean"),
        F.coalesce(F.stddev_samp(c), F.when(n == 1, 0.0)).alias(prefix + "std"),
        F.percentile(c, F.lit(0.5)).alias(prefix + "median"),
        F.min(c).alias(prefix + "min"),
        F.max(c).alias(prefix + "max"),
        q(0.25).alias(prefix + "p25"),
        q(0.75).alias(prefix + "p75"),
        (q(0.75) - q(0.25)).alias(prefix + "iqr"),
    ]


#: Overlapping groups of stages.
STAGE_GROUPS = {"all": None, "nrem": ("N1", "N2", "N3"), "rem": ("REM",), "n2": ("N2",), "n3": ("N3",)}


def by_stage_group(df: DataFrame, stage: str, name: str = "grp") -> DataFrame:
    """Each row once for every group that its stage is in; groups overlap, so they are no grouping sets."""
    tags = [F.when(F.lit(True) if s is None else F.col(stage).isin(*s), F.lit(g)) for g, s in STAGE_GROUPS.items()]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*tags))))


def third_compare(df: DataFrame, key: str, third: str, value: str) -> DataFrame:
    """Mean of each third and their differences; the relative one is null if the first mean is 0."""
    p = df.groupBy(key).pivot(third, [1, 2, 3]).agg(F.avg(value))
    p = p.select(key, F.col("1").alias("t1"), F.col("2").alias("t2"), F.col("3").alias("t3"))
    two = (F.col("t1").isNotNull().cast("int") + F.col("t2").isNotNull().cast("int") + F.col("t3").isNotNull().cast("int")) >= 2
    return p.where(two).withColumns(
        {"d31": F.col("t3") - F.col("t1"), "d21": F.col("t2") - F.col("t1"), "rel": F.try_divide(F.col("t3") - F.col("t1"), F.abs("t1"))}
    )


def cycle_trend(df: DataFrame, key: str, cycle: str, value: str) -> DataFrame:
    """Means of cycles 1 to 4, their slope (3 or more cycles), last minus first and that relative to the first."""
    m = df.where(F.col(cycle) >= 1).groupBy(key, cycle).agg(F.avg(value).alias("m"))
    first, last = F.min_by("m", cycle), F.max_by("m", cycle)
    return m.groupBy(key).agg(
        *[F.max(F.when(F.col(cycle) == k, F.col("m"))).alias(f"c{k}") for k in (1, 2, 3, 4)],
        F.when(F.count("m") >= 3, F.regr_slope("m", cycle)).alias("slope"),
        F.when(F.count("m") >= 2, last - first).alias("change"),
        F.when(F.count("m") >= 2, F.try_divide(last - first, F.abs(first))).alias("rel"),
    )


def sleep_summary(epochs: DataFrame, key: str) -> DataFrame:
    """Minutes in bed and asleep, efficiency, stage minutes and shares, onset and REM latency, wake after onset, transitions.

    ``epochs`` has start_sec, end_sec, duration_sec, stage.
    """
    d, s = F.col("duration_sec"), F.col("stage")
    w = Window.partitionBy(key)
    rows = epochs.withColumn("_onset", F.min(F.when(s != "W", F.col("start_sec"))).over(w))
    order = Window.partitionBy(key).orderBy("start_sec", "end_sec", "stage")
    rows = rows.withColumn("_change", F.coalesce((s != F.lag("stage").over(order)).cast("int"), F.lit(0)))
    asleep = F.sum(F.when(s != "W", d).otherwise(0.0))
    stages = ("W", "N1", "N2", "N3", "REM")
    share = lambda x: 100.0 * F.try_divide(F.sum(F.when(s == x, d).otherwise(0.0)), asleep)
    return rows.groupBy(key).agg(
        ((F.max("end_sec") - F.min("start_sec")) / 60).alias("trt_min"),
        (asleep / 60).alias("tst_min"),
        (100.0 * asleep / F.sum(d)).alias("efficiency"),
        *[(F.sum(F.when(s == x, d).otherwise(0.0)) / 60).alias(f"{x.lower()}_min") for x in stages],
        *[share(x).alias(f"{x.lower()}_pct") for x in stages],
        (F.max("_onset") / 60).alias("onset_min"),
        ((F.min(F.when(s == "REM", F.col("start_sec"))) - F.max("_onset")) / 60).alias("rem_latency_min"),
        (F.sum(F.when((s == "W") & (F.col("start_sec") > F.col("_onset")), d).otherwise(0.0)) / 60).alias("waso_min"),
        F.sum("_change").alias("transitions"),
        F.try_divide(F.sum("_change"), asleep / 3600).alias("fragmentation"),
    )


def confusion(y: str, score: str, threshold: float = 0.5) -> list[Column]:
    p, t = F.col(score) > threshold, F.col(y) == 1
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")]


def metrics(counts: DataFrame) -> DataFrame:
    """Measures in closed form from tp, fp, fn, tn; null where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    div = F.try_divide
    sens, spec, prec = div(tp, tp + fn), div(tn, tn + fp), div(tp, tp + fp)
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return counts.withColumns(
        {
            "accuracy": div(tp + tn, n), "sensitivity": sens, "specificity": spec, "precision": prec, "npv": div(tn, tn + fn),
            "f1": div(2 * tp, 2 * tp + fp + fn), "balanced": (sens + spec) / 2, "youden": sens + spec - 1,
            "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
            "kappa": div(div(tp + tn, n) - expected, 1 - expected), "lr_pos": div(sens, 1 - spec), "lr_neg": div(1 - sens, spec), "dor": div(tp * tn, fp * fn),
        }
    )


def auroc(df: DataFrame, y: str, score: str, groups: list[str] = ()) -> DataFrame:
    """Area under the ROC curve from mid-ranks, ties counting a half.

    Scores are first reduced to counts by distinct value, so the ranking window sees
    distinct scores, not rows.
    """
    g = list(groups)
    v = df.groupBy(*g, score).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    v = running(v, score, {"_below": "_n"}, groups=g)
    v = v.withColumn("_wins", F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    out = v.groupBy(*g).agg(F.try_divide(F.sum("_wins"), F.sum("_p").cast("double") * F.sum("_n")).alias("auroc"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return out


def auprc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the step of recall."""
    v = df.groupBy(score).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count(F.lit(1)).alias("_k"))
    v = running(v, score, {"_above": "_p", "_rows": "_k"}, down=True)
    v = v.withColumn("_precision", (F.col("_above") + F.col("_p")) / (F.col("_rows") + F.col("_k")))
    return v.agg((F.sum(F.col("_precision") * F.col("_p")) / F.sum("_p")).alias("auprc"))


def auroc_age(df: DataFrame, y: str, score: str, age: str, gap: int) -> DataFrame:
    """Share of (positive, negative) pairs with ages at most ``gap`` apart that are in order, ties counting a half.

    Rows become counts by (age, score).  A positive's count is compared with the negatives
    of each age in its band by their running count in score order: a window over the
    union of both for each band age.
    """
    v = df.groupBy(age, score).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    near = F.explode(F.sequence(F.col(age) - gap, F.col(age) + gap)).alias("_band")
    pos = v.where("_p > 0").select(near, F.col(score).alias("_s"), "_p", F.lit(0).cast("long").alias("_n"))
    neg = v.where("_n > 0").select(F.col(age).alias("_band"), F.col(score).alias("_s"), F.lit(0).cast("long").alias("_p"), "_n")
    both = pos.unionByName(neg).groupBy("_band", "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    w = Window.partitionBy("_band")
    below = F.coalesce(F.sum("_n").over(w.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumn("_wins", F.col("_p") * (below + F.col("_n") / 2.0)).withColumn("_pairs", F.col("_p") * F.sum("_n").over(w))
    return both.agg(F.try_divide(F.sum("_wins"), F.sum("_pairs").cast("double")).alias("auroc_age"), F.sum("_pairs").alias("pairs"))


def auroc_age_weighted(df: DataFrame, y: str, score: str, age: str, gap: int) -> DataFrame:
    """Mean over grid ages k of the AUROC of rows within ``gap`` of k, weighted by their number; cells without a pair count nothing."""
    cells = df.withColumn("_k", F.explode(F.sequence(F.col(age) - gap, F.col(age) + gap)))
    a = auroc(cells, y, score, ["_k"]).withColumn("_w", F.when(F.col("auroc").isNotNull(), F.col("n_pos") + F.col("n_neg")).otherwise(0))
    return a.agg(F.try_divide(F.sum(F.col("auroc") * F.col("_w")), F.sum("_w").cast("double")).alias("auroc_weighted"))


def reward(df: DataFrame, y: str, prediction: Column, p: str) -> Column:
    """TP: 1/p - 1, TN: 1/(1 - p) - 1, else -1."""
    t = F.col(y) == 1
    return F.when(prediction & t, 1 / F.col(p) - 1).when(~prediction & ~t, 1 / (1 - F.col(p)) - 1).otherwise(-1.0)


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: list[float]) -> DataFrame:
    """Counts and measures at each threshold: rows go to bins of the thresholds once, then running sums."""
    bins = sum((F.col(score) > x).cast("int") for x in thresholds)
    per = df.groupBy(bins.alias("_b")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, float(x)) for i, x in enumerate(thresholds)], "i int, threshold double")
    hits = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias
    above = F.col("_b") > F.col("i")
    out = grid.join(F.broadcast(per), F.lit(True), "left").groupBy("i", "threshold").agg(
        hits("_p", above)("tp"), hits("_n", above)("fp"), hits("_p", ~above)("fn"), hits("_n", ~above)("tn")
    )
    return metrics(out).drop("i")


def calibration(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Per uniform bin: rows, mean score, share of positives and their gap."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    out = df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(y).cast("double")).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("rate")))


def with_mid_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the mid-rank of each column of ``names`` (name: column), from counts by distinct value joined back."""
    out = df
    for name, value in names.items():
        counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
        v = running(counts, value, {"_before": "_k"}).select(value, (F.col("_before") + (F.col("_k") + 1) / 2.0).alias(name))
        out = out.join(F.broadcast(v) if counts.count() <= FEW else v, value)
    return out


def rank_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, rank_sum) with mid-ranks over all rows: what Mann-Whitney and Kruskal-Wallis need."""
    v = df.groupBy(value, group).agg(F.count(F.lit(1)).alias("_k"))
    total = v.groupBy(value).agg(F.sum("_k").alias("_t"))
    total = running(total, value, {"_before": "_t"}).withColumn("_mid", F.col("_before") + (F.col("_t") + 1) / 2.0)
    return v.join(total, value).groupBy(group).agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("_mid")).alias("rank_sum"))


def poisson_bootstrap(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """Each row ``replicates`` times with a weight drawn from Poisson(1) by a hash of (seed, key, replicate); zeros are left out."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.lit(seed), key, "replicate"), F.lit(2**53)) + 0.5) / float(2**53)
    total, term, edges = 0.0, 0.36787944117144233, []
    for k in range(8):
        total += term
        term /= k + 1
        edges.append(total)
    weight = sum((u > e).cast("int") for e in edges)
    return rows.withColumn("weight", weight).where("weight > 0")
