"""Tests and intervals on cohorts: p values from rank sums, effect sizes, rank correlation, resampled metrics, fairness."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.operators import cohort as C


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: by its series below a + 1, by a continued fraction above."""
    if not x > 0:
        return 1.0 if x == 0 else math.nan
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square distribution; meant for tables of tests, which have a row for each."""

    @F.pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma(k / 2, v / 2) if v == v and k == k else None for v, k in zip(x, df)])

    return run(x.cast("double"), df.cast("double"))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|), which is the tail of a chi-square with one degree of freedom at z squared."""
    return chi2_tail(z * z, F.lit(1.0))


def mann_whitney(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """u (of ``first``), z (ties and continuity corrected), p, rank_biserial of two groups; one row."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isin(first, second))
    r = C.rank_tests(rows, group, value)
    pick = lambda c, k: F.max(F.when(F.col(group) == k, F.col(c)))
    g = r.agg(pick("n", first).cast("double").alias("n1"), pick("n", second).cast("double").alias("n2"), pick("rank_sum", first).alias("r1"))
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("_k")).agg(F.sum(F.expr("_k * _k * _k - _k")).alias("t"))
    g = g.crossJoin(F.broadcast(ties)).withColumn("u", F.expr("r1 - n1 * (n1 + 1) / 2"))  # one row each
    g = g.withColumn("s", F.expr("sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1))))"))
    off = F.expr("greatest(abs(u - n1 * n2 / 2) - 0.5D, 0D)")
    z = F.signum(F.expr("u - n1 * n2 / 2")) * F.try_divide(off, F.col("s"))
    return g.withColumn("z", z).select("n1", "n2", "u", "z", normal_two_sided(F.col("z")).alias("p"), F.expr("2 * u / (n1 * n2) - 1").alias("rank_biserial"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, h, p), ties corrected; one row."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    r = C.rank_tests(rows, group, value).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").cast("double").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("ss"))
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("_k")).agg(F.sum(F.expr("_k * _k * _k - _k")).alias("t"))
    h = F.try_divide(F.expr("12.0D / (n * (n + 1)) * ss - 3 * (n + 1)"), F.expr("1 - t / (n * n * n - n)"))
    out = r.crossJoin(F.broadcast(ties)).withColumn("h", h)
    return out.select("groups", F.col("n").cast("long").alias("n"), "h", chi2_tail(F.col("h"), F.col("groups") - 1).alias("p"))


def pairwise_mann_whitney(df: DataFrame, group: str, value: str, groups: list) -> DataFrame:
    """A row for each pair of ``groups``: a, b, u, p, p_bonferroni, rank_biserial.

    Ranks of a pair's union come from the counts by (value, group), joined to the pairs: a
    distinct value is ranked once for each pair that has it, and rows take no further part.
    """
    pairs = list(combinations(groups, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, u double, p double, p_bonferroni double, rank_biserial double")
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(i, a, b, g) for i, (a, b) in enumerate(pairs) for g in (a, b)], f"pair int, a {kind}, b {kind}, {group} {kind}")
    v = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    rows = v.join(F.broadcast(table), group)
    at = rows.groupBy("pair", "a", "b", value).agg(F.sum(F.when(F.col(group) == F.col("a"), F.col("_k")).otherwise(0)).alias("ka"), F.sum("_k").alias("t"))
    at = C.running(at, value, {"before": "t"}, groups=["pair", "a", "b"]).withColumn("mid", F.col("before") + (F.col("t") + 1) / 2.0)
    g = at.groupBy("pair", "a", "b").agg(F.sum("ka").cast("double").alias("n1"), F.sum(F.col("t") - F.col("ka")).cast("double").alias("n2"), F.sum(F.col("ka") * F.col("mid")).alias("r1"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("t"))
    g = g.where("n1 > 0 and n2 > 0").withColumn("u", F.expr("r1 - n1 * (n1 + 1) / 2")).withColumn("s", F.expr("sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1))))"))
    z = F.try_divide(F.expr("greatest(abs(u - n1 * n2 / 2) - 0.5D, 0D)"), F.col("s"))
    g = g.withColumn("p", normal_two_sided(z))
    return g.select("a", "b", "u", "p", F.least(F.lit(1.0), F.col("p") * len(pairs)).alias("p_bonferroni"), F.expr("2 * u / (n1 * n2) - 1").alias("rank_biserial"))


def effect_sizes(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(feature, n1, n0, d, p) for each feature: Cohen's d with the pooled deviation, and the p value of the rank test; greatest |d| first."""
    long = df.where(F.col(label).isin(0, 1)).unpivot([label], [F.col(c).cast("double").alias(c) for c in features], "feature", "v").where("v is not null and not isnan(v)")
    one = lambda k: F.when(F.col(label) == k, F.col("v"))
    g = long.groupBy("feature").agg(F.avg(one(1)).alias("m1"), F.avg(one(0)).alias("m0"), F.var_samp(one(1)).alias("v1"), F.var_samp(one(0)).alias("v0"), F.count(one(1)).cast("double").alias("n1"), F.count(one(0)).cast("double").alias("n0"))
    d = g.withColumn("d", F.expr("(m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0)"))
    at = long.groupBy("feature", "v").agg(F.count_if(F.col(label) == 1).alias("_p"), F.count(F.lit(1)).alias("_t"))
    at = C.running(at, "v", {"_before": "_t"}, groups=["feature"]).withColumn("_mid", F.col("_before") + (F.col("_t") + 1) / 2.0)
    r = at.groupBy("feature").agg(F.sum(F.col("_p") * F.col("_mid")).alias("r1"), F.sum(F.expr("cast(_t as double) * _t * _t - _t")).alias("t"))
    out = d.join(r, "feature").withColumn("u", F.expr("r1 - n1 * (n1 + 1) / 2")).withColumn("s", F.expr("sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1))))"))
    z = F.try_divide(F.expr("greatest(abs(u - n1 * n0 / 2) - 0.5D, 0D)"), F.col("s"))
    return out.select("feature", F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"), "d", normal_two_sided(z).alias("p")).orderBy(F.abs("d").desc_nulls_last(), "feature")


def spearman_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, rho) for each pair of features, rows with a null in any of them left out."""
    rows = df.select(*features).dropna()
    rows = C.with_mid_ranks(rows, {f"_r_{c}": c for c in features})
    pairs = list(combinations(features, 2))
    one = rows.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("rho")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("x")).select("x.*")


def bootstrap_metrics(df: DataFrame, key: str, y: str, score: str, threshold: float = 0.5, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, low, median, high): percentiles 2.5, 50 and 97.5 of metrics over Poisson replicates.

    Rows become one of the four outcomes before they are weighted, so a replicate is four
    sums; a row's weight in a replicate is a function of (seed, key, replicate).
    """
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    hit, truth = F.col(score) > threshold, F.col(y) == 1
    b = C.poisson_bootstrap(rows.select(key, hit.alias("_h"), truth.alias("_t")), key, replicates, seed)
    n = lambda h, t: F.sum(F.when((F.col("_h") == h) & (F.col("_t") == t), F.col("weight")).otherwise(0))
    counts = b.groupBy("replicate").agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    names = ["accuracy", "sensitivity", "specificity", "precision", "f1", "balanced", "mcc"]
    m = C.metrics(counts).unpivot(["replicate"], names, "metric", "v").where("v is not null")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return m.groupBy("metric").agg(q.alias("q")).select("metric", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def fairness(df: DataFrame, group: str, y: str, score: str, threshold: float = 0.5, least: int = 5) -> DataFrame:
    """Per group of ``least`` rows or more: n, tpr, fpr, positive_rate, accuracy, precision, f1, auroc."""
    rows = df.where(F.col(group).isNotNull())
    c = rows.groupBy(group).agg(*C.confusion(y, score, threshold), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.join(C.auroc(rows, y, score, [group]).select(group, "auroc"), group, "left")
    return out.select(
        group, "n", F.try_divide(tp, tp + fn).alias("tpr"), F.try_divide(fp, fp + tn).alias("fpr"), ((tp + fp) / F.col("n")).alias("positive_rate"),
        ((tp + tn) / F.col("n")).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), "auroc",
    )


def fairness_summary(groups: DataFrame, most: float = 0.1) -> DataFrame:
    """Greatest differences between groups with both classes, and whether all are below ``most``; one row."""
    f = groups.where("tpr is not null and fpr is not null")
    gap = lambda c: F.max(c) - F.min(c)
    out = f.agg(F.count(F.lit(1)).alias("groups"), gap("positive_rate").alias("parity_gap"), gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"))
    out = out.withColumn("odds_gap", F.greatest("tpr_gap", "fpr_gap"))
    return out.withColumn("fair", (F.col("parity_gap") < most) & (F.col("tpr_gap") < most) & (F.col("odds_gap") < most))
