"""Queries on tests, effect sizes and fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.operators import stats
from nocturne.plans.base import SC, scored, t
from nocturne.plans.registry import query

r5 = lambda c: F.round(c, 5)


def upper(a: str, x: str) -> str:
    """SQL for the regularised upper incomplete gamma function, by the series of the lower one."""
    return f"(1 - exp({a} * ln({x}) - ({x}) - lgamma({a} + 1)) * list_sum(list_transform(range(0, 600), lambda n: exp(n * ln({x}) + lgamma({a} + 1) - lgamma({a} + n + 1)))))"


def _test(source: str) -> str:
    """u, z and p from n1, n2, r1 and t of ``source``."""
    return f"""u0 AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS s FROM {source}),
u1 AS (SELECT *, sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5e0, 0) / s AS z FROM u0), u2 AS (SELECT *, CASE WHEN z = 0 THEN 1e0 ELSE {upper("0.5e0", "(z * z / 2)")} END AS p FROM u1)"""


MID = "rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0"


@query(
    "mann_whitney_p",
    f"""WITH {SC}, r AS (SELECT y2, score, {MID} AS r FROM sc), k AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM sc GROUP BY score),
g AS (SELECT CAST(count(*) FILTER (y2 = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y2 = 0) AS DOUBLE) AS n2, sum(r) FILTER (y2 = 1) AS r1, (SELECT sum(k * k * k - k) FROM k) AS t FROM r), {_test("g")}
SELECT n1, n2, u, round(z, 5) AS z, round(p, 5) AS p, round(2 * u / (n1 * n2) - 1, 5) AS rank_biserial FROM u2""",
)
def mann_whitney_p(spark, sf):
    """Rank test of two groups with its p value, ties and continuity corrected."""
    out = stats.mann_whitney(scored(spark, sf), "y2", "score", 1, 0)
    return out.select("n1", "n2", "u", r5("z").alias("z"), r5("p").alias("p"), r5("rank_biserial").alias("rank_biserial"))


@query(
    "kruskal_p",
    f"""WITH {SC}, r AS (SELECT grp, {MID} AS r FROM sc WHERE grp IS NOT NULL), g AS (SELECT grp, count(*) AS n, sum(r) AS s FROM r GROUP BY 1), k AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM sc WHERE grp IS NOT NULL GROUP BY score),
h AS (SELECT count(*) AS groups, CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS ss, (SELECT sum(k * k * k - k) FROM k) AS t FROM g), x AS (SELECT groups, n, (12e0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM h)
SELECT groups, CAST(n AS BIGINT) AS n, round(h, 5) AS h, round({upper("((groups - 1) / 2e0)", "(h / 2)")}, 5) AS p FROM x""",
)
def kruskal_p(spark, sf):
    """Rank test of all groups with its p value."""
    out = stats.kruskal_wallis(scored(spark, sf), "grp", "score")
    return out.select("groups", "n", r5("h").alias("h"), r5("p").alias("p"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]


@query(
    "pairwise_tests",
    f"""WITH c AS (SELECT c_mktsegment AS g, CAST(floor(c_acctbal / 100) AS DOUBLE) AS v FROM customer), s AS (SELECT unnest({SEGMENTS}) AS g), p AS (SELECT a.g AS a, b.g AS b FROM s a JOIN s b ON a.g < b.g),
w AS (SELECT p.a, p.b, c.g, c.v FROM p JOIN c ON c.g = p.a OR c.g = p.b), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2e0 AS r FROM w),
k AS (SELECT a, b, sum(k * k * k - k) AS t FROM (SELECT a, b, CAST(count(*) AS DOUBLE) AS k FROM w GROUP BY a, b, v) GROUP BY a, b),
g AS (SELECT r.a, r.b, CAST(count(*) FILTER (g = r.a) AS DOUBLE) AS n1, CAST(count(*) FILTER (g = r.b) AS DOUBLE) AS n2, sum(r) FILTER (g = r.a) AS r1, any_value(t) AS t FROM r JOIN k ON r.a = k.a AND r.b = k.b GROUP BY r.a, r.b), {_test("g")}
SELECT a, b, u, round(p, 5) AS p, round(least(1, p * 6), 5) AS p_bonferroni, round(2 * u / (n1 * n2) - 1, 5) AS rank_biserial FROM u2""",
)
def pairwise_tests(spark, sf):
    """Rank tests of all pairs of segments, corrected for their number."""
    rows = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.floor(F.col("c_acctbal") / 100).cast("double").alias("v"))
    out = stats.pairwise_mann_whitney(rows, "g", "v", SEGMENTS)
    return out.select("a", "b", "u", r5("p").alias("p"), r5("p_bonferroni").alias("p_bonferroni"), r5("rank_biserial").alias("rank_biserial"))


@query(
    "effect_sizes",
    f"""WITH {SC}, l AS (SELECT y2, unnest(['score', 'age']) AS feature, unnest([score, age]) AS v FROM sc), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS r FROM l),
k AS (SELECT feature, sum(k * k * k - k) AS t FROM (SELECT feature, CAST(count(*) AS DOUBLE) AS k FROM l GROUP BY feature, v) GROUP BY feature),
g AS (SELECT r.feature, CAST(count(*) FILTER (y2 = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y2 = 0) AS DOUBLE) AS n2, sum(r) FILTER (y2 = 1) AS r1, any_value(t) AS t, avg(v) FILTER (y2 = 1) AS m1, avg(v) FILTER (y2 = 0) AS m0, var_samp(v) FILTER (y2 = 1) AS v1, var_samp(v) FILTER (y2 = 0) AS v0 FROM r JOIN k ON r.feature = k.feature GROUP BY r.feature), {_test("g")}
SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v0) / (n1 + n2 - 2)), 5) AS d, round(p, 5) AS p FROM u2""",
)
def effect_sizes(spark, sf):
    """Cohen's d and p value of each feature."""
    out = stats.effect_sizes(scored(spark, sf), "y2", ["score", "age"])
    return out.select("feature", "n1", "n0", r5("d").alias("d"), r5("p").alias("p"))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0 AS {0}"
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "spearman_matrix",
    f"WITH r AS (SELECT {', '.join(RANK.format(c) for c in COLUMNS)} FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS rho FROM r" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]),
)
def spearman_matrix(spark, sf):
    """Rank correlation of every pair of columns."""
    return stats.spearman_matrix(t(spark, sf, "lineitem"), COLUMNS).withColumn("rho", r5("rho"))


@query("bootstrap_metrics")
def bootstrap_metrics(spark, sf):
    """Intervals of seven metrics over 1,000 replicates with a fixed seed."""
    out = stats.bootstrap_metrics(scored(spark, sf), "doc_id", "y2", "score")
    return out.select("metric", *[r5(c).alias(c) for c in ("low", "median", "high")])


COUNTS = "count(*) FILTER (score > 0.5 AND y2 = 1) AS tp, count(*) FILTER (score > 0.5 AND y2 <> 1) AS fp, count(*) FILTER (score <= 0.5 AND y2 = 1) AS fn, count(*) FILTER (score <= 0.5 AND y2 <> 1) AS tn"
FAIR = f"""WITH {SC}, c AS (SELECT grp, count(*) AS n, {COUNTS} FROM sc WHERE grp IS NOT NULL GROUP BY grp HAVING count(*) >= 5),
a AS (SELECT p.grp, avg(CASE WHEN p.score > q.score THEN 1e0 WHEN p.score = q.score THEN 0.5e0 ELSE 0e0 END) AS auroc FROM sc p JOIN sc q ON p.grp = q.grp AND p.y2 = 1 AND q.y2 = 0 GROUP BY 1),
f AS (SELECT c.grp, n, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, (tp + fp) / n AS positive_rate, (tp + tn) / n AS accuracy, tp / nullif(tp + fp, 0) AS precision, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, auroc FROM c LEFT JOIN a ON a.grp = c.grp)"""
MEASURES = ["tpr", "fpr", "positive_rate", "accuracy", "precision", "f1", "auroc"]


@query("fairness_measures", FAIR + f" SELECT grp, n, {', '.join(f'round({c}, 5) AS {c}' for c in MEASURES)} FROM f")
def fairness_measures(spark, sf):
    out = stats.fairness(scored(spark, sf), "grp", "y2", "score")
    return out.select("grp", "n", *[r5(c).alias(c) for c in MEASURES])


@query(
    "fairness_verdict",
    FAIR + """, g AS (SELECT count(*) AS groups, max(positive_rate) - min(positive_rate) AS parity_gap, max(tpr) - min(tpr) AS tpr_gap, max(fpr) - min(fpr) AS fpr_gap FROM f WHERE tpr IS NOT NULL AND fpr IS NOT NULL)
SELECT groups, round(parity_gap, 5) AS parity_gap, round(tpr_gap, 5) AS tpr_gap, round(fpr_gap, 5) AS fpr_gap, round(greatest(tpr_gap, fpr_gap), 5) AS odds_gap, parity_gap < 0.1 AND tpr_gap < 0.1 AND greatest(tpr_gap, fpr_gap) < 0.1 AS fair FROM g""",
)
def fairness_verdict(spark, sf):
    out = stats.fairness_summary(stats.fairness(scored(spark, sf), "grp", "y2", "score"))
    return out.select("groups", *[r5(c).alias(c) for c in ("parity_gap", "tpr_gap", "fpr_gap", "odds_gap")], "fair")
