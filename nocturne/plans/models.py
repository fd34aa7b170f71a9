"""Queries on automata and on learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.operators import automata, learning, training
from nocturne.operators import cohort as C
from nocturne.plans.base import EV, SC, ev, scored, t
from nocturne.plans.registry import query

r6 = lambda c: F.round(c, 6)
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("sleep_cycles")
def sleep_cycles(spark, sf):
    """Cycles of each recording, a segment an event."""
    rows = ev(spark, sf).withColumn("at", F.col("t") * 1e6 + F.col("event_id") * 1e-3)
    return automata.sleep_cycles(rows, "pid", "at", "stage", 5.0)


@query(
    "cap_sequences",
    f"""WITH {EV}, a AS (SELECT *, event_type = 'error' AS guard FROM ev WHERE event_type IN ('view', 'purchase', 'error')), b AS (
  SELECT *, sum(CAST(guard AS INTEGER)) OVER (PARTITION BY pid ORDER BY start_sec, end_sec) AS br FROM a WHERE guard OR dur <= 36000
), c AS (SELECT *, lag(end_sec) OVER w AS pe, lag(br) OVER w AS pb FROM b WHERE NOT guard WINDOW w AS (PARTITION BY pid ORDER BY start_sec, end_sec)),
d AS (SELECT *, sum(CAST(pe IS NULL OR start_sec - pe > 86400 OR pb <> br AS INTEGER)) OVER (PARTITION BY pid ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS seq FROM c)
SELECT pid, round(min(start_sec), 6) AS start, round(max(end_sec), 6) AS "end", count(*) AS n FROM d GROUP BY pid, seq HAVING count(*) >= 3""",
)
def cap_sequences(spark, sf):
    rows = ev(spark, sf).where("event_type in ('view', 'purchase', 'error')")
    out = automata.sequences(rows, "pid", "start_sec", "end_sec", 86_400.0, F.col("event_type") == "error", 3, 36_000.0, F.col("dur"))
    return out.withColumns({"start": r6("start"), "end": r6("end")})


@query("cap_stats", f"""WITH {EV}, a AS (SELECT pid, CASE event_type WHEN 'view' THEN 'A1' WHEN 'purchase' THEN 'A2' ELSE 'A3' END AS kind, dur FROM ev WHERE event_type IN ('view', 'purchase', 'signup'))
SELECT pid, count(*) AS n, round(avg(dur), 6) AS mean_dur, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k.lower()}_n, round(avg(dur) FILTER (kind = '{k}'), 6) AS {k.lower()}_dur, round(100e0 * count(*) FILTER (kind = '{k}') / count(*), 6) AS {k.lower()}_pct" for k in ("A1", "A2", "A3"))} FROM a GROUP BY pid""")
def cap_stats(spark, sf):
    kind = F.when(F.col("event_type") == "view", "A1").when(F.col("event_type") == "purchase", "A2").otherwise("A3")
    a = ev(spark, sf).where("event_type in ('view', 'purchase', 'signup')").withColumn("kind", kind)
    aggs = []
    for k in ("A1", "A2", "A3"):
        own = F.col("kind") == k
        aggs += [F.count_if(own).alias(f"{k.lower()}_n"), r6(F.avg(F.when(own, F.col("dur")))).alias(f"{k.lower()}_dur"), r6(100.0 * F.count_if(own) / F.count(F.lit(1))).alias(f"{k.lower()}_pct")]
    return a.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dur")).alias("mean_dur"), *aggs)


@query(
    "impute_scale",
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS q, l_tax AS x FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT quantile_cont(q, 0.5) FROM r)) AS q, x FROM r)
SELECT l_orderkey, l_linenumber, round((q - (SELECT avg(q) FROM f)) / (SELECT stddev_pop(q) FROM f), 6) AS q, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) AS x FROM f""",
)
def impute_scale(spark, sf):
    rows = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS q", "l_tax AS x")
    return learning.impute_scale(rows, ["q", "x"]).withColumns({"q": r6("q"), "x": r6("x")})


@query(
    "anova_f",
    "WITH l AS (SELECT l_returnflag AS y, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem), p AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY ALL), g AS (SELECT feature, avg(v) AS grand FROM l GROUP BY 1) SELECT p.feature, round((sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 5) AS f FROM p JOIN g USING (feature) GROUP BY 1",
)
def anova_f(spark, sf):
    return learning.anova_f(t(spark, sf, "lineitem"), "l_returnflag", FEATURES).withColumn("f", F.round("f", 5))


@query(
    "mutual_information",
    "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), l AS (SELECT l_returnflag AS y, least(floor((l_quantity - a) / (b - a) * 10), 9) AS bin FROM lineitem, e), j AS (SELECT y, bin, CAST(count(*) AS DOUBLE) AS k FROM l GROUP BY ALL), s AS (SELECT k, sum(k) OVER () AS n, sum(k) OVER (PARTITION BY bin) AS x, sum(k) OVER (PARTITION BY y) AS y FROM j) SELECT 'l_quantity' AS feature, round(sum(k / n * ln(k * n / (x * y))), 9) AS mi FROM s",
)
def mutual_information(spark, sf):
    return learning.mutual_information(t(spark, sf, "lineitem"), "l_returnflag", ["l_quantity"]).withColumn("mi", F.round("mi", 9))


@query(
    "combined_selection",
    """WITH l AS (SELECT l_returnflag AS y, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem),
p AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY ALL), g AS (SELECT feature, avg(v) AS grand, min(v) AS a, max(v) AS b FROM l GROUP BY 1),
f AS (SELECT p.feature, (sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM p JOIN g USING (feature) GROUP BY 1),
j AS (SELECT feature, y, least(floor((v - a) / (b - a) * 10), 9) AS bin, CAST(count(*) AS DOUBLE) AS k FROM l JOIN g USING (feature) GROUP BY ALL),
s AS (SELECT feature, k, sum(k) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature, bin) AS x, sum(k) OVER (PARTITION BY feature, y) AS y FROM j), i AS (SELECT feature, sum(k / n * ln(k * n / (x * y))) AS mi FROM s GROUP BY 1)
SELECT feature, round(f / max(f) OVER () / 2 + mi / max(mi) OVER () / 2, 6) AS score FROM f JOIN i USING (feature) ORDER BY 2 DESC, 1 LIMIT 3""",
)
def combined_selection(spark, sf):
    return learning.combined_selection(t(spark, sf, "lineitem"), "l_returnflag", FEATURES, 3).select("feature", r6("score").alias("score"))


@query("stratified_folds", f"WITH {SC}, h AS (SELECT doc_id, y2, md5('42:' || doc_id) AS h FROM sc), b AS (SELECT *, CAST('0x' || h[1:2] AS INTEGER) % 64 AS b FROM h), f AS (SELECT y2, CAST((row_number() OVER (PARTITION BY y2, b ORDER BY h, doc_id) - 1 + b) % 5 AS INTEGER) AS fold FROM b) SELECT fold, y2, count(*) AS n FROM f GROUP BY ALL")
def stratified_folds(spark, sf):
    return learning.stratified_folds(scored(spark, sf), "doc_id", "y2").groupBy("fold", "y2").agg(F.count(F.lit(1)).alias("n"))


def cohort_matrix(spark, sf):
    s = scored(spark, sf)
    return s.select("doc_id", F.col("y2").cast("double").alias("label"), F.col("score").alias("a"), F.col("age").cast("double").alias("b"), (F.col("score") * F.col("age")).alias("c"))


@query("oof_predictions")
def oof_predictions(spark, sf):
    out = learning.out_of_fold(cohort_matrix(spark, sf), "doc_id", "label", ["a", "b", "c"])
    return out.select("doc_id", "fold", r6("p").alias("p"))


@query("train_predict")
def train_predict(spark, sf):
    """Two models by soft voting."""
    rows = cohort_matrix(spark, sf)
    models = [learning.pipeline(k, ["a", "b", "c"], "label").fit(rows) for k in ("lr", "rf")]
    return learning.vote(models, rows, "doc_id").select("doc_id", r6("p").alias("p"))


@query("smote_balance")
def smote_balance(spark, sf):
    """The rows and those made of them, which have the doc_id of the row they start from."""
    out = learning.smote(cohort_matrix(spark, sf), "label", "doc_id", ["a", "b", "c"])
    return out.select("doc_id", "label", r6("a").alias("a"), r6("b").alias("b"), r6("c").alias("c"))


NEAR = f"""WITH {SC}, m AS (SELECT doc_id, y2, sqrt(n_chars) AS a, ln(doc_id + 2) AS b, score * age AS c FROM sc JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)),
z AS (SELECT doc_id, y2, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c FROM m),
d AS (SELECT x.doc_id, x.y2, y.doc_id AS o, y.y2 AS yo, row_number() OVER (PARTITION BY x.doc_id ORDER BY pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2), y.doc_id) AS k FROM z x JOIN z y ON x.doc_id <> y.doc_id)"""


def spaced(spark, sf):
    """Rows with features that give no equal distances."""
    n = t(spark, sf, "documents").select("doc_id", "n_chars")
    m = scored(spark, sf).join(n, "doc_id")
    return m.select("doc_id", F.col("y2").cast("double").alias("label"), F.sqrt("n_chars").alias("a"), F.log(F.col("doc_id") + 2).alias("b"), (F.col("score") * F.col("age")).alias("c"))


@query("tomek_links", NEAR + " SELECT p.doc_id AS a, p.o AS b FROM d p JOIN d q ON p.o = q.doc_id AND q.o = p.doc_id AND p.k = 1 AND q.k = 1 WHERE p.doc_id < p.o AND p.y2 <> p.yo")
def tomek_links(spark, sf):
    """Rows of different classes that are each other's nearest, found in bands; the SQL compares all pairs."""
    return training.tomek_links(spaced(spark, sf), "doc_id", "label", ["a", "b", "c"])


@query("minority_hardness", NEAR + " SELECT doc_id, count(*) FILTER (yo <> y2) AS others FROM d WHERE k <= 5 AND y2 = 1 GROUP BY doc_id")
def minority_hardness(spark, sf):
    """How many of a minority row's five nearest are of the other class."""
    return training.hardness(spaced(spark, sf), "doc_id", "label", ["a", "b", "c"], 1.0)


@query("adasyn_balance")
def adasyn_balance(spark, sf):
    out = training.adasyn(spaced(spark, sf), "label", "doc_id", ["a", "b", "c"])
    return out.select("doc_id", "label", r6("a").alias("a"), r6("b").alias("b"), r6("c").alias("c"))


@query("smote_tomek")
def smote_tomek(spark, sf):
    out = training.smote_tomek(spaced(spark, sf), "label", "doc_id", ["a", "b", "c"])
    return out.select("doc_id", "label", r6("a").alias("a"), r6("b").alias("b"), r6("c").alias("c"))


SHAP = {"a": 0.5, "b": -0.02, "c": 0.001}


@query("linear_shap", f"WITH {SC}, m AS (SELECT doc_id, score AS a, age AS b, score * age AS c FROM sc), g AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM m) " + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS feature, round(({c} - m{c}) * {w}, 6) AS shap FROM m, g" for c, w in SHAP.items()))
def linear_shap(spark, sf):
    """Contributions of features to a linear score."""
    return training.linear_shap(cohort_matrix(spark, sf), "doc_id", SHAP).withColumn("shap", r6("shap"))


@query("model_choice")
def model_choice(spark, sf):
    """Candidates on one holdout, best first."""
    rows = cohort_matrix(spark, sf)
    metrics = {"auroc_age": lambda d: training.auroc_within_ages("b")(d.withColumn("b", F.col("b").cast("int"))), "auroc": training.auroc}
    table, _ = training.choose(rows, "doc_id", "label", ["a", "b", "c"], ["lr", "rf", "gb"], metrics)
    return spark.createDataFrame([(i + 1, r["model"], r["auroc_age"], r["auroc"]) for i, r in enumerate(table)], "rank int, model string, auroc_age double, auroc double")


@query("model_search")
def model_search(spark, sf):
    """Settings of a forest by cross-validation."""
    found = training.search(cohort_matrix(spark, sf), "doc_id", "label", ["a", "b", "c"], "rf", {"maxDepth": [2, 4], "numTrees": [5, 10]}, training.auroc, trials=3, k=2)
    return spark.createDataFrame([(r["trial"], r["metric"], str(sorted(r["setting"].items()))) for r in found], "trial int, metric double, setting string")


@query("stacked_predictions")
def stacked_predictions(spark, sf):
    rows = cohort_matrix(spark, sf)
    stack = training.Stack.fit(rows, "doc_id", "label", ["a", "b", "c"], ["lr", "rf"], k=3)
    return stack.predict(rows).select("doc_id", r6("p").alias("p"))


@query("cohort_predictions")
def cohort_predictions(spark, sf):
    """Raw and shifted probabilities; a column that the table lacks is null and imputed."""
    rows = cohort_matrix(spark, sf)
    model = learning.pipeline("lr", ["a", "b", "c"], "label").fit(rows)
    out = training.predict_cohort(model, rows.drop("c"), ["a", "b", "c"], 0.1, 0.05)
    return out.select("doc_id", r6("p").alias("p"), r6("p_shifted").alias("p_shifted"), "positive")


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows = cohort_matrix(spark, sf)
    model = learning.pipeline("lr", ["a", "b", "c"], "label").fit(rows)
    out = training.permutation_importance(model, rows, "doc_id", "label", ["a", "b", "c"])
    return spark.createDataFrame([(r["feature"], r["drop"]) for r in out], "feature string, drop double").withColumn("drop", r6("drop"))


@query("prevalence_fold", f"WITH {SC}, n AS (SELECT count(*) FILTER (y2 = 0) AS neg, count(*) FILTER (y2 = 1) AS pos FROM sc) SELECT neg AS n_neg, least(pos, greatest(1, CAST(floor(neg * 0.05e0 / 0.95e0) AS BIGINT))) AS n_pos FROM n")
def prevalence_fold(spark, sf):
    """Size of a validation fold that has the expected prevalence."""
    c = scored(spark, sf).agg(F.count_if(F.col("y2") == 0).alias("n_neg"), F.count_if(F.col("y2") == 1).alias("pos"))
    return c.select("n_neg", F.least("pos", F.greatest(F.lit(1), F.floor(F.col("n_neg") * 0.05 / 0.95))).alias("n_pos"))


@query("shap_importance", "WITH l AS (SELECT unnest(['a', 'b', 'c']) AS feature, unnest([l_discount - 0.05, l_tax - 0.04, (l_quantity - 25) / 1000]) AS v FROM lineitem), s AS (SELECT feature, avg(abs(v)) AS importance, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY 1), n AS (SELECT *, importance / sum(importance) OVER () AS share FROM s) SELECT feature, round(importance, 6) AS importance, round(mean, 6) AS mean, round(std, 6) AS std, row_number() OVER (ORDER BY importance DESC, feature) AS rank, round(sum(share) OVER (ORDER BY importance DESC, feature), 6) AS cumulative FROM n")
def shap_importance(spark, sf):
    from nocturne.operators.tables import importance, long_form

    wide = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_discount - 0.05D AS a", "l_tax - 0.04D AS b", "(l_quantity - 25) / 1000 AS c")
    s = long_form(wide, ["l_orderkey"], ["a", "b", "c"]).groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    out = importance(s, "feature", "importance")
    return out.select("feature", r6("importance").alias("importance"), r6("mean").alias("mean"), r6("std").alias("std"), "rank", r6("cumulative").alias("cumulative"))
