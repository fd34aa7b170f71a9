"""Preparation, folds, selection and models on Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_medians(df: DataFrame, columns: list[str], most: int = 1_000_000) -> dict[str, float | None]:
    """Median of each column, exact: the values about it are cut narrower until at most ``most`` are left to sort.

    Each pass counts the values below and within the bounds of every column at once and
    takes new bounds from approximate quantiles of those within; a bound is a value of the
    column, so the rank within the bounds is known exactly.
    """
    bounds: dict[str, tuple] = {c: (None, None) for c in columns}
    within = lambda c: (F.lit(True) if bounds[c][0] is None else F.col(c) >= F.lit(bounds[c][0])) & (F.lit(True) if bounds[c][1] is None else F.col(c) <= F.lit(bounds[c][1]))
    while True:
        aggs = []
        for c in columns:
            aggs += [F.count(c).alias(f"{c}|n"), F.count(F.when(within(c), F.col(c))).alias(f"{c}|k")]
            aggs.append((F.lit(0) if bounds[c][0] is None else F.count_if(F.col(c) < F.lit(bounds[c][0]))).alias(f"{c}|b"))
            aggs += [F.percentile_approx(F.when(within(c), F.col(c)), [0.0, *[i / 100 for i in range(1, 100)], 1.0], 10_000).alias(f"{c}|q")]
        s = df.agg(*aggs).first()
        wide = False
        for c in columns:
            n, k, below, q = (s[f"{c}|{x}"] for x in "nkbq")
            if k > most and q[0] < q[-1]:
                rank = (n - 1) / 2 - below  # of the median within the bounds
                low, high = q[max(0, int(100 * rank / k) - 1)], q[min(100, int(100 * rank / k) + 2)]
                if (low, high) != bounds[c]:
                    bounds[c], wide = (low, high), True
        if not wide:
            break
    exact = df.agg(*[F.sort_array(F.collect_list(F.when(within(c), F.col(c)))).alias(c) if s[f"{c}|k"] <= most else F.array(F.min(F.when(within(c), F.col(c)))).alias(c) for c in columns]).first()
    out: dict[str, float | None] = {}
    for c in columns:
        n, below, values = s[f"{c}|n"], s[f"{c}|b"], exact[c]
        pick = lambda r: values[min(max(r - below, 0), len(values) - 1)]  # noqa: B023, E731
        out[c] = (pick((n - 1) // 2) + pick(n // 2)) / 2 if n else None
    return out


def impute_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians in place of nulls, then mean 0 and population deviation 1; one aggregation each."""
    medians = exact_medians(df, columns)
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns})
    s = filled.agg(*[F.avg(c).alias(f"{c}|m") for c in columns], *[F.stddev_pop(c).alias(f"{c}|s") for c in columns]).first()
    return filled.withColumns({c: (F.col(c) - s[f"{c}|m"]) / (s[f"{c}|s"] or 1.0) for c in columns})


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold of each row: rows of a class in hashed order go round the folds.

    The order is taken within 64 buckets of the hash, so a large class is no single task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % 64)
    w = Window.partitionBy(label, "_b").orderBy("_h", key)
    return rows.withColumn("fold", ((F.row_number().over(w) - 1 + F.col("_b")) % k).cast("int")).drop("_h", "_b")


def anova_f(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(feature, f): between-class over within-class mean squares, nulls left out; one pass in long form."""
    long = df.unpivot([label], [F.col(c).cast("double").alias(c) for c in features], "feature", "v").where("v is not null")
    per = long.groupBy("feature", label).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    w = Window.partitionBy("feature")
    per = per.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    g = per.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")
    )
    return g.select("feature", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def mutual_information(df: DataFrame, label: str, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, mi): in nats, features cut into equal-width bins between their extremes."""
    edges = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in features]).first()
    cut = []
    for c in features:
        a, b = float(edges[c]["a"]), float(edges[c]["b"])
        cut.append(F.least(F.floor((F.col(c) - a) / ((b - a) or 1.0) * bins), F.lit(bins - 1)).cast("double").alias(c))
    long = df.select(label, *cut).unpivot([label], features, "feature", "bin").where("bin is not null")
    joint = long.groupBy("feature", label, "bin").agg(F.count(F.lit(1)).alias("k"))
    w = lambda *c: F.sum("k").over(Window.partitionBy("feature", *c))
    joint = joint.withColumns({"_n": w(), "_x": w("bin"), "_y": w(label)})
    return joint.groupBy("feature").agg(F.sum(F.col("k") / F.col("_n") * F.log(F.col("k") * F.col("_n") / (F.col("_x") * F.col("_y")))).alias("mi"))


def combined_selection(df: DataFrame, label: str, features: list[str], k: int) -> DataFrame:
    """Half of F over its maximum plus half of mutual information over its maximum; the k best, names breaking ties."""
    both = anova_f(df, label, features).join(mutual_information(df, label, features), "feature")
    w = Window.partitionBy()
    score = F.coalesce(F.try_divide(F.col("f"), F.max("f").over(w)), F.lit(0.0)) / 2 + F.coalesce(F.try_divide(F.col("mi"), F.max("mi").over(w)), F.lit(0.0)) / 2
    return both.withColumn("score", score).orderBy(F.desc("score"), "feature").limit(k)


def neighbours(df: DataFrame, key: str, features: list[str], k: int = 5, band: int = 1024, names: bool = False) -> DataFrame:
    """(key, near): the k nearest other rows of each row by Euclidean distance, nearest first, ties by key; near holds their features, or with ``names`` their keys.

    A line through the feature space is cut into bands of about ``band`` rows.  A distance along it is never above the distance
    in space, so the k-th distance within a row's own band tells which other bands can hold a nearer row; these are searched too.
    """
    d = len(features)
    line = np.sqrt(np.arange(2, d + 2))
    line /= np.linalg.norm(line)
    at = sum((F.col(c) * F.lit(float(w)) for c, w in zip(features, line)), F.lit(0.0))
    rows = df.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), at.alias("at"))
    cuts = max(rows.count() // band, 1)
    edges = np.unique(rows.approxQuantile("at", [i / cuts for i in range(1, cuts)], 0.1 / cuts)) if cuts > 1 else np.zeros(0)
    kind = rows.schema["key"].dataType.simpleString()
    found = f"key {kind}, d double, other {kind}, nx array<double>"

    def nearest(own, all_, same):
        """For each row of own (its place in all_ left out if same): places of the k nearest in all_, and their distances."""
        x, y, names = np.stack(own["x"]), np.stack(all_["x"]), all_["key"].rank(method="first").to_numpy()
        for low in range(0, len(x), 256):
            part = x[low : low + 256]
            far = np.zeros((len(part), len(y)))
            for i in range(d):
                far += (part[:, i, None] - y[None, :, i]) ** 2
            if same:
                far[np.arange(len(part)), low + np.arange(len(part))] = np.inf
            for i, line in enumerate(far):
                limit = np.partition(line, k - 1)[k - 1] if len(line) > k else np.inf
                places = np.flatnonzero((line <= limit) & (line < np.inf))
                places = places[np.lexsort((names[places], line[places]))][:k]
                yield low + i, places, np.sqrt(line[places])

    def table(own, all_, same):
        out = [(own["key"].iat[i], r, all_["key"].iat[j], all_["x"].iat[j]) for i, places, far in nearest(own, all_, same) for j, r in zip(places, far)]
        return pd.DataFrame(out, columns=["key", "d", "other", "nx"])

    def within(own):
        return table(own, own, True)

    def across(asks, held):
        asks = asks.rename(columns={"asks_key": "key", "asks_x": "x"})
        return table(asks, held, False) if len(asks) and len(held) else pd.DataFrame([], columns=["key", "d", "other", "nx"])

    @F.pandas_udf("int")
    def band_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("band", band_of("at"))
    first = rows.groupBy("band").applyInPandas(within, found)
    reach = first.groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("r"))
    asks = rows.join(reach, "key", "left").withColumn("r", F.coalesce(F.col("r") * (1 + 1e-9) + 1e-9, F.lit(float("inf"))))
    asks = asks.withColumn("to", F.explode(F.sequence(band_of(F.col("at") - F.col("r")), band_of(F.col("at") + F.col("r"))))).where("to <> band")
    asks = asks.select(F.col("key").alias("asks_key"), F.col("x").alias("asks_x"), "to")
    more = asks.groupBy("to").cogroup(rows.groupBy("band")).applyInPandas(across, found)
    both = first.unionByName(more).groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other", "nx"))), 1, k).alias("near"))
    return both.select(F.col("key").alias(key), F.transform("near", lambda n: n["other"] if names else n["nx"]).alias("near"))


def smote(df: DataFrame, label: str, key: str, features: list[str], seed: int = 42, k: int = 5) -> DataFrame:
    """Rows of the minority class until the classes are even: points between a row and one of its k nearest in the class, features scaled.

    A missing feature counts as the mean for distances and is missing in what is made of it; a class of one row gives copies of it.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    own = df.select(key, label, *features)
    if not sizes or len(set(sizes.values())) == 1:
        return own
    small, large = min(sizes, key=sizes.get), max(sizes.values())
    scale = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in features]).first()
    means, stds = [scale[c][0] or 0.0 for c in features], [scale[c][1] or 1.0 for c in features]
    rows = own.where(F.col(label).eqNullSafe(F.lit(small)))
    scaled = rows.select(key, *[F.coalesce((F.col(c) - m) / s, F.lit(0.0)).alias(c) for c, m, s in zip(features, means, stds)])
    rows = rows.join(neighbours(scaled, key, features, k), key, "left")
    times, rest = divmod(large - sizes[small], sizes[small])
    draw = lambda what, *also: F.xxhash64(F.lit(seed), F.lit(what), key, *also)
    extra = rows.select(key).orderBy(draw("extra"), key).limit(rest).select(key, F.lit(1).alias("_more"))
    rows = rows.join(extra, key, "left").withColumn("_times", F.lit(times) + F.coalesce("_more", F.lit(0))).where("_times > 0")
    return own.unionByName(between(rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))), label, key, features, means, stds, seed))


def between(rows: DataFrame, label: str, key: str, features: list[str], means: list[float], stds: list[float], seed: int) -> DataFrame:
    """For each row a point between it and one of ``near``, the number ``_i`` of its key; means and deviations undo the scaling of near."""
    draw = lambda what: F.xxhash64(F.lit(seed), F.lit(what), key, "_i")
    pick = F.get("near", F.pmod(draw("pick"), F.greatest(F.size("near"), F.lit(1))).cast("int"))
    copies = rows.withColumns({"_n": pick, "_u": F.pmod(draw("place"), F.lit(2**53)) / float(2**53)})
    made = [(F.col(c) + F.col("_u") * F.coalesce(F.get("_n", F.lit(i)) * s + m - F.col(c), F.lit(0.0))).alias(c) for i, (c, m, s) in enumerate(zip(features, means, stds))]
    return copies.select(key, label, *made)


MODELS = {
    "lr": lambda **a: LogisticRegression(**({"maxIter": 50, "regParam": 0.01} | a)),
    "rf": lambda **a: RandomForestClassifier(**({"numTrees": 20, "maxDepth": 5, "seed": 42} | a)),
    "gb": lambda **a: GBTClassifier(**({"maxIter": 10, "maxDepth": 3, "seed": 42} | a)),
}


def pipeline(kind: str, features: list[str], label: str, weight: str | None = None, params: dict | None = None) -> Pipeline:
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=0.0),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        MODELS[kind](labelCol=label, featuresCol="features", **({"weightCol": weight} if weight else {}), **(params or {})),
    ]
    return Pipeline(stages=stages)


def predict(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1])


def vote(models: list[PipelineModel], df: DataFrame, key: str) -> DataFrame:
    """Soft voting: the mean of the models' probabilities."""
    out = df
    for i, m in enumerate(models):
        p = predict(m, df, f"p{i}").select(key, f"p{i}")
        out = out.join(p, key)
    return out.withColumn("p", sum(F.col(f"p{i}") for i in range(len(models))) / len(models))


def out_of_fold(df: DataFrame, key: str, label: str, features: list[str], kind: str = "lr", k: int = 5) -> DataFrame:
    """Predictions of each row by the model fitted without its fold; preparation is fitted without it as well."""
    rows = stratified_folds(df, key, label, k)
    parts = []
    for fold in range(k):
        model = pipeline(kind, features, label).fit(rows.where(F.col("fold") != fold))
        parts.append(predict(model, rows.where(F.col("fold") == fold)).select(key, label, "fold", "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
