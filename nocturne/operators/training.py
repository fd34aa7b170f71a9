"""Choice of models: holdout, prevalence in folds, cross-validation, search, candidates, stacking, resampling, explanations."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nocturne.operators import cohort as C
from nocturne.operators import learning as L

Metric = Callable[[DataFrame], float | None]


def holdout(df: DataFrame, key: str, label: str, parts: int = 5, seed: int = 42) -> DataFrame:
    """Rows with ``held``: one of ``parts`` of each class, in hashed order, is held out."""
    return L.stratified_folds(df, key, label, parts, seed).withColumn("held", F.col("fold") == 0).drop("fold")


def prevalence_split(rows: DataFrame, key: str, label: str, held: Column, prevalence: float, seed: int = 42) -> DataFrame:
    """Rows with ``held``: of the positives held out only as many stay as give the expected prevalence, at least one; the others train.

    Which stay goes by a hash of the key: the least hashes, found by a top-k and not a sort.
    """
    rows = rows.withColumn("held", held)
    n = rows.where("held").agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    most = min(n["pos"], max(1, int(n["neg"] * prevalence / (1 - prevalence))))
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    stay = rows.where(F.col("held") & (F.col(label) == 1)).orderBy(*order).limit(most).select(F.col(key).alias("_k")).distinct()
    out = rows.join(stay, rows[key] == stay["_k"], "left")
    return out.withColumn("held", F.col("held") & ((F.col(label) == 0) | F.col("_k").isNotNull())).drop("_k")


def auroc(df: DataFrame, label: str = "label", p: str = "p") -> float | None:
    return C.auroc(df, label, p).first()["auroc"]


def auroc_within_ages(age: str, gap: int = 2, label: str = "label", p: str = "p") -> Metric:
    return lambda df: C.auroc_age(df, label, p, age, gap).first()["auroc_age"]


def score_tuple(df: DataFrame, label: str, metrics: dict[str, Metric]) -> dict[str, float | None]:
    return {n: m(df) for n, m in metrics.items()}


def cross_validate(df: DataFrame, key: str, label: str, make: Callable[[], Pipeline], metrics: dict[str, Metric], k: int = 5, prevalence: float | None = None, resample: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
    """A dict of metrics for each fold.  Everything is fitted without the fold; ``resample`` sees training rows only."""
    rows = L.stratified_folds(df, key, label, k)
    out = []
    for fold in range(k):
        held = F.col("fold") == fold
        parts = prevalence_split(rows, key, label, held, prevalence) if prevalence else rows.withColumn("held", held)
        train = parts.where(~F.col("held")).drop("held", "fold")
        model = make().fit(resample(train) if resample else train)
        out.append({"fold": fold, **score_tuple(L.predict(model, parts.where("held")), label, metrics)})
    return out


def mean_metric(folds: list[dict], name: str) -> float:
    values = [f[name] for f in folds if f[name] is not None]
    return sum(values) / len(values) if values else float("-inf")


def random_grid(space: dict[str, list], trials: int, seed: int = 42) -> list[dict]:
    """Distinct settings, drawn from all combinations with a fixed seed; all of them if there are no more than ``trials``."""
    names = sorted(space)
    every = [dict(zip(names, v)) for v in itertools.product(*[space[n] for n in names])]
    return every if len(every) <= trials else random.Random(seed).sample(every, trials)


def search(df: DataFrame, key: str, label: str, features: list[str], kind: str, space: dict[str, list], metric: Metric, trials: int = 25, k: int = 3, seed: int = 42) -> list[dict]:
    """Settings with their mean metric over folds, the best first, the first drawn of equals."""
    out = []
    for i, setting in enumerate(random_grid(space, trials, seed)):
        folds = cross_validate(df, key, label, lambda: L.pipeline(kind, features, label, **{"params": setting}), {"m": metric}, k)  # noqa: B023
        out.append({"trial": i, "metric": mean_metric(folds, "m"), "setting": setting})
    return sorted(out, key=lambda r: (-r["metric"], r["trial"]))


def choose(df: DataFrame, key: str, label: str, features: list[str], kinds: list[str], metrics: dict[str, Metric], settings: dict[str, dict] | None = None) -> tuple[list[dict], PipelineModel]:
    """(a dict for each candidate, best first; the best one refitted on all rows).  Candidates are compared on one holdout by the metrics in turn."""
    rows = holdout(df, key, label).cache()
    table = []
    for kind in kinds:
        params = (settings or {}).get(kind, {})
        model = L.pipeline(kind, features, label, params=params).fit(rows.where(~F.col("held")))
        table.append({"model": kind, **score_tuple(L.predict(model, rows.where("held")), label, metrics)})
    names = list(metrics)
    table.sort(key=lambda r: tuple(-(r[n] if r[n] is not None else float("-inf")) for n in names))
    best = table[0]["model"]
    final = L.pipeline(best, features, label, params=(settings or {}).get(best, {})).fit(df)
    rows.unpersist()
    return table, final


class Stack:
    """Models whose out-of-fold probabilities are the features of a logistic regression."""

    def __init__(self, models: list[PipelineModel], top: PipelineModel):
        self.models, self.top = models, top

    @staticmethod
    def fit(df: DataFrame, key: str, label: str, features: list[str], kinds: list[str], k: int = 5) -> Stack:
        parts = df.select(key, label)
        for i, kind in enumerate(kinds):
            oof = L.out_of_fold(df, key, label, features, kind, k).select(key, F.col("p").alias(f"p{i}"))
            parts = parts.join(oof, key)
        top = L.pipeline("lr", [f"p{i}" for i in range(len(kinds))], label).fit(parts)
        return Stack([L.pipeline(kind, features, label).fit(df) for kind in kinds], top)

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            keep = [c for c in out.columns]
            out = L.predict(m, out, f"p{i}").select(*keep, f"p{i}")
        return L.predict(self.top, out, name).select(*df.columns, name)


def predict_cohort(model: PipelineModel, df: DataFrame, features: list[str], source_prior: float, target_prior: float, threshold: float = 0.5) -> DataFrame:
    """``df`` with p (raw), p_shifted and positive: columns that the model asks for and the table lacks are null, and the shifted probability decides."""
    from nocturne.functions.scalar import prior_shift

    have = df.columns
    full = df.select(*have, *[F.lit(None).cast("double").alias(c) for c in features if c not in have])
    out = L.predict(model, full).select(*have, "p")
    out = out.withColumn("p_shifted", prior_shift(F.col("p"), F.lit(source_prior), F.lit(target_prior)))
    return out.withColumn("positive", F.col("p_shifted") >= threshold)


# ---------------------------------------------------------------- resampling


def _scaled(df: DataFrame, key: str, label: str, features: list[str]) -> tuple[DataFrame, list[float], list[float]]:
    s = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in features]).first()
    means, stds = [s[c][0] or 0.0 for c in features], [s[c][1] or 1.0 for c in features]
    return df.select(key, label, *[F.coalesce((F.col(c) - m) / d, F.lit(0.0)).alias(c) for c, m, d in zip(features, means, stds)]), means, stds


def hardness(df: DataFrame, key: str, label: str, features: list[str], small, k: int = 5) -> DataFrame:
    """(key, others): how many of the k nearest rows of each row of class ``small`` are of another class; features scaled."""
    scaled, _, _ = _scaled(df, key, label, features)
    near = L.neighbours(scaled, key, features, k, names=True)
    pairs = near.select(key, F.explode("near").alias("_o")).join(scaled.select(F.col(key).alias("_o"), F.col(label).alias("_l")), "_o")
    own = scaled.where(F.col(label).eqNullSafe(F.lit(small))).select(key)
    return own.join(pairs.groupBy(key).agg(F.count_if(~F.col("_l").eqNullSafe(F.lit(small))).alias("others")), key, "left").na.fill(0, ["others"])


def adasyn(df: DataFrame, label: str, key: str, features: list[str], seed: int = 42, k: int = 5) -> DataFrame:
    """Rows and points between a minority row and one of its neighbours in the class; the harder a row's surroundings, the more points.

    A row's share is the share of other classes among its k nearest rows over the sum of
    these; with no such neighbour anywhere nothing is made.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    own = df.select(key, label, *features)
    if len(set(sizes.values())) < 2:
        return own
    small, large = min(sizes, key=sizes.get), max(sizes.values())
    scaled, means, stds = _scaled(df, key, label, features)
    hard = hardness(df, key, label, features, small, k)
    total = hard.agg(F.sum("others")).first()[0] or 0
    if not total:
        return own
    near = L.neighbours(scaled.where(F.col(label).eqNullSafe(F.lit(small))), key, features, k)
    rows = own.where(F.col(label).eqNullSafe(F.lit(small))).join(hard, key).join(near, key, "left")
    times = F.round(F.col("others") * ((large - sizes[small]) / total)).cast("int")
    made = rows.withColumn("_t", times).where("_t > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_t"))))
    return own.unionByName(L.between(made, label, key, features, means, stds, seed))


def tomek_links(df: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """(a, b) with a < b: rows of different classes that are each other's nearest; features scaled, ties by key."""
    scaled, _, _ = _scaled(df, key, label, features)
    one = L.neighbours(scaled, key, features, 1, names=True).select(F.col(key).alias("a"), F.col("near")[0].alias("b"))
    back = one.select(F.col("a").alias("b"), F.col("b").alias("a"))
    kinds = scaled.select(key, label)
    both = one.join(back, ["a", "b"]).where("a < b").join(kinds.select(F.col(key).alias("a"), F.col(label).alias("_la")), "a").join(kinds.select(F.col(key).alias("b"), F.col(label).alias("_lb")), "b")
    return both.where(~F.col("_la").eqNullSafe(F.col("_lb"))).select("a", "b")


def without_tomek(df: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """``df`` without both rows of each such pair."""
    links = tomek_links(df, key, label, features)
    gone = links.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    return df.join(gone, key, "left_anti")


def smote_tomek(df: DataFrame, label: str, key: str, features: list[str], seed: int = 42) -> DataFrame:
    """SMOTE, and then the pairs of nearest rows of different classes taken out; ``id`` numbers the rows anew."""
    made = L.smote(df, label, key, features, seed)
    named = made.withColumn("id", F.xxhash64(F.col(key), *features))
    return without_tomek(named, "id", label, features)


# ---------------------------------------------------------------- explanations


def linear_shap(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, feature, shap): weight times the distance from the feature's mean, which is exact for a linear score of independent features; a missing value counts as the mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    values = [F.struct(F.lit(c).alias("feature"), F.coalesce((F.col(c) - F.lit(means[c] or 0.0)) * w, F.lit(0.0)).alias("shap")) for c, w in weights.items()]
    return df.select(key, F.explode(F.array(*values)).alias("x")).select(key, "x.*")


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, label: str, features: list[str], metric: Metric | None = None, seed: int = 42) -> list[dict]:
    """How much the metric (AUROC) falls if a feature's values are dealt to other rows, greatest first.

    Values move to the next row in hashed order within one of 64 buckets, so no task sorts
    the table.
    """
    metric = metric or (lambda d: auroc(d, label))
    base = metric(L.predict(model, df)) or 0.0
    h = F.xxhash64(F.lit(seed), key)
    w = Window.partitionBy("_b").orderBy("_h", key)
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(64)))
    out = []
    for c in features:
        first = F.first(c).over(Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        moved = rows.withColumn(c, F.when(F.lead(F.lit(1)).over(w).isNull(), first).otherwise(F.lead(c).over(w))).drop("_h", "_b")
        out.append({"feature": c, "drop": base - (metric(L.predict(model, moved)) or 0.0)})
    return sorted(out, key=lambda r: (-r["drop"], r["feature"]))
