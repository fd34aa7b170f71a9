"""Operators on whole tables: keep-first, ranking, importance, column profiles, alignment, name patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Place of each row.  For tables of models or features, which are small by nature: one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def importance(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Share of the total, rank and cumulative share of each feature; a row for each feature, so one task."""
    share = F.col(value) / F.sum(value).over(Window.partitionBy())
    w = Window.orderBy(F.desc("share"), feature)
    out = df.withColumn("share", share).withColumn("rank", F.row_number().over(w).cast("long"))
    return out.withColumn("cumulative", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def profile(df: DataFrame, most_null: float, count_distinct: bool = False) -> DataFrame:
    """(column_name, constant, null_share, kept) of every column, in one aggregation over the table.

    A column is constant if its least and greatest values are equal, which takes one pass
    without a shuffle of the values.  ``count_distinct`` adds n_distinct, which does shuffle
    them, a row for each column of each row.
    """
    aggs = []
    for c in df.columns:
        x = F.col(c)
        kind = df.schema[c].dataType.typeName()
        if kind in ("double", "float"):
            x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        aggs += [F.min(x).eqNullSafe(F.max(x)).alias(f"{c}|c"), F.count(x).alias(f"{c}|n")]
        if count_distinct:
            aggs.append(F.count_distinct(x).alias(f"{c}|d"))
    one = df.agg(F.count(F.lit(1)).alias("_all"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}|c`").alias("constant"), *([F.col(f"`{c}|d`").alias("n_distinct")] if count_distinct else []), (1 - F.col(f"`{c}|n`") / F.col("_all")).alias("null_share")) for c in df.columns])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("kept", ~F.col("constant") & (F.col("null_share") <= most_null))


def clean_columns(df: DataFrame, most_null: float, always: tuple[str, ...] = ()) -> DataFrame:
    """Columns that the profile keeps, infinities and NaN as null, booleans as 0 and 1."""
    kept = {r["column_name"] for r in profile(df, most_null).where("kept").collect()} | set(always)
    out = []
    for f in df.schema.fields:
        if f.name in kept:
            x = F.col(f.name)
            if f.dataType.typeName() in ("double", "float"):
                x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
            elif f.dataType.typeName() == "boolean":
                x = x.cast("int")
            out.append(x.alias(f.name))
    return df.select(*out)


def align(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns that a model asks for, missing ones as null."""
    return df.select(*[(F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in columns.items()])


def matching_columns(columns: list[str], patterns: list[str], always: list[str] = (), most: int | None = None) -> list[str]:
    """Names that contain one of the patterns, in pattern order, after ``always``; at most ``most`` of them."""
    found = [c for p in patterns for c in columns if p in c]
    found = list(dict.fromkeys(found))[:most]
    return [*always, *[c for c in found if c not in always]]


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value): the form in which tables of unknown width travel."""
    return df.unpivot(keys, [F.col(f).cast("double").alias(f) for f in features], "feature", "value")
