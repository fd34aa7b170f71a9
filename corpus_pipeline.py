"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing to weights, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; the
result of each is written as Parquet and read again, so lineage ends at each stage, and
what was written on the way is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nocturne.llm import stages
from nocturne.llm.common import forget, mark, materialize, table
from nocturne.llm.queries import model_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.encoded(docs, model_path())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]
#: SQL can't express the fingerprints' hash, the shuffled order or the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begin = mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
            forget(spark, begin, docs)
    return docs
