"""Near-dedup's candidates by SimHash, and the exact similarity that follows."""

import random

from pyspark.sql import functions as F

from nocturne.llm import near_dedup as N
from tests.llm.conftest import SCHEMA, prose


def test_simhash_gives_candidates_and_similarity_decides(spark):
    rng = random.Random(5)
    base = [prose(rng, 900) for _ in range(12)]
    near = [t.rsplit(" ", 1)[0] + " edited" for t in base]  # one shingle of some 900 differs
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(base + near + ["a b c", None])], SCHEMA)
    rows = N.banded(docs, 5)
    fps = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "copy")).alias("least"), F.first("sim").alias("sim"), F.array().cast("array<long>").alias("bands"))
    key = {r.least.doc_id: r.key for r in N.alike(fps).join(fps, "fp").select("least", "key").collect()}
    assert all(key[i] == key[i + 12] for i in range(12)) and len({key[i] for i in range(12)}) == 12
    # Without any band, the fingerprints' candidates are verified and linked; at a similarity that none has, nothing is.
    own = fps.where("least.doc_id < 24").withColumn("bands", F.when(F.col("least.doc_id") >= 0, F.array("fp")))
    pairs = lambda least: N.links(docs, own, 5, least).count()
    assert pairs(0.8) == 12 and pairs(0.99999) == 0
