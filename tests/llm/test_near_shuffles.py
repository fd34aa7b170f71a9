"""Near-dedup shuffles the texts once."""

import re

import numpy as np
from pyspark.sql import functions as F

from nocturne.llm import near_dedup as N
from nocturne.llm import stages
from tests.llm.conftest import SCHEMA


def test_sets_are_made_where_the_texts_are(spark):
    texts = [f"a{i} b c d e f" for i in range(300)] + [None]
    docs = spark.createDataFrame([(i if i else None, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = docs.where("doc_id is null or doc_id in (7, 8, 300)").select(F.xxhash64("doc_id", F.xxhash64("text")).alias("id"))
    bits, bitmap = N.bitmap_of(want)
    assert bits == 15 and int(np.bitwise_count(bitmap).sum()) == 4
    found = N.sets(docs, 5, bits, spark.sparkContext.broadcast(bitmap))
    own = {r.fp for r in N.banded(docs.where("doc_id is null or doc_id in (7, 8, 300)"), 5).collect()}
    got = [r.fp for r in found.collect()]
    assert len(own) == 4 and own <= set(got) and len(got) < 10
    assert not re.search("Join|hashpartitioning", found._jdf.queryExecution().executedPlan().toString())
    many = spark.range(100_000).select(F.xxhash64("id").alias("id"))
    bits, bitmap = N.bitmap_of(many)
    slot = np.array([r.id for r in many.collect()]).view(np.uint64) >> np.uint64(64 - bits)
    assert bits == 22 and np.array_equal(np.flatnonzero(np.unpackbits(bitmap, bitorder="little")), np.unique(slot))


def test_kept_rows_shuffle_their_texts_once(spark):
    rows = [(1, "a b c", "x", "s", 1), (1, "a b c", "y", "s", 1), (2, "A b c", "z", "s", 2), (None, "a b c", "z", "s", 2), (None, None, "z", "s", 2), (None, None, "z", "s", 2), (3, "d", "z", "s", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    kept = stages.keep_near(docs)
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str) == [(0, None), (1, "a b c"), (3, "d")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning(" in x and "_copy#" in x]
    assert len(dealt) == 1 and "coalesce" not in dealt[0]
