"""Null and repeated ids, ids that are no numbers, and very long texts, in the operators on documents and the stages."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from nocturne.llm import exact_dedup as E
from nocturne.llm import mixing, near_dedup, quality_rules, simhash, stages, substring_dedup
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_documents import brute_fp, words


@pytest.fixture(scope="module")
def odd():
    """Null ids, one id for several texts, repeated rows, and texts of 300,000 words."""
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(120, 200)) + " the of and" for _ in range(8)]
    long = prose(rng, 300_000)
    return [
        (None, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (5, texts[0], "en", "b", 1), (5, texts[2], "en", "b", 2), (5, texts[2].replace(" ", "  ", 3), "de", "b", 3),
        (6, texts[3], "en", None, 1), (6, texts[3], "en", None, 1), (6, texts[3], "en", None, 1), (3, texts[2], "en", "a", 1), (7, long, "en", "a", 9), (8, long + " x", "en", "b", 9), (9, None, None, None, None),
        (10, texts[4], "en", "a", 1), (11, texts[5], "en", "b", 1), (12, texts[6], "en", "b", 1), (13, texts[7], "en", None, 1),
    ]


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(4)


def squeezed(t):
    return "".join(words(t))


def test_exact_with_null_and_repeated_ids(spark, odd, odd_docs):
    got = E.exact_dedup(odd_docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in odd:
        groups[squeezed(t)].append((-len(t or ""), i is None, i))
    want = collections.Counter()
    for i, t, *_ in odd:
        own = groups[squeezed(t)]
        want[i, min(own)[2], len(own), hashlib.sha256(squeezed(t).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    named = odd_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r.doc_id, r.keep_id) for r in E.exact_dedup(named).collect()} == {(f"d{i}" if i is not None else None, f"d{k}" if k is not None else None) for i, k, *_ in want}


def test_names_are_the_same_in_every_run(spark, odd):
    texts = sorted({t or "" for _, t, *_ in odd})
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    runs = [{r.k: (r.rounds, r.name) for r in E.block_names(df.repartition(n), ["k"], "t", 64).collect()} for n in (1, 7)]
    assert runs[0] == runs[1]


def test_simhash_and_near_with_null_and_repeated_ids(odd, odd_docs):
    got = simhash.simhash_dedup(odd_docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((i, f"{brute_fp(t):016x}") for i, t, *_ in odd)
    assert {r.component_id for r in got if r.doc_id is None} == {5, None}  # equal texts under 5; a text that only a null id has
    near = near_dedup.near_dedup(odd_docs).collect()
    assert {(r.doc_id, r.component_id) for r in near} == {(None, 5), (None, None), (5, 5), (5, 3), (6, 6), (3, 3), (7, 7), (8, 7), (9, 9), (10, 10), (11, 11), (12, 12), (13, 13)}


def test_substring_with_null_and_repeated_ids(odd, odd_docs):
    key = lambda i: (i is not None, i or 0)  # a null id is the least
    first = {}
    for i, t, *_ in odd:
        w = words(t)
        for k in range(len(w) - 49):
            g = hash(tuple(w[k : k + 50]))
            first[g] = min(first.get(g, (2, 0)), key(i))
    want = collections.Counter()
    for i, t, *_ in odd:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49):
            f = first[hash(tuple(w[k : k + 50]))]
            if f[0] and i is not None and f[1] < i:
                gone.update(range(k, k + 50))
        want[i, len(w), len(gone)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(odd_docs).collect()) == want


def test_quality_and_mixing_of_odd_rows(odd, odd_docs):
    got = quality_rules.quality_rules(odd_docs).collect()
    assert collections.Counter((r.doc_id, r.n_words) for r in got) == collections.Counter((i, len(words(t))) for i, t, *_ in odd)
    mix = mixing.mix(odd_docs, copies=True).collect()
    assert collections.Counter((r.doc_id, r["size"], r.source) for r in mix) == collections.Counter((i, len(words(t)), s) for i, t, _, s, _ in odd)
    taken, target = collections.Counter(), {}
    for r in mix:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 4 * 256 for s, t in target.items())


def test_stages_with_null_and_repeated_ids(spark, odd, odd_docs):
    rows = lambda df: sorted((str(r.doc_id), r.text or "", str(r.source)) for r in df.collect())
    exact = rows(stages.keep_exact(odd_docs))
    assert len(exact) == len({squeezed(t) for _, t, *_ in odd})
    assert ("5", odd[4][1], "b") in exact and ("5", odd[2][1], "b") in exact and ("None", odd[1][1], "a") in exact  # the longest, the smallest id that isn't null
    near = rows(stages.keep_near(odd_docs))
    assert [i for i, *_ in near] == sorted(["None", "5", "3", "6", "7", "9", "10", "11", "12", "13"])
    assert ("5", odd[2][1], "b") in near and ("5", odd[3][1], "b") not in near  # one id, two texts: one is a copy of 3
    a, b = (sorted((r.doc_id or -1, r.lang or "", r.text or "") for r in stages.keep_exact(odd_docs.repartition(n)).collect()) for n in (1, 5))
    assert a == b
    times = collections.Counter((r.doc_id, r.text) for r in stages.mixed(odd_docs).collect())
    want = collections.defaultdict(list)
    text = collections.defaultdict(set)
    for i, t, *_ in odd:
        text[i, len(words(t))].add(t)
    for r in mixing.mix(odd_docs, copies=True).collect():
        want[r.doc_id, r.copy, r.source, r["size"]].append(r.taken)
    total = sum(len(v) * int(sum(v) / (k[3] * len(v)) + 0.5) for k, v in want.items() if k[3])
    assert sum(times.values()) == total
    assert stages.keep_quality(odd_docs).columns == odd_docs.columns
