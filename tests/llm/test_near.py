"""Near-dedup against brute force, with copies planted at similarities about the threshold."""

import random

import pytest

from nocturne.llm import near_dedup, stages
from tests.llm.conftest import SCHEMA, prose


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(120, 400)) for _ in range(60)]
    texts += [edited(rng, t, max(1, round(len(t.split()) * (0.004 + 0.024 * k / 60)))) for k, t in enumerate(texts)]
    texts += [None, "", "one", "ONE", "a b c d", "a b c e", texts[0].upper()]
    return texts


@pytest.mark.parametrize("cell", [3, near_dedup.CELL])
def test_copies_with_edited_words_are_found(spark, planted, monkeypatch, cell):
    monkeypatch.setattr(near_dedup.links, "__defaults__", (cell,))
    sets = [shingles(t) for t in planted]
    root = list(range(len(planted)))
    between = 0
    for i in range(len(planted)):
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            between += 0.8 <= s < 0.95
            if s >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert between > 30 and any(0.6 < jaccard(sets[k], sets[k + 60]) < 0.8 for k in range(60))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(planted)], SCHEMA).repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_dedup(docs).collect()) == list(enumerate(root))
    assert sorted(r.doc_id for r in stages.keep_near(docs).collect()) == sorted(set(root))
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0
