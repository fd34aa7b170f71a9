"""What substring dedup sends, and its result where windows repeat in many ways."""

import random

import numpy as np
import pytest

from nocturne.llm import substring_dedup as S


class _All:
    """A bitmap with each counter at 2."""

    value = np.full((S.ROWS << S.MIN_BITS) // 8, 255, np.uint8)


def test_equal_windows_are_sent_once(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, i, text) for i in range(40)], "doc_id long, copy long, text string").coalesce(1)
    found = S.candidates(docs, 50, S.MIN_BITS, _All()).collect()
    assert sorted((r.doc_id, r.at) for r in found if r.at is not None) == [(0, i) for i in range(31)]
    assert len(found) == 31 + 39
    again = spark.createDataFrame([(7, 7, "a " * 300)], "doc_id long, copy long, text string")
    (row,) = S.candidates(again, 50, S.MIN_BITS, _All()).collect()
    assert row.at == 0 and sorted(row.more) == list(range(1, 251))


def _brute(rows, size):
    starts = {}
    for doc, text in rows:
        words = (text or "").split(" ") if text else []
        for i in range(len(words) - size + 1):
            if doc is not None:
                key = tuple(words[i : i + size])
                starts[key] = min(starts.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").split(" ") if text else []
        gone = set()
        for i in range(len(words) - size + 1):
            if doc is not None and starts[tuple(words[i : i + size])] < doc:
                gone |= set(range(i, i + size))
        out.append((doc, len(words), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["long", "string", "double"])
@pytest.mark.parametrize("most", [1, 40, 1 << 19])
def test_repeats_against_brute_force(spark, kind, most, monkeypatch):
    monkeypatch.setattr(S.candidates, "__defaults__", (most,))
    rng = random.Random(5)
    passages = [[rng.choice("abc") for _ in range(9)] for _ in range(4)] + [["a"] * 30]
    make = {"long": int, "string": str, "double": float}[kind]
    rows = []
    for _ in range(60):
        doc = None if rng.random() < 0.05 else make(rng.randrange(25))
        rows.append((doc, " ".join(sum((rng.choice(passages) + [rng.choice("xyz")] for _ in range(rng.randrange(4))), [])) or None))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    found = S.substring_dedup(docs, window=6).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, found), key=str) == _brute(rows, 6)
