"""Operators on documents against brute force on a small corpus with all the odd cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nocturne.llm import exact_dedup as E
from nocturne.llm import mixing, quality_rules, simhash, substring_dedup
from nocturne.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORD.findall(t or "")


def clashing(df):
    """The same rows with extra columns that have the operators' own names."""
    return df.withColumns({c: F.lit(1) for c in ("kept", "size", "name", "fp", "at", "copy", "h", "norm", "target", "n_words", "_text", "_words")})


def test_quality(docs, no_docs, corpus):
    got = {r.doc_id: r for r in quality_rules.quality_rules(clashing(docs)).collect()}
    for i, t, *_ in corpus:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + o for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for o in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert got[0].kept or got[0].n_words < 50
    assert quality_rules.quality_rules(no_docs).count() == 0
    judged = quality_rules.judge(docs).where("kept")  # a filter on the verdict must not change or slow it
    assert {r.doc_id for r in judged.collect()} == {i for i, r in got.items() if r.kept}


def test_exact(docs, no_docs, corpus):
    got = E.exact_dedup(clashing(docs), block=16).collect()
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[strip(t)].append((-len(t or ""), i))
    assert len(got) == len(corpus)
    text = {i: t for i, t, *_ in corpus}
    for r in got:
        own = groups[strip(text[r.doc_id])]
        assert (r.keep_id, r.group_size) == (min(own)[1], len(own))
        assert r.text_sha256 == hashlib.sha256(strip(text[r.doc_id]).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert E.exact_dedup(no_docs).count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_names_are_equal_for_equal_texts_only(spark, block):
    texts = ["", "a", "ab", "ba", "aba", "abab", "abab", "x" * 50, "x" * 51, "x" * 50, "é漢" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    names = {r.k: (r.rounds, r.name) for r in E.block_names(df, ["k"], "t", block).collect()}
    assert len(names) == len(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (names[i] == names[j]) == (a == b)


def brute_fp(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, no_docs, corpus):
    got = simhash.simhash_dedup(clashing(docs)).collect()
    assert len(got) == len(corpus)
    fps = {i: brute_fp(t) for i, t, *_ in corpus}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == find(r.doc_id)
    assert simhash.simhash_dedup(no_docs).count() == 0


@pytest.mark.parametrize("cell", [4, 2048])
def test_links_of_dense_and_sparse_fingerprints(spark, cell):
    """Balls around few centres, dealt into small cells too: the components are those of all links."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, cell)
    for a, b in ((r.a, r.b) for r in links.limit(0).collect()):
        raise AssertionError((a, b))
    label = {r.node: r.root for r in components(links).collect()}
    label = {x: label.get(x, x) for x in signed}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    mine = collections.defaultdict(set)
    want = collections.defaultdict(set)
    for k, x in enumerate(signed):
        mine[label[x]].add(x)
        want[find(k)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (5, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(corpus, size=50):
    first = {}
    for i, t, *_ in corpus:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t, *_ in corpus:
        w = words(t)
        gone = {k + o for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for o in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring(docs, no_docs, corpus, monkeypatch):
    want = brute_removed(corpus)
    got = substring_dedup.substring_dedup(clashing(docs)).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert sum(v[1] for v in want.values()) > 400
    assert substring_dedup.substring_dedup(no_docs).count() == 0
    monkeypatch.setattr(substring_dedup, "MAX_BITS", 3)  # a sketch that is far too small loses nothing
    monkeypatch.setattr(substring_dedup, "MIN_BITS", 3)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()} == {(i, *v) for i, v in want.items()}


def waterfill(sizes, weights, total, times):
    level, out = dict.fromkeys(sizes, 0.0), {}
    free, rest = set(sizes), total
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / w > times * sizes[s]}
        if not over:
            return out | {s: rest * weights[s] / w for s in free}
        out |= {s: times * sizes[s] for s in over}
        rest -= sum(times * sizes[s] for s in over)
        free -= over
    return out or level


def test_mixing(docs, no_docs, corpus):
    got = mixing.mix(clashing(docs).drop("size").withColumn("size", F.lit(9)), block=16).collect()
    assert len(got) == len(corpus)
    size = {i: len(words(t)) for i, t, *_ in corpus}
    source = {i: s for i, t, l, s, n in corpus}
    sums = collections.Counter()
    for i, t, l, s, n in corpus:
        sums[s] += len(words(t))
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    want = waterfill(sums, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sums.values()), 2)
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sums[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4 * 16 + 1
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3), block=16).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(no_docs).count() == 0


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([(0, 0.0, 0.5, 8000.0), (1, 0.5, 0.75, 4000.0), (2, 0.75, 1.0, 4000.0)], "source_no int, low double, high double, target double")
    rows = mixing.schedule(plan, block=16, chunk=100).collect()
    assert len(rows) == 1000
    for s in (0, 1, 2):
        own = sorted((r.slot, r["rank"]) for r in rows if r.source_no == s)
        assert [k for _, k in own] == list(range(len(own)))
        share = np.array([slot for slot, _ in own])
        expect = np.arange(len(own)) / (0.5 if s == 0 else 0.25)
        assert np.abs(share - expect).max() < 20
