"""Chat, encoding, pages, toxicity and the pipeline."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nocturne.llm import chat, html_extract, queries, toxicity, warc
from nocturne.llm import sentencepiece_lattice as L
from tests.llm.conftest import SCHEMA, prose

MODEL = queries.model_path()
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


def test_rotation(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello <|im_end|>"), (1, 3, "cy", None), (1, 3, "ann", "again"),
        (2, 0, "system", "alone"), (3, None, None, "no turn"), (3, 5, "ann", "x"), (1, 1, "ann", "hi"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "speaker": F.lit("z"), "mask": F.lit(0)})
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "unknown"), (3, "ann")}
    ann = got[1, "ann"]
    assert ann.n_turns == 6
    assert ann.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nhello < |im_end|>")
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi<|im_end|>"] * 2 + ["again<|im_end|>"]
    assert ann.masked_chars == sum(m.end - m.start for m in ann.mask)
    assert [got[1, "cy"].text[m.start : m.end] for m in got[1, "cy"].mask] == ["<|im_end|>"]
    last = [r.text for r in chat.rotate(df).where("conv_id = 3 and perspective = 'ann'").orderBy("part").collect()]
    assert "assistant\nx<" in last[0] and "no turn" in last[1]  # a null turn comes last, in a part of its own
    assert chat.rotate(df.limit(0)).count() == 0


def test_long_dialogues_come_in_parts(spark):
    df = spark.range(1300).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") % 7).alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    parts = chat.rotate(df).where("perspective = 'a'").orderBy("part").collect()
    assert [p.n_turns for p in parts] == [512, 512, 276]
    assert sum(len(p.mask) for p in parts) == 650


TEXTS = [
    "the cat sat on the mat.", " leading and  double  spaces ", "line\nbreaks\n\nand\ttabs", "naïve café — 漢字 😀 Ωmega", "", None, "a", "▁" * 3, "x" * 200,
    "supercalifragilisticexpialidocious " * 3, "1234567890 $$$ ### if (x) {\r\n}", "  ", "\n", "the the the the cat cat",
]


@needs_model
def test_encoding_is_the_librarys(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + [prose(random.Random(k), 80) for k in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"ids": F.lit(0), "word": F.lit("w"), "n": F.lit(0)})
    out = L.encode(df, MODEL, check=True)
    for r in out.collect():
        t = texts[r.doc_id] or ""
        assert list(r.ids) == lib.encode(t) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
        assert r.round_trip == ("▁" not in t)
    back = {r.doc_id: r.text for r in L.decode(out, MODEL).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    assert L.encode(df.limit(0), MODEL).count() == 0


@needs_model
def test_lattice_agrees_with_the_other_way(spark):
    table = L.PieceTable.load(MODEL)
    words = sorted({L.MARK + w for k in range(6) for w in prose(random.Random(k), 120).split()} | {L.MARK + "漢字é", L.MARK * 3 + "ab", "\nWas", L.MARK + "don't.", L.MARK + "😀x"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in L.lattice(df, table).collect()}
    assert got == dict(zip(words, table.encode_words([w.replace(L.MARK, " ") for w in words])))


def test_viterbi_by_brute_force(spark):
    rng = random.Random(2)
    pieces = ["<unk>"] + [a for a in "abc▁"] + ["ab", "bc", "abc", "▁a", "ca", "cab", "▁abc", "bb"]
    table = L.PieceTable(pieces, [0.0] + [-rng.random() * 5 - 1 for _ in pieces[1:]], [2] + [1] * (len(pieces) - 1))

    def ways(w):
        if not w:
            yield 0.0, []
        for k in range(1, len(w) + 1):
            if w[:k] in table.match or k == 1:
                i, s = table.match.get(w[:k], (table.unknown, table.least))
                for score, rest in ways(w[k:]):
                    yield s + score, [i, *rest]

    words = ["▁" + "".join(rng.choice("abcz") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    got = {r.word: list(r.ids) for r in L.lattice(spark.createDataFrame([(w,) for w in set(words)], "word string"), table).collect()}
    for w in words:
        assert got[w] == table.viterbi(w) == max(ways(w), key=lambda x: x[0])[1]


PAGES = [
    ("<html><head><title>T</title><script>var a='</p>';</script><style>p{}</style></head><body><nav><ul><li><a>Menu</a></li></ul></nav><div class='ad'>Buy now.</div>"
     "<article><h1>Title here</h1><p><b>First one, with text.<br><p>Second &amp; third, é &#233; x.</p><p>Short.</p></article><footer>&copy; foot</footer>", "Title here First one, with text. Second & third, é é x. Short."),
    ("<body><div id=sidebar>Side text is long, very long, really long.</div><div class='content'><p>A paragraph, with commas, and words enough to count.</p><p>Another paragraph, which is also long enough.</p></div>"
     "<div class=comments><p>A reader comment, long enough to be taken for text, if nothing is done.</p></div><form>Name <input></form></body>", "A paragraph, with commas, and words enough to count. Another paragraph, which is also long enough."),
    ("<p>Only one", "Only one"), ("plain text", "plain text"), ("", ""), (None, ""), ("<<<>>><p", None), ("<div><p>a</div></p><p>b</p>", None), ("<!-- only a comment", ""),
    ("<main><header>Head of it</header><p>Body of the page, long enough.</p><aside>note</aside></main>", "Head of it Body of the page, long enough."),
    ("<article><p>Kept text, yes.</p><div class='cookie-notice'><p>We use cookies, a lot, really.</p></div><p>More kept text.</p></article>", "Kept text, yes. More kept text."),
    ("<article><p>" + "word, " * 20000 + "</p></article>", ("word, " * 20000).strip()),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = {r.page_id: r for r in html_extract.html_extract(df).collect()}
    assert len(rows) == len(PAGES)
    for i, (_, want) in enumerate(PAGES):
        assert rows[i].n_chars == len(rows[i].text) and rows[i].url == f"u{i}"
        assert want is None or rows[i].text == want
    assert html_extract.html_extract(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "<p>a</p>", None, "", "é漢😀" * 500, "<p>a</p>", "x\r\n\r\n\r\n\r\n", "é漢😀" * 500]
    rows = [(100 - i, None if i == 3 else f"http://x/{i} \r\nInjected: y", h) for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"original": F.lit(1), "payload_bytes": F.lit(0), "value": F.lit("v")})
    for least in (0, 9):
        path = str(tmp_path / f"w{least}")
        warc.write_archive(df, path, least, most=3000)
        got = {r.page_id: r for r in warc.read_archive(spark, path, payloads=True).collect()}
        assert len(got) == len(rows)
        first = {}
        for page, _, h in rows:
            first[h or ""] = min(first.get(h or "", page), page)
        for page, _, h in rows:
            data, r = (h or "").encode(), got[page]
            again = first[h or ""] != page and len(data) >= least
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if again else ("response", None))
            assert bytes(r.payload) == (b"" if again else data)
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    plain = str(tmp_path / "plain")
    warc.write_archive(df, plain, most=3000, compression="none")
    files = [p for p in os.listdir(plain) if p.startswith("part")]
    data = [open(os.path.join(plain, p), "rb").read() for p in files]
    assert len(files) > 2 and all(d.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and d.endswith(b"\r\n\r\n") and len(d) < 9000 for d in data)
    assert warc.read_archive(spark, plain).count() == len(rows)


def test_warc_of_a_hot_page_and_odd_ids(spark, tmp_path):
    """A page that comes 3,000 times is one payload; ids that are texts; repeated rows; a page of 40 MB."""
    big = "x" * 40_000_000
    rows = [(f"p{i:04}", "u", "<p>not found</p>") for i in range(3000)] + [("big", "u", big), ("p0000", "u", "<p>not found</p>"), (None, None, "<p>no id</p>")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    path = str(tmp_path / "hot")
    warc.write_archive(df, path)
    got = warc.read_archive(spark, path, page_id="string").collect()
    assert len(got) == len(rows) and sum(r.record_type == "response" for r in got) == 4  # both rows of p0000 have the least id
    assert all(r.refers_to == "p0000" for r in got if r.record_type == "revisit")
    assert [r.payload_bytes for r in got if r.page_id == "big"] == [len(big)]


def labelled(n, seed):
    rng = random.Random(seed)
    bad = "idiot scum worthless vequsse veququ loweiein loweisch".split()
    rows = []
    for i in range(n):
        w = prose(rng, rng.randint(30, 120)).split()
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 9) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    train, held = labelled(400, 1), labelled(200, 2)
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int"))
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    odd = [(1000, None), (1001, ""), (1002, "the of and " * 5000), (1003, "Idiot!!! " + "the of and " * 5000)]
    df = spark.createDataFrame([(i, t) for i, t, _ in held] + odd, "doc_id long, text string").withColumns({"severity": F.lit(9), "grade": F.lit(1)})
    got = {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}
    right = sum(got[i].toxic == bool(y) for i, _, y in held)
    assert right >= 196 and len(got) == 204
    assert not got[1000].toxic and not got[1001].toxic and not got[1002].toxic and got[1003].toxic
    counts = {i: sum(w in "idiot scum worthless vequsse veququ loweiein loweisch".split() for w in t.split()) for i, t, _ in held}
    many, few = [got[i].severity for i, n in counts.items() if n >= 7], [got[i].severity for i, n in counts.items() if 1 <= n <= 2]
    assert np.mean(many) > np.mean(few) + 0.5
    doubled = toxicity.train(docs.unionByName(docs).unionByName(docs.limit(9)), labels)  # repeated ids are one document each
    assert np.array_equal(doubled.keys, model.keys) and np.allclose(doubled.weights, model.weights)
    none = toxicity.train(docs.where("toxic = 0"), labels)
    assert not any(r.toxic for r in toxicity.toxicity(df, none).collect())
    assert toxicity.toxicity(df.limit(0), model).count() == 0


def test_ordinal_gradient():
    """A step of the fit goes down: the loss after fitting is below that of the intercepts alone."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (300, 6)).astype(float)
    s = x @ np.array([2.0, -1, 0, 1.5, 0, 0]) + rng.logistic(size=300)
    grade = np.searchsorted(np.array([0.0, 1.5, 3.0]), s)
    w, t = toxicity.fit_ordinal(x, grade, 4)

    def loss(w, t):
        edge = np.concatenate((np.full((300, 1), -50.0), t[None] - (x @ w)[:, None], np.full((300, 1), 50.0)), axis=1)
        cdf = 1 / (1 + np.exp(-edge))
        return -np.log(cdf[np.arange(300), grade + 1] - cdf[np.arange(300), grade]).mean()

    assert loss(w, t) < loss(np.zeros(6), np.quantile(s, [0.3, 0.6, 0.9])) - 0.1
    assert w[0] > 1 and w[1] < 0 and abs(w[2]) < 0.6


@needs_model
def test_pipeline_against_brute_force(spark, tmp_path):
    """The steps' decisions, worked out row by row, and the encoding of what they leave."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    from nocturne.llm import mixing
    from tests.llm.test_documents import words
    from tests.llm.test_near import jaccard, shingles

    rng = random.Random(4)
    good = [prose(rng, rng.randint(60, 200)) + " the of and the of" for _ in range(60)]
    near = []
    for k in range(3):
        w = (good[k] + " " + prose(rng, 400)).split()
        good[k] = " ".join(w)
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    texts = good + near + [good[10], good[11].replace(" ", "  "), None, "", "short", "$$$ ### " * 60]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 7) for i, t in enumerate(texts)]
    rows.append(rows[20])
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == df.columns
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen[0] == sorted([*range(len(good) + len(near) + 2), 20])
    assert seen[1] == [i for i in range(len(good) + len(near))] or set(range(60 + 3)) - set(seen[1]) == {11} and 64 in seen[1]
    sets = {i: shingles(texts[i]) for i in seen[1]}
    root = {i: min(j for j in sets if jaccard(sets[i], sets[j]) >= 0.8) for i in sets}  # no chains among these
    assert seen[2] == sorted(i for i in sets if root[i] == i) and len(seen[2]) < len(seen[1])
    kept = spark.createDataFrame([r for r in rows[: len(texts)] if r[0] in set(seen[2])], SCHEMA)
    taken = {r.doc_id: r.taken / r["size"] for r in mixing.mix(kept).collect()}
    assert collections.Counter(seen[3]) == +collections.Counter({i: int(v + 0.5) for i, v in taken.items()})
    size = {i: len(words(texts[i])) for i in seen[2]}
    targets = collections.defaultdict(set)
    out_words = collections.Counter()
    for r in mixing.mix(kept, copies=True).collect():
        targets[r.source].add(r.target)
    for i in seen[3]:
        out_words[rows[i][3]] += size[i]
    for s, t in targets.items():  # only documents at the end of a pass are rounded, and blocks of 256 words
        assert abs(out_words[s] - t.pop()) <= 2 * 256 + 2 * max(size.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == seen[3]
    from nocturne.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    begin = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)
    left = {p.split("-")[0] for p in set(os.listdir(folder)) - begin}
    assert left <= {"stage", "words", "pairs", ""}, left  # the last stage's input, and what the encoding reads
    assert all(list(r.ids) == lib.encode(texts[r.doc_id]) for r in out)
    clash = df.withColumns({"_row": F.lit(1), "n_words": F.lit(2), "kept": F.lit(True), "_id": F.lit(0)})
    wide = clash
    for _, stage in corpus_pipeline.STAGES[:4]:
        wide = stage(spark, wide, str(tmp_path))
        assert wide.columns == clash.columns
        wide = corpus_pipeline.materialize(wide, "t")
    assert sorted(r.doc_id for r in wide.collect()) == seen[3]
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_words_of_batches():
    from nocturne.llm import textvec as V

    texts = ["a bb", None, "", "  x ", "é\tb\n", "last"]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"])
    w = V.words_of(*V.buffer_of(batch.column(0)))
    assert w.counts.tolist() == [2, 0, 0, 1, 2, 1]
    data, offsets, start, end = V.joined(w)
    assert [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])] == ["a bb", "", "", "x", "é b", "last"]
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["a", "bb", "x", "é", "b", "last"]
    assert sum(p.num_rows for p in V.pieces(batch, 0, 3)) == 6
    sliced = V.words_of(*V.buffer_of(batch.slice(3).column(0)))
    assert V.word_hashes(sliced).tolist() == V.word_hashes(w)[2:].tolist()
    assert re.fullmatch(r"\d+", str(V.word_hashes(w)[0]))
