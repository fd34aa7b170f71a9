import random

import pytest

SYLLABLES = "the of and ra mo li ta ve so ne ki lu".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, blanks, nulls, repeated rows."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(30, 260)) for _ in range(40)]
    passage = prose(rng, 70)
    texts += [texts[3], texts[3].replace(" ", "  \n"), texts[4] + " ", " " + texts[5]]  # copies but for white space
    for k in (6, 7, 8):  # near copies
        words = texts[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 15) for _ in range(4)] + [passage, passage + " x"]
    texts += [None, "", " \t\n", "one", "two words", "a b c", "é ß ñ 漢字   x", "*** $$$ ### " * 30, "same line\n" * 80, texts[9] * 3]
    rows = [(i, t, "en", ["s1", "s2", None, "s0"][i % 4] if i % 3 else "s1", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2]]  # repeated rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
