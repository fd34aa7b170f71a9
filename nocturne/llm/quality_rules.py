"""Quality rules: a threshold table compiled into one Spark projection.

Each rule names a measured ratio and its least and greatest value; compile_rules() turns
the table into a single boolean expression over the measures.  All of it is built-in
expressions of the row itself: no user function, no shuffle.

Repeated 3-word windows are found within the row: if any of the windows' 64-bit hashes
comes twice, they are sorted with their places, equal neighbours are kept, and the places, sorted again, give the number of
words that they cover.  The cost is n log n in the words of a text, however long.

Defined results: null text has no words, fails the base rules and is not kept; a text
without words has ratio 0 everywhere; other columns are ignored; ties don't arise;
repeated rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import strip_blanks, words_of

#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for was on with be by "
    "der die und den von zu das mit sich des ist im dem nicht ein eine auf "
    "le la les de des et en un une du que qui dans par pour sur "
    "el los las y que se del con una su para al lo"
)

#: (measure, least, greatest); None: no bound.  A text is kept if every measure is within its bounds.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_length", 2.0, 14.0),
    ("symbol_word_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)
BASE_RULES = ("n_words", "repeat_word_ratio")


def compile_rules(rules: Iterable[tuple[str, float | None, float | None]] = RULES) -> Column:
    """One boolean column: every measure is within its bounds."""
    verdict = F.lit(True)
    for name, least, greatest in rules:
        if least is not None:
            verdict = verdict & (F.col(name) >= F.lit(least))
        if greatest is not None:
            verdict = verdict & (F.col(name) <= F.lit(greatest))
    return verdict


def measure(docs: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measures of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), words_of(text).alias("_words"))
    at = F.col("_words")
    places = F.sequence(F.lit(0), F.size("_words") - 3)
    rows = rows.withColumn(
        "_hashes",
        F.when(F.size("_words") >= 3, F.transform(places, lambda i: F.xxhash64(F.get(at, i), F.get(at, i + 1), F.get(at, i + 2)))).otherwise(
            F.expr("array()")
        ),
    )
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    windows = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *keep,
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        lines.alias("_lines"),
        F.when(twice, F.sort_array(windows)).alias("_sorted"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(sorted(set(STOP_WORDS.split()))))).alias("_stops"),
        F.char_length(strip_blanks(F.col("_text"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    s = F.col("_sorted")
    again = F.filter(
        s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
    )
    rows = rows.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + F.least(F.lit(3), i + 3 - acc["end"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    covered = F.coalesce(covered, F.lit(0).cast("long"))
    n_lines = F.size("_lines")
    rows = rows.withColumns({"n_dup_lines": (n_lines - F.size(F.array_distinct("_lines"))).cast("long"), "n_repeat_words": covered, "_n_lines": n_lines})
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    share = lambda pattern: ratio(F.size(F.filter("_lines", lambda x: x.rlike(pattern))), F.col("_n_lines"))
    return rows.select(
        *keep,
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_word_ratio"),
        ratio(F.col("_stops"), F.col("n_words")).alias("stop_word_ratio"),
        ratio(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
        share(r"^[\x20\x09-\x0D]*[-*•]").alias("bullet_line_ratio"),
        share(r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("ellipsis_line_ratio"),
    )


def judge(docs: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id",), rules=RULES) -> DataFrame:
    """The measures with base_failed (integer arithmetic, as the contract has it) and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rest = [r for r in rules if r[0] not in BASE_RULES]
    # The last term is always true.  It isn't deterministic for the optimizer, which would else push a filter on
    # ``kept`` below the projections and evaluate their arrays again for every word.
    verdict = ~F.col("base_failed") & compile_rules(rest) & (F.monotonically_increasing_id() >= 0)
    return measure(docs, text_col, keep).withColumn("base_failed", failed).withColumn("kept", verdict)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    return judge(docs, keep=("doc_id",))
