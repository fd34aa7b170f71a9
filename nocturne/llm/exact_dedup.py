"""Exact dedup by deterministic block naming.

Texts are equal when they are identical after all white space is deleted.  A text is cut
into blocks of a fixed number of code points.  The distinct blocks are sorted, and a
block's place in that order is its integer name, the same in every run; then adjacent pairs of names are named
in the same way, again and again, until each document has a single name.  Two documents
have the same (rounds, name) if and only if their texts are equal: no hash decides.

Only texts that share length and a 64-bit hash with another one are named; any other
text differs from all the rest by that alone.  Names are written to the shared folder
before they are used, so a task that runs again reads the same names.

Defined results: null text is the empty text; all empty texts are one group; an empty
table gives an empty result; rows with the same doc_id are rows of
their own, and of rows equal in all respects exactly one is kept; ids may be of any type
that sorts, and a null doc_id stays only where no other row of its group is as long; a
very long text is many blocks, named like any others; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import discard, materialize, ranked, strip_blanks

BLOCK = 4096


def _named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``keys`` with their place in sort order as an integer name.

    Blocks are sorted by their first 32 characters, their hash and then themselves, so that
    the driver samples short keys only and blocks with one opening are spread.
    """
    order = [F.substring("block", 1, 32), F.xxhash64("block"), F.col("block")] if columns == ["block"] else [F.col(c) for c in columns]
    if columns != ["block"]:
        return ranked(keys.select(*columns).distinct(), order, "name", "names")
    first = keys.select("block").distinct().withColumns({"_a": order[0], "_b": order[1]})
    return ranked(first, [F.col("_a"), F.col("_b")], "name", "names", [F.col("block")])


def block_names(texts: DataFrame, key: list[str], text: str, block: int = BLOCK) -> DataFrame:
    """``key`` columns with (rounds, name), equal exactly where ``text`` is equal."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = texts.select(*key, F.when(F.length(text) > 0, pieces).otherwise(F.array(F.lit(""))).alias("blocks"))
    rows = rows.select(*key, F.size("blocks").alias("left"), F.posexplode("blocks").alias("at", "block"))
    names = _named(rows, ["block"])
    rows = materialize(rows.join(names, "block").select(*key, "left", "at", "name"), "rows")
    discard(names)
    done = rows.where("left = 1").select(*key, F.lit(0).alias("rounds"), "name")
    longest = rows.agg(F.max("left")).first()[0] or 1
    rounds, written = 0, rows
    while longest > 1:
        rounds, longest = rounds + 1, (longest + 1) // 2
        pairs = (
            written.where("left > 1")
            .groupBy(*key, ((F.col("left") + 1) / 2).cast("int").alias("left"), F.shiftright("at", 1).alias("at"))
            .agg(
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = materialize(pairs, "pairs")
        names = _named(pairs, ["a", "b"])
        written = materialize(pairs.join(names, ["a", "b"]).select(*key, "left", "at", "name"), "rows")
        discard(names)
        discard(pairs)
        done = done.unionByName(written.where("left = 1").select(*key, F.lit(rounds).alias("rounds"), "name"))
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text, then the
    smallest id, stays.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.char_length(text_col), F.lit(0)).alias("n_points"),
        strip_blanks(F.col(text_col)).alias("norm"),
    ).withColumns({"len": F.length("norm"), "sig": F.xxhash64("norm")})
    # Written, so that the joins below are between two shuffles, of which a hot key's can be split.
    shared = materialize(base.groupBy("len", "sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    sha = F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256")
    alone = base.select("doc_id", "len", "sig", sha).join(shared, ["len", "sig"], "left_anti")
    key = ["doc_id", "n_points", "text_sha256", "copy"]
    again = base.join(shared, ["len", "sig"], "left_semi").select(
        "doc_id", "n_points", "norm", sha, F.monotonically_increasing_id().alias("copy")
    )
    again = materialize(again, "copies")  # the rows' numbers must not change if a task runs again
    named = materialize(block_names(again, key, "norm", block), "identity")
    discard(again)
    best = F.min(F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "copy"))
    groups = materialize(named.groupBy("rounds", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    copies = named.join(groups, ["rounds", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("copy") == F.col("best.copy")).alias("kept"),
        "text_sha256",
    )
    return alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    ).unionByName(copies)
