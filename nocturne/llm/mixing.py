"""Mixing sources to target weights with a low-discrepancy source schedule.

Every source is a stream of words: its documents in a shuffled order that a seeded hash
fixes, end to end.  The stream is cut into blocks of equal size, in words.  Slot n of the
schedule gets the point frac((n + 1) * golden ratio), in integers modulo 2**64; the source whose interval of the
cumulative target weights holds the point owns the slot: both are cut into CELLS equal
cells of [0, 1) and joined by cell, so a slot meets the few sources of its cell only.  The slots of a source are
ranked, and its slot of rank k takes block k of its stream; a stream that is used up
starts again, and ends for good after ``max_epochs`` passes.

Nothing is collected: prefix sums over documents and ranks of slots are taken in two
steps, within chunks of bounded size and over the chunks' totals, so that a source with
most of the rows is spread over as many tasks as its size asks for.  Only the table of
sources passes through one task, with a row for each source.

Defined results: null text has size 0; a document of size 0 takes 0 words; a null source
is a source of its own, after all others; repeated rows are rows of their own; rows of one
source with equal hash, id and size follow each other; a text of any length has its size; with no
words at all targets are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.llm.common import count_words, discard, materialize

GOLDEN = 0x9E3779B97F4A7C15  # of 2**64
CELLS = 4096
BLOCK = 256
CHUNK = 4_000


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size) with weight, target and the interval [low, high) of cumulative weights.

    Targets stop at ``max_epochs`` times the size, and the excess goes to the others by
    weight: target = min(cap, level * weight) for one common level, found by sorting the
    sources by cap / weight.  One row per source, so one task.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("_no", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), "_no")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("_level", F.max("_level").over(everything))  # it rises until the first source that is not capped, then falls
    rows = rows.withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("weight")), F.col("_cap")))
    total = F.sum("target").over(everything)
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("high", F.coalesce(F.try_divide(upto, total), F.lit(0.0)))
    rows = rows.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    last = F.col("_no") == F.max("_no").over(everything)
    return rows.select(
        "source", F.col("_no").alias("source_no"), "source_size", "weight", "target", "low", F.when(last, 1.0).otherwise(F.col("high")).alias("high")
    )


def _running(rows: DataFrame, group: str, chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running total of ``value`` within ``group``, by chunk and then by ``order``."""
    per_chunk = rows.groupBy(group, chunk).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select(group, chunk, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(base, [group, chunk]).withColumn(out, F.col(out) + F.col("_base")).drop("_base")


def schedule(plan: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(source_no, rank, slot): every slot of the mix, in order, and its rank within its source."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    slots = spark.range(max(0, round(total / block)))
    product = F.expr(f"cast(id + 1 as decimal(19, 0)) * cast({GOLDEN} as decimal(20, 0)) % cast({2**64} as decimal(20, 0))")
    point = F.least(product.cast("double") / float(2**64), F.lit(1 - 2.0**-53))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    slots = slots.select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / chunk).alias("chunk")).withColumn("cell", cell(F.col("point")))
    owner = plan.where("target > 0 and low < high").select("source_no", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    owned = slots.join(owner, "cell").where("point >= low and point < high").select("slot", "chunk", "source_no", F.lit(1).alias("one"))
    return _running(owned, "source_no", "chunk", ["slot"], "one", "rank").select("source_no", "rank", "slot")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    block: int = BLOCK,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    copies: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document.

    ``copies`` adds source and copy, the hash of the text, which tell apart documents that share an id.
    """
    also = ["source", "copy"] if copies else []
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), *([F.xxhash64(text_col).alias("copy")] if copies else []))
    slim = materialize(slim, "sizes")
    plan = materialize(
        targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).drop("n"), weights, share, max_epochs), "targets"
    )
    n = slim.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / CHUNK)).alias("chunks"))
    sources = plan.join(n, plan.source.eqNullSafe(n.source)).select(plan["*"], "chunks")
    rows = slim.join(sources, slim.source.eqNullSafe(sources.source)).select("doc_id", "size", "source_no", "source_size", "target", "chunks", *[slim[c] for c in also])
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = rows.withColumns({"key": key, "chunk": F.pmod(F.shiftright(key, 7), F.col("chunks"))})
    placed = _running(rows, "source_no", "chunk", ["key", "doc_id", "size", *also[1:]], "size", "start")
    placed = materialize(placed.select("doc_id", "size", "source_no", "source_size", "target", "start", *also), "placed")

    # Pieces of each document by block, for each pass over the stream.
    used = placed.where("size > 0").select("doc_id", "source_no", "size", "start", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])).alias("epoch"), "source_size")
    used = used.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
    rank = F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)))
    pieces = used.select("doc_id", "source_no", "start", "a", "b", rank.alias("rank"))
    pieces = pieces.withColumn("n", F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block))
    taken = pieces.join(schedule(plan, block), ["source_no", "rank"]).groupBy("doc_id", "source_no", "start").agg(F.sum("n").alias("taken"))
    same = ["source_no", "start"]
    filled = placed.where("size > 0").join(taken.withColumnRenamed("doc_id", "_id"), same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *also
    )
    nothing = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *also)
    discard(slim)
    return filled.unionByName(nothing)
