"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and the others as named users; system turns stay what they are and take
no perspective.  The mask is the list of character spans that the assistant says, its
end mark included.

A conversation is rendered in parts: turns whose numbers share a quotient by SPAN, at most
PART of them, so that no task's work is an unbounded dialogue; a part's text follows on the
text of the part before.  whole() puts the parts of a rendering together again, with masks
counted from the start of the dialogue.

Defined results: a null role is the speaker "unknown"; null text is empty; null turns come
last; equal turns are ordered by speaker and text, and repeated rows are repeated turns; a
conversation with system turns only gives no row; a null conversation id is a
conversation; marks within a text or a speaker's name lose their force by a space, as do
line ends within a name; an empty role is a speaker without a name; participants who say
the same at the same turn have a row each; a dialogue of any length is one row of whole();
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SPAN, PART = 256, 512


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, perspective, part, n_turns, text, mask (array of struct start, end), masked_chars."""
    part = F.coalesce("chunk", F.lit(2**40)).cast("long") * 1_000_000 + F.col("sub")
    return _parts(turns, system).select("conv_id", "perspective", part.alias("part"), "n_turns", "text", "mask", "masked_chars")


def whole(turns: DataFrame, system: str = "system") -> DataFrame:
    """The columns of rotate() without part, one row for each conversation and perspective."""
    part = F.struct(F.col("chunk").isNull().alias("last"), "chunk", "sub", "text", "mask")
    both = _parts(turns, system).groupBy("conv_id", "perspective").agg(
        F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(part)).alias("parts"), F.sum("masked_chars").alias("masked_chars")
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    mask = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["text"])).alias("at"),
            F.concat(acc["spans"], F.transform(p["mask"], lambda m: F.struct((acc["at"] + m["start"]).alias("start"), (acc["at"] + m["end"]).alias("end")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return both.select("conv_id", "perspective", "n_turns", text.alias("text"), mask.alias("mask"), "masked_chars")


def _parts(turns: DataFrame, system: str) -> DataFrame:
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.floor(F.col("turn") / SPAN).cast("long").alias("chunk"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]
    within = Window.partitionBy("conv_id", "chunk").orderBy(*order)
    rows = rows.withColumn("at", F.row_number().over(within) - 1).withColumn("sub", F.floor(F.col("at") / PART))
    said = F.array_sort(F.collect_list(F.struct("at", "speaker", "text")))
    parts = rows.groupBy("conv_id", "chunk", "sub").agg(said.alias("said"))
    speakers = rows.where(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.*", "perspective")

    def head(t):
        name = F.translate(F.replace(t["speaker"], F.lit("<|"), F.lit("< |")), "\r\n", "  ")
        label = F.when(t["speaker"] == system, F.lit("system")).when(t["speaker"] == F.col("perspective"), F.lit("assistant"))
        return F.concat(F.lit(OPEN), F.coalesce(label, F.concat(F.lit("user name="), name)), F.lit("\n"))

    cut = F.transform("said", lambda t: F.struct(
        (t["speaker"] == F.col("perspective")).alias("own"), F.char_length(head(t)).alias("head"), (F.char_length(t["text"]) + len(CLOSE)).alias("body")
    ))
    text = F.array_join(F.transform("said", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE + "\n"))), "")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    spans = F.aggregate(
        "cut",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["head"] + x["body"] + 1).alias("at"),
            F.when(
                x["own"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    out = both.withColumns({"cut": cut, "out": text}).withColumn("mask", spans)
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(
        "conv_id", "perspective", "chunk", "sub", F.size("said").cast("long").alias("n_turns"),
        F.col("out").alias("text"), "mask", masked.alias("masked_chars"),
    )
