"""Operators as steps of a corpus pipeline: documents in, documents out.

Columns of the input stay as they are, whatever their names: a row travels as one struct
beside the columns that an operator needs.  A document is a doc_id and a text: rows that
share an id but not a text are documents of their own; null ids and null texts are values
like others; texts are read whole, whatever their length.  Of rows with equal id and text
one is kept where a step keeps one, that with the least hash of the whole row.  An empty
table passes every step empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import strip_blanks
from nocturne.llm.exact_dedup import exact_dedup
from nocturne.llm.mixing import mix
from nocturne.llm.near_dedup import near_dedup
from nocturne.llm.quality_rules import judge
from nocturne.llm.sentencepiece_lattice import encode


def _packed(docs: DataFrame, *columns) -> DataFrame:
    """``columns``, the row as one struct, and a hash of the row (but for maps, which have none)."""
    plain = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.xxhash64(*plain).alias("_hash"), *columns)


def keep_quality(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep."""
    judged = judge(_packed(docs, docs["text"].alias("text")), keep=("_row",))
    return judged.where("kept").select("_row.*")


def keep_exact(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts: of rows with the id that stays, the longest text before white space is deleted."""
    kept = exact_dedup(docs).where("kept").select(F.xxhash64("doc_id", "text_sha256").alias("_key"), F.col("doc_id").alias("_doc"), "text_sha256")
    sha = F.sha2(F.encode(strip_blanks(docs["text"]), "UTF-8"), 256)
    rows = _packed(docs, docs["doc_id"].alias("_id"), sha.alias("_sha")).withColumn("_key", F.xxhash64("_id", "_sha"))
    rows = rows.join(kept, (rows["_key"] == kept["_key"]) & rows["_id"].eqNullSafe(kept["_doc"]) & (rows["_sha"] == kept["text_sha256"]), "left_semi")
    first = F.struct((-F.coalesce(F.char_length(F.col("_row").getField("text")), F.lit(0))).alias("n"), "_hash")
    return rows.groupBy("_key", "_id", "_sha").agg(F.min_by("_row", first).alias("_row")).select("_row.*")


def keep_near(docs: DataFrame) -> DataFrame:
    """The document with the least id of each group of near copies: candidates by SimHash and by bands, five-word shingles, Jaccard similarity 0.8 or more."""
    first = near_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.lit(True).alias("_kept"))
    rows = _packed(docs, docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_copy"))
    # Grouped together and not joined, so that the texts are shuffled once; of equal rows that with the least hash stays, the same in every run.
    both = rows.unionByName(first, allowMissingColumns=True).groupBy("_id", "_copy").agg(F.min_by("_row", "_hash").alias("_row"), F.max("_kept").alias("_kept"))
    return both.where("_kept").select("_row.*")


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them, a share of a half or more counting as once more.

    The mix takes whole passes of a source's stream and part of one, so only documents at
    a pass's end are rounded; rows with equal id, text and source are taken alike, by the mean.
    """
    key = lambda c, s: F.xxhash64(c, "copy", s).alias("_key")
    plan = mix(docs, copies=True).where("size > 0").groupBy("doc_id", "copy", "source").agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("_times"))
    plan = plan.where("_times > 0").select(key("doc_id", "source"), F.col("doc_id").alias("_doc"), F.col("copy").alias("_text"), F.col("source").alias("_from"), "_times")
    rows = _packed(docs, docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("copy"), docs["source"].alias("_source"))
    rows = rows.withColumn("_key", key("_id", "_source"))
    same = rows["_id"].eqNullSafe(plan["_doc"]) & (rows["copy"] == plan["_text"]) & rows["_source"].eqNullSafe(plan["_from"])
    taken = rows.join(plan, (rows["_key"] == plan["_key"]) & same).select("_row", "_times")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and ids of every row."""
    return encode(docs, model)
