"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm.chat import whole
from nocturne.llm.common import table
from nocturne.llm.exact_dedup import exact_dedup
from nocturne.llm.html_extract import html_extract
from nocturne.llm.mixing import mix
from nocturne.llm.quality_rules import quality_rules
from nocturne.llm.sentencepiece_lattice import encode
from nocturne.llm.simhash import simhash_dedup
from nocturne.llm.sql import ORACLES
from nocturne.llm.substring_dedup import substring_dedup
from nocturne.llm.toxicity import toxicity, train
from nocturne.llm.warc import warc_round_trip


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer's file; the folder is a parameter (NOCTURNE_TOKENIZERS)."""
    folder = os.environ.get("NOCTURNE_TOKENIZERS")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side, with the mask as text: start-end of each span."""
    out = whole(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ";")
    return out.select("conv_id", "perspective", "n_turns", "text", spans.alias("mask"), "masked_chars")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and whether decoding gives the text back."""
    return encode(table(spark, sf_dir, "documents"), model_path(), ids=False, check=True)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_mix, op2_chat, op3_simhash, op4_substring, op5_sentencepiece, op6_html, op7_quality, op8_exact_dedup, op9_warc, op10_toxicity)
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
