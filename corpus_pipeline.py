"""A corpus from raw documents to tokens: each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.

Stages are written as Parquet and read again, so that each has a short lineage and its own input. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from provena.llm import bpe, decontaminate, language, simhash, suffix_dedup
from provena.llm.common import fold, materialize, table


#: A document goes if no language has this share of its positions: of the held-out documents of the test tables over 99.9 % have.
LEAST_LANGUAGE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network recognises a language stay, and take it as their lang if they had none; noise and texts without a letter go."""
    net = language.learn(docs, fold(F.col("doc_id"), 4) != 2)
    found = language.identify(docs, net, whole=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))
    return found.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    return simhash.deduplicate(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in several of the remaining documents go from their texts; n_chars follows."""
    return suffix_dedup.removal(docs, unit="words", across=True, text=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), whole=True).where(~F.col("contaminated")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language id", language_id), ("near-duplicates", near_dedup), ("suffix-array dedup", suffix_array_dedup), ("decontamination", decontamination), ("byte-level BPE", encode)]

#: Three stages cannot be put in SQL; the tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
