"""A corpus pipeline: language ID, near-duplicate removal, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next stage's docs.
All stages but the last return the columns of ``documents``, whatever further ones there are and whatever their names; the last
returns the pieces of packed sequences.

The first stage identifies every text's language and writes it to ``lang`` in place of the label; the last packs each language by itself
and returns it with each piece.

Edge cases: a null or letterless text goes in the first stage.  Rows without a doc_id go through all stages: they are neither
near-duplicates nor searched for passages.  Rows that share a doc_id are judged by their own texts; equal rows count once in near-dedup.
Of a class of near-duplicates the lowest doc_id stays (of several texts of it, the one of the lowest hash), of a repeated passage the
first place in the lowest doc_id.  Texts may be of any length; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import cdc, langid, packing, probminhash
from tributary.llm.common import table
from tributary.session import drop, settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, with that language as their lang; those without a letter go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the lowest doc_id, of each class of near-duplicates."""
    return probminhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier, n_chars with them; documents of which nothing is left go."""
    out = cdc.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences, each of one language (the one that the first stage identified)."""
    return packing.pack_documents(docs, by="lang")


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]

#: SQL can't express the stages (kernel regression, sampled hashing, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on its way, and its input, are removed once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
