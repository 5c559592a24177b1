"""From raw documents to token ids: the stages of a training corpus, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import bpe, exact_dedup, langid, minhash, mixing
from plenum.llm.common import WRITTEN, bounded, cut, discard, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the learnt languages, null texts and those without letters among them; fills in lang where it is null."""
    bounded(spark)
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near-duplicates."""
    bounded(spark)
    return minhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes near its target, in training order."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left, repeats included."""
    bounded(spark)
    return bpe.digest(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Language ID, MinHash and BPE can't be written in SQL; tests/llm compares run() with a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each result written and read again; what a stage wrote on its way is deleted when its result is there."""
    docs, before = table(spark, sf_dir, "documents"), len(WRITTEN)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        discard(spark, WRITTEN[before:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
