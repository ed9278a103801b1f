"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Toxic documents go, one document of each group of near-duplicates stays, strings of 200 bytes that occur more than once
are cut from the texts, documents that hold benchmark passages go, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontaminate, simhash, suffixes, toxicity
from quillspark.llm.common import materialize, table
from quillspark.llm.queries import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words have a similarity of 0.8 or more."""
    return simhash.thin(docs, shingle=5, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes covered by strings of 200 bytes that also start elsewhere: passages of over 50 words need not have 400."""
    return suffixes.cut_text(docs, length=200)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE counts and digests of what the other stages kept."""
    return bpe.encode_decode(docs, vocabulary(), keep_ids=False)


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("suffixes", repeats), ("decontamination", leaks), ("bpe", encode)]

ORACLE_SQL = None  # beyond SQL. tests/llm compares near-duplicates, suffixes and decontamination with brute force, BPE with the library; toxicity by held-out accuracy


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # nulls, ties, empty tables and clashing columns: as each stage's operator says
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
