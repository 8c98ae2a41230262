"""The corpus pipeline: language ID, SimHash near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``; a stage works on every row that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import bpe, langid, mixing, simhash
from tidewake.scratch import saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as often as the mix takes them; those it doesn't take go."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, and their decoding, as lengths and digests."""
    return bpe.encode(docs, bpe.TOKENIZER, "digests")


STAGES = [("language ID", identify_language), ("SimHash near-dedup", drop_near_duplicates), ("mixing to target weights", mix_sources), ("BPE encoding", encode)]

#: No stage of it can be said in SQL whole (naive Bayes, 64-bit hashes, dependent rounding, BPE); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage{i}")
    return docs
