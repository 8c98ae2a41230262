"""The thin queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import audit, bpe, langid, licences, lm, mixing, neardup, packing, runs, simhash, spotsigs, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), bpe.TOKENIZER, "digests")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint(_table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(_table(spark, sf_dir, "documents")).withColumn("row", F.explode(F.expr("sequence(1L, m)")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ids=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.judged(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_planted(_table(spark, sf_dir, "documents"))
    return runs.digests(runs.find(docs))


def op7_spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with like fingerprints: those of equal fingerprints, and how many classes are like each."""
    pairs, members = spotsigs.similar_pairs(_table(spark, sf_dir, "documents"))
    both = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
    links = both.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_licences, op3_lm_score, op4_bpe, op5_warc, op6_url_filter, op7_spotsigs, op8_langid, op9_simhash, op10_mixing, op11_packing, op12_filter_audit, op13_periodic_runs, op7_spotsigs_classes)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.ORACLE, "op6_url_filter": urls.ORACLE, "op12_filter_audit": audit.ORACLE}
