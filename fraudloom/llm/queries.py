"""The registered queries of this folder, with the SQL that checks them where SQL can."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, fill_in_middle, importance, jaccard_join, license_scan, mix_sources, quality_kn, shard, simhash, suffix_tree_lm, token_counts, toxicity
from .common import bounded_batches


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 10)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), "piece_bpe_32k.model", limit=4096)


def op3_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"), 50, 5)


def op4_suffix_tree_lm(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree_lm.score_documents(_table(spark, folder, "documents"), 10)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"), 5)


def op6_quality_kn(spark: SparkSession, folder: str) -> DataFrame:
    return quality_kn.quality_table(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, folder, "documents"), 3, (90, 100)).select("doc_id", "n_shingles", "component_id")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_table(spark, folder, "documents"), license_scan.templates(spark))


def op9_shard(spark: SparkSession, folder: str) -> DataFrame:
    return shard.shard_table(_table(spark, folder, "documents"), 16)


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources.mix_table(_table(spark, folder, "documents"))


def op11_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), 4, 4)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, folder, "documents"))


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_token_counts, op3_cross_polytope, op4_suffix_tree_lm, op5_toxicity, op6_quality_kn, op7_jaccard_join, op8_license_scan, op9_shard, op10_mix_sources,
        op11_simhash_pivots, op12_fill_in_middle, op13_importance,
    )
}
ORACLES = {"op1_decontaminate": decontaminate.SQL, "op8_license_scan": license_scan.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_importance": importance.SQL}
