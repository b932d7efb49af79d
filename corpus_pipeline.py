"""The corpus pipeline: quality, near duplicates, contamination, mixture, shards.

Every stage takes (spark, docs, folder) and works on all rows its predecessor kept; it is
written as Parquet and reread before the next.  All but the last return the columns of docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraudloom.llm import decontaminate, jaccard_join, mix_sources, quality_kn, shard
from fraudloom.llm.common import bounded_batches, checked, cut, text_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    bounded_batches(spark, "1m")
    return quality_kn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 stays."""
    bounded_batches(spark, "1m")
    return jaccard_join.one_per_component(docs, 5, (8, 10))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    keyed = docs.withColumn("__tk", text_key())
    marked = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, ("__tk",))
    bad = cut(marked.filter("contaminated").select("__tk").distinct())
    return keyed.join(checked(bad), "__tk", "left_anti").drop("__tk")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight takes it."""
    return mix_sources.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes, with a gapless slot."""
    return shard.shard_documents(docs, 16)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("contamination", contamination), ("mixture", mixture), ("shards", shards)]
ORACLE_SQL = None  # the quality model has no SQL form; tests/llm checks run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
