"""Lineage cuts that survive executor loss: tables written to the shared checkpoint folder.

A written table is computed once (a plain checkpoint() computes its input twice), and its
real size is known when the next join is planned.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="fraudloom-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str = "cut") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by hash of the keys over enough partitions that a task sees about TASK_ROWS of the `rows`, however many there are."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write the frame once and continue from the written table."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_cleaned(df: DataFrame, path: str | None = None) -> DataFrame:
    """`cut`, or appended to `path`; the files of its exchanges are removed at once and not when the driver collects garbage."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame, *metrics: Column) -> tuple[DataFrame, tuple]:
    """`cut`, and aggregates read back from the written table.

    (An Observation would save the read, but once a session has one, closures that capture
    the session can no longer be serialised.)
    """
    out = cut(df)
    return out, tuple(out.agg(*metrics).first())
