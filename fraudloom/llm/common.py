"""What the operators of this folder share: size-checked joins and row keys."""
from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import cut, fresh_path  # noqa: F401  (used by the operators)

BROADCAST_ROWS = 200_000  # a side is broadcast only when it was counted and has at most this many slim rows


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of bounded size, so that long texts do not add up in a Python worker or in its JVM buffers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system, where the C library offers that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run):
    """The batch function `run`; after its last batch the worker, which stays for later tasks, keeps its imports only."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def checked(side: DataFrame, rows: int = BROADCAST_ROWS, known: int | None = None) -> DataFrame:
    """`side` with a broadcast hint if it is small (counted unless `known`); else as it is, for a shuffle join."""
    n = side.limit(rows + 1).count() if known is None else known
    return F.broadcast(side) if n <= rows else side.hint("merge")


def text_key() -> Column:
    """64-bit key of a row's text; null and empty text share one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def id_bytes(name: str = "doc_id") -> Column:
    return F.col(name).cast("string")


def crc_remainder(mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def join_counted(rows: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` joined with `side`, which has one row per `key` and in `count` how many rows carry it.

    Keys with over a 2000th of all rows are at most 2000 and are broadcast, so that no task of
    the shuffle join meets one of them.
    """
    total = side.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) > max(1000, total // 2000)
    hot = side.filter(often).drop(count)
    if not hot.limit(1).count():
        return rows.join(checked(side.drop(count)), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(checked(side.filter(~often).drop(count)), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
