"""Sharding by sampled splitters: shards of near equal bytes, in key order.

The order of a record is one 64-bit number: the high bits of the hash of its text, then
bits of the hash of its id and row, so equal texts are neighbours and still a group that
holds a third of all rows can be cut anywhere.  A size-weighted sample of these numbers
gives quantile splitters; records are range-partitioned by them, and ranges that come out
overfull are subdivided with a sample of their own.  Prefix sums over the range totals
turn the place of a record within its range into its place in the whole order.

Ties: rows that are equal as a whole are told apart by a stored row number, so a repeated
row takes a place of its own.  A null text has size 1.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE_PER_RANGE = 32
RANGES_PER_SHARD = 8
TEXT_BITS = 40


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def position(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, at.to_numpy(np.int64), "right").astype(np.int32))

    return position


def _sample(rows: DataFrame, total: int, wanted: int) -> list[tuple[int, int]]:
    """(at, weight) of about `wanted` records, drawn in proportion to size by a fixed hash; bounded by `wanted`."""
    unit = F.pmod(F.xxhash64("row", F.lit(7)), 1 << 30) / float(1 << 30)
    share = F.col("size") * (wanted / max(total, 1))
    picked = rows.filter(unit < share).select("at", F.greatest(F.ceil(share), F.lit(1)).cast("bigint").alias("w"))
    return [(r.at, r.w) for r in picked.collect()]


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[int]:
    if not sample or parts < 2:
        return []
    sample.sort()
    at, w = np.array([a for a, _ in sample], np.int64), np.array([b for _, b in sample], np.float64)
    run = np.cumsum(w)
    cuts = np.searchsorted(run, run[-1] * np.arange(1, parts) / parts, "left")
    return sorted(set(at[np.minimum(cuts, len(at) - 1)].tolist()))


def shard_slots(docs: DataFrame, shards: int = 16, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(stored input with a row number, row -> shard, slot) for any columns beside doc_id and text."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.monotonically_increasing_id().alias("__row"),
        size.alias("__size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"),
        F.xxhash64("doc_id").alias("__id"),
    )
    return _assign(cut(keyed), shards, rounds)


def _assign(stored: DataFrame, shards: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    low = 64 - TEXT_BITS
    at = F.shiftleft(F.shiftright("__text", low), low).bitwiseOR(F.shiftrightunsigned(F.xxhash64("__id", "__row"), TEXT_BITS))
    rows = stored.select(at.alias("at"), F.col("__row").alias("row"), F.col("__size").alias("size"))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(shards * RANGES_PER_SHARD, int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _quantiles(_sample(rows, total, parts * SAMPLE_PER_RANGE), parts)
    for _ in range(rounds):
        ranged = rows.withColumn("range", _range_of(np.array(cuts, np.int64))("at"))
        sums = [(r.range, r.n, r.b) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).orderBy("range").collect()]
        over = [(r, b) for r, k, b in sums if k > 1 and b > 2 * total / parts]
        more: set[int] = set()
        if over:
            full = ranged.filter(F.col("range").isin([r for r, _ in over]))
            share = sum(b for _, b in over)
            pieces = max(2 * len(over), -(-parts * share // max(total, 1)))
            drawn = _sample(full.select("at", "row", "size"), share, pieces * SAMPLE_PER_RANGE)
            inside = np.searchsorted(np.array(cuts, np.int64), [a for a, _ in drawn], "right")
            for r, b in over:
                more.update(_quantiles([d for d, i in zip(drawn, inside) if i == r], max(2, -(-parts * b // max(total, 1)))))
        if not more - set(cuts):
            break
        cuts = sorted(set(cuts) | more)
    # one row per range: places of its first record in the whole order
    starts, k, b = [], 0, 0
    for r, rn, rb in sums:
        starts.append((r, k, b))
        k, b = k + rn, b + rb
    offsets = stored.sparkSession.createDataFrame(starts or [(0, 0, 0)], "range int, row0 bigint, byte0 bigint")
    inside = Window.partitionBy("range").orderBy("at", "row")
    placed = ranged.withColumn("i", F.row_number().over(inside) - 1).withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # the table of ranges has as many rows as there are splitters, a parameter
    placed = placed.join(F.broadcast(offsets), "range").select(
        "row", (F.col("i") + F.col("row0")).alias("place"), F.least(((F.col("before") + F.col("byte0")) * shards / F.lit(max(total, 1))).cast("int"), F.lit(shards - 1)).alias("shard")
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return stored, placed.join(F.broadcast(first), "shard").select("row", "shard", (F.col("place") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """`docs` with shard (0 to shards-1) and slot (gapless from 0 within a shard)."""
    clash = {"shard", "slot"} & set(docs.columns)
    stored, slots = shard_slots(docs.drop(*clash), shards)
    return stored.join(slots.withColumnRenamed("row", "__row"), "__row").drop("__row", "__size", "__text", "__id")


def shard_table(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard without moving any text."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", size.alias("__size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__text"), F.xxhash64("doc_id").alias("__id"), F.monotonically_increasing_id().alias("__row"))
    stored, slots = _assign(cut(slim), shards, 6)
    out = stored.join(slots.withColumnRenamed("row", "__row"), "__row")
    return out.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
