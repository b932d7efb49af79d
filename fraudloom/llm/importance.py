"""Importance resampling towards a target distribution of hashed n-grams.

Batch concatenation: the texts of a batch are joined with a separator no word holds, one
regex pass finds all words, their starts are searched in the sorted text offsets, n-grams
whose first and last word lie in different texts are masked, and one bincount adds up the
rest.  A first pass counts the buckets of the corpus and of the target; the counts are a
table of fixed size whatever the input.  A second pass takes the mean gain of every text.

The draw is a top k by weight plus Gumbel noise from the id.  Scores are whole thousandths,
so rows per score are a short table that gives the threshold; rank is the number of better
scores plus the place among equal ones, counted in (score, id, task of origin) cells.  No
window holds more than the rows of one score.

Defined cases: null and empty texts have no features, weight 0, and are never drawn; a null id
draws as the empty text and comes last among equal scores; repeated rows are rows of their own
and take ranks one after the other; an empty target or corpus gives gains from the smoothing
alone; other columns of the input are not read.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import LOWER, slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\n"


def features(raw: np.ndarray, off: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, its text, number of words of every text) of a slice."""
    buf = LOWER[raw].tobytes()
    edges = off.tolist()
    joined = SEPARATOR.join([buf[a:b] for a, b in zip(edges[:-1], edges[1:])])
    begins = off[:-1] + np.arange(len(off) - 1) * len(SEPARATOR)
    crc, found, at = zlib.crc32, [], []
    for m in WORD.finditer(joined):
        found.append(m[0])
        at.append(m.start())
    doc = np.searchsorted(begins, np.array(at, np.int64), "right") - 1
    value = list(map(crc, found))
    of, where = [np.array(value, np.int64)], [doc]
    for n in range(2, longest + 1):  # checksums go on where the shorter run ended
        value = [crc(w, crc(b" ", v)) for v, w in zip(value, found[n - 1 :])]
        whole = doc[: len(value)] == doc[n - 1 :] if value else np.zeros(0, bool)
        of.append(np.array(value, np.int64)[whole])
        where.append(doc[: len(value)][whole])
    return np.concatenate(of) % buckets, np.concatenate(where), np.bincount(doc, minlength=len(off) - 1)


def _count(longest: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, raw, off in slices(b.column(0)):
                total += np.bincount(features(raw, off, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: at most `buckets` rows."""
    return texts.select("text").mapInArrow(_count(longest, buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed bucket shares."""
    both = bucket_counts(docs, longest, buckets).withColumn("t", F.lit(False)).unionByName(bucket_counts(target, longest, buckets).withColumn("t", F.lit(True)))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.collect():  # at most two rows a bucket
        (t if r.t else s)[r.bucket] = r.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weights(longest: int, buckets: int, gain):
    def run(batches):
        worth = gain.value
        for b in batches:
            for lo, hi, raw, off in slices(b.column(1)):
                bucket, doc, words = features(raw, off, longest, buckets)
                n = np.bincount(doc, minlength=hi - lo)
                total = np.bincount(doc, weights=worth[bucket], minlength=hi - lo).astype(np.int64)  # whole numbers below 2^53
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(words), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "n_words", "weight"]
                )

    return run


def weigh(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, n_words, weight: one row per input row."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(docs, target, longest, buckets))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_weights(longest, buckets, gain), f"doc_id {id_type}, n_features bigint, n_words bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per input row; rank is null for rows not drawn.

    `percent` of 100 rows with at least `least_words` words are drawn, highest score first,
    ties to the smaller id.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weigh(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))
    may = F.col("n_words") >= least_words
    by_score = scored.filter(may).groupBy("score").agg(F.count(F.lit(1)).alias("c"))  # scores are whole thousandths: a short table
    above = F.sum("c").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    by_score = cut(by_score.select("score", "c", F.coalesce(above, F.lit(0)).alias("before")))
    n = by_score.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    k = percent * n // 100
    floor = by_score.filter(F.col("before") < k).agg(F.min("score")).first()[0] if k else None
    first = ["doc_id", "n_features", "weight", "score"]
    if floor is None:
        return scored.select(*first, F.lit(None).cast("bigint").alias("rank"))
    top = may & (F.col("score") >= floor)
    drawn = scored.filter(top).withColumn("task", F.shiftright("row", 33))
    cells = drawn.groupBy("score", "doc_id", "task").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "task").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("c").over(order), F.lit(0))).drop("c").withColumnRenamed("doc_id", "id").withColumnRenamed("task", "of").withColumnRenamed("score", "s")
    local = drawn.withColumn("i", F.row_number().over(Window.partitionBy("score", "doc_id", "task").orderBy("row")))
    met = local.join(cells, (F.col("score") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("task") == F.col("of")))
    met = met.join(F.broadcast(by_score.filter(F.col("score") >= floor).select(F.col("score").alias("at"), "before")), F.col("score") == F.col("at"))  # one row a score
    rank = F.col("before") + F.col("start") + F.col("i")
    ranked = met.select(*first, F.when(rank <= k, rank).cast("bigint").alias("rank"))
    return scored.filter(~top).select(*first, F.lit(None).cast("bigint").alias("rank")).unionByName(ranked)


SQL = r"""
WITH RECURSIVE low AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS x FROM low), gw AS (SELECT unnest(w) AS x FROM goal),
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
vocabulary AS (SELECT x, hex(encode(x)) AS b FROM (SELECT x FROM dw UNION SELECT x FROM gw)),
step(x, b, pos, c) AS (SELECT x, b, 1, 4294967295::BIGINT FROM vocabulary UNION ALL
  SELECT x, b, pos + 2, xor(t[xor(c % 256, ('0x' || b[pos:pos + 1])::BIGINT) + 1], c // 256) FROM step, tab WHERE pos < length(b)),
crc AS (SELECT x, xor(c, 4294967295::BIGINT) % 10000 AS k FROM step WHERE pos > length(b)),
sc AS (SELECT k, count(*) AS s FROM dw JOIN crc USING (x) GROUP BY k), tc AS (SELECT k, count(*) AS t FROM gw JOIN crc USING (x) GROUP BY k),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM sc)::DOUBLE AS su, (SELECT coalesce(sum(t), 0) FROM tc)::DOUBLE AS ta),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (su + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (ta + 10000))))::BIGINT AS g FROM sc LEFT JOIN tc USING (k), tot),
per AS (SELECT r, count(*) AS n, floor(sum(g) / count(*)::DOUBLE)::BIGINT AS weight FROM dw JOIN crc USING (x) JOIN gain USING (k) GROUP BY r),
sco AS (SELECT doc_id, r, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM low LEFT JOIN per USING (r)),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () AS n FROM sco WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN p <= 10 * n // 100 THEN p END::BIGINT AS rank FROM sco LEFT JOIN rk USING (r)
"""
