"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (three rounds of random signs and a
Hadamard transform) and hashed to its nearest signed axis; with more rotations per table the
axes are combined, so the number of buckets follows the number of rows.  A query probes, in
every table, the buckets whose axes are next nearest.  Candidates are ranked by the exact
cosine in double precision.

Equal vectors are one class with its five smallest ids and one more, enough for an exact
top five; copies never fill a bucket.  A bucket with more than SPLIT classes or queries is dealt
over several tasks, classes by queries, so no bucket is one task and none is cut.
Inside a task a bucket is one matrix product per block; only the best of each query leave it.

How many probes are needed grows with the rows.  `tune` finds the true neighbours of a sample of
queries in all rows, looks up at which probe of which table each of them lies, and takes the
fewest probes with which the sample reaches the recall asked for; if none does, buckets are
made wider.  So the recall holds at any size and its price is paid in candidates.

Vectors that are null, empty, zero or hold a null or non-finite number take no part; vectors
of different lengths are searched each among their own.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, cut

TABLES = 12  # whatever the rows, so that what is stored grows in proportion to them
PROBES = (16, 32, 64, 128, 256, 512, 1024)  # what `tune` chooses from
PER_BUCKET = 400  # wanted classes in a bucket of one table
RECALL = 0.97  # on the sample, so that all queries reach 0.9
SAMPLED = 100
SPLIT = 4096
SEED = 20240229


def _pad(d: int) -> int:
    return 1 << max(0, int(d - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """Pseudo-rotation of the rows of x, padded to a power of two."""
    n = _pad(x.shape[1])
    rng = np.random.Generator(np.random.PCG64([SEED, table, turn, n]))
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    for _ in range(3):
        out = hadamard(out * (rng.integers(0, 2, n) * 2 - 1))
    return out


def scores_of(y: np.ndarray, axes: int) -> np.ndarray:
    """Signed coordinates, the nearest signed axis first when sorted down; only the first `axes` coordinates."""
    return np.concatenate((y[:, :axes], -y[:, :axes]), axis=1)


def plan(classes: int, dims: int, wanted: int = PER_BUCKET) -> list[int]:
    """Axes used by each rotation of a table, so that a bucket holds about `wanted` classes."""
    n, need, out = _pad(dims), max(1.0, classes / wanted), []
    while need > 1:
        axes = int(min(n, max(1, np.ceil(need / 2))))
        out.append(axes)
        need /= 2 * axes
    return out or [1]


def bucket_probes(x: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """(rows, probes) bucket numbers, best first; -1 where there are fewer."""
    total, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for turn, a in enumerate(axes):
        s = scores_of(rotations(x, table, turn), a)
        k = min(probes, s.shape[1])
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(x), 1))
        best = np.take_along_axis(s, top, axis=1)
        # distance to an axis falls with its coordinate: the sum over rotations ranks the combinations
        total = (total[:, :, None] + best[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * a) + top[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        total, code = np.take_along_axis(total, order, axis=1), np.take_along_axis(code, order, axis=1)
    return code


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(len(col), -1)


def _hash(dims: int, axes: list[int], tables: int, probes: int):
    """(cid, query, vector) -> rows (table, bucket, cid, query, vector): one bucket a table to be found in, `probes` to look in."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                if not part.num_rows:
                    continue
                x = _matrix(part.column(2))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                asks = np.flatnonzero(part.column(1).to_numpy(zero_copy_only=False))
                for t in range(tables):
                    code = bucket_probes(x, t, axes, 1)[:, 0]
                    rows, codes, query = np.arange(len(x)), code, np.zeros(len(x), bool)
                    if len(asks):
                        p = bucket_probes(x[asks], t, axes, probes)
                        rows = np.concatenate((rows, np.repeat(asks, p.shape[1])))
                        codes = np.concatenate((codes, p.ravel()))
                        query = np.concatenate((query, np.ones(p.size, bool)))
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(codes), part.column(0).take(at), pa.array(query), part.column(2).take(at)], names=["table", "bucket", "cid", "query", "vector"])

    return run


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision, the same for a pair wherever it is computed."""
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def _search(keep: int):
    """Rows sorted by (key, query first) -> (qid, cid, score): the best `keep` of every query in every bucket."""

    def block(qid, q, cid, c):
        un, vn = q / np.linalg.norm(q, axis=1, keepdims=True), c / np.linalg.norm(c, axis=1, keepdims=True)
        for a in range(0, len(q), 512):
            s = un[a : a + 512] @ vn.T
            k = min(keep, s.shape[1])
            floor = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 1e-12  # ties stay
            r, j = np.nonzero(s >= floor)
            r += a
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(r)), cid.take(pa.array(j)), pa.array(exact(q[r], c[j]))], names=["qid", "cid", "score"])

    def run(batches):
        now, qids, qs = None, None, None
        for b in batches:
            key = b.column(0).to_numpy()
            query = b.column(2).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (query[1:] != query[:-1])))) if len(key) else []
            for a, z in zip(edge, [*edge[1:], len(key)]):
                part = b.slice(a, z - a)
                if query[a]:
                    ids, x = part.column(1), _matrix(part.column(3))
                    if now == key[a]:
                        qids, qs = pa.concat_arrays([qids, ids]), np.concatenate((qs, x))
                    else:
                        now, qids, qs = key[a], ids, x
                elif now == key[a]:
                    for lo in range(0, part.num_rows, 4096):
                        some = part.slice(lo, 4096)
                        yield from block(qids, qs, some.column(1), _matrix(some.column(3)))

    return run


def _neighbours(queries: dict[str, np.ndarray], keep: int):
    """(cid, vector) -> (qid, cid, score, vector): the best `keep` of the task for every sampled query, itself left out."""
    ids, q = list(queries), np.stack(list(queries.values()))
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)

    def run(batches):
        best: list[list] = [[] for _ in ids]
        for b in batches:
            if not b.num_rows:
                continue
            c = _matrix(b.column(1))
            s = unit @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
            names = b.column(0).to_pylist()
            k = min(keep + 1, s.shape[1])
            for i, row in enumerate(s):
                some = [(float(row[j]), names[j], c[j].tobytes()) for j in np.argpartition(-row, k - 1)[:k].tolist() if names[j] != ids[i]]
                best[i] = sorted(best[i] + some, reverse=True)[:keep]
        rows = [(ids[i], cid, score, vector) for i, found in enumerate(best) for score, cid, vector in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["qid", "cid", "score", "vector"])

    return run


def tune(classes: DataFrame, n: int, dims: int, k: int, recall: float = RECALL, sampled: int = SAMPLED) -> tuple[list[int], int, int, float]:
    """(axes, tables, probes, recall on the sample) for `classes` (cid, query, vector) of one dimension, `n` of them."""
    drawn = classes.filter("query").orderBy(F.xxhash64("cid", F.lit(SEED))).select("cid", "vector").limit(sampled).collect()
    if not drawn or n < 2:
        return plan(n, dims), TABLES, PROBES[0], 1.0
    queries = {r.cid: np.frombuffer(r.vector, "<f8") for r in drawn}
    near = classes.select("cid", "vector").mapInArrow(_neighbours(queries, k), "qid string, cid string, score double, vector binary")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    true = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()  # sampled x k rows
    q = np.stack([queries[r.qid] for r in true])
    c = np.stack([np.frombuffer(r.vector, "<f8") for r in true])
    q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, c))
    wanted = PER_BUCKET
    while True:
        axes = plan(n, dims, wanted)
        first = np.full(len(true), max(PROBES))
        for t in range(TABLES):
            hit = bucket_probes(q, t, axes, max(PROBES)) == bucket_probes(c, t, axes, 1)
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), max(PROBES)))
        for p in PROBES:
            got = float((first < p).mean())
            if got >= recall:
                return axes, TABLES, p, got
        wanted *= 4  # with one bucket every probe finds everything


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(sound, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _pack(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(x, "<f8").tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "vector"])


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`.

    Ties go to the smaller vec_id; a row does not find itself; a null vec_id asks nothing and
    is not found.  A vec_id that occurs with several vectors asks and is found with each;
    its best score counts.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = usable(vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL"))
    packed = cut(rows.mapInArrow(_pack, f"vec_id {id_type}, vector binary"))
    members = packed.select("vec_id", F.md5("vector").alias("cid"))
    asks = F.pmod(F.col("vec_id"), every) == 0
    classes = cut(packed.groupBy(F.md5("vector").alias("cid")).agg(F.first("vector").alias("vector"), F.max(asks).alias("query")))
    low = Window.partitionBy("cid").orderBy("vec_id")
    ids = cut(members.distinct().withColumn("n", F.row_number().over(low)).filter(F.col("n") <= k + 1).select("cid", "vec_id"))
    found = None
    for length, n in [(r[0], r[1]) for r in classes.groupBy(F.octet_length("vector")).count().collect()]:  # lengths of vectors: a handful
        part = classes.filter(F.octet_length("vector") == length).select("cid", "query", "vector")
        axes, tables, probes, _ = tune(part, n, length // 8, k, recall)
        hashed = part.mapInArrow(_hash(length // 8, axes, tables, probes), "table int, bucket bigint, cid string, query boolean, vector binary")
        hashed = cut(hashed.filter("bucket >= 0"))
        pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.count(F.when(c, 1)) / SPLIT)).cast("int")
        asked = F.count(F.when(F.col("query"), 1)) > 0
        size = hashed.groupBy("table", "bucket").agg(pieces(~F.col("query")).alias("parts"), pieces(F.col("query")).alias("qparts"), asked.alias("asked"))
        size = cut(size.filter("asked").drop("asked"))
        placed = hashed.join(checked(size), ["table", "bucket"])
        turn = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = placed.filter("NOT query").withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int")).withColumn("qpart", turn("qparts"))
        sent = placed.filter("query").withColumn("part", turn("parts")).withColumn("qpart", F.pmod(F.xxhash64("cid"), "qparts").cast("int"))
        work = own.unionByName(sent).select(F.xxhash64("table", "bucket", "part", "qpart").alias("key"), "cid", "query", "vector")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = work.repartition(tasks, "key").sortWithinPartitions("key", F.col("query").desc()).mapInArrow(_search(k + 3), "qid string, cid string, score double")
        got = got.groupBy("qid", "cid").agg(F.max("score").alias("score"))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    # the best classes of a query class: k + 1 distinct scores are enough, each class has an id; its own class counts too
    tie = Window.partitionBy("qid").orderBy(F.col("score").desc())
    top = cut(found.withColumn("r", F.rank().over(tie)).filter(F.col("r") <= k + 1).select("qid", "cid", "score"))
    queries = members.filter(asks).distinct().select(F.col("cid").alias("qid"), F.col("vec_id").alias("query_id"))
    pairs = queries.join(top, "qid").join(ids, "cid").filter(F.col("vec_id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
