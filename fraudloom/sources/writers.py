"""Sinks. Re-running a job replaces what it wrote before and never duplicates it.

Keyed tables are split into hash buckets whose number grows with the table (linear hashing): a
small batch reads and rewrites the buckets that its keys fall in, at any size of the table.
The file `_layout` beside the buckets holds their number n.  A key with hash h is in bucket
h mod 2m if that is below n, else in h mod m, m the largest power of two up to n; so bucket
n + 1 only takes rows from one bucket.  A merge splits buckets when those it wrote hold more than
`bucket_bytes` on average, at most as many as it wrote anyway.

A merge first writes all new content of its buckets to a folder of its own and names it in
`_layout`; then it replaces the buckets; then it takes the name out.  A merge that was cut off
is finished by the next one from that folder, so no row is lost or doubled.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BYTES = 128 << 20
FIRST_BUCKETS = 8
LAYOUT = "_layout"


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as one max_by aggregation (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(*keys, "e.*").select(*df.columns)


class _Folder:
    """A table folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *names)) if names else self.path)

    def layout(self) -> dict | None:
        if not self.fs.exists(self.at(LAYOUT)):
            return None
        stream = self.fs.open(self.at(LAYOUT))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_layout(self, **layout) -> None:
        fresh = self.at(f"{LAYOUT}-{uuid.uuid4().hex}")
        stream = self.fs.create(fresh, True)
        stream.write(bytearray(json.dumps(layout).encode()))
        stream.close()
        self.fs.delete(self.at(LAYOUT), False)
        self.fs.rename(fresh, self.at(LAYOUT))

    def bytes_of(self, names: list[str]) -> int:
        there = [self.at(n) for n in names if self.fs.exists(self.at(n))]
        return sum(self.fs.getContentSummary(p).getLength() for p in there)

    def size(self) -> int:
        return self.fs.getContentSummary(self.at()).getLength()

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def bucket_of(key: str, n: int) -> Column:
    """Bucket of a key when there are n, by linear hashing."""
    m = 1 << (n.bit_length() - 1)
    h = F.xxhash64(key)
    wide = F.pmod(h, F.lit(2 * m))
    return F.when(wide < n, wide).otherwise(F.pmod(h, F.lit(m))).cast("int")


def _sources(first: int, last: int) -> list[int]:
    """Buckets whose rows go to the buckets first..last-1 as they are opened one by one."""
    return [b - (1 << (b.bit_length() - 1)) for b in range(first, last)]


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A keyed table; columns that came later are null in older rows."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop("part")


def is_keyed(spark: SparkSession, path: str) -> bool:
    return _Folder(spark, path).layout() is not None


def holds_files(spark: SparkSession, path: str) -> bool:
    folder = _Folder(spark, path)
    return folder.fs.exists(folder.at()) and len(folder.fs.listStatus(folder.at())) > 0


def read_buckets(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame | None:
    """Rows of a keyed table whose keys (the columns of `wanted`, the table's first key first) occur in `wanted`; None without a table.

    Only the buckets that the keys fall in are listed and read.
    """
    folder = _Folder(spark, path)
    layout = folder.layout()
    if layout is None:
        return None
    if "pending" in layout:
        _replace(spark, folder, layout)
    keys = wanted.distinct()
    parts = [r[0] for r in keys.select(bucket_of(wanted.columns[0], layout["n"])).distinct().collect()]  # at most n
    there = [f"{path}/part={b}" for b in parts if folder.fs.exists(folder.at(f"part={b}"))]
    table = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*there) if there else read_keyed(spark, path).limit(0)
    return table.drop("part").join(keys, wanted.columns, "left_semi")


def _replace(spark: SparkSession, folder: _Folder, layout: dict) -> None:
    """The second half of a merge; doing it again changes nothing."""
    content = spark.read.parquet(layout["pending"])
    here = {r.part for r in content.select("part").distinct().collect()}  # at most the buckets of the merge
    content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder.path)
    for b in set(layout["replaced"]) - here:
        folder.drop(f"part={b}")
    folder.put_layout(n=layout["n"])


def replace_by_key(df: DataFrame, path: str, keys: list[str], order: list[str], bucket_bytes: int = BUCKET_BYTES, first_buckets: int = FIRST_BUCKETS) -> None:
    """Merge into a keyed parquet table; of rows with one key the one that is last in `order` stays.

    Columns are matched by name: one that the table lacks is null in its older rows, one that the
    batch lacks is null in the batch's rows.
    """
    from ..operators.durable import fresh_path

    spark, folder = df.sparkSession, _Folder(df.sparkSession, path)
    layout = folder.layout()
    if layout and "pending" in layout:
        _replace(spark, folder, layout)
        layout = folder.layout()
    if layout is None and holds_files(spark, path):
        raise ValueError(f"{path} holds files but no layout: not a keyed table")
    n = layout["n"] if layout else first_buckets
    if layout is None:  # the first load is written once to learn its size
        first = fresh_path(spark, "first")
        latest_per_key(df, keys, order).write.parquet(first)
        n = max(n, -(-_Folder(spark, first).size() // bucket_bytes))
        df = spark.read.schema(df.schema).parquet(first)
    new = df.withColumn("part", bucket_of(keys[0], n))
    touched = sorted(r.part for r in new.select("part").distinct().collect())  # at most n
    if not touched:
        return
    room = -(-folder.bytes_of([f"part={b}" for b in touched]) // len(touched)) if layout else 0
    more = min(len(touched), n * max(0, -(-room // bucket_bytes) - 1))
    read = sorted(set(touched) | {b for b in _sources(n, n + more) if b < n})
    if layout:
        held = [b for b in read if folder.fs.exists(folder.at(f"part={b}"))]
        if held:
            old = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*[f"{path}/part={b}" for b in held])
            new = new.unionByName(old, allowMissingColumns=True)
    n += more
    new = new.withColumn("part", bucket_of(keys[0], n))
    pending = fresh_path(spark, "merge")
    latest_per_key(new, keys + ["part"], order).repartition("part").write.parquet(pending)
    folder.fs.mkdirs(folder.at())
    whole = {"n": n, "pending": pending, "replaced": read}
    folder.put_layout(**whole)
    _replace(spark, folder, whole)


def write_verdicts(df: DataFrame, path: str) -> None:
    """SNK1: one verdict per submission, the newest."""
    replace_by_key(df, path, ["submission_id"], ["decided_at"])


def write_biometrics(df: DataFrame, path: str) -> None:
    """SNK2: vectors or hashes keyed by submission and kind."""
    replace_by_key(df, path, ["submission_id", "kind"], ["created_at"])


def append_audit(df: DataFrame, path: str, grain: str = "day") -> None:
    """SNK3: append-only event log, partitioned by day (or by a coarser grain for sparse logs).

    Rows of one period are brought together first, so a back-fill does not write one small
    file per task and period; AQE splits a period that is too big for one task.
    """
    dated = df.withColumn(grain, F.to_date(F.date_trunc(grain, "created_at")))
    dated.hint("rebalance", grain).write.mode("append").partitionBy(grain).parquet(path)


def _safe(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(t)).otherwise(c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: _safe(v, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """PRJ6: NaN and infinities become null, inside structs, arrays and maps too."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_report(df: DataFrame, path: str) -> None:
    """SNK4: report JSON with explicit nulls."""
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def record_decisions(events: DataFrame, audit_path: str) -> None:
    """SNK6: analyst decisions (see `views.decision_events`) appended to the audit log."""
    append_audit(events.drop("decision"), audit_path)
