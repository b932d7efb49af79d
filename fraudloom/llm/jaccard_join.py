"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Method
1. Every text becomes its set of distinct k-word shingle hashes (64 bits).  Equal sets are
   one class; copies never meet each other again.
2. A fixed-size frequency sketch orders shingles rare first.  The order only prunes: any
   global order gives the same links.  A set of n shingles links at t only with sets that
   share one of its first n - ceil(t n) + 1 shingles (prefix filter).
3. Classes with the same prefix and size are one group; shingle lists are built and
   filtered on groups (a list with one group is dropped), then expanded to members.
4. Pairs inside a list pass by size and by a parity bitmap: two sets within reach of t
   differ in at most (1-t)/(1+t) (n1+n2) shingles, and the XOR of the bitmaps cannot have
   more bits than that.  The bound loses nothing.
5. Round one keeps a spanning forest of the passing pairs of each list and verifies it on
   the full sets.  Round two takes every passing pair whose ends are still in different
   components and verifies it.  So pairs within a crowd are never all made, and every link
   that could join two components is checked exactly.

Crowded lists are cut into blocks of `BLOCK` members and block pairs, so no list is one task.
Null or empty text has an empty set and links with nothing.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import component_roots
from .common import checked, cut, give_back, text_key, trimmed
from .tokens import mix, shingle_sets, slices

CELL_BITS = 23  # 8 MB sketch, whatever the input; more bits only prune better
SEGMENTS = 64
SHORT_BITS, LONG_BITS, LONG_SET = 512, 2048, 1000  # bitmap of a set, and from which size on it is the long one
BLOCK = 512


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles that fall on each bit; a long bitmap folds to the short one by XOR."""
    width = SHORT_BITS if len(s) < LONG_SET else LONG_BITS
    at = (mix(s) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _unpack_bitmaps(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(short bitmaps of all, row of the long ones or -1, long bitmaps)."""
    long = np.array([len(b) * 8 == LONG_BITS for b in blobs], bool)
    short = np.zeros((len(blobs), SHORT_BITS // 64), np.uint64)
    short[~long] = np.frombuffer(b"".join(b for b in blobs if len(b) * 8 != LONG_BITS), np.uint64).reshape(-1, SHORT_BITS // 64)
    full = np.frombuffer(b"".join(b for b in blobs if len(b) * 8 == LONG_BITS), np.uint64).reshape(-1, LONG_BITS // 64)
    short[long] = np.bitwise_xor.reduce(full.reshape(len(full), LONG_BITS // SHORT_BITS, -1), axis=1) if len(full) else 0
    at = np.full(len(blobs), -1)
    at[long] = np.arange(len(full))
    return short, at, full


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _profile(k: int):
    """(doc_id, tkey, text) -> one row per document (n, digest) and, at the end, the sketch of the task."""

    def run(batches):
        counts = np.zeros(1 << CELL_BITS, np.uint8)  # a task's counts end at 255; the order needs magnitudes only
        for b in batches:
            ids, keys, texts = b.column(0), b.column(1), b.column(2)
            for lo, hi, raw, off in slices(texts):
                sets = shingle_sets(raw, off, k)
                if any(map(len, sets)):
                    at, c = np.unique(_cells(np.concatenate(sets)), return_counts=True)
                    counts[at] = np.minimum(255, counts[at] + c)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), keys.slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["doc_id", "tkey", "n", "digest", "segment", "cells"],
                )
        if counts.any():
            parts = counts.reshape(SEGMENTS, -1)
            blobs = [zlib.compress(p.tobytes(), 1) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SEGMENTS, ids.type), pa.nulls(SEGMENTS, pa.int64()), pa.nulls(SEGMENTS, pa.int64()), pa.nulls(SEGMENTS, pa.binary()), pa.array(range(SEGMENTS), pa.int32()), pa.array(blobs, pa.binary())],
                names=["doc_id", "tkey", "n", "digest", "segment", "cells"],
            )

    return run


def _sum_cells(batches):
    """Rows of (segment, cells), grouped into tasks by segment -> one summed row per segment."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for seg, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), np.uint8)
            total[seg] = total[seg] + part if seg in total else part.astype(np.uint64)
    if total:
        # the order needs magnitudes only: a step of one eighth of a power of two
        level = [np.minimum(255, np.round(8 * np.log2(1 + p.astype(np.float64)))).astype(np.uint8) for p in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in level], pa.binary())], names=["segment", "cells"])


def _prefixes(k: int, num: int, den: int, sketch):
    """text -> (digest, n, gid, prefix, bits), once per digest of the task."""

    def run(batches):
        levels = np.frombuffer(sketch.value, np.uint8)
        seen: set[bytes] = set()
        for b in batches:
            for _, _, raw, off in slices(b.column(0)):
                rows = []
                for s in shingle_sets(raw, off, k):
                    if not len(s) or (d := digest(s)) in seen:
                        continue
                    seen.add(d)
                    p = prefix_length(len(s), num, den)
                    if p < len(s):
                        level = levels[_cells(s)]
                        if p < len(s) // 2:  # the p rarest: cut by level first, then sort what is left
                            last = np.partition(level, p - 1)[p - 1]
                            keep = level <= last
                            part, level = s[keep], level[keep]
                        else:
                            part = s
                        head = part[np.argsort(level, kind="stable")[:p]]  # ties by hash: s is sorted
                    else:
                        head = s
                    gid = hashlib.blake2b(head.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest()
                    rows.append((d, len(s), gid, head.tobytes(), bitmap(s)))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.binary()) for i, c in enumerate(cols)], names=["digest", "n", "gid", "prefix", "bits"])

    return run


def _explode_prefix(batches):
    for b in batches:
        gnums, prefixes = b.column(0), b.column(1).to_pylist()
        lens = np.array([len(p) // 8 for p in prefixes], np.int64)
        tokens = np.frombuffer(b"".join(prefixes), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), gnums.take(pa.array(np.repeat(np.arange(len(lens)), lens)))], names=["token", "gnum"])


def _list_pairs(num: int, den: int, forest: bool):
    """Rows sorted by list key -> passing pairs (list, a, b); forest: at most one path between two members of a list."""

    def passing(x, y, n, short, at, full, tier):
        """popcount of the XOR is at most tier (den-num)/(den+num) (n1+n2)."""
        most = tier * (den - num) * (n[x] + n[y])
        ok = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64) * (den + num) <= most
        both = np.flatnonzero(ok & (at[x] >= 0) & (at[y] >= 0))
        if len(both):
            ok[both] = np.bitwise_count(full[at[x[both]]] ^ full[at[y[both]]]).sum(axis=1, dtype=np.int64) * (den + num) <= most[both]
        return ok

    def merge(lab, x, y):
        """Joins the labels of x and y, in place; which pairs joined two."""
        parent: dict[int, int] = {}

        def find(v):
            while (p := parent.get(v, v)) != v:
                v = p
            return v

        keep = np.zeros(len(x), bool)
        for i, (u, v) in enumerate(zip(lab[x].tolist(), lab[y].tolist())):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
                keep[i] = True
        if parent:
            old = np.array(sorted(parent), np.int64)
            new = np.array([find(v) for v in old.tolist()], np.int64)
            at = np.minimum(np.searchsorted(old, lab), len(old) - 1)
            hit = old[at] == lab
            lab[hit] = new[at[hit]]
        return keep

    def pairs_of(key, n, blk, two, lab, maps):
        """Rows sorted by key; lab: component label of each row."""
        out = [np.zeros((2, 0), np.int64)]
        for tier in (0.7, 1.0) if forest else (1.0,):
            gap, live = 1, np.arange(len(key))
            while True:
                live = live[live + gap < len(key)]
                live = live[key[live] == key[live + gap]]
                if not len(live):
                    break
                a, b = live, live + gap
                ok = (lab[a] != lab[b]) & (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & (~two[a] | (blk[a] != blk[b]))
                a, b = a[ok], b[ok]
                for c in range(0, len(a), 1 << 14):
                    x, y = a[c : c + (1 << 14)], b[c : c + (1 << 14)]
                    good = passing(x, y, n, *maps, tier)
                    x, y = x[good], y[good]
                    if forest:
                        keep = merge(lab, x, y)
                        x, y = x[keep], y[keep]
                    out.append(np.stack([x, y]))
                gap += 1
        return np.concatenate(out, axis=1)

    def work(rows: pa.Table):
        key = rows["key"].to_numpy()
        lists = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
        nums, comp = rows["num"].to_numpy(), rows["comp"].to_numpy()
        lab = np.arange(len(key)) if forest else np.unique(comp, return_inverse=True)[1]
        pick = pairs_of(lists, rows["n"].to_numpy(), rows["blk"].to_numpy(), rows["two"].to_numpy(), lab, _unpack_bitmaps(rows["bits"].to_pylist()))
        token = rows["token"].to_numpy()
        if pick.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(token[pick[0]]), pa.array(nums[pick[0]]), pa.array(nums[pick[1]])], names=["token", "a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 20_000:
                continue
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))  # the last list may go on
            if last:
                yield from work(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _sets(k: int):
    """text -> (digest, set), once per digest of the task."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            for _, _, raw, off in slices(b.column(0)):
                rows = []
                for s in shingle_sets(raw, off, k):
                    if len(s) and (d := digest(s)) not in seen:
                        seen.add(d)
                        rows.append((d, s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["digest", "items"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))  # the sets end here

    return run


def _links(docs: DataFrame, slim: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The candidate pairs (a, b) that link, checked on the full sets of one text per class."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("num")).unionByName(pairs.select(F.col("b").alias("num"))).distinct()
    wanted = reps.select("num", "digest").join(ends, "num", "left_semi")
    one_text = slim.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("tkey").alias("tkey"))
    texts = cut(one_text.join(wanted, "digest").select("tkey"))
    rows = docs.select(text_key().alias("tkey"), "text").join(checked(texts), "tkey", "left_semi")
    sets = rows.select("text").mapInArrow(trimmed(_sets(k)), "digest binary, items binary").join(wanted, "digest")
    sets = cut(sets.groupBy("num").agg(F.first("items").alias("items")))
    both = pairs.join(sets.select(F.col("num").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("num").alias("b"), F.col("items").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(trimmed(_verify(num, den)), "a bigint, b bigint"))


def _roots(links: DataFrame) -> DataFrame:
    return component_roots(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "num")


def jaccard_classes(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, classes, roots, links) of `docs` (doc_id, text, ...).

    documents: doc_id, tkey, n, digest (null: empty set), one row per input row.
    classes: num, digest, n, one row per distinct set.  links: class pairs a, b that were
    verified.  roots: num, root (the class that stands for the component), for every class
    with a link.
    """
    num, den = threshold
    spark = docs.sparkSession
    src = docs.select("doc_id", text_key().alias("tkey"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    first = cut(src.mapInArrow(trimmed(_profile(k)), f"doc_id {id_type}, tkey bigint, n bigint, digest binary, segment int, cells binary"))
    slim = first.filter("n IS NOT NULL").select("doc_id", "tkey", "n", "digest")
    sums = first.filter("segment IS NOT NULL").select("segment", "cells").repartition(SEGMENTS, "segment").mapInArrow(trimmed(_sum_cells), "segment int, cells binary").collect()  # 8 MB at any size
    width = (1 << CELL_BITS) // SEGMENTS
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    for seg, blob in sums:
        levels[seg * width : (seg + 1) * width] = np.frombuffer(zlib.decompress(bytes(blob)), np.uint8)
    sketch = spark.sparkContext.broadcast(levels.tobytes())
    del sums, levels
    give_back()

    found = docs.select("text").mapInArrow(trimmed(_prefixes(k, num, den, sketch)), "digest binary, n bigint, gid binary, prefix binary, bits binary")
    reps = found.groupBy("digest").agg(F.first(F.struct("n", "gid", "prefix", "bits")).alias("r")).select("digest", "r.*")
    reps = cut(reps.withColumn("num", F.monotonically_increasing_id()))  # stored, so a class keeps its number
    sketch.unpersist()
    groups = reps.groupBy("gid").agg(F.min(F.struct("num", "prefix")).alias("r"), F.count(F.lit(1)).alias("size")).select("gid", F.col("r.num").alias("gnum"), F.col("r.prefix").alias("prefix"), "size")
    several = cut(groups.filter("size > 1").select("gid", "gnum", "size"))
    postings = groups.select("gnum", "prefix").mapInArrow(trimmed(_explode_prefix), "token bigint, gnum bigint")
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("token")
    # members of one group meet in a list of their own
    lists = cut(postings.join(shared, "token").unionByName(several.select(F.xxhash64("gid").alias("token"), "gnum")))
    members = reps.select("gid", "num", "n", "bits").join(checked(several.select("gid", "gnum")), "gid", "left").select(F.coalesce("gnum", "num").alias("gnum"), "num", "n", "bits")
    weight = several.select("gnum", "size")
    crowd = lists.join(checked(weight), "gnum", "left").groupBy("token").agg(F.sum(F.coalesce("size", F.lit(1))).alias("members")).filter(F.col("members") > BLOCK)
    crowd = cut(crowd.select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("nb")))

    def pairs(some: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Passing pairs of the lists; with components, only pairs across them."""
        who = members.withColumn("comp", F.col("num")) if comps is None else members.join(comps, "num", "left").withColumn("comp", F.coalesce("root", "num")).drop("root")
        df = some.join(who, "gnum").join(checked(crowd), "token", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        df = df.withColumn("blk", F.pmod(F.xxhash64("num"), "nb").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        # a block meets itself in the list (b, b) only; in (b, c) only pairs across count
        df = df.select(F.xxhash64("token", F.least("blk", "other"), F.greatest("blk", "other")).alias("key"), "token", "num", "n", "bits", "comp", "blk", (F.col("blk") != F.col("other")).alias("two"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(parts, "key").sortWithinPartitions("key", "n").mapInArrow(trimmed(_list_pairs(num, den, comps is None)), "token bigint, a bigint, b bigint")

    pairs1 = cut(pairs(lists, None))
    links1 = _links(docs, slim, reps, pairs1, k, num, den)
    roots = _roots(links1)
    # a list without a passing pair in round one has none in round two
    again = lists.join(checked(pairs1.select("token").distinct()), "token", "left_semi")
    pairs2 = pairs(again, roots).join(pairs1.select("a", "b").distinct(), ["a", "b"], "left_anti")
    links2 = _links(docs, slim, reps, pairs2, k, num, den)
    links = links1.unionByName(links2).distinct()
    return slim, reps.select("num", "digest", "n"), _roots(links) if links2.limit(1).count() else roots, links


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """doc_id, tkey, n_shingles, component_id: the smallest doc_id reachable by links.

    Rows with null or empty text keep their own id.  Null ids are reached by links but never
    name a component unless all its ids are null.  A repeated row is a row of its own.
    """
    slim, classes, roots, _ = jaccard_classes(docs, k, threshold)
    ids = slim.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("low")).join(classes, "digest").join(roots, "num", "left")
    ids = ids.select("digest", "low", F.coalesce("root", "num").alias("top"))
    low = ids.groupBy("top").agg(F.min("low").alias("component_id"))
    named = ids.select("digest", "top").join(low, "top").select("digest", "component_id")
    out = slim.join(named, "digest", "left")
    return out.select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """`docs` with one row of each component kept: the one with the smallest (doc_id, text key); all empty texts stay."""
    comps = cut(jaccard_components(docs, k, threshold))
    best = comps.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")).alias("r"), F.count(F.lit(1)).alias("rows"))
    best = best.select(F.col("r.doc_id").alias("__id"), F.col("r.tkey").alias("__key"))
    keyed = docs.withColumn("__tk", text_key())
    kept = keyed.join(checked(best.unionByName(comps.filter("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key")).distinct())), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tk") == F.col("__key")), "left_semi")
    # rows repeated as a whole are in the same place of the key: keep one of each, unless empty
    again = comps.filter("n_shingles > 0").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key"))
    if not again.limit(1).count():
        return kept.drop("__tk")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tk") == F.col("__key"))
    once = kept.join(checked(again), same, "left_anti")
    return once.unionByName(kept.join(checked(again), same, "left_semi").dropDuplicates(["doc_id", "__tk"])).drop("__tk")
