"""SimHash near-duplicates: pivot distance tables, maximum coordinate difference, exact check.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's
k-word shingles, repeats included.  Equal fingerprints are one class, so copies never meet.

Pivot tables.  The Hamming distances of a fingerprint to `PIVOTS` reference fingerprints are
its coordinates.  Each distance is also kept by parts, one for each of some blocks of bits.
Two fingerprints within r bits differ by at most r in every coordinate, and their parts are
equal in every block where no bit differs: with B blocks that holds for B - r of them at least.
So one table for every choice of B - r blocks, keyed by the parts there, brings every pair
within r together at least once.  B follows the number of fingerprints (`blocks_for`), which
keeps a key's list short at any size.

Inside a list, rows are ordered by the first coordinate and only rows within r of it are
compared.  A pair goes if its greatest coordinate difference is over r; what is left is checked
on the bits.  A list gives a spanning forest of its links, so a crowd never gives all its
pairs.  Lists of more than `CROWD` rows are cut into blocks and block pairs.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other;
repeated rows and ids are rows of their own; a null id is reached by links but names a
component only if all its ids are null; other columns of the input are not read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import component_roots
from .common import checked, cut, join_counted
from .tokens import IS_SPACE, LOWER, mix, slices, spans

SEED = 42
PIVOTS = 16
REFERENCES = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LIST_ROWS = 512  # rows a list should hold on average at most
CROWD = 4096
HASHED = 1 << 16  # shingles whose bits are counted at a time


def prints(raw: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of every text of a slice."""
    n = len(off) - 1
    starts, ends, first = spans(raw, off)
    if not len(starts):
        return np.zeros(n, np.uint64)
    # the words of a text, lower-cased and joined by single spaces
    inner = np.ones(len(starts), bool)
    inner[first[1:][first[1:] > first[:-1]] - 1] = False  # the last word of a text has no space behind it
    keep = ~IS_SPACE[raw]
    keep[ends[inner]] = True
    text = LOWER[raw]
    text[ends[inner]] = 0x20
    place = np.cumsum(keep)
    buf = text[keep].tobytes()
    at, to = place[starts] - 1, place[ends - 1]
    words = np.diff(first)
    shingles = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(n), shingles)
    lead = np.repeat(first[:-1], shingles) + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = lead + np.minimum(words, k)[doc] - 1
    ones = np.zeros((n, 64), np.int64)
    value = xxhash.xxh64_intdigest
    for a in range(0, len(doc), HASHED):
        b = min(a + HASHED, len(doc))
        h = np.fromiter((value(buf[s:e], SEED) for s, e in zip(at[lead[a:b]].tolist(), to[last[a:b]].tolist())), np.uint64, b - a)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = doc[a:b]
        begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _fingerprints(k: int):
    def run(batches):
        for b in batches:
            for lo, hi, raw, off in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(prints(raw, off, k).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (signed 64 bits): one row per input row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(k), f"doc_id {id_type}, fp bigint")


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks with which a list of `n` even fingerprints holds at most LIST_ROWS rows."""
    b = radius + 1
    while b < 2 * radius + 2 and n / 2 ** (64 * (b - radius) / b) > LIST_ROWS:
        b += 1
    return b


def parts_of(fp: np.ndarray, blocks: int) -> np.ndarray:
    """Distances to the reference fingerprints by blocks of bits: blocks x pivots x fingerprints."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(edge[:-1], edge[1:])]
    return np.stack([[np.bitwise_count((fp ^ p) & m) for p in REFERENCES] for m in masks])


def _tables(blocks: int, radius: int):
    """fp -> (key, fp, coords) for every choice of blocks - radius blocks."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fp = b.column(0).to_numpy().view(np.uint64)
            parts = parts_of(fp, blocks)
            coords = np.ascontiguousarray(parts.sum(axis=0, dtype=np.uint8).T)
            rows = pa.array([c.tobytes() for c in coords], pa.binary())
            # a block's parts as one number
            block = np.zeros((blocks, len(fp)), np.uint64)
            for i in range(blocks):
                for c in parts[i]:
                    block[i] = mix(block[i] * np.uint64(31) + c + np.uint64(1))
            for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
                key = np.full(len(fp), t + 1, np.uint64)
                for i in chosen:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + block[i])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), rows], names=["key", "fp", "coords"])

    return run


def far(x: np.ndarray, y: np.ndarray, coords: np.ndarray, radius: int) -> np.ndarray:
    """Whether the greatest coordinate difference of the rows x and y is over the radius."""
    out = np.zeros(len(x), bool)
    left = np.arange(len(x))
    for some in (slice(1, 4), slice(4, PIVOTS)):  # most pairs go by a few coordinates
        d = np.abs(coords[x[left], some] - coords[y[left], some]).max(axis=1) > radius
        out[left[d]] = True
        left = left[~d]
    return out


def forest(key: np.ndarray, fp: np.ndarray, coords: np.ndarray, blk: np.ndarray, two: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key and first coordinate -> links (x, y), at most one path between two rows of a list."""
    lab = np.arange(len(key))
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            v = p
        return v

    out_x, out_y = [], []
    live, gap = np.arange(len(key)), 1
    c0 = coords[:, 0]
    while True:
        live = live[live + gap < len(key)]
        live = live[(key[live] == key[live + gap]) & (c0[live + gap] - c0[live] <= radius)]
        if not len(live):
            break
        y = live + gap
        some = (lab[live] != lab[y]) & (~two[live] | (blk[live] != blk[y]))
        a, b = live[some], y[some]
        for c in range(0, len(a), 1 << 16):
            i, j = a[c : c + (1 << 16)], b[c : c + (1 << 16)]
            near = ~far(i, j, coords, radius)
            i, j = i[near], j[near]
            linked = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            merged = False
            for u, v in zip(i[linked].tolist(), j[linked].tolist()):
                ru, rv = find(int(lab[u])), find(int(lab[v]))
                if ru != rv:
                    parent[max(ru, rv)] = min(ru, rv)
                    out_x.append(u)
                    out_y.append(v)
                    merged = True
            if merged:
                old = np.array(sorted(parent), np.int64)
                new = np.array([find(v) for v in old.tolist()], np.int64)
                at = np.minimum(np.searchsorted(old, lab), len(old) - 1)
                hit = old[at] == lab
                lab[hit] = new[at[hit]]
                parent.clear()
        gap += 1
    return np.array(out_x, np.int64), np.array(out_y, np.int64)


def _links(radius: int):
    """Rows (key, fp, coords, blk, two), sorted by key and coords -> links (u, v)."""

    def work(rows: pa.Table):
        coords = np.frombuffer(b"".join(rows["coords"].to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int8)
        fp = rows["fp"].to_numpy()
        x, y = forest(rows["key"].to_numpy(), fp.view(np.uint64), coords, rows["blk"].to_numpy(), rows["two"].to_numpy(), radius)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(fp[x]), pa.array(fp[y])], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
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


def similar(prints_: DataFrame, radius: int = 4, blocks: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` within `radius` bits that join the same
    components as all such links; every link was checked on the bits."""
    if blocks is None:
        blocks = blocks_for(prints_.count(), radius)
    rows = prints_.select("fp").mapInArrow(_tables(blocks, radius), "key bigint, fp bigint, coords binary")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowds = cut(shared.filter(F.col("n") > crowd).select("key", F.ceil(F.col("n") / crowd).cast("int").alias("nb")))
    rows = rows.join(checked(crowds), "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("fp"), "nb").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    # a block meets itself in the list (b, b) only; in (b, c) only pairs across count
    one = F.when(F.col("nb") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")))
    rows = rows.select(one.alias("key"), "fp", "coords", "blk", (F.col("blk") != F.col("other")).alias("two"))
    lists = rows.repartition(int(prints_.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "coords")
    return cut(lists.mapInArrow(_links(radius), "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links, its own included."""
    rows = cut(fingerprints(docs, k))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")))
    roots = component_roots(similar(classes, radius)).withColumnRenamed("id", "fp")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = cut(named.join(low, "root").select("fp", "copies", "component_id"))
    out = join_counted(rows, found, "fp", "copies")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
