"""Cosine self-join over face vectors.

Copies of one vector are folded first.  The rest is cut into pivot blocks: a row belongs to its
nearest pivot and, there, to a ring of similar angle.  A block knows the least and the greatest
angle of its rows to every pivot.  Angles obey the triangle inequality, so two blocks whose
intervals lie further apart at some pivot than the threshold allows hold no hit, and their pair
is skipped without loss.  Every other pair of blocks is one matrix product in a task, and only
what was asked for leaves it: the best partners of each row, a spanning forest of the hits, all
hits, or counts of scores.  One pass gives several of these.  Pairs of blocks are dealt as tiles
of neighbouring blocks: a block is sent once per tile, and a task holds one side of a tile while
the other passes.

Approximate mode takes candidates from random hyperplanes.  How many tables that needs for a
stated recall is read off a collision curve sampled on the data; every candidate is checked
with the exact cosine, so links can be missed but not invented.  Tables are compared in rounds
that leave nothing but their pairs; a pair belongs to the first table in which it meets.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import cut, cut_cleaned, fresh_path

BLOCK_ROWS = 8192
SLACK = 1e-4  # float32 candidates this far below the threshold are re-checked in float64
STRIPE, CELL_STRIPE = 256, 64  # rows of a block compared with the other block at a time; what a task holds follows them
RINGS = 128  # rings per radian
EPS = 1e-6  # radians by which an angle may be off
TILE_NUMBERS = 1 << 22  # numbers of the blocks that a task holds while others pass
ROUND_NUMBERS = 1 << 27  # numbers that a round of tables of hyperplanes sends
PAIR = "kind string, a {0}, b {0}, similarity double"


def usable_vectors(emb: DataFrame, dims: int | None = None) -> DataFrame:
    """Non-null, non-empty, non-zero vectors of one dimension; anything else matches nothing."""
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0)
    df = emb.filter(ok)
    return df.filter(F.size("vector") == dims) if dims else df


def fold_copies(emb: DataFrame, id_col: str = "submission_id") -> tuple[DataFrame, DataFrame]:
    """(distinct vectors keyed by their lowest id, id -> rep map with the number of copies)."""
    tagged = emb.select(id_col, "vector", F.sha2(F.to_json(F.struct("vector")), 256).alias("__key"))
    reps = cut(tagged.groupBy("__key").agg(F.min(id_col).alias("rep"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies")))
    members = tagged.select(id_col, "__key").join(reps.select("__key", "rep", "copies"), "__key").drop("__key")
    return reps.drop("__key"), members


# --- blocks and the pairs of them that can hold a hit ------------------------------------
def _unit(column: pa.Array, d: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _by_size(batch: pa.RecordBatch, vector: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dimension, places, rows) of a batch; vectors of different dimensions never meet."""
    sizes = batch.column(vector).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, batch if len(at) == batch.num_rows else batch.take(pa.array(at))


def _place(pivots):
    """(..., vector) -> (..., vector, p, q): nearest pivot and ring."""

    def run(batches):
        known = pivots.value
        for b in batches:
            for d, _, rows in _by_size(b, b.num_columns - 1):
                angle = _angles(_unit(rows.column(rows.num_columns - 1), d), known[d])
                p = angle.argmin(axis=1)
                q = (angle[np.arange(len(p)), p] * RINGS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p.astype(np.int32)), pa.array(q)], names=[*b.schema.names, "p", "q"])

    return run


def _intervals(pivots):
    """(b, vector) -> (b, m, lo, hi): least and greatest angle to pivot m among the rows of a task."""

    def run(batches):
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

        def rows():
            b, lo, hi = [*held], [x[1] for x in held.values()], [x[2] for x in held.values()]
            n = [len(x) for x in lo]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(b, np.int64), n)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in n])), pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))], names=["b", "m", "lo", "hi"]
            )

        for batch in batches:
            for d, _, some in _by_size(batch, 1):
                angle = _angles(_unit(some.column(1), d), pivots.value[d])
                own = some.column(0).to_numpy()
                for b in np.unique(own).tolist():
                    lo, hi = angle[own == b].min(axis=0), angle[own == b].max(axis=0)
                    if b in held:
                        lo, hi = np.minimum(lo, held[b][1]), np.maximum(hi, held[b][2])
                    held[b] = d, lo, hi
            if len(held) > 4096:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return run


def _near_blocks(blocks, limit: float):
    """Place in the list of blocks of a dimension -> (i, j) with their tile, j at or behind i, that can hold an angle of `limit`."""

    def run(batches):
        for batch in batches:
            for d, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, lo, hi, side = blocks.value[d]
                gap = np.maximum(lo[k] - hi[k:], lo[k:] - hi[k]).max(axis=1)
                at = k + np.flatnonzero(gap <= limit + EPS)
                one = lambda v: pa.array(np.full(len(at), v))
                yield pa.RecordBatch.from_arrays([one(ids[k]), pa.array(ids[at]), one(ids[k // side * side]), pa.array(ids[at // side * side])], names=["i", "j", "ti", "tj"])

    return run


def pivot_blocks(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(`rows` with a block number b, pairs of blocks (i, j) that can hold a cosine of `threshold`, with their tile (ti, tj)).

    A dimension with at most `block_rows` rows is one block, numbered minus the dimension.  A tile
    is named by the first blocks of its sides; i is never above j.
    """
    spark = rows.sparkSession
    d = F.size("vector")
    sizes = cut(rows.groupBy(d.alias("d")).agg(F.count(F.lit(1)).alias("n")))
    big = {r.d: r.n for r in sizes.filter(F.col("n") > block_rows).collect()}  # each has over block_rows rows
    small = sizes.filter(F.col("n") <= block_rows).select(*[(-F.col("d")).cast("bigint").alias(c) for c in ("i", "j", "ti", "tj")])
    if not big:
        return rows.withColumn("b", (-d).cast("bigint")), small
    count = {k: -(-n // block_rows) for k, n in big.items()}
    most = {k: max(8, min(256, 2 * c, (1 << 22) // c)) for k, c in count.items()}  # intervals of all blocks stay within 2^22 numbers a side
    large = rows.filter(d.isin(list(big)))
    first = Window.partitionBy(d).orderBy(F.xxhash64("rep", F.lit(seed)))
    drawn = large.select("vector", d.alias("d"), F.row_number().over(first).alias("rn")).filter(F.col("rn") <= max(most.values())).orderBy("d", "rn").collect()
    pivots = {}
    for k, m in most.items():
        x = np.array([r.vector for r in drawn if r.d == k and r.rn <= m], np.float64)
        pivots[k] = x / np.linalg.norm(x, axis=1, keepdims=True)
    known = spark.sparkContext.broadcast(pivots)
    others = [c for c in rows.columns if c != "vector"]
    src = large.select(*others, "vector")
    placed = cut(src.mapInArrow(_place(known), T.StructType([*src.schema.fields, T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType())])))
    # rings become blocks of about block_rows rows; a ring with more rows is split by a hash
    cells = placed.groupBy(d.alias("d"), "p", "q").agg(F.count(F.lit(1)).alias("n"))  # at most pivots x 403 rows a dimension
    before = F.coalesce(F.sum("n").over(Window.partitionBy("d", "p").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cut(cells.select("d", "p", "q", F.floor(before / block_rows).cast("bigint").alias("blk"), F.ceil(F.col("n") / block_rows).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    number = ((F.col("d").cast("bigint") * 4096 + F.col("p")) * (1 << 20) + F.col("blk")) * (1 << 16) + part
    named = placed.withColumn("d", d).join(cells, ["d", "p", "q"]).withColumn("b", number)
    blocked = cut(named.select(*others, "vector", "b"))
    spans = blocked.select("b", "vector").mapInArrow(_intervals(known), "b bigint, m int, lo double, hi double").groupBy("b", "m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    got = spans.orderBy("b", "m").toPandas()  # rows / block_rows blocks, at most 2^22 numbers a side by the choice of `most`
    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in big:
        mine = got[got["b"] // (1 << 48) == k]
        ids = mine["b"].drop_duplicates().to_numpy()
        shape = len(ids), len(pivots[k])
        # as many blocks to a side as a task may hold, but some two tiles for every partition
        side = max(1, min(TILE_NUMBERS // (block_rows * k), int(len(ids) / math.sqrt(4 * parts))))
        table[k] = ids, mine["lo"].to_numpy().reshape(shape), mine["hi"].to_numpy().reshape(shape), side
    sent = spark.sparkContext.broadcast(table)
    heads = spark.createDataFrame([(k, i) for k in big for i in range(len(table[k][0]))], "d int, k int").repartition(parts)
    pairs = heads.mapInArrow(_near_blocks(sent, math.acos(max(-1.0, min(1.0, threshold)))), "i bigint, j bigint, ti bigint, tj bigint")
    rest = rows.filter(~d.isin(list(big))).select(*others, "vector", (-d).cast("bigint").alias("b"))
    return blocked.unionByName(rest), cut(pairs.unionByName(small))


def _scan(rows: DataFrame, threshold: float, block_rows: int, work, schema: str, extra: list[str] = []) -> DataFrame:
    """Runs work(same, left rows, right rows) on every pair of blocks that can hold a hit.

    A tile has its pairs as one row before those of its blocks, which come by number: the blocks of
    its first side are held, every block of the second meets them as it passes.
    """
    blocked, pairs = pivot_blocks(rows.select("rep", *extra, "vector"), threshold, block_rows)
    parts, tile = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["ti", "tj"]
    sides = pairs.select(*tile, F.explode(F.array("i", "j")).alias("b")).distinct()
    met = blocked.join(sides, "b").select(*tile, "b", "rep", *extra, "vector")
    lists = pairs.groupBy(*tile).agg(F.collect_list(F.struct("i", "j")).alias("pairs"))  # at most the square of the blocks of a side
    dealt = met.unionByName(lists, allowMissingColumns=True).repartition(parts, *tile).sortWithinPartitions(*tile, F.asc_nulls_first("b"), "rep")

    def meet(b: int, block: pa.Table, near: dict[int, list[int]], first: set[int], held: dict[int, pa.Table]):
        for i in near.get(b, []):
            yield from work(i == b, block if i == b else held[i], block)
        if b in first:
            held[b] = block

    def run(batches):
        key, near, first, held, block = None, {}, set(), {}, []
        for batch in batches:
            ti, tj = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            head, b = batch.column(2).is_null().to_numpy(zero_copy_only=False), batch.column(2).fill_null(0).to_numpy()
            edges = [*(np.flatnonzero((ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1]) | (b[1:] != b[:-1]) | head[:-1]) + 1).tolist(), batch.num_rows]
            at = 0
            for to in edges:
                if to == at:
                    continue
                now = None if head[at] else (int(ti[at]), int(tj[at]), int(b[at]))
                if block and key != now:
                    yield from meet(key[2], pa.Table.from_batches(block), near, first, held)
                    block = []
                if now is None:
                    near, first, held = {}, set(), {}
                    for p in batch.column(batch.num_columns - 1)[at].as_py():
                        near.setdefault(p["j"], []).append(p["i"])
                        first.add(p["i"])
                else:
                    block.append(batch.slice(at, to - at))
                key, at = now, to
        if block:
            yield from meet(key[2], pa.Table.from_batches(block), near, first, held)

    return dealt.mapInArrow(run, schema)


def _paired(met: DataFrame, work, schema: str, extra: list[str]) -> DataFrame:
    """Rows (i, j, b, rep, extra..., vector): those of one (i, j) are brought together and split by b."""
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select("i", "j", "b", "rep", *extra, "vector").repartition(parts, "i", "j").sortWithinPartitions("i", "j", "b", "rep")

    def pair(rows: pa.Table):
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        b = rows["b"].to_numpy()
        left = rows.filter(pa.array(b == i))
        yield from work(i == j, left, left if i == j else rows.filter(pa.array(b == j)))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [*(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), batch.num_rows]
            for to in edges:
                if to == at:
                    continue
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (int(i[at]), int(j[at])):
                    yield from pair(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield from pair(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def _matrix(side: pa.Table) -> np.ndarray:
    column = side["vector"].combine_chunks()
    return _unit(column, len(column[0])) if len(column) else np.zeros((0, 1))


def _hits(a64: np.ndarray, b64: np.ndarray, threshold: float, same: bool):
    """Stripe by stripe: row and column indexes plus exact similarity of every hit."""
    b32 = b64.astype(np.float32)
    for at in range(0, len(a64), STRIPE):
        part = a64[at : at + STRIPE]
        r, c = np.nonzero(part.astype(np.float32) @ b32.T >= threshold - SLACK)
        if same:
            keep = c > r + at
            r, c = r[keep], c[keep]
        # both sides of 65,536 hits are gathered at a time, whatever the density
        for z in range(0, len(r), 65536):
            x, y = r[z : z + 65536], c[z : z + 65536]
            sim = np.round(np.einsum("ij,ij->i", part[x], b64[y]), 12)  # equal vectors must tie
            keep = sim >= threshold
            yield x[keep] + at, y[keep], sim[keep]


class _Best:
    """The k best partners of each row, ties to the lower order, kept up to date stripe by stripe."""

    def __init__(self, k: int):
        self.k, self.kept, self.size, self.least = k, [], 0, 0

    def add(self, a, b, s, order):
        if len(a):
            self.kept.append((a, b, s, order))
            self.size += len(a)
            if self.size > 2 * self.least + 500_000:
                self.kept = [self.done()]
                self.size = self.least = len(self.kept[0][0])

    def done(self):
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        a, b, s, order = (np.concatenate(x) for x in zip(*self.kept))
        by = np.lexsort((order, -s, a))
        a, b, s, order = a[by], b[by], s[by], order[by]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = rank < self.k
        return a[keep], b[keep], s[keep], order[keep]


class _Forest:
    """A spanning forest of the hits: every round each label takes one hit that leaves it."""

    def __init__(self, n: int):
        self.lab, self.out = np.arange(n), []

    def add(self, a, b, s):
        while True:
            open_ = self.lab[a] != self.lab[b]
            if not open_.any():
                return
            a, b, s = a[open_], b[open_], s[open_]
            _, first = np.unique(self.lab[a], return_index=True)
            parent: dict[int, int] = {}

            def find(v):
                while (p := parent.get(v, v)) != v:
                    v = p
                return v

            for i in first.tolist():
                u, v = find(int(self.lab[a[i]])), find(int(self.lab[b[i]]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    self.out.append((a[i], b[i], s[i]))
            step = np.arange(len(self.lab))
            for v in parent:
                step[v] = find(v)
            self.lab = step[self.lab]


def scan_pairs(reps: DataFrame, threshold: float, top: int | None = None, links: bool = False, every: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One pass over all pairs of distinct vectors (rep, vector): rows (kind, a, b, similarity).

    kind='top': directed, at most the `top` best partners of a row per block pair; the best
    overall are among them, so a dense identity never emits all its pairs.
    kind='link': a < b, a spanning forest of each block pair; the same components as all hits.
    kind='pair': a < b, every hit.
    """
    kinds = [("top", top), ("link", links), ("pair", every)]

    def work(same: bool, left: pa.Table, right: pa.Table):
        a, b = _matrix(left), _matrix(right)
        if not len(a) or not len(b):
            return
        ids = left["rep"] if same else pa.chunked_array([*left["rep"].chunks, *right["rep"].chunks])
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        _, order = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)  # ids as numbers in their order
        shift = 0 if same else len(a)

        def rows(kind: str, x, y, s):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(x), pa.string()), ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(s)], names=["kind", "a", "b", "similarity"])

        best, forest = _Best(top) if top else None, _Forest(len(ids)) if links else None
        for r, c, s in _hits(a, b, threshold, same):
            c = c + shift
            if best:
                best.add(np.concatenate([r, c]), np.concatenate([c, r]), np.concatenate([s, s]), np.concatenate([order[c], order[r]]))
            if forest:
                forest.add(r, c, s)
            if every and len(r):
                low = order[r] < order[c]
                yield rows("pair", np.where(low, r, c), np.where(low, c, r), s)
        if best:
            yield rows("top", *best.done()[:3])
        if forest and forest.out:
            x, y, s = (np.array(z) for z in zip(*forest.out))
            low = order[x] < order[y]
            yield rows("link", np.where(low, x, y), np.where(low, y, x), s)

    assert any(on for _, on in kinds)
    return _scan(reps, threshold, block_rows, work, PAIR.format(reps.schema["rep"].dataType.simpleString()))


def similar_pairs(reps: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Unordered pairs (a < b by id) of distinct vectors with cosine at or above the threshold."""
    return scan_pairs(reps, threshold, every=True, block_rows=block_rows).drop("kind")


def similar_top(reps: DataFrame, threshold: float, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Directed pairs, at most the k best partners of each row per block pair."""
    return scan_pairs(reps, threshold, top=k, block_rows=block_rows).drop("kind")


def similar_forest(reps: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A spanning forest of the hits of each block pair: the components of the full pair list."""
    return scan_pairs(reps, threshold, links=True, block_rows=block_rows).drop("kind")


def similar_prior(rows: DataFrame, threshold: float, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Directed pairs whose partner is strictly older, the k best per row per block pair.

    `rows` has rep (the row id), vector and at (microseconds).  Ties go to the oldest.
    """
    idt = rows.schema["rep"].dataType.simpleString()

    def work(same: bool, left: pa.Table, right: pa.Table):
        a, b = _matrix(left), _matrix(right)
        if not len(a) or not len(b):
            return
        both = left if same else pa.concat_tables([left, right])
        ids, at = both["rep"].combine_chunks(), both["at"].to_numpy()
        by = np.lexsort((np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1], at))
        age = np.empty(len(by), np.int64)
        age[by] = np.arange(len(by))  # oldest first, then by id
        shift, best = 0 if same else len(a), _Best(k)
        for r, c, s in _hits(a, b, threshold, same):
            c = c + shift
            x, y, v = np.concatenate([r, c]), np.concatenate([c, r]), np.concatenate([s, s])
            older = at[y] < at[x]
            best.add(x[older], y[older], v[older], age[y[older]])
        x, y, s, _ = best.done()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(s), pa.array(at[y])], names=["a", "b", "similarity", "b_at"])

    return _scan(rows, threshold, block_rows, work, f"a {idt}, b {idt}, similarity double, b_at bigint", ["at"])


# --- all scores as counts -------------------------------------------------------------------
UNIT = 10**12  # scores are whole trillionths
CELLS = (10**8, 10**4, 1)  # width of a cell on each level: 1e-4, 1e-8, exact


def score_cells(reps: DataFrame, level: int = 0, within: list[int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """cell, n, total: all pairs of distinct rows counted by score, as whole trillionths cut into cells.

    Level 0 has at most 20,001 cells, whatever the number of pairs.  A deeper level counts only
    the pairs inside the cells `within` of the level above, at most 10,000 cells for each.
    """
    width, wanted = CELLS[level], None if within is None else np.array(sorted(within), np.int64)
    least = -1.0 if wanted is None else float(wanted[0]) * CELLS[level - 1] / UNIT

    def work(same: bool, left: pa.Table, right: pa.Table):
        a, b = _matrix(left), _matrix(right)
        cells, counts, sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(a), CELL_STRIPE):
            s = a[at : at + CELL_STRIPE] @ b.T
            if same:
                s = s[np.triu(np.ones(s.shape, dtype=bool), at + 1)]
            g = np.rint(s.ravel() * UNIT).astype(np.int64)
            if wanted is not None:
                up = g // CELLS[level - 1]
                g = g[wanted[np.minimum(np.searchsorted(wanted, up), len(wanted) - 1)] == up]
            if not len(g):
                continue
            if level == 0:  # few cells: one counting pass instead of a sort
                own = g // width + UNIT // width
                n = np.bincount(own, minlength=2 * UNIT // width + 2)
                t = np.bincount(own, weights=g / UNIT, minlength=len(n))
                used = np.flatnonzero(n)
                u, n, t = used - UNIT // width, n[used], t[used]
            else:
                u, of = np.unique(g // width, return_inverse=True)
                n, t = np.bincount(of), np.bincount(of, weights=g / UNIT)
            cells, of = np.unique(np.concatenate([cells, u]), return_inverse=True)
            counts = np.bincount(of, weights=np.concatenate([counts, n]), minlength=len(cells)).astype(np.int64)
            sums = np.bincount(of, weights=np.concatenate([sums, t]), minlength=len(cells))
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts), pa.array(sums)], names=["cell", "n", "total"])

    found = _scan(reps, least, block_rows, work, "cell bigint, n bigint, total double")
    return found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class ScoreCounts:
    """The scores of all pairs of `reps` (rep, vector) as mergeable counts, and exact order statistics of them."""

    def __init__(self, reps: DataFrame, block_rows: int = BLOCK_ROWS):
        self.reps, self.block_rows = reps, block_rows
        rows = sorted(tuple(r) for r in score_cells(reps, block_rows=block_rows).collect())  # at most 20,001
        self.cells, self.counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.pairs = int(self.counts.sum())
        self.mean = sum(r[2] for r in rows) / self.pairs if self.pairs else None

    def at_least(self, threshold: float) -> int:
        """Pairs with a score at or above a threshold of at most four places."""
        return int(self.counts[self.cells >= round(threshold * 10_000)].sum())

    def ranked(self, ranks: list[int]) -> dict[int, float]:
        """Exact scores by rank, 0 the lowest: two refining passes over the cells that hold the ranks."""
        want = {r: r for r in ranks}  # rank -> rank inside its cell
        cells, counts, cell_of = self.cells, self.counts, {}
        before = np.cumsum(counts) - counts
        for r in ranks:
            i = int(np.searchsorted(before, r, "right")) - 1
            cell_of[r], want[r] = int(cells[i]), r - int(before[i])
        for level in (1, 2):
            found = sorted((x.cell, x.n) for x in score_cells(self.reps, level, sorted(set(cell_of.values())), self.block_rows).collect())  # at most 10,000 a rank
            cells, counts = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
            up = cells // (CELLS[level - 1] // CELLS[level])
            for r in ranks:
                mine = np.flatnonzero(up == cell_of[r])
                upto = np.cumsum(counts[mine])
                i = int(np.searchsorted(upto, want[r], "right"))
                want[r] -= int(upto[i] - counts[mine[i]])
                cell_of[r] = int(cells[mine[i]])
        return {r: cell_of[r] / UNIT for r in ranks}

    def percentiles(self, shares: list[float]) -> dict[float, float]:
        """Linear interpolation between the two neighbouring scores."""
        if not self.pairs:
            return {p: None for p in shares}
        place = {p: p * (self.pairs - 1) for p in shares}
        got = self.ranked(sorted({f(x) for x in place.values() for f in (math.floor, math.ceil)}))
        return {p: got[math.floor(x)] + (got[math.ceil(x)] - got[math.floor(x)]) * (x - math.floor(x)) for p, x in place.items()}


# --- random hyperplanes -----------------------------------------------------------------------
def _planes(d: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).normal(size=(tables * bits, d))


def collision_curve(sample: dict[int, np.ndarray], threshold: float, bits: int, seed: int, trials: int = 64) -> float:
    """Share of tables of `bits` hyperplanes in which a vector and a partner at exactly the threshold
    collide, measured over the sampled vectors; closer partners collide more often."""
    rng, hit, total = np.random.default_rng(seed), 0, 0
    for d, x in sample.items():
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        h = rng.normal(size=(trials * bits, d))
        same = ((x @ h.T >= 0) == (y @ h.T >= 0)).reshape(len(x), trials, bits).all(axis=2)
        hit, total = hit + int(same.sum()), total + same.size
    return hit / total if total else 1.0


def _codes(unit: np.ndarray, bits: int, tables: range, of: int, seed: int) -> np.ndarray:
    """The bucket of every row in each of `tables`, out of `of`.

    Products of whole numbers below 2^53 have no rounding: a row has the same buckets in every batch.
    """
    whole = lambda m: np.rint(m * (1 << 22))
    planes = whole(_planes(unit.shape[1], bits, of, seed)[tables.start * bits : tables.stop * bits])
    out = np.empty((len(unit), len(tables)), np.min_scalar_type((1 << bits) - 1))
    weights, rows = 1 << np.arange(bits, dtype=np.int64), whole(unit)
    for z in range(0, len(tables), 64):  # the signs of 64 tables at a time
        some = planes[z * bits : (z + 64) * bits]
        out[:, z : z + 64] = (rows @ some.T >= 0).reshape(len(unit), -1, bits) @ weights
    return out


def _hashed(bits: int, tables: range, of: int, seed: int, whole: bool = True):
    """(rep, vector) -> (t, h, d, rep, vector), once per table; only (t, h, d) if not `whole`."""

    def run(batches):
        for b in batches:
            for d, _, rows in _by_size(b, 1):
                h = _codes(_unit(rows.column(1), d), bits, tables, of, seed).astype(np.int64)
                for k, t in enumerate(tables):
                    n = rows.num_rows
                    columns = [pa.array(np.full(n, t, np.int32)), pa.array(h[:, k]), pa.array(np.full(n, d, np.int32)), *(rows.columns if whole else [])]
                    yield pa.RecordBatch.from_arrays(columns, names=["t", "h", "d", "rep", "vector"][: len(columns)])

    return run


def approx_pairs(reps: DataFrame, threshold: float, recall: float = 0.95, bits: int | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS, scores: bool = True) -> DataFrame:
    """Pairs (a < b, similarity) that share a bucket of random hyperplanes and reach the threshold, as a written table.

    Without `scores` the table is (a, b), half as large.

    With `tables` tables a pair at the threshold is found with probability 1 - (1 - p)^tables,
    p from the collision curve; tables are as many as `recall` asks for.  Bits follow the number
    of rows, so that a bucket holds some 4,000 of evenly spread ones: fewer would ask for many
    more tables, and every table sends all vectors once.  A crowded bucket is cut into blocks
    and block pairs.  Vectors of ROUND_NUMBERS numbers are on their way at a time, those of one
    table at least; a pair is kept by the first table in which it meets.
    """
    n, numbers = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    bits = bits or max(2, min(24, round(math.log2(max(4, n / 4096)))))
    sample: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("rep", F.lit(seed))).select("vector").limit(512).collect():
        sample.setdefault(len(r.vector), []).append(r.vector)
    p = collision_curve({d: np.array(x, np.float64) for d, x in sample.items()}, threshold, bits, seed)
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - p)))) if p < 1 else 1
    idt, vec = (reps.schema[c].dataType.simpleString() for c in ("rep", "vector"))
    src, bucket = reps.select("rep", "vector"), ["t", "h", "d"]
    keys = src.mapInArrow(_hashed(bits, range(tables), tables, seed, False), "t int, h bigint, d int")
    crowded = cut(keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block_rows).select(*bucket, F.ceil(F.col("m") / block_rows).cast("int").alias("nb")))
    key = lambda c: F.xxhash64(*bucket, c)
    lo, hi = F.least("blk", "o"), F.greatest("blk", "o")

    def work(same: bool, left: pa.Table, right: pa.Table):
        a, b = _matrix(left), _matrix(right)
        if len(a) and len(b):
            x, y = left["rep"].combine_chunks(), right["rep"].combine_chunks()
            met = range(left["t"][0].as_py())
            ca = _codes(a, bits, met, tables, seed)
            cb = ca if same else _codes(b, bits, met, tables, seed)
            for r, c, s in _hits(a, b, threshold, same):
                new = np.arange(len(r))
                for z in range(0, len(met), 16):
                    new = new[(ca[r[new], z : z + 16] != cb[c[new], z : z + 16]).all(axis=1)]
                yield pa.RecordBatch.from_arrays([x.take(pa.array(r[new])), y.take(pa.array(c[new])), pa.array(s[new])], names=["a", "b", "similarity"])

    path, step = fresh_path(reps.sparkSession), max(1, ROUND_NUMBERS // max(1, numbers))
    for at in range(0, tables, step):
        hashed = src.mapInArrow(_hashed(bits, range(at, min(tables, at + step)), tables, seed), f"t int, h bigint, d int, rep {idt}, vector {vec}").join(crowded, bucket, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        met = hashed.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
        met = met.select(key(lo).alias("i"), key(hi).alias("j"), key(F.col("blk")).alias("b"), "rep", "t", "vector")
        found = _paired(met, work, f"a {idt}, b {idt}, similarity double", ["t"])
        out = cut_cleaned(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *["similarity"][: int(scores)]), path)
    return out
