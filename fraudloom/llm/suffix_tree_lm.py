"""LM scoring with a probabilistic suffix tree over words.

Contexts are word sequences of length 0, 1 or 2.  A next word w is explicit in a context s
if its count c(sw) is at least MIN_COUNT and P(w|s) diverges from P(w|suffix(s)) by more than
the ratio RATIO; then P(w|s) = (c(sw) - DISCOUNT) / c(s) + back(s) P(w|suffix(s)).  Any other
word has back(s) P(w|suffix(s)), where back(s) is the mass that is left, so every
distribution sums to one.  The root is (c(w) + 0.1) / (N + 0.1 (V + 1)).  A context is
retained if the gain in log-likelihood of its own training occurrences over its suffix
exceeds GAIN nats.  A text is scored from the longest retained suffix state at each word.

With this form the log probability of a text is a sum of one stored value per n-gram: what
the gram adds as an entry, plus log back(gram) as a context.  So the model is a table
(gram, value) that grows with the corpus, and scoring is a join:
* grams with at least N / 2^20 occurrences are at most 2^20 per length and travel as a
  broadcast array;
* all other lookups (gram, document, times) are joined with the table by range of the gram,
  packed in blocks; a fixed-size Bloom filter keeps grams that are surely not in the table
  from being sent.

Counts are exact for all training texts.  Occurrences are shuffled as arrays of
48-bit prefixes of gram hashes with a count, 7 bytes each, and counted per bucket; a prefix stands for
its gram (two grams that meet in it share a count; at 10^8 grams that hits about 20).  Grams
of three words are counted only if both their pairs passed the filter of repeated pairs,
which loses none with a count of MIN_COUNT.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, cut
from .tokens import grams, mix, slices, spans, word_hashes

MIN_COUNT, RATIO, DISCOUNT, GAIN = 3, 2.0, 0.75, 6.0
HEAVY_BITS = 20
FILTER_BITS = 26  # 8 MB; a fuller filter only lets more rows through
FILTER_PARTS = 64
MOST_TASKS = 4096  # partitions of a shuffle; beyond it a task takes several buckets, one after the other
BLOCK_TEXTS = 100_000  # texts whose lookups travel together, at most
DROPPED_BITS = 16  # gram hashes are kept to 48 bits
END = mix(np.array([1], np.uint64))[0]
LN10 = float(np.log(10.0))


def _probes(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = g.view(np.uint64)
    return (g >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (mix(g) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def maybe_in(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """bits: packed; False only if surely absent."""
    out = np.ones(len(g), bool)
    for at in _probes(g):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
    return out


def _short(g: np.ndarray) -> np.ndarray:
    return g & ~np.uint64((1 << DROPPED_BITS) - 1)


def _sequences(raw, off):
    """(hashes with an end after each text, text of each token)."""
    starts, ends, first = spans(raw, off)
    h = word_hashes(raw, starts, ends)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    seq = np.insert(h, first[1:], END)
    return seq, np.insert(doc, first[1:], np.arange(n))


def _with_end(batches, limit=1 << 21):
    for b in batches:
        for lo, hi, raw, off in slices(b.column(b.num_columns - 1), limit):
            yield b, lo, hi, *_sequences(raw, off)


def _word_counts(batches):
    """text -> (gram, c): words of the task, merged while few."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["gram", "c"])

    for _, _, _, seq, _ in _with_end(batches):
        k, c = np.unique(seq, return_counts=True)
        keys, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate((counts, c)), minlength=len(keys)).astype(np.int64)
        if len(keys) > 1_000_000:
            yield rows()
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield rows()


def _occurrences(n: int, parts: int, repeated):
    """text -> (bucket, items): records (48-bit prefix, count up to 255) of the n-grams of the task, by range of the hash."""

    def run(batches):
        held, size = [], 0

        def rows():
            g, c = np.unique(np.concatenate(held) >> np.uint64(DROPPED_BITS), return_counts=True)
            many = -(-c // 255)  # a count over 255 takes several records
            g, full = np.repeat(g, many), np.repeat(c, many)
            first = np.concatenate(([0], np.cumsum(many)[:-1]))
            left = full - 255 * (np.arange(len(g)) - np.repeat(first, many))
            raw = np.empty((len(g), 7), np.uint8)
            raw[:, :6] = g.view(np.uint8).reshape(-1, 8)[:, :6]
            raw[:, 6] = np.minimum(left, 255)
            some = list(_by_bucket(g << np.uint64(DROPPED_BITS), parts))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array([raw[a:b].tobytes() for _, a, b in some], pa.binary())], names=["bucket", "items"])

        for _, _, _, seq, doc in _with_end(batches):
            g = grams(seq, n)
            ok = doc[: len(g)] == doc[n - 1 :] if len(g) else np.zeros(0, bool)
            if repeated is not None and len(g):
                part = maybe_in(np.frombuffer(repeated.value, np.uint8), _short(grams(seq, n - 1)))
                ok &= part[:-1] & part[1:]
            held.append(g[ok])
            size += len(held[-1])
            if size > 3_000_000:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def _tally(batches):
    """(bucket, items) sorted by bucket -> (gram, c) with c >= MIN_COUNT. A bucket is a range of hashes, so no gram is in two."""
    held: list[bytes] = []
    now = None

    def rows():
        raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 7)
        g = np.zeros((len(raw), 8), np.uint8)
        g[:, :6] = raw[:, :6]
        g = g.reshape(-1).view(np.uint64)
        order = np.argsort(g, kind="stable")
        g, times = g[order], raw[order, 6].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        c = np.add.reduceat(times, first) if len(g) else times
        keep = c >= MIN_COUNT
        return pa.RecordBatch.from_arrays([pa.array((g[first[keep]] << np.uint64(DROPPED_BITS)).view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["gram", "c"])

    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != now and held:
                yield rows()
                held = []
            now = bucket
            if blob:
                held.append(blob)
    if held:
        yield rows()


def _bit_parts(batches):
    """gram -> (part, bits): the filter of the task, in parts."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    some = False
    for b in batches:
        g = b.column(0).to_numpy()
        some |= len(g) > 0
        for at in _probes(g):
            bits[at] = True
    if some:
        packed = np.packbits(bits, bitorder="little").reshape(FILTER_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(FILTER_PARTS), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["part", "bits"])


def _or_parts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(blob, np.uint8)
            total[part] = total[part] | x if part in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "bits"])


def gram_filter(table: DataFrame):
    """Broadcast Bloom filter of the grams of a table: 8 MB whatever the table."""
    spark = table.sparkSession
    found = table.select("gram").coalesce(8).mapInArrow(_bit_parts, "part int, bits binary").repartition(FILTER_PARTS, "part").mapInArrow(_or_parts, "part int, bits binary").collect()
    out = np.zeros((FILTER_PARTS, (1 << FILTER_BITS) // 8 // FILTER_PARTS), np.uint8)
    for part, bits in found:
        out[part] = np.frombuffer(bytes(bits), np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def _candidates(n: int, filt):
    """text -> distinct repeated n-grams of the task as (gram, ctx, low, mid, word): gram, its first n-1 words, its last n-1,
    the word before the last, the last."""

    def run(batches):
        bits = np.frombuffer(filt.value, np.uint8)
        seen = np.zeros(0, np.uint64)
        for _, _, _, seq, doc in _with_end(batches):
            g = _short(grams(seq, n))
            if not len(g):
                continue
            at = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
            at = at[maybe_in(bits, g[at])]
            u, first = np.unique(g[at], return_index=True)
            at = at[first]
            if len(seen):
                pos = np.minimum(np.searchsorted(seen, u), len(seen) - 1)
                new = seen[pos] != u
                u, at = u[new], at[new]
            if not len(u):
                continue
            seen = np.sort(np.concatenate((seen, u))) if len(seen) < 1_000_000 else u
            part = seq if n == 2 else _short(grams(seq, n - 1))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, part[at], part[at + 1], seq[at + n - 2], seq[at + n - 1])], names=["gram", "ctx", "low", "mid", "word"])

    return run


def _values(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links (gram, c, ctx, c_ctx, p_low) -> (entries (gram, c, p, add), contexts (ctx, back)) of what the tests retain."""
    links = cut(links.filter(F.col("c") > RATIO * F.col("c_ctx") * F.col("p_low")).withColumn("explicit", (F.col("c") - DISCOUNT) / F.col("c_ctx")))
    back = links.groupBy("ctx").agg(F.greatest(F.lit(1e-9), 1 - F.sum("explicit")).alias("back"), F.first("c_ctx").alias("c_ctx"), F.sum("c").alias("c_in"))
    with_p = links.drop("c_ctx").join(back, "ctx").withColumn("p", F.col("explicit") + F.col("back") * F.col("p_low"))
    gain = F.sum(F.col("c") * F.log(F.col("p") / F.col("p_low"))) + F.first((F.col("c_ctx") - F.col("c_in")) * F.log("back"))
    tested = cut(with_p.groupBy("ctx").agg(gain.alias("gain"), F.first("back").alias("back")).filter(F.col("gain") > GAIN).select("ctx", "back"))
    kept = with_p.drop("back").join(tested, "ctx")
    return cut(kept.select("gram", "c", "p", (F.log(F.col("p") / F.col("p_low")) - F.log("back")).alias("add"))), tested


def learn(texts: DataFrame, depth: int = 2) -> dict:
    """The model of `texts` (text): words (gram, c, base, add), grams (gram, c, add), total N, distinct V. Logs are natural."""
    spark = texts.sparkSession
    texts = texts.select("text")
    words = cut(texts.mapInArrow(_word_counts, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c")))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    p_word = words.select("gram", "c", ((F.col("c") + 0.1) / (total + 0.1 * (distinct + 1))).alias("p"))
    root = p_word.select(F.col("gram").alias("word"), F.col("p").alias("p_word"))
    # a bucket holds about a million occurrences, 7 MB at most
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1_000_000 + 1)
    added, contexts, repeated, parents, short, backs = [], [], None, p_word.select("gram", "c"), None, None
    form = "gram bigint, ctx bigint, low bigint, mid bigint, word bigint"
    for n in range(2, depth + 2):
        counted = texts.mapInArrow(_occurrences(n, parts, repeated), "bucket int, items binary")
        counts = cut(counted.repartition(min(parts, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(_tally, "gram bigint, c bigint"))
        repeated = gram_filter(counts)
        links = texts.mapInArrow(_candidates(n, repeated), form).groupBy("gram").agg(*[F.min(x).alias(x) for x in ("ctx", "low", "mid", "word")])
        links = links.join(counts, "gram").join(parents.select(F.col("gram").alias("ctx"), F.col("c").alias("c_ctx")), "ctx").join(root, "word")
        if n == 2:
            links = links.withColumn("p_low", F.col("p_word"))
        else:
            # P(word | suffix): an entry of a retained suffix, else the suffix's back-off times the root
            links = links.join(short.select(F.col("gram").alias("low"), F.col("p").alias("p_own")), "low", "left").join(backs.withColumnRenamed("ctx", "mid"), "mid", "left")
            links = links.withColumn("p_low", F.coalesce("p_own", F.coalesce("back", F.lit(1.0)) * F.col("p_word")))
        entries, tested = _values(links.select("gram", "c", "ctx", "c_ctx", "p_low"))
        added.append(entries.select("gram", "c", "add"))
        contexts.append(tested.join(parents.withColumnRenamed("gram", "ctx"), "ctx").select(F.col("ctx").alias("gram"), "c", F.log("back").alias("add")))
        parents, short, backs = counts, entries, tested
    words = p_word.join(contexts[0].select("gram", F.col("add").alias("back")), "gram", "left").select("gram", "c", F.log("p").alias("base"), (F.log("p") + F.coalesce("back", F.lit(0.0))).alias("add"))
    table = added[0]
    for x in [*added[1:], *contexts[1:]]:
        table = table.unionByName(x)
    table = table.groupBy("gram").agg(F.max("c").alias("c"), F.sum("add").alias("add"))
    return {"words": cut(words), "grams": cut(table), "total": total, "distinct": distinct, "depth": depth}


def _packed(df: DataFrame, least: int, columns: list[str]):
    """Broadcast arrays of the rows with c >= least, sorted by gram: at most N / least rows a gram length."""
    rows = df.filter(F.col("c") >= least).select("gram", *columns).toPandas()
    keys = rows["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return df.sparkSession.sparkContext.broadcast((keys[order], *[rows[c].to_numpy(np.float64)[order] for c in columns]))


def _find(keys: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(g), np.int64), np.zeros(len(g), bool)
    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    return at, keys[at] == g


ROUTED = ["bucket", "kind", "block", "items", "row", "doc_id", "n_tokens", "n_known", "base", "score"]
VALUES, ASKED, TEXT = range(3)  # kinds of routed rows, in the order in which a bucket needs them
SUMS = ("<u4", "<u4", "<f8", "<f8")  # what a bucket answers a block: text, known words, base, score


def _planes(*columns: np.ndarray) -> bytes:
    """Byte planes of columns of equal length: equal bytes come together, so a shuffle compresses them."""
    return np.concatenate([c.view(np.uint8).reshape(len(c), -1) for c in columns], axis=1).T.tobytes()


def _unplaned(blob: bytes, *types) -> list[np.ndarray]:
    ends = np.cumsum([np.dtype(t).itemsize for t in types])
    raw = np.frombuffer(blob, np.uint8).reshape(ends[-1], -1).T
    return [np.ascontiguousarray(raw[:, e - np.dtype(t).itemsize : e]).view(t)[:, 0] for e, t in zip(ends, types)]


def _by_bucket(keys: np.ndarray, buckets: int):
    """Sorted keys -> (bucket, from, to) of the buckets that occur; a bucket is a range of keys."""
    own = (keys >> np.uint64(32)).astype(np.int64) * buckets >> 32
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
    return zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)])


def _routed(doc_type, kind: int, block: int, rows: list[tuple[int, bytes]]):
    """Rows (bucket, items) of a kind; the block is the number of its first text."""
    n = len(rows)
    ints = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([r[1] for r in rows], pa.binary()), ints, pa.nulls(n, doc_type), ints, ints, pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names=ROUTED
    )


def _route_values(buckets: int):
    """(key, base, value, doc_id) -> values by bucket."""

    def run(batches):
        held, size, doc_type = [], 0, None

        def rows():
            key, base, value = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            key, base, value = key[order], base[order], value[order]
            return _routed(doc_type, VALUES, 0, [(k, _planes(key[i:j], base[i:j], value[i:j])) for k, i, j in _by_bucket(key, buckets)])

        for b in batches:
            doc_type = b.column(3).type
            held.append((b.column(0).to_numpy().view(np.uint64), *[b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2)]))
            size += b.num_rows
            if size > 500_000:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def _lookups(depth: int, heavy_words, heavy_grams, filt, buckets: int):
    """(row, doc_id, text) -> one row per text with the sums known here, and by bucket the (gram, text, times) to look up.

    Texts that follow one another are a block, named by its first row; a text is known in it by
    its distance from that row.  A word to look up has an odd gram, other grams are even.
    """

    def run(batches):
        keys, base, add = heavy_words.value
        often, worth = heavy_grams.value
        bits = np.frombuffer(filt.value, np.uint8)
        held, texts, size, doc_type = [], [], 0, None

        def rows():
            block = int(min(t[0].min() for t in texts))
            ids, docs, *sums = (list(x) for x in zip(*texts))
            ids = np.concatenate(ids)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array((ids % buckets).astype(np.int32)), pa.array(np.full(n, TEXT, np.int32)), pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), pa.array(ids), pa.concat_arrays(docs), *[pa.array(np.concatenate(x)) for x in sums]], names=ROUTED
            )
            if size:
                g, row = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(g, kind="stable")
                g, row = g[order], row[order]
                first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (row[1:] != row[:-1]))))
                times = np.diff(np.append(first, len(g))).astype(np.uint32)
                g, row = g[first], (row[first] - block).astype(np.uint32)
                yield _routed(doc_type, ASKED, block, [(k, _planes(g[i:j], row[i:j], times[i:j])) for k, i, j in _by_bucket(g, buckets)])

        for b, lo, hi, seq, doc in _with_end(batches, 1 << 21):
            n = hi - lo
            ids = b.column(0).to_numpy()[lo:hi]
            doc_type = b.column(1).type
            if texts and max(int(ids.max()), int(texts[0][0].max())) - min(int(ids.min()), int(texts[0][0].min())) >= 1 << 31:
                yield from rows()  # a distance has 32 bits
                held, texts, size = [], [], 0
            at, hit = _find(keys, seq)
            sums = [np.bincount(doc[hit], weights=w[at[hit]], minlength=n) for w in (base, add)] if len(keys) else [np.zeros(n), np.zeros(n)]
            asked = [(seq[~hit] | np.uint64(1), doc[~hit])]
            for k in range(2, depth + 2):
                g = _short(grams(seq, k))
                if not len(g):
                    continue
                start = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
                start = start[maybe_in(bits, g[start])]
                where, got = _find(often, g[start])
                if got.any():
                    sums[1] += np.bincount(doc[start[got]], weights=worth[where[got]], minlength=n)
                asked.append((g[start[~got]], doc[start[~got]]))
            texts.append((ids, b.column(1).slice(lo, n), np.bincount(doc, minlength=n), np.bincount(doc[hit], minlength=n), *sums))
            g, d = (np.concatenate(x) for x in zip(*asked))
            if len(g):
                held.append((g, ids[d]))
                size += len(g)
            if size > 2_000_000 or sum(len(t[0]) for t in texts) > BLOCK_TEXTS:
                yield from rows()
                held, texts, size = [], [], 0
        if texts:
            yield from rows()

    return run


def _resolve(miss: float):
    """Rows sorted by (bucket, kind) -> rows by block: a text as it came, or one answer of the bucket for all texts of the block."""

    def table(blobs: list[bytes]):
        key, base, value = (np.concatenate(x) for x in zip(*[_unplaned(x, "<u8", "<f8", "<f8") for x in blobs])) if blobs else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
        order = np.argsort(key)
        return key[order], base[order], value[order]

    def run(batches):
        now, blobs, known = None, [], None
        for b in batches:
            kind = b.column(1).to_numpy()
            text = b.filter(pa.array(kind == TEXT))
            if text.num_rows:
                yield pa.RecordBatch.from_arrays(text.columns[2:], names=ROUTED[2:])
            for i in np.flatnonzero(kind != TEXT).tolist():
                bucket, blob = b.column(0)[i].as_py(), b.column(3)[i].as_py()
                if bucket != now:
                    now, blobs, known = bucket, [], None
                if kind[i] == VALUES:
                    blobs.append(blob)
                    continue
                if known is None:
                    known, blobs = table(blobs), []
                g, row, times = _unplaned(blob, "<u8", "<u4", "<u4")
                at, hit = _find(known[0], g)
                word = (g & np.uint64(1)).astype(bool)
                worth, base = np.where(word, miss, 0.0), np.where(word, miss, 0.0)
                worth[hit] = known[2][at[hit]]
                some = hit & word
                base[some] = known[1][at[some]]
                u, of = np.unique(row, return_inverse=True)
                answer = _planes(u.astype(np.uint32), np.bincount(of, weights=times * some).astype(np.uint32), *[np.bincount(of, weights=times * x) for x in (base, worth)])
                ints, reals = pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(2).slice(i, 1), pa.array([answer], pa.binary()), ints, pa.nulls(1, b.column(5).type), ints, ints, reals, reals], names=ROUTED[2:])

    return run


def _added(batches):
    """Rows sorted by (block, row), answers first -> (row, doc_id, n_tokens, n_known, base, score)."""
    now, known, base, score, held = None, None, None, None, []

    def rows():
        both = pa.Table.from_batches(held).combine_chunks()
        at = both["row"].to_numpy() - now
        sums = [pa.array(own + (more[np.minimum(at, len(more) - 1)] if len(more) else 0) * (at < len(more))) for own, more in zip((both[c].to_numpy() for c in ROUTED[7:]), (known, base, score))]
        return pa.RecordBatch.from_arrays([both["row"].combine_chunks(), both["doc_id"].combine_chunks(), both["n_tokens"].combine_chunks(), *sums], names=["row", "doc_id", "n_tokens", "n_known", "base", "score"])

    for b in batches:
        blocks, text = b.column(0).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False)
        edges = [*(np.flatnonzero((blocks[1:] != blocks[:-1]) | (text[1:] != text[:-1])) + 1).tolist(), b.num_rows]
        at = 0
        for to in edges:
            if to == at:
                continue
            if blocks[at] != now:
                if held:
                    yield rows()
                now, held = int(blocks[at]), []
                known, base, score = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
            if text[at]:
                held.append(b.slice(at, to - at))
            else:
                for blob in b.column(1).slice(at, to - at).to_pylist():
                    row, *parts = _unplaned(blob, *SUMS)
                    most = int(row.max()) + 1
                    if most > len(known):
                        known, base, score = (np.append(x, np.zeros(most - len(x), x.dtype)) for x in (known, base, score))
                    for total, part in zip((known, base, score), parts):
                        total[row] += part.astype(total.dtype)  # a text occurs once in an answer
            at = to
    if held:
        yield rows()


def score(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` (row, doc_id, text) -> row, doc_id, n_tokens, n_known, base, score (log10)."""
    spark, words, table, total = docs.sparkSession, model["words"], model["grams"], model["total"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    miss = float(np.log(0.1 / (total + 0.1 * (model["distinct"] + 1))))
    least = max(2, -(-total // (1 << HEAVY_BITS)))
    filt = gram_filter(table)
    # a bucket holds the values of about four million occurrences
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4_000_000 + 1)
    sums = "row bigint, doc_id {0}, n_tokens bigint, n_known bigint, base double, score double".format(id_type)
    form = "bucket int, kind int, block bigint, items binary, " + sums
    asked = docs.select("row", "doc_id", "text").mapInArrow(_lookups(model["depth"], _packed(words, least, ["base", "add"]), _packed(table, least, ["add"]), filt, buckets), form)
    rare = words.filter(F.col("c") < least).select(F.col("gram").bitwiseOR(1).alias("key"), "base", F.col("add").alias("value"))
    # words that differ in the last bit of their hash alone would share a key: one of them stands for both
    rare = rare.groupBy("key").agg(F.max("base").alias("base"), F.max("value").alias("value"))
    values = rare.unionByName(table.filter(F.col("c") < least).select(F.col("gram").alias("key"), F.lit(None).cast("double").alias("base"), F.col("add").alias("value")))
    values = values.withColumn("doc_id", F.lit(None).cast(id_type)).mapInArrow(_route_values(buckets), form)
    routed = values.unionByName(asked).repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", "kind")
    parts = routed.mapInArrow(_resolve(miss), form.split(", ", 2)[2])
    tasks = min(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = parts.repartition(tasks, "block").sortWithinPartitions("block", "row").mapInArrow(_added, sums)
    return sums.select("row", "doc_id", "n_tokens", "n_known", (F.col("base") / LN10).alias("base"), (F.col("score") / LN10).alias("score"))


def score_documents(docs: DataFrame, folds: int = 10, depth: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Learns from rows whose crc32(doc_id as text) mod `folds` is not 0 (a null id counts as
    the empty text).  A null or empty text is its end alone.
    """
    held = crc_remainder(folds) == 0
    model = learn(docs.filter(~held), depth)
    scores = score(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), model)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["total"]).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")
