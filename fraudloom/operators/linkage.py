"""Cross-submission links: faces, exact files, near-identical images."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions.scalars import hash64_bits, is_hash64, name_norm
from ..functions.scoring import linkage_reasons, linkage_score
from .durable import cut
from .similarity import approx_pairs, fold_copies, scan_pairs, similar_prior, similar_top, usable_vectors

L = F.lit


def first_ids(members: DataFrame, key: list[str], id_col: str, k: int) -> DataFrame:
    """The k lowest ids per key.  row_number() <= k prunes map-side, so a hot key stays small."""
    w = Window.partitionBy(*key).orderBy(id_col)
    return members.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


# --- faces -------------------------------------------------------------------
class FaceScan:
    """The hits of one pass over all face vectors, for links and for the graph.

    rows: usable vectors.  reps: one row per distinct vector.  members: submission_id, rep.
    found: what `scan_pairs` gave, stored.  need: partners kept per distinct vector.
    """

    def __init__(self, emb: DataFrame, threshold: float, top_k: int | None = K.FACE_LINK_LIMIT, links: bool = True, block_rows: int = 8192):
        self.rows = usable_vectors(emb)
        self.reps, self.members = fold_copies(self.rows)
        self.need = None if top_k is None else partners_needed(self.members, top_k)
        self.found = cut(scan_pairs(self.reps, threshold, self.need, links, block_rows=block_rows))

    def kind(self, kind: str) -> DataFrame:
        return self.found.filter(F.col("kind") == kind).drop("kind")


def partners_needed(members: DataFrame, top_k: int) -> int:
    """Vectors stored for one submission take places of their own in a list; one of the others may be the row itself."""
    stored = members.groupBy("submission_id").agg(F.count(L(1)).alias("n")).agg(F.coalesce(F.max("n"), L(1))).first()[0]
    return (top_k + 1) * stored


def face_links(emb: DataFrame, threshold: float = K.SAME_PERSON, top_k: int = K.FACE_LINK_LIMIT, mode: str = "all_others", method: str = "exact", block_rows: int = 8192, scan: FaceScan | None = None, recall: float = 0.95) -> DataFrame:
    """The top_k most similar other selfies of every submission.

    `emb`: submission_id, vector, claimed_name, merchant_id, created_at (selfies only).
    `all_others` searches every other row; `prior` only rows created earlier.
    Ties in similarity go to the lowest id, in `prior` mode to the oldest row.
    `scan`: a pass made before with the same vectors, threshold and top_k.
    method='approx' finds each pair at the threshold with probability `recall`.
    """
    rows = scan.rows if scan else usable_vectors(emb)
    reps, members = (scan.reps, scan.members) if scan else fold_copies(rows)
    if mode == "prior":
        return _prior_links(rows, members, threshold, top_k, block_rows)
    need = scan.need if scan else partners_needed(members, top_k)
    if scan:
        near = scan.kind("top")
    elif method == "approx":
        p = approx_pairs(reps, threshold, recall)
        near = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    else:
        near = similar_top(reps, threshold, need, block_rows)
    near = near.unionByName(reps.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), L(1.0).cast("double").alias("similarity")))
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), F.asc("b"))
    near = near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= need).drop("rn")
    # a partner vector contributes at most `need` members to anyone's list
    partner = first_ids(members.select("submission_id", "rep"), ["rep"], "submission_id", need)
    flat = near.join(partner.select(F.col("rep").alias("b"), F.col("submission_id").alias("other_id")), "b")
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), F.asc("other_id"))
    short = flat.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= need).groupBy("a").agg(
        F.array_sort(F.collect_list(F.struct("rn", "other_id", "similarity"))).alias("list")  # at most need entries
    )
    own = members.select("submission_id", F.col("rep").alias("a")).join(short, "a")
    other = F.filter("list", lambda e: e["other_id"] != F.col("submission_id"))
    links = own.select("submission_id", F.explode(other).alias("e")).groupBy("submission_id", "e.other_id").agg(F.max("e.similarity").alias("similarity"))
    ranked = Window.partitionBy("submission_id").orderBy(F.desc("similarity"), F.asc("other_id"))  # at most need rows per stored vector
    links = links.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_k).select("submission_id", "rank", "other_id", "similarity")
    return _with_names(links, rows)


def _with_names(links: DataFrame, rows: DataFrame) -> DataFrame:
    # one row per submission, however often it is stored
    info = rows.groupBy("submission_id").agg(F.min(F.struct("claimed_name", "merchant_id")).alias("r")).select("submission_id", "r.*")
    mine = info.select("submission_id", F.col("claimed_name").alias("__mine"))
    theirs = info.select(F.col("submission_id").alias("other_id"), F.col("claimed_name").alias("other_name"), F.col("merchant_id").alias("other_merchant"))
    joined = links.join(mine, "submission_id").join(theirs, "other_id")
    comparable = (F.coalesce("__mine", L("")) != "") & (F.coalesce("other_name", L("")) != "")
    differs = comparable & (name_norm(F.col("__mine")) != name_norm(F.col("other_name")))
    return joined.select("submission_id", "rank", "other_id", "similarity", "other_name", "other_merchant", comparable.alias("name_comparable"), differs.alias("name_differs"))


def _prior_links(rows, members, threshold, top_k, block_rows) -> DataFrame:
    """Point-in-time form: only partners created before the submission.

    Of the copies of one vector only the top_k + 1 oldest go through the similarity join.
    Every younger copy already has top_k older copies of itself, which nothing can beat.
    """
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    timed = members.join(rows.select("submission_id", "vector", micros.alias("at")), "submission_id")
    age = Window.partitionBy("rep").orderBy("at", "submission_id")
    oldest = cut(timed.withColumn("__rn", F.row_number().over(age)).filter(F.col("__rn") <= top_k + 1))
    searched = oldest.select(F.col("submission_id").alias("rep"), "vector", "at")
    near = similar_prior(searched, threshold, top_k, block_rows).select(F.col("a").alias("submission_id"), F.col("b").alias("other_id"), "similarity", "b_at")
    first = oldest.filter(F.col("__rn") <= top_k).groupBy("rep").agg(F.collect_list(F.struct("submission_id", "at")).alias("own"))  # at most top_k
    young = timed.select("submission_id", "rep").join(oldest.select("submission_id"), "submission_id", "left_anti").join(first, "rep")
    copies = young.select("submission_id", F.explode("own").alias("o")).select("submission_id", F.col("o.submission_id").alias("other_id"), L(1.0).alias("similarity"), F.col("o.at").alias("b_at"))
    w = Window.partitionBy("submission_id").orderBy(F.desc("similarity"), F.asc("b_at"), F.asc("other_id"))
    links = near.unionByName(copies).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return _with_names(links.select("submission_id", "rank", "other_id", "similarity"), rows)


# --- files -------------------------------------------------------------------
def asset_links_exact(hashes: DataFrame, k: int = K.ASSET_LINK_LIMIT) -> DataFrame:
    """Per file: how many other submissions hold the same bytes, and the k lowest ids among them.

    A common file is not expanded into all its pairs: each member joins the k+1 lowest ids
    of its group, and the group size gives the full count.
    """
    valid = hashes.filter(F.coalesce("content_hash", L("")) != "").select("submission_id", "kind", "content_hash").distinct()
    sizes = valid.groupBy("kind", "content_hash").agg(F.count(L(1)).alias("copies")).filter("copies > 1")
    low = first_ids(valid, ["kind", "content_hash"], "submission_id", k + 1)
    low = low.groupBy("kind", "content_hash").agg(F.array_sort(F.collect_list("submission_id")).alias("low"))  # at most k + 1
    groups = sizes.join(low, ["kind", "content_hash"])
    others = F.slice(F.filter("low", lambda x: x != F.col("submission_id")), 1, k)
    return valid.join(groups, ["kind", "content_hash"]).select(
        "submission_id", "kind", (F.col("copies") - 1).alias("n_others"), F.explode(others).alias("other_id")
    ).select("submission_id", "other_id", "kind", "n_others", L("exact").alias("match"), L(0).alias("hamming"))


def _ball(radius: int) -> list[int]:
    """Every 16-bit mask with at most `radius` bits set."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | (1 << i) for m in masks for i in range(16)} | set(masks))
    return masks


def _radii(bits: int, bands: int) -> list[int]:
    """Radii whose sum plus the number of bands is bits + 1: two hashes within `bits` are within its radius in some band."""
    each, more = divmod(bits + 1 - bands, bands)
    return [each + (i < more) for i in range(bands)]


MANY_PROBES, PAIRS_A_PROBE = 1000, 1000  # a shuffled probe costs as much as some 1,000 compared pairs


def all_hash_pairs(distinct: DataFrame, bits: int, n: int) -> DataFrame:
    """`near_hash_pairs` by comparing every pair: blocks of hashes of one kind, a task takes pairs of blocks."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = min(65536, max(1024, math.ceil(n / math.sqrt(2 * parts))))
    sizes = distinct.groupBy("kind").agg(F.ceil(F.count(L(1)) / rows).cast("int").alias("nb"))
    dealt = distinct.withColumn("__k", F.coalesce("kind", L(""))).join(sizes.select(F.coalesce("kind", L("")).alias("__k"), "nb"), "__k")
    blocks = dealt.groupBy("kind", "nb", F.pmod(F.xxhash64("h"), F.col("nb")).cast("int").alias("b")).agg(F.collect_list("h").alias("hs"))  # about `rows` hashes
    met = blocks.select("kind", "b", "hs", F.explode(F.sequence(L(0), F.col("nb") - 1)).alias("o"))
    met = met.groupBy("kind", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).agg(F.min_by("hs", "b").alias("x"), F.max_by("hs", "b").alias("y"), F.countDistinct("b").alias("sides"))
    met = met.filter((F.col("i") == F.col("j")) | (F.col("sides") == 2)).select("kind", (F.col("i") == F.col("j")).alias("same"), "x", "y")  # a block can be empty

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                kind, same = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                x, y = (batch.column(c)[at].values.to_numpy().view(np.uint64) for c in (2, 3))
                step = max(1, (1 << 20) // len(y))
                for lo in range(0, len(x), step):
                    near = np.bitwise_count(x[lo : lo + step, None] ^ y[None, :])
                    r, c = np.nonzero(near <= bits)
                    if same:
                        r, c = r[c > r + lo], c[c > r + lo]
                    u, v = x[lo + r].view(np.int64), y[c].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(r), pa.string()), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(near[r, c].astype(np.int32))], names=["kind", "a", "b", "hamming"])

    return met.mapInArrow(run, "kind string, a bigint, b bigint, hamming int")


def near_hash_pairs(distinct: DataFrame, bits: int = K.SAME_IMAGE_BITS, hot: int = 4096) -> DataFrame:
    """Unordered pairs of distinct 64-bit hashes of one kind within `bits`, exact.

    Multi-index hashing over four 16-bit bands with unequal radii (2, 1, 1, 1 for 8 bits): by
    the general pigeonhole rule probing those balls misses nothing.  A band value shared by
    more than `hot` hashes (a document template) is refined by a second band among the other
    three, and a crowded pair of values by a third, with the radii of the bands that are left.
    A pair is reported by the first band that finds it, on every level, so no distinct is needed.
    `distinct` has kind and h (signed 64-bit).  A wide bound has thousands of probes a hash (4,608
    for 16 bits); up to millions of hashes comparing all pairs in blocks is then far less work.
    """
    probes = sum(len(_ball(r)) for r in _radii(bits, 4))
    if probes > MANY_PROBES:
        distinct = cut(distinct)
        n = distinct.count()
        if n <= 2 * PAIRS_A_PROBE * probes:
            return all_hash_pairs(distinct, bits, n)
    owned = distinct.select("kind", "h", F.array().cast("array<int>").alias("path"), F.xxhash64("kind").alias("key"))
    probed, done = owned, []
    for level in range(3):
        step = lambda df, probe: df.select("kind", "h", "path", "key", F.explode(_values(level, bits, probe)).alias("e")).select(
            "kind", "h", F.concat("path", F.array("e.i")).alias("path"), F.xxhash64("key", "e.i", "e.v").alias("key")
        )
        owned, probed = step(owned, False), step(probed, True)
        crowded = cut(owned.groupBy("key").agg(F.count(L(1)).alias("n")).filter(F.col("n") > hot).select("key")) if level < 2 else None
        if crowded is None or not crowded.limit(1).count():
            done.append(_meet(owned, probed, level, bits))
            break
        done.append(_meet(owned.join(crowded, "key", "left_anti"), probed.join(crowded, "key", "left_anti"), level, bits))
        owned, probed = owned.join(crowded, "key", "left_semi"), probed.join(crowded, "key", "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _band(c: Column, m: int) -> Column:
    return F.shiftrightunsigned(c, 16 * m).bitwiseAND(L(0xFFFF)).cast("int")


def _rest(path: Column, m: int, bits: int, level: int) -> tuple[Column, Column]:
    """(whether band m is still free after the bands of `path`, its radius among the free ones)."""
    radii = _radii(bits, 4 - level)
    place = L(m) - F.size(F.filter(path, lambda x: x < m))
    return ~F.array_contains(path, m), F.when(place < radii.count(radii[0]), radii[0]).otherwise(radii[-1])


def _values(level: int, bits: int, probe: bool) -> Column:
    """(band, value) of every free band; to probe, every value inside the band's ball."""
    masks = {r: F.array(*[L(x) for x in _ball(r)]) for r in set(_radii(bits, 4 - level))} if probe else {}
    out = []
    for m in range(4):
        free, radius = _rest(F.col("path"), m, bits, level)
        v = _band(F.col("h"), m)
        balls = F.coalesce(*[F.when(radius == r, x) for r, x in masks.items()]) if probe else F.array(L(0))
        out.append(F.when(free, _moved(balls, v, m)).otherwise(F.array().cast("array<struct<i:int,v:int>>")))
    return F.flatten(F.array(*out))


def _moved(masks: Column, v: Column, m: int) -> Column:
    return F.transform(masks, lambda x: F.struct(L(m).alias("i"), v.bitwiseXOR(x).alias("v")))


def _meet(owned: DataFrame, probed: DataFrame, level: int, bits: int) -> DataFrame:
    pairs = probed.select("key", F.col("h").alias("a")).join(owned.select("key", "kind", "path", F.col("h").alias("b")), "key")
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(x) <= bits))
    earlier = L(False)
    for at in range(level + 1):
        before = F.slice("path", 1, at)
        for m in range(3):
            free, radius = _rest(before, m, bits, at)
            earlier = earlier | ((L(m) < F.get("path", L(at))) & free & (F.bit_count(_band(x, m)) <= radius))
    return near.filter(~earlier).select("kind", "a", "b", F.bit_count(x).cast("int").alias("hamming"))


def asset_links_near(hashes: DataFrame, bits: int = K.SAME_IMAGE_BITS, k: int = K.ASSET_LINK_LIMIT, hot: int = 4096) -> DataFrame:
    """Per file: the k closest other submissions of the same kind within `bits`.

    Equal bytes imply an equal image hash, so byte-identical partners (which are exact links,
    not near ones) only occur inside one hash value.  Distinct hashes are paired first, each
    keeps the k + 1 closest hashes, and a hash lends at most 2(k + 1) members: after
    capping every content at k + 1 that many always hold k rows of any other content.
    """
    valid = hashes.filter(is_hash64(F.col("phash"))).select("submission_id", "kind", hash64_bits(F.col("phash")).alias("h"), F.coalesce("content_hash", L("")).alias("content_hash"))
    distinct = cut(valid.groupBy("kind", "h").agg(F.count(L(1)).alias("n"), F.min("submission_id").alias("low_id")))
    pairs = near_hash_pairs(distinct.select("kind", "h"), bits, hot)
    turn = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = pairs.select("kind", "hamming", turn.alias("e")).select("kind", "e.a", "e.b", "hamming")
    both = both.join(distinct.select("kind", F.col("h").alias("b"), "low_id"), ["kind", "b"])
    closest = Window.partitionBy("kind", "a").orderBy("hamming", "low_id")
    both = both.withColumn("rn", F.row_number().over(closest)).filter(F.col("rn") <= k + 1).select("kind", "a", "b", "hamming")
    both = both.unionByName(distinct.filter("n > 1").select("kind", F.col("h").alias("a"), F.col("h").alias("b"), L(0).alias("hamming")))
    lent = first_ids(first_ids(valid, ["kind", "h", "content_hash"], "submission_id", k + 1), ["kind", "h"], "submission_id", 2 * (k + 1))
    partner = lent.select("kind", F.col("h").alias("b"), F.col("submission_id").alias("other_id"), F.col("content_hash").alias("other_hash"))
    short = both.join(partner, ["kind", "b"]).groupBy("kind", "a").agg(
        F.array_sort(F.collect_list(F.struct("hamming", "other_id", "other_hash"))).alias("list")  # at most (k + 2) * 2(k + 1)
    )
    mine = valid.select("kind", F.col("h").alias("a"), "submission_id", "content_hash").join(short, ["kind", "a"])
    same_file = lambda e: (F.col("content_hash") != "") & (F.col("content_hash") == e["other_hash"])
    other = F.slice(F.filter("list", lambda e: (e["other_id"] != F.col("submission_id")) & ~same_file(e)), 1, k)
    return mine.select("submission_id", "kind", F.explode(other).alias("e")).select(
        "submission_id", "e.other_id", "kind", L("near").alias("match"), "e.hamming"
    )


def best_asset_links(links: DataFrame, k: int = K.ASSET_LINK_LIMIT) -> DataFrame:
    """One link per other submission (exact beats near, then the closest), then the k best."""
    strength = F.struct((F.col("match") != "exact").alias("near"), "hamming", "kind")
    one = links.groupBy("submission_id", "other_id").agg(F.min(strength).alias("s"))
    w = Window.partitionBy("submission_id").orderBy("s.near", "s.hamming", "other_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "submission_id", "other_id", "rank", F.when(F.col("s.near"), "near").otherwise("exact").alias("match"), "s.hamming", "s.kind"
    )


def ring_names(hashes: DataFrame, subs: DataFrame) -> DataFrame:
    """content_hash, claimed_name, copies: every name under which a selfie file was sent, one row a name."""
    selfies = hashes.filter((F.col("kind") == "selfie") & (F.coalesce("content_hash", L("")) != "")).select("submission_id", "content_hash")
    named = selfies.join(subs.select("submission_id", "claimed_name"), "submission_id", "left")
    return named.filter(F.coalesce("claimed_name", L("")) != "").groupBy("content_hash", "claimed_name").agg(F.count(L(1)).alias("copies"))


def ring_siblings(hashes: DataFrame, subs: DataFrame) -> DataFrame:
    """Per submission: its selfie file, how many others share the bytes and under how many other names.

    The names themselves are the rows of `ring_names` for the file: a list per submission
    would hold them once per sharer.
    """
    selfies = hashes.filter((F.col("kind") == "selfie") & (F.coalesce("content_hash", L("")) != "")).select("submission_id", "content_hash")
    named = selfies.join(subs.select("submission_id", "claimed_name"), "submission_id", "left")
    sizes = named.groupBy("content_hash").agg(F.count(L(1)).alias("sharers")).filter("sharers > 1")
    per_name = ring_names(hashes, subs)
    totals = per_name.groupBy("content_hash").agg(F.count(L(1)).alias("n_names"))
    full = named.join(sizes, "content_hash").join(totals, "content_hash", "left").join(per_name, ["content_hash", "claimed_name"], "left")
    only_me = F.coalesce(F.col("copies") == 1, L(False))
    return full.select("submission_id", "content_hash", (F.col("sharers") - 1).alias("shared_selfie_with"), (F.coalesce("n_names", L(0)) - only_me.cast("int")).alias("n_other_names"))


# --- the channel -------------------------------------------------------------
def linkage_signal(ids: DataFrame, faces: DataFrame, assets: DataFrame) -> DataFrame:
    """Score, exact flag and reasons from face_links and best_asset_links output."""
    differs = F.col("name_differs")
    f = faces.groupBy("submission_id").agg(
        F.count(L(1)).alias("n_face"),
        F.count(F.when(differs, 1)).alias("n_conflict"),
        F.count(F.when(F.col("name_comparable"), 1)).alias("n_comparable"),
        F.countDistinct(F.when(differs, F.col("other_name"))).alias("n_names"),
        F.countDistinct(F.when(differs, F.col("other_merchant"))).alias("n_merchants"),
    )
    a = assets.groupBy("submission_id").agg(F.count(F.when(F.col("match") == "exact", 1)).alias("n_exact"), F.count(F.when(F.col("match") != "exact", 1)).alias("n_near"))
    joined = ids.select("submission_id").join(f, "submission_id", "left").join(a, "submission_id", "left").fillna(0)
    c = F.col
    return joined.select(
        "*",
        linkage_score(c("n_face"), c("n_conflict"), c("n_exact"), c("n_near")).alias("link_score"),
        (c("n_exact") > 0).alias("link_exact"),
        linkage_reasons(c("n_face"), c("n_conflict"), c("n_names"), c("n_merchants"), c("n_comparable"), c("n_exact"), c("n_near")).alias("link_reasons"),
    )
