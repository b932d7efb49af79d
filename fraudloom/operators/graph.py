"""Fraud-ring graph: edges, connected components, ring summaries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import fixed_values as K
from ..functions.scalars import name_trim
from .durable import cut, cut_measured
from .ordered import row_numbers
from .linkage import FaceScan
from .similarity import fold_copies, similar_pairs, usable_vectors

L = F.lit
EDGE = ["source", "target", "kind", "weight", "name_differs"]


def _copy_star(members: DataFrame) -> DataFrame:
    """Copies of one vector hang on their lowest id instead of forming all pairs."""
    return members.filter((F.col("copies") > 1) & (F.col("submission_id") != F.col("rep"))).select(
        F.col("rep").alias("source"), F.col("submission_id").alias("target"), L(1.0).alias("weight")
    )


def graph_face_edges(emb: DataFrame, threshold: float = K.SAME_PERSON, form: str = "pairs", block_rows: int = 8192, scan: FaceScan | None = None) -> DataFrame:
    """Face edges between submissions; names are compared trimmed and lower-cased only.

    form='pairs': every pair of distinct vectors at or above the threshold.
    form='forest': a spanning forest with the same components, fewer edges than nodes.
    Copies of one vector are a star in both forms.  `scan`: a pass made before, with links.
    """
    if form == "pairs":
        rows = usable_vectors(emb)
        reps, members = fold_copies(rows)
        near = similar_pairs(reps, threshold, block_rows)
    else:
        scan = scan or FaceScan(emb, threshold, None, block_rows=block_rows)
        rows, members, near = scan.rows, scan.members, scan.kind("link")
    edges = near.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("similarity").alias("weight")).unionByName(_copy_star(members))
    names = rows.select("submission_id", name_trim(F.coalesce("claimed_name", L(""))).alias("n"))
    a = names.select(F.col("submission_id").alias("source"), F.col("n").alias("na"))
    b = names.select(F.col("submission_id").alias("target"), F.col("n").alias("nb"))
    differs = (F.col("na") != "") & (F.col("nb") != "") & (F.col("na") != F.col("nb"))
    return edges.join(a, "source").join(b, "target").select("source", "target", L("face").alias("kind"), "weight", differs.alias("name_differs"))


def _star(groups: DataFrame, key: str, kind: str, weight: float) -> DataFrame:
    """Every member of a group -> its lowest id."""
    low = groups.groupBy(key).agg(F.min("submission_id").alias("source"), F.count(L(1)).alias("members")).filter("members > 1")
    return groups.join(low, key).filter(F.col("submission_id") != F.col("source")).select(
        "source", F.col("submission_id").alias("target"), L(kind).alias("kind"), L(weight).alias("weight"), L(False).alias("name_differs"), "members"
    )


def graph_asset_edges(hashes: DataFrame) -> DataFrame:
    """File edges, kind ignored: equal bytes are exact; an equal image hash is near, unless any
    row with that image hash has bytes that repeat.

    A group of n files becomes n-1 star edges that carry the group size; the all-pairs form
    has n(n-1)/2 edges and the same components.
    """
    exact, near = file_groups(hashes)
    return _star(exact, "file", "asset_exact", 1.0).unionByName(_star(near, "file", "asset_near", 0.9))


def file_groups(hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submission_id, file) of equal bytes, and of equal image hashes that are not barred by repeated bytes."""
    has_bytes, has_image = F.coalesce("content_hash", L("")) != "", F.coalesce("phash", L("")) != ""
    repeated = hashes.filter(has_bytes).groupBy("content_hash").agg(F.count(L(1)).alias("n")).filter("n > 1").select("content_hash")
    barred = hashes.filter(has_bytes & has_image).join(repeated, "content_hash", "left_semi").select("phash").distinct()
    exact = hashes.filter(has_bytes).select("submission_id", F.col("content_hash").alias("file")).distinct()
    near = hashes.filter(has_image).select("submission_id", "phash").distinct().join(barred, "phash", "left_anti").withColumnRenamed("phash", "file")
    return exact, near


def _shared_files(groups: DataFrame) -> DataFrame:
    """The rows of files with several members, the file as a number: pairs meet these, and need not carry its hash."""
    files = cut(groups.groupBy("file").agg(F.count(L(1)).alias("n")).filter("n > 1").select("file", F.monotonically_increasing_id().alias("no")))
    return groups.join(files, "file").select("submission_id", F.col("no").alias("file"))


def file_relation(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """`pairs` (source, target, ...) with file_kind: asset_exact or asset_near if both ends are in one
    group of files, else null.

    A group of n files is a clique of n(n-1)/2 pairs that are never listed: both ends of a pair
    meet their groups instead, so every pair has its kind, inside and outside the stars.
    """
    exact, near = map(_shared_files, file_groups(hashes))
    key = pairs.select("source", "target").distinct()
    found = None
    for groups, kind, rank in ((exact, "asset_exact", 3), (near, "asset_near", 1)):
        a, b = groups.select(F.col("submission_id").alias("source"), "file"), groups.select(F.col("submission_id").alias("target"), "file")
        both = key.join(a, "source").join(b, ["target", "file"]).select("source", "target", L(kind).alias("file_kind"), L(rank).alias("r"))
        found = both if found is None else found.unionByName(both)
    best = found.groupBy("source", "target").agg(F.max_by("file_kind", "r").alias("file_kind"))
    return pairs.join(best, ["source", "target"], "left")


def strongest_edges(assets: DataFrame, faces: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """One edge per unordered pair: exact over face over near.

    With `hashes`, a face pair inside a group of equal files is exact even where the group's
    star does not list it; without, only listed edges count (the components are the same).
    """
    rank = F.when(F.col("kind") == "asset_exact", 3).when(F.col("kind") == "face", 2).otherwise(1)
    lo, hi = F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")
    both = assets.select(*EDGE).unionByName(faces.select(*EDGE)).select(lo, hi, *EDGE[2:])
    if hashes is not None:
        same = file_relation(both, hashes).withColumn("up", (F.col("file_kind") == "asset_exact") & (F.col("kind") != "asset_exact"))
        up = lambda c, v: F.when(F.coalesce("up", L(False)), v).otherwise(F.col(c)).alias(c)
        both = same.select("source", "target", up("kind", L("asset_exact")), up("weight", L(1.0)), up("name_differs", L(False)))
    return both.groupBy("source", "target").agg(F.max_by(F.struct(*EDGE[2:]), F.struct(rank, "weight")).alias("e")).select("source", "target", "e.kind", "e.weight", "e.name_differs")


def component_roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node -> lowest node of its component, by alternating large-star and small-star.

    Each half step is one min-aggregation (combined map-side) and one join on the node, so
    a hub never has its neighbours collected.  Every round is checkpointed and the loop
    ends when the edge set stops changing.
    """
    stamp = [F.count(L(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))]
    e, state = cut_measured(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), *stamp)
    for _ in range(max_rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, after = cut_measured(turned.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), *stamp)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id) and edges(source, target) -> id, root, ring; singletons have a null ring.

    Edges with an unknown endpoint and self-edges are ignored.  Ring numbers are contiguous
    from 0, in order of the lowest member for numeric ids and in hash order for text ids.
    """
    known = nodes.select("id").distinct()
    kept = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    kept = kept.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")
    roots = component_roots(kept)
    heads = roots.select("root").distinct()
    numeric = isinstance(roots.schema["root"].dataType, NumericType)
    ranked = row_numbers(heads, [], "root", [], "rn") if numeric else _rank_strings(heads)
    rings = roots.join(ranked.select("root", (F.col("rn") - 1).alias("ring")), "root")
    return nodes.join(rings, "id", "left")


def _rank_strings(df: DataFrame) -> DataFrame:
    """Numbers text ids in hash order: text may share long prefixes, hashes split evenly."""
    return row_numbers(df.withColumn("k", F.xxhash64("root")), [], "k", ["root"], "rn").drop("k")


def ring_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, merchant_id, claimed_name, score, ring) -> one row per ring, largest first."""
    inside = nodes.filter(F.col("ring").isNotNull())
    name = F.when(F.coalesce("claimed_name", L("")) != "", name_trim(F.col("claimed_name")))
    body = inside.groupBy("ring").agg(
        F.count(L(1)).alias("size"),
        F.countDistinct(name).alias("distinct_names"),
        F.max("score").alias("max_score"),
        F.array_sort(F.collect_set("merchant_id")).alias("merchants"),  # bounded by the merchant table
    )
    of = inside.select(F.col("id").alias("source"), "ring")
    exact = edges.filter(F.col("kind") == "asset_exact").join(of, "source").select("ring").distinct().withColumn("has_exact_asset_reuse", L(True))
    return body.join(exact, "ring", "left").fillna({"has_exact_asset_reuse": False})


def threat_graph(nodes: DataFrame, emb: DataFrame, hashes: DataFrame, as_of=None, hours: int | None = None, max_nodes: int | None = None, threshold: float = K.SAME_PERSON, block_rows: int = 8192) -> dict[str, DataFrame]:
    """nodes, edges and rings of a time window.  The node cap of an interactive view is optional."""
    win = nodes
    if as_of is not None and hours is not None:
        win = win.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours)))
    if max_nodes is not None:
        win = win.orderBy(F.desc("created_at"), F.desc("id")).limit(max_nodes)
    ids = win.select(F.col("id").alias("submission_id"))
    e = emb.join(ids, "submission_id", "left_semi")
    h = hashes.join(ids, "submission_id", "left_semi")
    edges = cut(strongest_edges(graph_asset_edges(h), graph_face_edges(e, threshold, "forest", block_rows), h))
    comp = connected_components(win, edges)
    return {"nodes": comp, "edges": edges, "rings": ring_summary(comp, edges)}
