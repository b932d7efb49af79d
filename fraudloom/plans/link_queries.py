"""Linkage, graph and decision queries, up to the flagship."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions import scalars as X
from ..functions import scoring as S
from ..operators import calibrate as C
from ..operators import graph as G
from ..operators import linkage as N
from ..operators import scoring as R
from ..operators import similarity as V
from ..operators.durable import cut, cut_cleaned, fresh_path
from . import bindings as B
from .bindings import EMB, FACE_T, HASHES, OUTPUTS, POLICIES, SUBS, VERD, with_ctes
from .registry import query

L = F.lit

SIMS = """sims AS (SELECT a.submission_id AS a, b.submission_id AS b, a.claimed_name AS an, b.claimed_name AS bn, b.merchant_id AS bm, a.at AS at_a, b.at AS at_b, round(list_cosine_similarity(a.vector, b.vector), 12) AS sim FROM emb a JOIN emb b ON a.submission_id <> b.submission_id)"""


def face_cte(t):
    return f"""flinks AS (SELECT a AS submission_id, rank, b AS other_id, sim AS similarity, bn AS other_name, bm AS other_merchant, true AS name_comparable, an <> bn AS name_differs
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sims WHERE sim >= {t}) WHERE rank <= 25)"""


@query("jn4_face_links", with_ctes(EMB, SIMS, face_cte(FACE_T)) + "SELECT * FROM flinks")
def face_links(t):
    return N.face_links(B.embeddings(t), FACE_T)


@query("jn4_face_links_shipped_threshold", with_ctes(EMB, SIMS, face_cte(K.SAME_PERSON)) + "SELECT * FROM flinks")
def face_links_shipped(t):
    return N.face_links(B.embeddings(t))


@query("jn4_face_links_prior", with_ctes(EMB, SIMS) + f"SELECT a AS submission_id, rank, b AS other_id, sim AS similarity, an <> bn AS name_differs FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, at_b, b) AS rank FROM sims WHERE sim >= {FACE_T} AND at_b < at_a) WHERE rank <= 25")
def face_links_prior(t):
    return N.face_links(B.embeddings(t), FACE_T, mode="prior").select("submission_id", "rank", "other_id", "similarity", "name_differs")


@query("jn4_face_links_approx")
def face_links_approx(t):
    return N.face_links(B.embeddings(t), FACE_T, method="approx")


PART_PAIRS = 1 << 25  # exact pairs that are joined at a time


@query("jn4_face_links_approx_recall", with_ctes(EMB, SIMS) + f"SELECT count(*) AS exact_pairs, 0 AS invented, true AS recall_reached FROM sims WHERE a < b AND sim >= {FACE_T}")
def approx_recall(t):
    """The approximate pairs, asked for 0.95 of the links, against the exact ones: none invented, at least 0.9 found."""
    reps, _ = V.fold_copies(V.usable_vectors(B.embeddings(t)))
    found = V.approx_pairs(reps, FACE_T, 0.95, scores=False).select("a", "b", L(1).alias("approx"))
    known = cut_cleaned(V.similar_pairs(reps, FACE_T).select("a", "b")).select("a", "b", L(1).alias("exact"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    exact, approx = F.col("exact").isNotNull(), F.col("approx").isNotNull()
    parts, path = 1 + known.count() // PART_PAIRS, fresh_path(t.spark)
    for k in range(parts):  # the pairs of one part of the hashes are on their way at a time
        mine = lambda df: df.filter(F.pmod(F.xxhash64("a", "b"), L(parts)) == k)
        both = mine(known).join(mine(found), ["a", "b"], "full")
        out = cut_cleaned(both.agg(n(exact, "exact"), n(approx & ~exact, "invented"), n(exact & approx, "hits")), path)
    return out.agg(F.sum("exact").alias("exact_pairs"), F.sum("invented").alias("invented"), (F.sum("hits") >= 0.9 * F.sum("exact")).alias("recall_reached"))


EXACT = """exact AS (SELECT a.submission_id, b.submission_id AS other_id, a.kind, count(*) OVER (PARTITION BY a.submission_id, a.kind) AS n_others, row_number() OVER (PARTITION BY a.submission_id, a.kind ORDER BY b.submission_id) AS rn
  FROM hashes a JOIN hashes b ON a.kind = b.kind AND a.content_hash = b.content_hash AND a.submission_id <> b.submission_id)"""
HAM = "bit_count(xor(('0x' || substr(a.phash, 1, 8))::BIGINT, ('0x' || substr(b.phash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.phash, 9, 8))::BIGINT, ('0x' || substr(b.phash, 9, 8))::BIGINT))"
NEAR = f"""near AS (SELECT *, row_number() OVER (PARTITION BY submission_id, kind ORDER BY hamming, other_id) AS rn FROM (SELECT a.submission_id, b.submission_id AS other_id, a.kind, {HAM} AS hamming
  FROM hashes a JOIN hashes b ON a.kind = b.kind AND a.content_hash <> b.content_hash AND a.submission_id <> b.submission_id) WHERE hamming <= 8)"""
BEST = """alinks AS (SELECT submission_id, other_id, row_number() OVER (PARTITION BY submission_id ORDER BY near, hamming, other_id) AS rank, CASE WHEN near THEN 'near' ELSE 'exact' END AS match, hamming, kind FROM
  (SELECT submission_id, other_id, min(near) AS near, min(hamming) AS hamming, min(kind) AS kind FROM (SELECT submission_id, other_id, false AS near, 0 AS hamming, kind FROM exact WHERE rn <= 15 UNION ALL SELECT submission_id, other_id, true, hamming, kind FROM near WHERE rn <= 15) GROUP BY 1, 2))"""


@query("jn5_asset_links_exact", with_ctes(HASHES, EXACT) + "SELECT submission_id, other_id, kind, n_others, 'exact' AS match, 0 AS hamming FROM exact WHERE rn <= 15")
def exact_links(t):
    return N.asset_links_exact(B.asset_hashes(t))


@query("jn6_asset_links_near", with_ctes(HASHES, NEAR) + "SELECT submission_id, other_id, kind, 'near' AS match, hamming FROM near WHERE rn <= 15")
def near_links(t):
    return N.asset_links_near(B.asset_hashes(t))


SIGNS = "list_sum(list_transform(range(1, 65), lambda i: ((a.embedding[i] >= 0) <> (b.embedding[i] >= 0))::INT))"


@query("jn6_near_vector_fingerprints", f"SELECT a, b, hamming FROM (SELECT a.vec_id AS a, b.vec_id AS b, {SIGNS} AS hamming FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE hamming <= 16")
def near_vectors(t):
    """A looser bound than the shipped 8 bits, because 8 has no hits on these vectors."""
    h = B.vector_hashes(t)
    bits = cut(h.select("submission_id", "kind", X.hash64_bits(F.col("phash")).alias("h")))  # else every side of the joins folds the vectors again
    pairs = N.near_hash_pairs(bits.select("kind", "h").distinct(), 16)
    a, b = bits.select(F.col("h").alias("a"), F.col("submission_id").alias("ia")), bits.select(F.col("h").alias("b"), F.col("submission_id").alias("ib"))
    equal = bits.select("h", F.col("submission_id").alias("ia")).join(b.withColumnRenamed("b", "h"), "h").filter("ia < ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"), L(0).alias("hamming"))
    return pairs.join(a, "a").join(b, "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "hamming").unionByName(equal)


@query("sc15_hamming64", f"SELECT hamming, count(*) AS n FROM (SELECT {SIGNS} AS hamming FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY 1")
def hamming(t):
    h = B.vector_hashes(t)
    nxt = h.select((F.col("submission_id") - 1).alias("submission_id"), F.col("phash").alias("other"))
    return h.join(nxt, "submission_id").groupBy(X.hamming64(F.col("phash"), F.col("other")).alias("hamming")).agg(F.count(L(1)).alias("n"))


@query("sc14_cosine", "SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    e = t.embeddings.select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", X.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query("sc16_name_norm", "SELECT count(DISTINCT trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS names FROM (SELECT c_name || '  ' || c_mktsegment AS text FROM customer)")
def names(t):
    return t.customer.select(X.name_norm(F.concat("c_name", L("  "), "c_mktsegment")).alias("n")).agg(F.countDistinct("n").alias("names"))


@query("jn7_best_asset_links", with_ctes(HASHES, EXACT, NEAR, BEST) + "SELECT submission_id, other_id, rank, match, hamming, kind FROM alinks WHERE rank <= 15")
def best_links(t):
    h = B.asset_hashes(t)
    return N.best_asset_links(all_asset_links(h))


def all_asset_links(h):
    return N.asset_links_exact(h).drop("n_others").unionByName(N.asset_links_near(h))


@query("jn8_graph_face_edges", with_ctes(EMB, SIMS) + f"SELECT a AS source, b AS target, 'face' AS kind, sim AS weight, an <> bn AS name_differs FROM sims WHERE a < b AND sim >= {FACE_T}")
def face_edges(t):
    return G.graph_face_edges(B.embeddings(t), FACE_T)


ASSET_EDGES = """rep AS (SELECT content_hash FROM hashes GROUP BY 1 HAVING count(*) > 1), barred AS (SELECT DISTINCT phash FROM hashes WHERE content_hash IN (FROM rep)),
 ex AS (SELECT min(submission_id) OVER (PARTITION BY content_hash) AS source, submission_id AS target, 'asset_exact' AS kind, 1.0 AS weight, count(*) OVER (PARTITION BY content_hash) AS members FROM hashes),
 nr AS (SELECT min(submission_id) OVER (PARTITION BY phash) AS source, submission_id AS target, 'asset_near' AS kind, 0.9 AS weight, count(*) OVER (PARTITION BY phash) AS members FROM hashes WHERE phash NOT IN (FROM barred)),
 aedges AS (SELECT *, false AS name_differs FROM (FROM ex UNION ALL FROM nr) WHERE source <> target)"""


@query("jn9_graph_asset_edges", with_ctes(HASHES, ASSET_EDGES) + "SELECT * FROM aedges")
def asset_edges(t):
    return G.graph_asset_edges(B.asset_hashes(t))


@query("jn9_asset_pair_counts", with_ctes(HASHES, ASSET_EDGES) + """, p AS (SELECT 'asset_exact' AS kind, count(*) AS pairs FROM hashes a JOIN hashes b ON a.content_hash = b.content_hash AND a.submission_id < b.submission_id
 UNION ALL SELECT 'asset_near', count(*) FROM hashes a JOIN hashes b ON a.phash = b.phash AND a.submission_id < b.submission_id WHERE a.phash NOT IN (FROM barred)) SELECT * FROM p""")
def asset_pairs(t):
    """The size of the all-pairs form, from the star form: n(n-1)/2 per group of n."""
    e = G.graph_asset_edges(B.asset_hashes(t))
    found = e.groupBy("kind", "source", "members").agg(F.first("members")).groupBy("kind").agg(F.sum((F.col("members") * (F.col("members") - 1) / 2)).cast("bigint").alias("pairs"))
    kinds = t.spark.createDataFrame([("asset_exact",), ("asset_near",)], "kind string")  # a kind without edges counts 0
    return kinds.join(found, "kind", "left").fillna(0, ["pairs"])


@query("jn15_ring_siblings", with_ctes(HASHES) + """, sizes AS (SELECT content_hash, count(*) AS c FROM hashes GROUP BY 1 HAVING count(*) > 1), nm AS (SELECT content_hash, claimed_name AS name, count(*) AS k FROM hashes GROUP BY 1, 2),
 o AS (SELECT h.submission_id, any_value(c) - 1 AS shared_selfie_with, list_sort(list(name) FILTER (WHERE name <> h.claimed_name OR k > 1)) AS others FROM hashes h JOIN sizes USING (content_hash) JOIN nm USING (content_hash) GROUP BY h.submission_id)
SELECT submission_id, h.content_hash, shared_selfie_with, coalesce(len(others), 0) AS n_other_names FROM o JOIN hashes h USING (submission_id)""")
def siblings(t):
    h = B.asset_hashes(t).withColumn("kind", L("selfie"))
    return N.ring_siblings(h, h.select("submission_id", "claimed_name"))


@query("jn15_ring_names", with_ctes(HASHES) + " SELECT content_hash, claimed_name, count(*) AS copies FROM hashes GROUP BY 1, 2")
def sibling_names(t):
    h = B.asset_hashes(t).withColumn("kind", L("selfie"))
    return N.ring_names(h, h.select("submission_id", "claimed_name"))


UNION_EDGES = f"""fedges AS (SELECT a AS source, b AS target, 'face' AS kind, sim AS weight, an <> bn AS name_differs FROM sims WHERE a < b AND sim >= {FACE_T}),
 alledges AS (SELECT source, target, kind, weight, name_differs FROM aedges UNION ALL FROM fedges),
 strong AS (SELECT source, target, kind, weight, name_differs FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY CASE kind WHEN 'asset_exact' THEN 3 WHEN 'face' THEN 2 ELSE 1 END DESC, weight DESC) AS rn FROM alledges) WHERE rn = 1)"""


FULL_PAIRS = """pairs3 AS (SELECT least(a.submission_id, b.submission_id) AS source, greatest(a.submission_id, b.submission_id) AS target, 'asset_exact' AS kind, 1.0::DOUBLE AS weight, false AS name_differs FROM hashes a JOIN hashes b ON a.content_hash = b.content_hash AND a.submission_id < b.submission_id
  UNION ALL FROM fedges UNION ALL SELECT a.submission_id, b.submission_id, 'asset_near', 0.9::DOUBLE, false FROM hashes a JOIN hashes b ON a.phash = b.phash AND a.submission_id < b.submission_id WHERE a.phash NOT IN (FROM barred)),
 fullpairs AS (SELECT source, target, kind, weight, name_differs FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY CASE kind WHEN 'asset_exact' THEN 3 WHEN 'face' THEN 2 ELSE 1 END DESC, weight DESC) AS rn FROM pairs3) WHERE rn = 1)"""


@query("so2_strongest_edges", with_ctes(EMB, SIMS, HASHES, ASSET_EDGES, UNION_EDGES, FULL_PAIRS) + "SELECT f.* FROM fullpairs f JOIN strong USING (source, target)")
def strongest(t):
    """The edges that are listed (stars and face pairs), each with its kind among all pairs."""
    h = B.asset_hashes(t)
    return G.strongest_edges(G.graph_asset_edges(h), G.graph_face_edges(B.embeddings(t), FACE_T), h)


@query("jn9_file_relation", with_ctes(EMB, SIMS, HASHES, ASSET_EDGES, UNION_EDGES, FULL_PAIRS) + "SELECT fe.source, fe.target, min(kind) AS file_kind FROM fedges fe LEFT JOIN (FROM pairs3 WHERE kind <> 'face') p ON p.source = fe.source AND p.target = fe.target GROUP BY ALL".replace("min(kind)", "min(p.kind)"))
def relation(t):
    """Which file group, if any, the two ends of every face pair share."""
    return G.file_relation(G.graph_face_edges(B.embeddings(t), FACE_T).select("source", "target"), B.asset_hashes(t))


GRAPH_NODES = "nodes AS (SELECT doc_id AS id, source AS merchant_id, lang AS claimed_name, (n_chars % 97) / 97.0::DOUBLE AS score FROM documents)"
COMPONENTS = """inn AS (SELECT source, target FROM strong WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)), sym AS (SELECT source AS a, target AS b FROM inn UNION SELECT target, source FROM inn),
 reach(id, m) AS (SELECT DISTINCT a, a FROM sym UNION SELECT r.id, s.b FROM reach r JOIN sym s ON s.a = r.m), roots AS (SELECT id, min(m) AS root FROM reach GROUP BY id),
 comp AS (SELECT n.*, root, (dense_rank() OVER (ORDER BY root) - 1) AS r0 FROM nodes n LEFT JOIN roots USING (id)), ringed AS (SELECT id, merchant_id, claimed_name, score, root, CASE WHEN root IS NOT NULL THEN r0 END AS ring FROM comp)"""
RECURSIVE = lambda *c: with_ctes(*c).replace("WITH ", "WITH RECURSIVE ", 1)


def graph_nodes(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("merchant_id"), F.col("lang").alias("claimed_name"), ((F.col("n_chars") % 97) / 97.0).alias("score"))


@query("gr1_connected_components", RECURSIVE(EMB, SIMS, HASHES, ASSET_EDGES, UNION_EDGES, GRAPH_NODES, COMPONENTS) + "SELECT id, root, ring FROM ringed")
def components(t):
    edges = G.strongest_edges(G.graph_asset_edges(B.asset_hashes(t)), G.graph_face_edges(B.embeddings(t), FACE_T, "forest"))
    return G.connected_components(graph_nodes(t).select("id"), edges)


RINGS = """rings AS (SELECT ring, count(*) AS size, count(DISTINCT lower(trim(claimed_name))) AS distinct_names, max(score) AS max_score, string_agg(DISTINCT merchant_id, ',' ORDER BY merchant_id) AS merchants,
  ring IN (SELECT ring FROM ringed JOIN strong ON id = source WHERE kind = 'asset_exact' AND ring IS NOT NULL) AS has_exact_asset_reuse FROM ringed WHERE ring IS NOT NULL GROUP BY ring)"""


def threat(t):
    return G.threat_graph(graph_nodes(t), B.embeddings(t), B.asset_hashes(t), threshold=FACE_T)


@query("gr2_threat_graph_rings", RECURSIVE(EMB, SIMS, HASHES, ASSET_EDGES, UNION_EDGES, GRAPH_NODES, COMPONENTS, RINGS) + "SELECT * FROM rings ORDER BY size DESC, max_score DESC")
def rings(t):
    return threat(t)["rings"].withColumn("merchants", F.array_join("merchants", ",")).orderBy(F.desc("size"), F.desc("max_score"))


@query("ag8_ring_summary", RECURSIVE(HASHES, ASSET_EDGES, "strong AS (SELECT source, target, kind FROM aedges)", GRAPH_NODES, COMPONENTS, RINGS) + "SELECT * FROM rings")
def file_rings(t):
    """Rings from shared files alone."""
    edges = G.graph_asset_edges(B.asset_hashes(t))
    comp = G.connected_components(graph_nodes(t), edges)
    return G.ring_summary(comp, edges).withColumn("merchants", F.array_join("merchants", ","))


# --- one-to-one face match ---------------------------------------------------------
@query("jn17_face_match_pair", """WITH s AS (SELECT a.vec_id // 2 AS submission_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9) AS similarity
  FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0) a LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 21 <> 0) b ON b.vec_id = a.vec_id + 1)
SELECT submission_id, similarity, CASE WHEN similarity < 0.1 THEN 'mismatch' WHEN similarity > 0.3 THEN 'duplicate' WHEN similarity IS NOT NULL THEN 'match' END AS direction,
 CASE WHEN similarity IS NULL THEN 0.5 WHEN similarity < 0.1 THEN least(1, 0.55 + (0.1 - similarity) * 1.4) WHEN similarity > 0.3 THEN least(1, least(1, 0.55 + (similarity - 0.3) * 12) + 0.2) ELSE abs(similarity - 0.2) / 0.2 * 0.5 END AS score,
 CASE WHEN similarity IS NULL THEN 0.2 WHEN similarity BETWEEN 0.1 AND 0.3 THEN 0.7 ELSE 0.85 END AS confidence FROM s""")
def match_pair(t):
    """Band 0.1 .. 0.3 so that all three outcomes occur on these vectors."""
    v = F.col("vec_id")
    e = t.embeddings.filter((v % 2 == 0) | (v % 21 != 0)).select(F.floor(v / 2).alias("submission_id"), F.when(v % 2 == 0, "selfie").otherwise("id_photo").alias("kind"), F.col("embedding").alias("vector"))
    sim = R.face_match_pair(e).select("submission_id", "similarity")
    return sim.select("submission_id", "similarity", S.face_match_score(F.col("similarity"), L(4), 0.1, 0.3).alias("m")).select("submission_id", "similarity", "m.*")


@query("jn18_live_match", "SELECT event_id, s >= 0.4065 AND s < 0.9878 AS match, s - 0.4065 AS margin, CASE WHEN abs(s - 0.4065) >= 0.10 THEN 'strong' WHEN abs(s - 0.4065) >= 0.03 THEN 'borderline' ELSE 'weak' END AS confidence FROM (SELECT event_id, value / 490.0::DOUBLE AS s FROM events)")
def live(t):
    return t.events.select("event_id", S.live_match(F.col("value") / 490.0).alias("m")).select("event_id", "m.*")


# --- fusion and the whole decision --------------------------------------------------
W = "(VALUES " + ", ".join(f"('{d}', {w}::DOUBLE)" for d, w in K.FUSION_WEIGHTS.items()) + ") w(detector, w)"
FUSED = f"""fused AS (SELECT submission_id, CASE WHEN den > 0 THEN least(1, 0.65 * num / den + 0.35 * loud) ELSE 0.5 END::DOUBLE AS fused FROM
  (SELECT submission_id, sum(w * greatest(confidence, 0.05) * score) FILTER (WHERE status = 'ok') AS num, sum(w * greatest(confidence, 0.05)) FILTER (WHERE status = 'ok') AS den, coalesce(max(score) FILTER (WHERE status = 'ok' AND confidence >= 0.5), 0) AS loud FROM outputs JOIN {W} USING (detector) GROUP BY 1))"""


@query("sc22_heuristic_fuse", with_ctes(OUTPUTS, FUSED) + "SELECT * FROM fused")
def fuse(t):
    return R.heuristic_fuse(B.detector_outputs(t))


SIGNAL = """f AS (SELECT submission_id, count(*) AS n_face, count(*) FILTER (WHERE name_differs) AS n_conflict, count(*) FILTER (WHERE name_comparable) AS n_comparable FROM flinks GROUP BY 1),
 g AS (SELECT submission_id, count(*) FILTER (WHERE match = 'exact') AS n_exact, count(*) FILTER (WHERE match = 'near') AS n_near FROM alinks WHERE rank <= 15 GROUP BY 1),
 sig AS (SELECT submission_id, coalesce(n_face, 0) AS n_face, coalesce(n_conflict, 0) AS n_conflict, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
  greatest(CASE WHEN n_conflict > 0 THEN least(0.95, 0.55 + 0.12 * n_conflict) WHEN n_face > 0 THEN 0.30 ELSE 0 END, CASE WHEN n_exact > 0 THEN least(0.9, 0.6 + 0.1 * n_exact) WHEN n_near > 0 THEN 0.35 ELSE 0 END)::DOUBLE AS link_score,
  coalesce(n_exact, 0) > 0 AS link_exact FROM ids LEFT JOIN f USING (submission_id) LEFT JOIN g USING (submission_id))"""
LINKS = (EMB, SIMS, face_cte(FACE_T), HASHES, EXACT, NEAR, BEST)


def signal(t, ids, scan=None):
    return N.linkage_signal(ids, N.face_links(B.embeddings(t), FACE_T, scan=scan), N.best_asset_links(all_asset_links(B.asset_hashes(t))))


@query("sc19_linkage_signal", with_ctes(*LINKS, "ids AS (SELECT doc_id AS submission_id FROM documents)", SIGNAL) + "SELECT * FROM sig")
def linkage(t):
    return signal(t, t.documents.select(F.col("doc_id").alias("submission_id"))).select("submission_id", "n_face", "n_conflict", "n_exact", "n_near", "link_score", "link_exact")


BEHAV = """behav AS (SELECT s.submission_id, merchant_id, coalesce(CASE WHEN status = 'ok' THEN least(score * confidence, greatest(min_risk_for_review, min_risk_for_reject - abstain_band - 0.000001)) END, 0) AS channel
  FROM subs s JOIN policies USING (merchant_id) LEFT JOIN (SELECT * FROM outputs WHERE detector = 'behavioral') o USING (submission_id))"""


@query("sc21_behavioral_channel", with_ctes(SUBS, POLICIES, OUTPUTS, BEHAV) + "SELECT submission_id, channel FROM behav")
def channel(t):
    o = B.detector_outputs(t).filter("detector = 'behavioral'").select("submission_id", "score", "confidence", "status")
    j = B.submissions(t).select("submission_id", "merchant_id").join(B.policies(t), "merchant_id").join(o, "submission_id", "left")
    cap = S.ceiling(F.col("min_risk_for_review"), F.col("min_risk_for_reject"), F.col("abstain_band"))
    ok = F.coalesce(F.col("status") == "ok", L(False))
    return j.select("submission_id", S.behavioral_channel(F.col("score"), F.col("confidence"), ok, L(False), cap).alias("channel"))


FINAL = """fin AS (SELECT s.submission_id, s.merchant_id, s.created_at, fu.fused, sg.*, b.channel, p.*, greatest(min_risk_for_review, min_risk_for_reject - abstain_band - 0.000001) AS cap FROM subs s JOIN policies p USING (merchant_id) JOIN sig sg USING (submission_id) JOIN behav b USING (submission_id) LEFT JOIN fused fu USING (submission_id)),
 sc AS (SELECT submission_id, merchant_id, link_score, link_exact, n_exact, n_conflict, greatest(coalesce(fused, 0.5), CASE WHEN link_exact THEN link_score ELSE least(link_score, cap) END, channel) AS s, min_risk_for_reject AS rej, min_risk_for_review AS rev, abstain_band AS band, require_liveness AS rl FROM fin),
 st AS (SELECT submission_id, coalesce(bool_or(detector = 'liveness_video' AND status = 'ok'), false) AS lv, coalesce(bool_or(detector = 'id_forensics' AND status = 'ok'), false) AS dv, coalesce(bool_or(status = 'error'), false) AS er,
   max(score) FILTER (WHERE detector = 'selfie_deepfake' AND status = 'ok') AS selfie, max(score) FILTER (WHERE detector = 'metadata_exif' AND status = 'ok') AS meta FROM outputs GROUP BY 1),
 v0 AS (SELECT sc.*, coalesce(lv, false) AS lv, coalesce(dv, false) AS dv, coalesce(er, false) AS er, coalesce(selfie, 0) AS selfie, coalesce(meta, 0) AS meta, (s >= rej AND s < rej + band) OR (s < rej AND s < rev AND s > rev - band) AS inband, CASE WHEN s >= rej THEN 'REJECT' WHEN s >= rev THEN 'REVIEW' ELSE 'PASS' END AS raw FROM sc LEFT JOIN st USING (submission_id)),
 v1 AS (SELECT *, CASE WHEN inband THEN 'REVIEW' ELSE raw END AS first FROM v0),
 dec AS (SELECT submission_id, merchant_id, link_score, link_exact, s AS final_score, CASE WHEN first = 'PASS' AND ((rl AND NOT lv) OR NOT dv OR er) THEN 'REVIEW' ELSE first END AS verdict, inband OR (first = 'PASS' AND ((rl AND NOT lv) OR NOT dv OR er)) AS abstained,
  CASE WHEN n_exact > 0 THEN 'reused_kyc_kit' WHEN n_conflict > 0 THEN 'onboarding_ring' WHEN selfie > 0.65 THEN 'generated_selfie' WHEN meta > 0.5 THEN 'stale_or_edited_media' ELSE 'clean' END AS attack_pattern FROM v1)"""
DECIDE = (SUBS, POLICIES, OUTPUTS, FUSED, *LINKS, "ids AS (SELECT submission_id FROM subs)", SIGNAL, BEHAV, FINAL)


def decisions(t, scan=None):
    subs = B.submissions(t).select("submission_id", "merchant_id")
    return R.score_submissions(subs, B.detector_outputs(t), signal(t, subs, scan), B.policies(t))


@query("sc23_final_score", with_ctes(*DECIDE) + "SELECT submission_id, final_score, verdict, abstained, link_score, link_exact FROM dec")
def final_scores(t):
    return decisions(t).select("submission_id", "final_score", "verdict", "abstained", "link_score", "link_exact")


@query("sc25_classify_attack", with_ctes(*DECIDE) + "SELECT attack_pattern, verdict, count(*) AS n FROM dec GROUP BY ALL")
def patterns(t):
    return decisions(t).groupBy("attack_pattern", "verdict").agg(F.count(L(1)).alias("n"))


@query("sc26_explanations")
def explanations(t):
    return decisions(t).select("submission_id", "verdict", "attack_pattern", "explanation")


@query("flagship_ring_decisions", RECURSIVE(*DECIDE, ASSET_EDGES, UNION_EDGES, "nodes AS (SELECT submission_id AS id, merchant_id, claimed_name, 0.0 AS score FROM subs)", COMPONENTS) +
       "SELECT submission_id, dec.merchant_id, ring, final_score, verdict, abstained, attack_pattern, link_score FROM dec JOIN ringed ON id = submission_id WHERE link_score > 0 OR ring IS NOT NULL")
def flagship(t):
    """Submissions that reuse a file or a face, the ring they are in, and the policy decision."""
    scan = N.FaceScan(B.embeddings(t), FACE_T)  # one pass for the links and for the rings
    scored = decisions(t, scan)
    nodes = B.submissions(t).select(F.col("submission_id").alias("id"))
    edges = G.graph_asset_edges(B.asset_hashes(t)).select("source", "target").unionByName(G.graph_face_edges(B.embeddings(t), FACE_T, "forest", scan=scan).select("source", "target"))
    ring = G.connected_components(nodes, edges).select(F.col("id").alias("submission_id"), "ring")
    hit = (F.col("link_score") > 0) | F.col("ring").isNotNull()
    return scored.join(ring, "submission_id").filter(hit).select("submission_id", "merchant_id", "ring", "final_score", "verdict", "abstained", "attack_pattern", "link_score")


# --- linkage calibration -------------------------------------------------------------
# Every stored vector is an identity, folded to 8 numbers (the sums of its dimensions modulo 8, which spreads
# the scores of these random vectors over the shipped thresholds); its second capture leans towards its neighbour.
IMP = """fold AS (SELECT vec_id, list_transform(range(1, 9), lambda i: list_sum(list_transform(range(0, 8), lambda j: embedding[i + 8 * j]::DOUBLE))) AS v FROM embeddings),
 imp AS (SELECT list_cosine_similarity(a.v, b.v) AS s FROM fold a JOIN fold b ON a.vec_id < b.vec_id),
 gen AS (SELECT list_cosine_similarity(a.v, list_transform(range(1, 9), lambda i: a.v[i] + 0.8::DOUBLE * b.v[i])) AS s FROM fold a JOIN fold b ON b.vec_id = a.vec_id + 1),
 need AS (SELECT count(*) AS pairs, 1 - (1 - 0.01::DOUBLE) ** (1 / 50.0::DOUBLE) AS need FROM imp),
 fit AS (SELECT pairs, need, floor(need * pairs) >= 1 AS resolved, ceil(round((SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS rn FROM imp) WHERE rn = floor(need * pairs)), 12) * 10000) / 10000 AS threshold FROM need)"""


def folded(t):
    x = F.col("embedding")
    total = lambda i: sum((x[i + 8 * j].cast("double") for j in range(1, 8)), x[i].cast("double"))
    return cut(t.embeddings.select(F.col("vec_id").alias("rep"), F.array(*[total(i) for i in range(8)]).alias("vector")))


def genuine_scores(reps):
    nxt = reps.select((F.col("rep") - 1).alias("rep"), F.col("vector").alias("w"))
    second = F.zip_with("vector", "w", lambda a, b: a + 0.8 * b)
    return reps.join(nxt, "rep").select(X.cosine(F.col("vector"), second).alias("sim"))


@query("cal5_impostor_summary", with_ctes(IMP) + "SELECT count(*) AS pairs, avg(s) AS mean, quantile_cont(s, 0.99) AS p99, quantile_cont(s, 0.9999) AS p99_99, max(s) AS highest FROM imp", digits=9)
def impostors(t):
    return C.impostor_summary(V.ScoreCounts(folded(t)), t.spark)


@query("cal5_genuine_summary", with_ctes(IMP) + "SELECT count(*) AS n, avg(s) AS mean, quantile_cont(s, 0.05) AS p05, quantile_cont(s, 0.5) AS p50 FROM gen")
def genuine(t):
    return C.genuine_summary(genuine_scores(folded(t)))


@query("cal6_linkage_threshold", with_ctes(IMP) + "SELECT pairs, need AS required_far, resolved, threshold, (SELECT count(*) FROM imp WHERE s >= threshold) AS accepted, (SELECT avg((s >= threshold)::INT) FROM imp) AS far FROM fit", digits=12)
def linkage_threshold(t):
    return C.linkage_threshold(V.ScoreCounts(folded(t)), t.spark, 0.01, 50)


@query("cal6_linkage_grades", with_ctes(IMP) + f""", g AS (SELECT 'fitted' AS name, threshold FROM fit UNION ALL FROM (VALUES ('superseded', {K.SUPERSEDED_SAME_PERSON}::DOUBLE), ('as_shipped', {K.SAME_PERSON}::DOUBLE)) g(name, threshold)),
 r AS (SELECT name, threshold, (SELECT count(*) FROM imp) AS pairs, (SELECT count(*) FROM imp WHERE s >= threshold) AS accepted, (SELECT avg((s >= threshold)::INT) FROM gen) AS tar FROM g)
SELECT name, threshold, pairs, accepted, accepted / pairs AS far, tar, """ + ", ".join(f"1 - (1 - accepted / pairs) ** {n} AS per_applicant_{n}" for n in K.APPLICANT_SIZES) + " FROM r", digits=10)
def grades(t):
    reps = folded(t)
    counts = V.ScoreCounts(reps)
    fitted = C.fitted_threshold(counts, 0.01, 50)[0]
    return C.grade(counts, genuine_scores(reps), {"fitted": fitted, "superseded": K.SUPERSEDED_SAME_PERSON, "as_shipped": K.SAME_PERSON})
