"""Skewed and crowded inputs: the exact answer, without all-pairs or one-task groups."""
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.operators import graph as G
from fraudloom.operators import linkage as N
from fraudloom.operators import metrics as M
from fraudloom.operators import ordered as O
from fraudloom.operators import similarity as V
from fraudloom.operators.sampling import aalto_sessionise


def skewed(n=900, seed=1):
    """A third of the rows under one key."""
    r = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{r.randint(0, 40)}", i, round(r.random(), 3)) for i in range(n)]


def test_row_numbers_and_running_sums_on_a_hot_key(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r.i: (r.rn, r.total) for r in O.row_numbers(df, ["k"], "v", ["i"], "rn", "total").collect()}
    groups = defaultdict(list)
    for k, i, v in rows:
        groups[k].append((v, i))
    for k, items in groups.items():
        for rn, (_, i) in enumerate(sorted(items), 1):
            assert got[i] == (rn, len(items))


def test_neighbours_cross_chunk_borders(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i int, v double").withColumn(O.CHUNK, F.floor(F.col("i") / 7))
    got = {r.i: (r.p, r.n) for r in O.neighbours(df, ["k"], ["i"], {"p": "v"}, {"n": "v"}).collect()}
    groups = defaultdict(list)
    for k, i, v in rows:
        groups[k].append((i, v))
    for items in groups.values():
        for at, (i, _) in enumerate(items):
            assert got[i] == (items[at - 1][1] if at else None, items[at + 1][1] if at + 1 < len(items) else None)


def test_percentiles_equal_numpy(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, i int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    for r in O.exact_percentiles(df, ["k"], "v", probs, stats=True).collect():
        x = np.array([v for k, _, v in rows if k == r.k])
        assert [r.a, r.b, r.c, r.d, r.e] == pytest.approx([np.quantile(x, p) for p in probs.values()])
        assert r.n == len(x) and r.mean == pytest.approx(x.mean())


def vectors(seed=2, copies=60):
    """Clusters of similar vectors plus many exact copies of one."""
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, 16))
    rows = []
    for i in range(120):
        v = centres[0] if i < copies else centres[g.integers(0, 12)] + g.normal(scale=0.35, size=16)
        rows.append((i, [float(np.float32(x)) for x in v], f"p{i % 5}", "m", i * 37 % 101))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "submission_id bigint, vector array<double>, claimed_name string, merchant_id string, at bigint")
    return df.select("submission_id", F.col("vector").cast("array<float>").alias("vector"), "claimed_name", "merchant_id", F.timestamp_seconds("at").alias("created_at"))


def brute(rows, t, k, prior=False):
    x = np.array([np.float32(r[1]) for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    out = {}
    for i in range(len(rows)):
        c = [j for j in range(len(rows)) if j != i and s[i, j] >= t and (not prior or rows[j][4] < rows[i][4])]
        c.sort(key=lambda j: (-s[i, j], rows[j][4] if prior else 0, j))
        for rank, j in enumerate(c[:k], 1):
            out[(i, rank)] = j
    return out


@pytest.mark.parametrize("mode", ["all_others", "prior"])
@pytest.mark.parametrize("block_rows", [1000, 11])
def test_face_links_equal_brute_force_with_many_copies(spark, mode, block_rows):
    rows = vectors()
    got = {(r.submission_id, r["rank"]): r.other_id for r in N.face_links(frame(spark, rows), 0.8, 5, mode, block_rows=block_rows).collect()}
    assert got == brute(rows, 0.8, 5, mode == "prior")


def test_approximate_links_are_a_subset_of_pairs(spark):
    reps, _ = V.fold_copies(frame(spark, vectors()))
    exact = {(r.a, r.b) for r in V.similar_pairs(reps, 0.8, 50).collect()}
    approx = {(r.a, r.b) for r in V.approx_pairs(reps, 0.8).collect()}
    assert approx <= exact and len(approx) > 0.8 * len(exact)


def test_forest_has_the_components_of_all_pairs_and_few_edges(spark):
    df = frame(spark, vectors())
    nodes = df.select(F.col("submission_id").alias("id"))
    full, forest = G.graph_face_edges(df, 0.8, "pairs", 13), G.graph_face_edges(df, 0.8, "forest", 13)
    ring = lambda e: {r.id: r.ring for r in G.connected_components(nodes, e).collect()}
    assert ring(full) == ring(forest)
    small = V.similar_forest(V.fold_copies(df)[0], 0.8, 1000)
    assert small.count() < 120 <= V.similar_pairs(V.fold_copies(df)[0], 0.8, 1000).count() + 60


def hash_rows(seed=4, n=160):
    """A template: most hashes share three bands; many files share one hash."""
    r = random.Random(seed)
    base = r.getrandbits(64)
    rows = []
    for i in range(n):
        h = base if i % 3 == 0 else base ^ (1 << r.randint(0, 15)) ^ (1 << r.randint(0, 15)) ^ (1 << r.randint(0, 63)) if i % 3 == 1 else r.getrandbits(64)
        rows.append((i, "doc" if i % 5 else "selfie", f"{h:016x}", f"c{i // 4}" if i % 3 == 0 else f"u{i}"))
    return rows


@pytest.mark.parametrize("hot", [4096, 2])
def test_near_pairs_equal_brute_force_even_in_crowded_bands(spark, hot):
    rows = hash_rows()
    df = spark.createDataFrame(rows, "submission_id bigint, kind string, phash string, content_hash string")
    from fraudloom.functions.scalars import hash64_bits

    d = df.select("kind", hash64_bits(F.col("phash")).alias("h")).distinct()
    got = [(r.kind, r.a, r.b, r.hamming) for r in N.near_hash_pairs(d, 8, hot).collect()]
    signed = lambda h: int(h, 16) - (1 << 64) if int(h, 16) >= 1 << 63 else int(h, 16)
    by = defaultdict(set)
    for _, k, h, _ in rows:
        by[k].add(signed(h))
    want = sorted((k, a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for k, v in by.items() for a in v for b in v if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 8)
    assert sorted(got) == want  # every pair once


def test_near_links_equal_brute_force(spark):
    rows = hash_rows()
    df = spark.createDataFrame(rows, "submission_id bigint, kind string, phash string, content_hash string")
    got = {(r.submission_id, r.other_id, r.hamming) for r in N.asset_links_near(df, 8, 4).collect()}
    want = set()
    for i, k, h, c in rows:
        near = sorted((bin(int(h, 16) ^ int(h2, 16)).count("1"), j) for j, k2, h2, c2 in rows if j != i and k2 == k and c2 != c)
        want |= {(i, j, d) for d, j in [x for x in near if x[0] <= 8][:4]}
    assert got == want


def test_exact_links_of_one_hot_file_stay_linear(spark):
    rows = [(i, "selfie", "hot" if i % 3 == 0 else f"u{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "submission_id bigint, kind string, content_hash string")
    out = N.asset_links_exact(df, 15).collect()
    assert len(out) == 100 * 15 and {r.n_others for r in out} == {99}
    edges = G.graph_asset_edges(df.withColumn("phash", F.lit(""))).collect()
    assert len(edges) == 99 and {e.members for e in edges} == {100}


def test_siblings_of_a_hot_file(spark):
    rows = [(i, "selfie", "hot", f"n{i % 40}") for i in range(80)] + [(100, "selfie", "x", "solo")]
    h = spark.createDataFrame(rows, "submission_id bigint, kind string, content_hash string, claimed_name string")
    got = {r.submission_id: r for r in N.ring_siblings(h.drop("claimed_name"), h.select("submission_id", "claimed_name")).collect()}
    assert set(got) == set(range(80)) and got[0].shared_selfie_with == 79 and got[0].n_other_names == 40


@pytest.mark.parametrize("chunk", [100000, 3])
def test_sessionise_with_reset_equals_a_plain_loop(spark, chunk):
    r = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"s{i % 7}", f"{i:05d}", r.randint(5, 70)) for i in range(300)]
    got = {(x.subject, x.section): x.session for x in aalto_sessionise(spark.createDataFrame(rows, "subject string, section string, n_keys bigint"), 110, chunk).collect()}
    want, by = {}, defaultdict(list)
    for s, sec, n in sorted(rows):
        by[s].append((sec, n))
    for s, items in by.items():
        have, session, open_ = 0, 0, []
        for sec, n in items:
            open_.append(sec)
            have += n
            if have >= 110:
                want.update({(s, x): session for x in open_})
                have, session, open_ = 0, session + 1, []
    assert got == want


def test_one_vs_control_never_copies_the_control(spark):
    rows = [("a" if i % 2 else "b", (i * 7 % 50) / 50, 1) for i in range(60)] + [(None, (i * 3 % 40) / 40, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    got = {r.g: r.auc_vs_control for r in M.one_vs_control(df, "g", "score", "y", []).collect()}
    neg = [s for g, s, y in rows if y == 0]
    for k in ("a", "b"):
        pos = [s for g, s, y in rows if g == k]
        assert got[k] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_plans_hold_no_cartesian_product(spark):
    for df in (N.face_links(frame(spark, vectors()), 0.8), N.asset_links_near(spark.createDataFrame(hash_rows(), "submission_id bigint, kind string, phash string, content_hash string"))):
        assert "CartesianProduct" not in df._jdf.queryExecution().toString()


def test_face_links_with_a_wrong_dimension_and_a_doubled_submission(spark):
    rows = [(1, [1.0, 0.0, 0.1], "a"), (1, [1.0, 0.0, 0.11], "a"), (2, [1.0, 0.0, 0.1], "b"), (3, [1.0, 0.0], "c"), (4, [1.0, 0.01], "d"), (5, [0.0, 1.0, 0.0], "e")]
    emb = spark.createDataFrame([(i, v, n, "m") for i, v, n in rows], "submission_id bigint, vector array<double>, claimed_name string, merchant_id string")
    got = sorted((r.submission_id, r.rank, r.other_id) for r in N.face_links(emb, 0.9).collect())
    assert got == [(1, 1, 2), (2, 1, 1), (3, 1, 4), (4, 1, 3)]


# --- pivot blocks, one pass, score counts -------------------------------------------------
def clustered(n=900, seed=9):
    """Twelve tight identities of 24 dimensions, with text ids."""
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, 24))
    return [(f"s{i:05d}", [float(x) for x in centres[i % 12] + g.normal(scale=0.1, size=24)]) for i in range(n)] + [("short", [1.0, 2.0]), ("short2", [1.0, 2.1])]


def unit(rows):
    x = np.array([np.float32(v) for _, v in rows if len(v) == 24], np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reps_of(spark, rows):
    return spark.createDataFrame(rows, "rep string, vector array<float>")


def test_pivot_blocks_skip_pairs_without_loss(spark):
    rows = clustered()
    reps = reps_of(spark, rows)
    x = unit(rows)
    s = np.round(x @ x.T, 12)
    want = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)))} | {("short", "short2")}
    blocked, pairs = V.pivot_blocks(reps, 0.9, 40)
    blocks = blocked.select("b").distinct().count()
    assert blocks >= 24 and pairs.count() < 0.35 * blocks * (blocks + 1) / 2
    assert {(r.a, r.b) for r in V.similar_pairs(reps, 0.9, 40).collect()} == want
    assert V.pivot_blocks(reps, -1.0, 40)[1].count() == (blocks - 1) * blocks // 2 + 1  # nothing can be skipped at -1


def test_one_pass_gives_links_and_forest(spark):
    rows = clustered(300)
    reps = reps_of(spark, rows)
    found = V.scan_pairs(reps, 0.9, top=3, links=True, every=True, block_rows=30).collect()
    x = unit(rows)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    name = [r[0] for r in rows[:300]]
    top = defaultdict(list)
    for r in found:
        if r.kind == "top":
            top[r.a].append((-r.similarity, r.b))
    for i in range(300):
        want = sorted((-s[i, j], name[j]) for j in range(300) if s[i, j] >= 0.9)[:3]
        assert [b for _, b in sorted(top[name[i]])[:3]] == [b for _, b in want]

    def roots(kind):
        up = {}

        def find(v):
            while up.setdefault(v, v) != v:
                v = up[v]
            return v

        for r in found:
            if r.kind == kind:
                a, b = find(r.a), find(r.b)
                up[max(a, b)] = min(a, b)
        return {v: find(v) for v in up}

    assert roots("link") == roots("pair") and sum(r.kind == "link" for r in found) < sum(r.kind == "pair" for r in found)


def test_score_counts_are_exact(spark):
    rows = clustered(260)[:260]
    x = unit(rows)
    s = np.round((x @ x.T)[np.triu_indices(260, 1)], 12)
    counts = V.ScoreCounts(reps_of(spark, rows), 50)
    assert counts.pairs == len(s) and counts.mean == pytest.approx(s.mean())
    for p, v in counts.percentiles([0.0, 0.05, 0.5, 0.99, 0.9999, 1.0]).items():
        assert v == pytest.approx(np.quantile(s, p), abs=2e-12)
    for t in (-1.0, 0.5, 0.9637, 0.8169):
        assert counts.at_least(t) == (s >= t).sum()


def test_approximate_links_reach_the_stated_recall(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(1500, 32))
    y = x[:700] + g.normal(scale=0.55, size=(700, 32))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, y]))]
    reps = spark.createDataFrame(rows, "rep bigint, vector array<double>")
    exact = {(r.a, r.b) for r in V.similar_pairs(reps, 0.8).collect()}
    for recall in (0.7, 0.95):
        approx = {(r.a, r.b) for r in V.approx_pairs(reps, 0.8, recall, bits=10, block_rows=64).collect()}
        assert approx <= exact and len(exact) > 400 and len(approx) >= recall * len(exact)


def test_pair_kinds_equal_full_pairs(spark):
    """1, 2 and 3 share a file and 2-3 are alike: exact, though the star lists 1-2 and 1-3 only."""
    hashes = [(1, "c1", "p1"), (2, "c1", "p1"), (3, "c1", "p1"), (4, "c4", "p4"), (5, "c5", "p4"), (6, "c6", "p4"), (7, "c7", "p7"), (5, "c9", "p9"), (6, "c9", "p9")]
    h = spark.createDataFrame([(i, "selfie", c, p) for i, c, p in hashes], "submission_id bigint, kind string, content_hash string, phash string")
    faces = spark.createDataFrame([(2, 3), (1, 7), (6, 4), (5, 6)], "source bigint, target bigint").selectExpr("source", "target", "'face' AS kind", "0.9D AS weight", "true AS name_differs")
    got = {(r.source, r.target): r.kind for r in G.strongest_edges(G.graph_asset_edges(h), faces, h).collect()}
    assert got == {(1, 2): "asset_exact", (1, 3): "asset_exact", (2, 3): "asset_exact", (1, 7): "face", (4, 6): "face", (4, 5): "asset_near", (5, 6): "asset_exact"}


@pytest.mark.parametrize("bits", [3, 8, 11])
def test_unequal_radii_cover_every_pair(bits):
    radii = N._radii(bits, 4)
    assert sum(r + 1 for r in radii) == bits + 1 or bits < 4
    assert sum(len(N._ball(r)) for r in N._radii(8, 4)) == 188
