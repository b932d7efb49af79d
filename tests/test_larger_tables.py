"""Faults that showed on larger or repeated tables only."""
from __future__ import annotations

import random

import pytest

from fraudloom.operators import linkage as N
from fraudloom.plans import catalogue


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.mark.parametrize("bits", [16, 20])
def test_wide_hash_bounds_equal_brute_force(spark, bits):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    rows = {("a" if i % 3 else "b", signed(base[i % 40] ^ sum(1 << r.randrange(64) for _ in range(i % 22)) & (1 << 64) - 1)) for i in range(1500)}
    want = sorted((k, a, b, bin((a ^ b) & (1 << 64) - 1).count("1")) for k, a in rows for j, b in rows if k == j and a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= bits)
    df = spark.createDataFrame(sorted(rows), "kind string, h bigint")
    assert sorted(map(tuple, N.near_hash_pairs(df, bits).collect())) == want
    assert sorted(map(tuple, N.all_hash_pairs(df, bits, 1 << 14).collect())) == want  # in other blocks


def test_copies_of_a_vector_are_near_vectors(spark, tmp_path):
    v = lambda s: [s if i % 3 else -s for i in range(64)]
    spark.createDataFrame([(1, v(1.0), 0), (2, v(-1.0), 0), (7, v(1.0), 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["jn6_near_vector_fingerprints"](spark, str(tmp_path)).collect()] == [(1, 7, 0)]


def test_a_kind_without_edges_counts_zero_pairs(spark, tmp_path):
    rows = [(i, f"text {i // 2}", "en", "s", 10) for i in range(6)]  # every text twice, so every image hash is barred
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["jn9_asset_pair_counts"](spark, str(tmp_path)).collect()}
    assert got == {("asset_exact", 3), ("asset_near", 0)}


def test_out_of_fold_reads_its_input_once(spark):
    from pyspark.sql import functions as F

    from fraudloom.operators import models as D

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(400).selectExpr("id", "CAST(id % 5 AS int) AS fold", "CAST(id * 37 % 11 < 5 AS int) AS y", "CAST(id * 53 % 17 AS double) AS a")
    p = D.out_of_fold(df.mapInArrow(count, df.schema), ["a"], 5).select("p")
    assert p.filter(F.col("p").isNull()).count() == 0
    assert read.value == 400  # not once an iteration


def test_cut_points_are_found_once(spark):
    from fraudloom.operators import ordered as O

    df = spark.range(1000).selectExpr("id % 2 AS g", "hash(id) AS k")
    out = O.row_numbers(df, ["g"], "k", [])
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()  # branches that sketch on their own may cut differently
    assert sorted(r.rn for r in out.filter("g = 0").collect()) == list(range(1, 501))


def test_small_generators_are_recognised(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from fraudloom.operators import models as D

    g = np.random.default_rng(2)
    rows = [("common" if i % 20 else "rare", float(g.normal(0.0 if i % 20 else 0.5)), float(g.normal())) for i in range(2000)]
    df = spark.createDataFrame(rows, "generator string, a double, b double")
    hit = D.train_fingerprint(df, ["a", "b"]).transform(df).filter("generator = 'rare'").agg(F.avg((F.col("prediction") == F.col("g")).cast("int"))).first()[0]
    assert hit > 0.4  # without equal weights hardly any


def test_identity_numbers_between_ascii_words(spark):
    from pyspark.sql import functions as F

    from fraudloom.functions import identity as I

    find = lambda s, **kw: spark.range(1).select(I.find_fields(F.lit(s), **kw).alias("f")).first().f.aadhaar
    assert find("ÉLAND B023 12S4 5608", ascii_words=True) is None  # LAND B023 12S4 is the first group, as in the SQL
    assert find("ÉLAND B023 12S4 5608") == "802312545608"


def test_selfie_score_of_large_event_values(spark, tmp_path):
    rows = [(1, 1, 700.0, '{"k": 90}'), (2, 1, 2000.0, '{"k": 0}')]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.score, r.confidence) for r in catalogue.QUERIES["sc9_selfie_score"](spark, str(tmp_path)).collect()}
    assert got[1] == pytest.approx((1.21, 0.7)) and got[2] == pytest.approx((2.48, -1.05))  # as its SQL has it, unclipped


def test_approximate_pairs_store_no_vectors(spark, monkeypatch):
    import numpy as np

    from fraudloom.operators import similarity as V

    stored, cut = [], V.cut
    monkeypatch.setattr(V, "cut", lambda df: stored.append(df.columns) or cut(df))
    x = np.random.default_rng(0).normal(size=(60, 8))
    reps = spark.createDataFrame([(i, [float(v) for v in x[i // 2] + 0.01 * (i % 2)]) for i in range(60)], "rep bigint, vector array<float>")
    got = {(r.a, r.b) for r in V.approx_pairs(reps, 0.99, block_rows=8).collect()}
    assert sum((i, i + 1) in got for i in range(0, 60, 2)) >= 27
    assert not any("vector" in c for c in stored)  # a table of hyperplanes sends a vector once
