"""The training-data operators against SQL or brute force, and their edge cases."""
import collections
import hashlib
import math
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from fraudloom.llm import ann, decontaminate, jaccard_join, license_scan, mix_sources, quality_kn, queries, shard, suffix_tree_lm, token_counts, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
ODD = [(1, "alpha beta gamma delta", "en", "s", 1), (1, "alpha beta gamma delta", "en", "s", 1), (2, None, None, None, None), (None, "", "xx", "s", 0), (3, "A", "en", "t", 1), (None, "alpha beta gamma delta", None, None, 1), (4, LONG, "en", "t", 5), (5, " \t\n ", "en", "u", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    out = compare(spark, duck(FOLDER), name, queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert out.startswith("ok"), out


def test_token_counts(spark, docs, odd, none, tmp_path):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    cache = str(tmp_path / "cache")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, cache=cache).collect()}
    for r in docs.collect():
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes) == (len(sp.encode(r.text or "")), len((r.text or "").encode()))
    before = token_counts.stored(spark, cache).count()
    assert before == docs.select("text").distinct().count()
    assert token_counts.token_counts(docs, cache=cache).count() == docs.count() and token_counts.stored(spark, cache).count() == before
    assert token_counts.token_counts(odd).count() == len(ODD) and token_counts.token_counts(none).count() == 0
    count = token_counts.counter("piece_bpe_32k.model")
    for t in [*token_counts.PROBES, "a▁ b", "x  ", "  ", "▁"]:
        assert count([t]) == [len(sp.encode(t))]


def brute_components(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_components(spark, docs, odd, none):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(120)]
    near = []
    for i in range(60):  # one crowd around the threshold
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 6)):
            w[p] = f"z{rng.integers(1000)}"
        near.append((10_000 + i, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near + [(a, b) for a, b, *_ in ODD[:-2]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, num, den in ((3, 90, 100), (5, 8, 10)):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, (num, den)).collect()]
        assert key(got) == key(brute_components(rows, k, num, den))
    assert jaccard_join.jaccard_components(none, 3, (90, 100)).count() == 0
    kept = jaccard_join.one_per_component(odd)
    assert kept.columns == odd.columns and kept.count() == 6  # one of three copies, three empty, "A", LONG: all but two rows


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x Alpha, beta gamma y"), (2, "beta z alpha gamma"), (3, None), (4, "alpha beta")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "alpha beta GAMMA"), (8, ""), (None, "alpha beta"), (9, None)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].items_sha256) == (5, 3, 1, hashlib.sha256(b"7").hexdigest())
    assert (got[4].n_hit, got[4].n_items, got[4].contaminated) == (2, 0, True)
    assert not got[2].contaminated and got[3].n_words == 0 and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    parts = decontaminate.prepare(docs, bench.filter("item_id = 7"), ["doc_id"])
    rows = {r.row: r.doc_id for r in parts[2].filter("tid = -1").collect()}
    assert {rows[r.row] for r in decontaminate.proximity_hits(*parts, size=10, span=4).collect()} == {1, 2}
    assert {rows[r.row] for r in decontaminate.proximity_hits(*parts, size=10, span=3).collect()} == {1}
    assert decontaminate.contamination(docs.filter("false"), bench).count() == 0
    assert decontaminate.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_shards(spark, docs, odd, none):
    copies = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100_000 + i, "the same text for all") for i in range(3000)] + [(5, "again")] * 50, "doc_id bigint, text string"))
    rows = shard.shard_table(copies).collect()
    assert len(rows) == copies.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id in texts and r.doc_id != 5)
    out = shard.shard_documents(odd.withColumnRenamed("n_chars", "slot"))
    assert out.count() == len(ODD) and shard.shard_table(none).count() == 0


def water(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    t, full = {}, set()
    while True:
        left, ws = sum(sizes.values()) - sum(cap * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else left * w[s] / ws for s in names}
        more = {s for s in names if t[s] > cap * sizes[s] + 1e-9}
        if not more:
            return t
        full |= more


def test_mix(spark, docs, odd, none):
    small = docs.unionByName(spark.createDataFrame([(9_000_000, "tiny source here", "en", "zz", 1), (9_000_001, "no source", "en", None, 1)], SCHEMA))
    rows = small.join(mix_sources.mix_table(small), "doc_id").collect()
    sizes, taken, big = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        big[r.source] = max(big[r.source], r.size)
    goal = water(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    assert all(abs(taken[s] - goal[s]) <= big[s] for s in sizes)
    assert sorted(mix_sources.mix_table(small).collect()) == sorted(mix_sources.mix_table(small.repartition(3)).collect())
    assert mix_sources.mix_table(odd).count() == len(ODD) and mix_sources.mix_table(none).count() == 0
    assert mix_sources.mix_documents(odd).columns == odd.columns


def test_suffix_tree(spark, docs, odd, none):
    rows = {r.doc_id: r for r in suffix_tree_lm.score_documents(docs).collect()}
    text = dict(docs.select("doc_id", "text").collect())
    seq = {d: [*(t or "").encode().lower().split(), None] for d, t in text.items()}
    train = [s for d, s in seq.items() if zlib.crc32(str(d).encode()) % 10]
    one, two, three = (collections.Counter(tuple(s[i : i + n]) for s in train for i in range(len(s) - n + 1)) for n in (1, 2, 3))
    total, vocab = sum(one.values()), len(one)
    root = lambda w: (one.get((w,), 0) + 0.1) / (total + 0.1 * (vocab + 1))
    tree = {}

    def p(ctx, w):
        if not ctx:
            return root(w)
        if ctx not in tree:
            return p(ctx[1:], w)
        own, back = tree[ctx]
        return own.get(w, 0.0) + back * p(ctx[1:], w)

    for counts, parents in ((two, one), (three, two)):
        by = collections.defaultdict(dict)
        for g, c in counts.items():
            if c >= suffix_tree_lm.MIN_COUNT and c > suffix_tree_lm.RATIO * parents[g[:-1]] * p(g[1:-1], g[-1]):
                by[g[:-1]][g[-1]] = c
        new = {}
        for ctx, nexts in by.items():
            n = parents[ctx]
            own = {w: (c - suffix_tree_lm.DISCOUNT) / n for w, c in nexts.items()}
            back = 1 - sum(own.values())
            gain = sum(c * math.log((own[w] + back * p(ctx[1:], w)) / p(ctx[1:], w)) for w, c in nexts.items()) + (n - sum(nexts.values())) * math.log(back)
            if gain > suffix_tree_lm.GAIN:
                new[ctx] = own, back
        tree.update(new)
    for d, s in seq.items():
        want = sum(math.log10(p(tuple(s[max(0, i - 2) : i]), w)) for i, w in enumerate(s))
        base = sum(math.log10(root(w)) for w in s)
        assert (rows[d].score, rows[d].base_score) == (pytest.approx(want, rel=1e-6), pytest.approx(base, rel=1e-9))
        assert (rows[d].n_tokens, rows[d].n_known, rows[d].train_tokens) == (len(s), sum((w,) in one for w in s), total)
    assert suffix_tree_lm.score_documents(odd).count() == len(ODD) and suffix_tree_lm.score_documents(none).count() == 0


def test_nearest(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    rows += [(1_000_000 + i, rows[0][1]) for i in range(40)] + [(2_000_000, None), (2_000_050, [0.0] * 64), (2_000_100, [float("nan")] * 64), (2_000_150, []), (None, rows[1][1]), (2_000_200, [1.0, 2.0]), (2_000_201, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(map(math.isfinite, v)) and any(v)]
    hit = total = 0
    for q, x in good:
        if q % 50 == 0:
            s = sorted(((float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), -i) for i, y in good if i != q and len(y) == len(x)), reverse=True)[:5]
            total += len(s)
            hit += sum(v >= s[-1][0] - 1e-9 for _, v in got[q])
            assert [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
    assert hit / total >= 0.9 and [i for i, _ in got[2_000_200]] == [2_000_201]
    assert not got[2_000_050] and ann.nearest(df.filter("false")).count() == 0


def test_quality(spark, docs, odd, none, labels):
    lab = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality_kn.quality_table(docs, lab).join(lab, "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.95
    logp, mean = quality_kn.train(docs)
    assert np.exp(logp.reshape(-1, quality_kn.K).astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-4) and mean > 0
    assert quality_kn.keep_good(odd, labels).columns == odd.columns
    assert quality_kn.quality_table(odd, labels).count() == len(ODD)
    assert quality_kn.quality_table(odd, labels.filter("false")).filter("keep").count() == len(ODD)
    assert quality_kn.quality_table(none, labels).count() == 0


def test_quality_one_trusted_text(spark):
    big = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    good = [(r.doc_id, r.text, r.lang) for r in d.join(quality_kn.trusted_ids(lab), d.doc_id == F.col("__trusted"), "left_semi").orderBy("doc_id").collect()]
    few = {i for i, _, lang in good if lang == "en"}
    few = set(sorted(few)[:40])
    df = spark.createDataFrame([(i, t, "zz" if i in few else lang, "s", 1) for i, t, lang in good], SCHEMA)
    trusted = [(i, 1, 0) for i, _, _ in good if i not in few or i == min(few)]
    rows = quality_kn.quality_table(df, spark.createDataFrame(trusted, "doc_id bigint, quality int, toxic int")).filter("lang = 'zz'").collect()
    assert len(rows) >= 40 and sum(r.keep for r in rows) >= 0.9 * len(rows)
    assert all(r.keep for r in rows if r.doc_id == min(few))


def test_toxicity(spark, odd, none, labels):
    big = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.toxicity(d, lab).join(lab, "doc_id").filter("held_out").collect()
    assert sum((r.predicted == 1) == (r.toxic == 1) for r in rows) / len(rows) > 0.9
    lex = toxicity.Lexicon({"moronic": 2.0}, {"idio": 3.0})
    assert lex.meet("moronic") == (2.0, 0.0) and lex.meet("morronic") == (0.0, 2.0) and lex.meet("maronik") == (0.0, 0.0) and lex.meet("idiots") == (3.0, 0.0)
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out) and toxicity.toxicity(none, labels).count() == 0


def test_toxicity_long_words():
    lex = toxicity.Lexicon({"moronic": 2.0}, {"idio": 3.0})
    texts = ["moronic" + "!" * 400, "idi" + "o" * 400, "moronic plain", "x" * 5000 + ' he said "moronic" there', "y" * 5000 + " he said moronic there", "a" + "!" * 200_000 + "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = next(toxicity._hits(types.SimpleNamespace(value=lex), ["text"])(iter([batch]))).column(1).to_pylist()
    assert got == pytest.approx([math.log1p(x) for x in (2, 3, 2, 2 * toxicity.QUOTED, 2 * toxicity.QUOTED, 0)])


def test_license(spark, odd, none):
    known = license_scan.templates(spark)
    df = spark.createDataFrame([(1, "x " * 33 + "Released under the MIT License. " + LONG), (2, "Released under an MIT License"), (3, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.license) for r in license_scan.scan(df, known).collect()] == [(1, "mit")]
    assert license_scan.scan(odd, known).count() == 0 and license_scan.scan(none, known).count() == 0


def test_license_full_texts(spark):
    texts = license_scan.TEMPLATES
    held = ["gpl-2.0-text", "bsd-3-clause-text", "isc-text", "unlicense-text", "mpl-2.0-text", "lgpl-2.1-header", "agpl-3.0-header", "cc-by-4.0", "cc-by-sa-4.0-text", "cc0-1.0"]
    df = spark.createDataFrame([(i, "x " * (7 * i) + texts[n] + " y" * 40) for i, n in enumerate(held)], "doc_id bigint, text string")
    found = {(r.doc_id, r.license) for r in license_scan.scan(df, license_scan.templates(spark)).collect()}
    assert found >= set(enumerate(held)) and (7, "cc-by-sa-4.0") not in found


def test_license_short_template(spark):
    known = license_scan.templates(spark, {"reserved": "All rights reserved.", "mit": "Released under the MIT License."})
    df = spark.createDataFrame([(1, "x " * 10 + "All rights reserved. " + "y " * 10), (2, "all rights reserved"), (3, "all rights were reserved " * 5), (4, "z " * 9 + "released under the MIT License")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.license) for r in license_scan.scan(df, known).collect()) == [(1, "reserved"), (2, "reserved"), (4, "mit")]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = P.run(spark, FOLDER)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    known = {(r.doc_id, r.text) for r in docs.collect()}
    assert rows and {(r.doc_id, r.text) for r in rows} <= known
    bench = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", r.text.translate({c: c + 32 for c in range(65, 91)})) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {" ".join(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9))}
    for r in rows:
        w = " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", r.text.translate({c: c + 32 for c in range(65, 91)})))
        assert not any(f" {x} " in f" {w} " for x in windows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
