"""Operators 11 to 13 against brute force and SQL, and their edge cases."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from fraudloom.llm import fill_in_middle, importance, simhash

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, fp string, row int, score double, __h1 int"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
ODD = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (None, ""), (3, "A"), (None, "Alpha\tbeta  gamma\ndelta"), (4, LONG), (5, " \t\n "), (6, "straße <P> über 漢字"), (7, "é漢𝄞" * 900), (8, "x" * 70_000), (9, "one two <M")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "f", 1, 0.5, 3) for r in ODD], SCHEMA)


def brute_print(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_simhash(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    fp = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= radius).tolist():
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_simhash(spark, docs, odd):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(300)]
    near = []
    for i in range(150):
        w = list(base)
        for p in rng.integers(0, 300, rng.integers(0, 8)):
            w[p] = f"z{rng.integers(1000)}"
        near.append((10_000 + i, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near + ODD
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_simhash(rows)
    assert key(map(tuple, got.collect())) == key(want)
    assert len({c for _, _, c in want}) < len(want) - 50  # links of different fingerprints occur
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(odd.filter("false")).count() == 0


@pytest.mark.parametrize("blocks,crowd", [(5, 4096), (5, 40), (6, 4096), (7, 100), (8, 4096)])
def test_pivot_tables_lose_no_component(spark, blocks, crowd):
    rng = np.random.default_rng(blocks)
    heads = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(heads.tolist())
    for h in heads.tolist() + [heads.tolist()[0]] * 400:  # one dense crowd
        for _ in range(4):
            fps.add(h ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    df = spark.createDataFrame([(int(np.int64(np.uint64(x))) if x < 2**63 else x - 2**64,) for x in fps], "fp bigint")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.similar(df, 4, blocks, crowd).collect()]
    assert all(bin(u ^ v).count("1") <= 4 for u, v in links)

    def roots(pairs):
        up = {x: x for x in fps}

        def find(v):
            while up[v] != v:
                v = up[v]
            return v

        for u, v in pairs:
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
        return {x: find(x) for x in fps}

    full = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 4).tolist()]
    assert roots(links) == roots(full) and len(links) < len(full)


def test_coordinates_are_a_lower_bound():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**64, 200, dtype=np.uint64)
    parts = simhash.parts_of(fp, 5)
    full = parts.sum(axis=0, dtype=np.int64)
    x, y = np.triu_indices(200, 1)
    d = np.bitwise_count(fp[x] ^ fp[y])
    assert (np.abs(full[:, x] - full[:, y]).max(axis=0) <= d).all()
    assert simhash.far(x, y, full.T.astype(np.int8), 4).mean() > 0.95  # pivots do the discarding
    assert simhash.blocks_for(1000, 4) == 5 and simhash.blocks_for(15_000_000, 4) == 6 and simhash.blocks_for(10**12, 4) == 8


def brute_fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, t
    p, q = sorted((a % (n + 1), b % (n + 1)))
    if d % 100 < 20:
        return n, "spm", p, q - p, f"<S>{t[q:]}<P>{t[:p]}<M>{t[p:q]}"
    return n, "psm", p, q - p, f"<P>{t[:p]}<S>{t[q:]}<M>{t[p:q]}"


def test_fill_in_middle(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD + [(100_000 + i, LONG[i : i + 9000] + "漢é") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = fill_in_middle.fill_in_middle(df).withColumn("back", fill_in_middle.restored()).collect()
    want = collections.Counter((d, *brute_fim(d, t), t or "") for d, t in rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(odd).count() == len(ODD) and fill_in_middle.digests(odd.filter("false")).count() == 0


def test_chunks_are_shared_and_bounded():
    memo = fill_in_middle.Memo()
    passage = LONG[:60_000]
    texts = ["head " * 30 + passage, "other start" + passage, "漢" * 5000 + passage]
    for t in texts:
        buf = t.encode()
        raw = np.frombuffer(buf, np.uint8)
        borders = fill_in_middle.chunks(0, len(buf), fill_in_middle.cut_places(raw))
        assert max(np.diff(borders)) <= fill_in_middle.LONGEST and borders[-1] == len(buf)
        counts, marked = fill_in_middle.measure(buf, borders, memo)
        assert counts[-1] == len(t) and not marked
        for p in (0, 1, len(t) // 2, len(t) - 1, len(t)):
            assert fill_in_middle.locate(buf, borders, counts, p) == len(t[:p].encode())
    assert memo.met > 30  # the passage is summed up once
    small = fill_in_middle.Memo(1000)
    for i in range(50):
        small.of(b"%d" % i * 100)
    assert small.held < 2000
    for at in range(1, 3):  # a mark across a chunk border
        assert fill_in_middle.measure(b"ab<P>cd", [0, 2 + at, 7], fill_in_middle.Memo())[1]
    assert fill_in_middle.measure(b"ab<P>cd", [0, 3, 4, 5, 7], fill_in_middle.Memo())[1]


def brute_features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_importance(spark, docs, longest):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD + [(300_000 + i, "same words again and again " * 6) for i in range(60)] + [(400_000, "t " * 25)] * 30 + [(None, "t " * 25)] * 9
    bench = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()] + [None, ""]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = collections.Counter(bucket(f) for _, t in rows for f in brute_features(t, longest)[0])
    g = collections.Counter(bucket(f) for t in bench for f in brute_features(t, longest)[0])
    big_s, big_t = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    want = []
    for d, t in rows:
        f, words = brute_features(t, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    may = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {i + 1: r[:4] for i, r in enumerate(may[: len(may) // 10])}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in bench], "text string"), longest=longest).collect()
    assert key((r.doc_id, r.n_features, r.weight, r.score) for r in got) == key(r[:4] for r in want)
    assert {r["rank"]: (r.doc_id, r.n_features, r.weight, r.score) for r in got if r["rank"]} == drawn and sum(r["rank"] is not None for r in got) == len(drawn)


def test_importance_empty(spark, odd):
    bench = spark.createDataFrame([], "text string")
    assert importance.resample(odd, bench).count() == len(ODD)
    assert importance.resample(odd.filter("false"), bench).count() == 0
    ranks = [r["rank"] for r in importance.resample(odd, bench, percent=100, least_words=1).collect()]
    assert sorted(x for x in ranks if x) == list(range(1, sum(x is not None for x in ranks) + 1))
