"""The quality model against a plain Kneser-Ney, the toxicity hits against plain edit distance."""
import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from fraudloom.llm import ann, mix_sources, quality_kn, toxicity

FOLDER = "/root/testdata/sf0.001"


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney of order 4, straight from its definition."""
    order, k, cls = quality_kn.ORDER, quality_kn.K, quality_kn.CLASS
    full = collections.Counter()
    for t in texts:
        s = [int(cls[10])] * (order - 1) + cls[np.frombuffer((t or "").encode(), np.uint8)].tolist()
        full.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    tables = [full]
    for _ in range(order - 1):  # continuation counts: in how many ways a gram is led into
        tables.insert(0, collections.Counter(g[1:] for g in tables[0]))
    rules = []
    for table in tables:
        n = [sum(c == i for c in table.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        cut = [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, 0.1 * i), 0.95 * i) for i in (1, 2, 3)]
        total, freed = collections.Counter(), collections.Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            freed[g[:-1]] += cut[min(c, 3) - 1]
        rules.append((table, cut, total, freed))

    def p(ctx, w):
        if ctx is None:
            return 1.0 / k
        table, cut, total, freed = rules[len(ctx)]
        lower = p(ctx[1:] if ctx else None, w)
        if not total[ctx]:
            return lower
        c = table[ctx + (w,)]
        return (c - cut[min(c, 3) - 1] if c else 0.0) / total[ctx] + freed[ctx] / total[ctx] * lower

    return p, full


def test_quality_model_is_modified_kneser_ney(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    texts = [r.text for r in docs.collect()] + [None, "", "Ein kurzer Text.", "краткий текст"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    logp, mean = quality_kn.train(df)
    p, full = plain_kneser_ney(texts)
    k = quality_kn.K
    number = lambda g: ((g[0] * k + g[1]) * k + g[2]) * k + g[3]
    r = random.Random(0)
    some = r.sample(sorted(full), 300) + [tuple(r.randrange(k) for _ in range(4)) for _ in range(100)]
    for g in some:
        assert float(logp[number(g)]) == pytest.approx(math.log(p(g[:3], g[3])), abs=2e-5)
    loss = -sum(c * math.log(p(g[:3], g[3])) for g, c in full.items()) / sum(full.values())
    assert mean == pytest.approx(loss, rel=1e-5)


def test_empty_texts_stay_by_rule(spark):
    good = [(i, f"plain words number {i} in a row of text that is long enough", "en") for i in range(300)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "", None), (1003, None, "qq")]
    df = spark.createDataFrame(good + odd, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id bigint, quality int")
    rows = {r.doc_id: r for r in quality_kn.quality_table(df, labels).collect()}
    assert all(rows[i].keep and rows[i].perplexity is None for i, _, _ in odd)
    kept = {r.doc_id for r in quality_kn.keep_good(df, labels).collect()}
    assert {i for i, _, _ in odd} <= kept


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_lexicon_meets_what_edit_distance_says():
    r = random.Random(5)
    terms = {w: 1.0 + i for i, w in enumerate(["moronic", "stupid", "pathetic", "worthless", "disgusting"])}
    lex = toxicity.Lexicon(terms, {})
    letters = "abcdefghijklmnopqrstuvwxyz"

    def change(w):
        at = r.randrange(len(w))
        return r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]])

    words = [change(w) for w in terms for _ in range(60)] + [change(change(w)) for w in terms for _ in range(40)] + ["".join(r.choice(letters) for _ in range(8)) for _ in range(60)]
    for w in words:
        exact, near = lex.meet(w)
        if w in terms:
            assert exact == terms[w]
            continue
        want = max((v for t, v in terms.items() if edits(w, t) <= 1), default=0.0)
        assert (exact, near) == (0.0, want), w


def test_bins_of_any_quality_are_small():
    u = (np.arange(1_000_000) + 0.5) / 1_000_000
    for quality in (1e-6, 0.05, 0.3, 1.0):
        key = -np.log(u) / quality
        _, n = np.unique(np.floor(np.log2(key) * mix_sources.BINS_A_DOUBLING), return_counts=True)
        assert n.max() < 0.01 * len(u)


def test_recall_follows_the_rows(spark):
    """With 60,000 random vectors and narrow buckets the tuned search still finds what it promises."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60_000, 32))
    df = spark.createDataFrame([(f"{i:032x}", i % 50 == 0, v.astype("<f8").tobytes()) for i, v in enumerate(x[:12_000])], "cid string, query boolean, vector binary")
    axes, tables, probes, got = ann.tune(df, 60_000, 32, 5)
    assert got >= ann.RECALL and np.prod([2 * a for a in axes]) > 100
    unit = x[:12_000] / np.linalg.norm(x[:12_000], axis=1, keepdims=True)
    asks = np.arange(25, 12_000, 60)
    s = unit[asks] @ unit.T
    s[np.arange(len(asks)), asks] = -2
    true = np.argsort(-s, axis=1)[:, :5]
    hit = np.zeros(true.shape, bool)
    for t in range(tables):
        own, look = ann.bucket_probes(unit, t, axes, 1)[:, 0], ann.bucket_probes(unit[asks], t, axes, probes)
        hit |= (own[true][:, :, None] == look[:, None, :]).any(axis=2)
    assert hit.mean() >= 0.9
