"""op6: code units as symbols, perplexities from grams joined with the count tables."""
import collections
import math
import random

import numpy as np
import pytest
from pyspark import SparkContext

from fraudloom.llm import quality_kn

FOLDER = "/root/testdata/sf0.001"


def code_units(text):
    return np.frombuffer((text or "").encode("utf-16-le"), "<u2").tolist()


def log_probability(texts):
    """The model of order 4 straight from its definition: text -> log probability of its code units."""
    grams = lambda t: zip(*[([10] * 3 + code_units(t))[i:] for i in range(4)])
    tables = [collections.Counter(g for t in texts for g in grams(t))]
    for _ in range(3):
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

    def p(g):
        if not g:
            return 1 / 65536
        table, cut, total, freed = rules[len(g) - 1]
        if not total[g[:-1]]:
            return p(g[1:])
        c = table[g]
        return ((c - cut[min(c, 3) - 1] if c else 0) + freed[g[:-1]] * p(g[1:])) / total[g[:-1]]

    return lambda t: sum(math.log(p(g)) for g in grams(t))


def test_perplexity_is_that_of_code_units_and_no_model_is_broadcast(spark, monkeypatch):
    known = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(30).collect() if r.text]
    known += ["краткий текст о погоде", "短い文章です", "smile \U0001f600 and \U0001f601 \U0001f600", "x"]
    other = ["кркатий тстек", "\U0001f602\U0001f600", "文章短い", "an unseen text, but plain", "\x00￿", "", None]
    rows = [(i, t, "en") for i, t in enumerate(known + other)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(len(known))], "doc_id bigint, quality int")
    monkeypatch.setattr(SparkContext, "broadcast", lambda *_: pytest.fail("the model is no broadcast variable"))
    got = {r.doc_id: r.perplexity for r in quality_kn.quality_table(df, labels).collect()}
    logp = log_probability(known)
    mean = -sum(map(logp, known)) / sum(len(code_units(t)) for t in known)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if t:
            assert got[i] == pytest.approx(math.exp((64 * mean - logp(t)) / (64 + len(code_units(t)))), rel=1e-5)
        else:
            assert got[i] is None


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрстуфхцчшыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "天地人山川田日月火水木金土王上下中大小"])
def test_scrambled_text_of_any_script_is_rejected(spark, letters):
    r = random.Random(1)
    words = ["".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(120)]
    good = [" ".join(r.choice(words) for _ in range(80)) for _ in range(600)]
    fresh, junk = good[500:], ["".join(r.sample(t, len(t))) for t in good[500:]]
    rows = [(i, t, "xx") for i, t in enumerate(good + junk)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(500)], "doc_id bigint, quality int")
    kept = {x.doc_id for x in quality_kn.keep_good(df, labels).collect()}
    assert sum(i in kept for i in range(500, 500 + len(fresh))) >= 95
    assert not any(i in kept for i in range(600, 600 + len(junk)))


def test_texts_like_the_trusted_ones_stay_where_few_are_trusted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_kn.quality_table(docs, labels.filter("crc32(cast(doc_id as string)) % 2 = 0")).join(labels, "doc_id")
    unseen = [r.keep for r in rows.filter("crc32(cast(doc_id as string)) % 2 = 1 AND quality = 1").collect()]
    assert len(unseen) > 100 and sum(unseen) / len(unseen) > 0.97


def test_code_units_of_broken_texts_stay_their_own():
    texts = [b"a\xc3", b"\xa9b", b"", "é\U0001f600".encode(), b"\xff", b"\xed\xa0\x80"]
    for some in (texts, texts[2:4], texts[5:], [b""], []):
        off = np.cumsum([0] + [len(t) for t in some])
        seq, at = quality_kn._code_units(np.frombuffer(b"".join(some), np.uint8), off)
        assert len(at) == len(some) + 1 and at[-1] == len(seq)
        if some == texts[2:4]:
            assert seq.tolist() == [0xE9, 0xD83D, 0xDE00] and at.tolist() == [0, 0, 3]
    seq, at = quality_kn._code_units(np.frombuffer(b"a\xc3\xa9b", np.uint8), np.array([0, 2, 4]))
    assert seq.tolist() == [97, 0xFFFD, 0xFFFD, 98] and at.tolist() == [0, 2, 4]
