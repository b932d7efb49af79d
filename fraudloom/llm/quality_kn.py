"""Quality filter: interpolated modified Kneser-Ney model of trusted text, cut at quantiles per language.

Symbols are UTF-16 code units, so every letter of every script is told apart, and an order-4
gram is exactly one 64-bit number: its context is the number without its last 16 bits, its
shorter form the number without its first ones.  The count tables (counts, continuation counts,
context totals, back-off weights) grow with the trusted text, lie in Spark as shards and meet by joins.

A document's perplexity comes from its grams joined with those tables.  Texts are dealt to blocks
by hash, and the distinct grams of a block stand for those of its texts; the distinct grams of
all blocks are joined, level by level, with the count tables, which gives each its probability,
and that is joined with the blocks that asked for it and summed over their texts.

A language's limits are a high and a low quantile of the perplexity of its own trusted texts
(text that repeats itself is too easy to predict); a language without trusted text uses the
quantiles over all.  With fewer than 1 / (1 - QUANTILE) = 200 trusted texts a quantile is their
extreme, so the limits are the wider of the language's own and those over all.  The model fits
the texts it learned from better than others, so the trusted texts are also scored as unseen, each
half by a model of the other, and the wider limits hold.  A short text says little: its perplexity is that of the text followed by
PRIOR symbols of average trusted text.  With no trusted text at all
nothing is rejected.  Null and empty texts have no perplexity and stay by rule.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked, cut, give_back, text_key, trimmed
from .tokens import slices

ORDER = 4
QUANTILE, MARGIN = 0.995, 1.03  # the low limit is the 1 - QUANTILE quantile over MARGIN
PRIOR = 64
SLICE = 1 << 18  # bytes looked at together: some 40 bytes of arrays each
BLOCK = 5 << 22  # bytes of text in a block, on average
HELD = 1 << 20  # grams that a task holds before it merges them


def _classes() -> np.ndarray:
    out = np.full(256, 43, np.uint8)
    out[97:123] = np.arange(26)
    out[65:91] = 26
    out[48:58] = 27
    for cls, chars in {28: " ", 29: "\n\t\r\v\f", 30: ".", 31: ",", 32: "!", 33: "?", 34: "\"'`", 35: "-_", 36: "|", 37: "%", 38: "*", 39: "&", 40: "#$@", 41: "()[]{}<>", 42: "/:;=+~^\\"}.items():
        out[[ord(c) for c in chars]] = cls
    out[0xC0:0x100] = 44
    out[0x80:0xC0] = 45 + np.arange(64) % 3
    return out


CLASS = _classes()  # the small alphabet of `train`; the query works on code units
K = 64


def _byte_classes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return CLASS[raw], off


def _code_units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 code units of texts in UTF-8, and where each text begins among them."""
    head = (raw & 0xC0) != 0x80
    try:
        if not head[off[:-1][np.diff(off) > 0]].all():
            raise UnicodeError("a text begins inside a character")
        units = raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass")
        run = np.concatenate(([0], np.cumsum(head + (raw >= 0xF0).astype(np.int64))))
        return np.frombuffer(units, "<u2"), run[off]
    except UnicodeError:  # not UTF-8: text by text, so that no text alters another
        texts = [raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-16-le") for a, b in zip(off[:-1], off[1:])]
        return np.frombuffer(b"".join(texts), "<u2"), np.concatenate(([0], np.cumsum([len(t) // 2 for t in texts], dtype=np.int64)))


UNITS = (16, _code_units, 10)  # an alphabet: bits of a symbol, texts -> symbols, the symbol before a text
CLASSES = (6, _byte_classes, CLASS[10])


def _keys(raw: np.ndarray, off: np.ndarray, alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the gram that ends at each symbol, text of each symbol, symbols of each text); a text begins after line ends."""
    bits, symbols, before = alphabet
    seq, off = symbols(raw, off)
    lens = np.diff(off)
    padded = np.insert(seq, np.repeat(off[:-1], ORDER - 1), before).astype(np.int64)
    key = padded[ORDER - 1 :].copy()
    for i in range(1, ORDER):
        key |= padded[ORDER - 1 - i : len(padded) - i] << (bits * i)
    doc = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(seq)) + (ORDER - 1) * doc
    return key[at] if len(seq) else np.zeros(0, np.int64), doc, lens


def _count(alphabet):
    """(fold, text) -> (gram, fold, c): the grams of the task in texts of each fold, merged while few."""

    def run(batches):
        held, size = {0: [], 1: []}, 0

        def merged(some):
            u, at = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
            return u, np.bincount(at, weights=np.concatenate([c for _, c in some]), minlength=len(u)).astype(np.int64)

        def rows():
            for fold, some in held.items():
                u, c = merged(some) if some else (np.zeros(0, np.int64),) * 2
                for a in range(0, len(u), 100_000):
                    z = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(u[z]), pa.array(np.full(len(u[z]), fold, np.int32)), pa.array(c[z])], names=["gram", "fold", "c"])

        for b in batches:
            for fold, some in held.items():
                for _, _, raw, off in slices(b.filter(pc.equal(b.column(0), fold)).column(1), SLICE):
                    some.append(np.unique(_keys(raw, off, alphabet)[0], return_counts=True))
                    size += len(some[-1][0])
            if size > HELD:
                held = {fold: [merged(some)] if some else [] for fold, some in held.items()}
                size = sum(len(some[0][0]) for some in held.values() if some)
                if size > HELD // 2:
                    yield from rows()
                    held, size = {0: [], 1: []}, 0
        yield from rows()

    return run


def _fold():
    """0 or 1 by the text, so that copies share a fold."""
    return F.pmod(text_key(), F.lit(2)).cast("int")


def gram_counts(texts: DataFrame, alphabet=UNITS) -> DataFrame:
    """(gram, all, half_0, half_1): how often all `texts` (text) and those of each fold hold it."""
    counted = texts.select(_fold().alias("fold"), "text").mapInArrow(trimmed(_count(alphabet)), "gram bigint, fold int, c bigint")
    halves = [F.sum(F.when(F.col("fold") == f, F.col("c")).otherwise(0)).alias(f"half_{f}") for f in (0, 1)]
    return cut(counted.groupBy("gram").agg(F.sum("c").alias("all"), *halves))


def _last(n: int, bits: int):
    """The last n symbols of a gram."""
    return F.col("gram") if n * bits >= 64 else F.col("gram").bitwiseAND(F.lit((1 << n * bits) - 1))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return [min(max(i - (i + 1) * y * b / a if a else 0.5 * i, 0.1 * i), 0.95 * i) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def levels(counts: DataFrame, bits: int = UNITS[0]) -> list[tuple[DataFrame, DataFrame]]:
    """The models of `counts` (gram, one column a model): for n = 1 to ORDER the grams seen (gram, p a model) and their contexts (ctx, back-off weight a model).

    A gram not seen has the back-off weight of its context (1 if that was not seen either)
    times the probability of its last n - 1 symbols; below one symbol all are equally likely.
    """
    names = counts.columns[1:]
    tables = [counts]
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols in front
        tables.insert(0, cut(tables[0].groupBy(_last(n, bits).alias("gram")).agg(*[F.count(F.when(F.col(m) > 0, 1)).alias(m) for m in names])))
    out: list[tuple[DataFrame, DataFrame]] = []
    for n, table in enumerate(tables, start=1):
        found = table.agg(*[F.count(F.when(F.col(m) == i, 1)) for m in names for i in (1, 2, 3, 4)]).first()
        d = {m: _discounts(*found[4 * i : 4 * i + 4]) for i, m in enumerate(names)}
        table = table.withColumn("ctx", F.shiftrightunsigned("gram", bits))
        sums = []
        for m in names:  # what is freed is added up as counts, in no order of doubles
            c, total = F.col(m), F.sum(m)
            freed = F.count(F.when(c == 1, 1)) * d[m][0] + F.count(F.when(c == 2, 1)) * d[m][1] + F.count(F.when(c > 2, 1)) * d[m][2]
            sums += [total.alias(f"total_{m}"), F.when(total > 0, freed / total).otherwise(1.0).alias(f"back_{m}")]
        ctx = cut(table.groupBy("ctx").agg(*sums))
        grams = table.join(ctx.hint("merge"), "ctx")
        if n == 1:
            low = {m: F.lit(1.0 / (1 << bits)) for m in names}
        else:
            grams = grams.withColumn("low", _last(n - 1, bits)).join(out[-1][0].select(F.col("gram").alias("low"), *[F.col(m).alias(f"low_{m}") for m in names]).hint("merge"), "low")
            low = {m: F.col(f"low_{m}") for m in names}
        own = {m: F.when(F.col(m) == 1, 1 - d[m][0]).when(F.col(m) == 2, 2 - d[m][1]).when(F.col(m) > 2, F.col(m) - d[m][2]).otherwise(0.0) for m in names}
        grams = cut(grams.select("gram", *[(own[m] / F.greatest(F.lit(1), f"total_{m}") + F.col(f"back_{m}") * low[m]).alias(m) for m in names]))
        out.append((grams, ctx.select("ctx", *[F.col(f"back_{m}").alias(m) for m in names])))
    return out


def probabilities(grams: DataFrame, model, bits: int = UNITS[0]) -> DataFrame:
    """`grams` (gram, distinct) -> (gram, one column a model): natural log P(last symbol | those before), by joins with every level."""
    names = model[0][0].columns[1:]
    out = grams.select("gram", *[F.lit(1.0 / (1 << bits)).alias(m) for m in names])
    for n, (seen, contexts) in enumerate(model, start=1):
        for side, length, key in ((contexts, n - 1, F.shiftrightunsigned(_last(n, bits), bits)), (seen, n, _last(n, bits))):
            side = side.toDF("__key", *[f"__{m}" for m in names])
            side = checked(side) if length < 3 else side.hint("merge")
            out = out.withColumn("__key", key).join(side, "__key", "left")
            if length < n:
                p = [(F.coalesce(F.col(f"__{m}"), F.lit(1.0)) * F.col(m)).alias(m) for m in names]
            else:
                p = [F.coalesce(f"__{m}", m).alias(m) for m in names]
            out = out.select("gram", *p)
    return out.select("gram", *[F.log(m).alias(m) for m in names])


def mean_loss(counts: DataFrame, model) -> float:
    """Mean log loss on the text that was counted."""
    both = counts.select("gram", F.col("all").alias("c")).join(model[-1][0].hint("merge"), "gram")
    return float(both.agg(-F.sum(F.col("c") * F.log("all")) / F.sum("c")).first()[0])


def train(texts: DataFrame) -> tuple[np.ndarray | None, float]:
    """(dense natural log P(symbol | three symbols) of `texts` (text), mean log loss on them); None without text.

    The model over classes of bytes, an alphabet so small that all its grams fit an array:
    64^4 floats.  No query uses it; it shows the distributions of `levels` whole.
    """
    bits = CLASSES[0]
    counts = gram_counts(texts, CLASSES).select("gram", "all")
    if not counts.limit(1).count():
        return None, 0.0
    model = levels(counts, bits)
    dense = np.full(1, 1.0 / K)
    for n, (seen, contexts) in enumerate(model, start=1):
        back, got, seen = np.ones(K ** (n - 1)), contexts.toPandas(), seen.toPandas()
        back[got["ctx"].to_numpy(np.int64)] = got["all"].to_numpy()
        dense = np.repeat(back, K) * (dense[0] if n == 1 else np.tile(dense, K))
        dense[seen["gram"].to_numpy(np.int64)] = seen["all"].to_numpy()
    return np.log(dense), mean_loss(counts, model)


def _asked(block: pa.Table) -> pa.Table:
    """(block, ..., text) of one block -> (block, gram): the distinct grams of its texts."""
    some = [np.unique(_keys(raw, off, UNITS)[0]) for b in block.to_batches() for _, _, raw, off in slices(b.column(b.num_columns - 1), SLICE)]
    grams = np.unique(np.concatenate(some))
    out = pa.table({"block": np.full(len(grams), block.column(0)[0].as_py()), "gram": grams})
    give_back()
    return out


def with_perplexity(docs: DataFrame, model, mean: float) -> DataFrame:
    """The columns of `docs` (..., text) before its last, ppl and unseen.

    ppl is the perplexity per symbol with PRIOR symbols of log loss `mean`; unseen is the same
    from the model of the other fold, which learned neither the text nor a copy.
    """

    def scored(block: pa.Table, found: pa.Table) -> pa.Table:
        gram = found.column("gram").to_numpy()
        order = np.argsort(gram)
        gram = gram[order]
        worths = [found.column(m).to_numpy()[order].astype(np.float64) for m in ("ppl", "unseen")]
        out = []
        for b in block.to_batches():
            made = [np.empty(b.num_rows), np.empty(b.num_rows)]
            for lo, hi, raw, off in slices(b.column(b.num_columns - 1), SLICE):
                key, doc, n = _keys(raw, off, UNITS)
                at = np.searchsorted(gram, key)
                for ppl, worth in zip(made, worths):
                    ppl[lo:hi] = np.exp((PRIOR * mean - np.bincount(doc, weights=worth[at], minlength=hi - lo)) / (PRIOR + n))
            out.append(pa.RecordBatch.from_arrays([*b.columns[1:-1], *map(pa.array, made)], names=[*b.schema.names[1:-1], "ppl", "unseen"]))
        give_back()
        return pa.Table.from_batches(out)

    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # by the whole row, so that copies of a text are spread by their ids; a block has texts of one fold
    block = F.pmod(F.xxhash64(*docs.columns), F.lit(total // (2 * BLOCK) + 1)) * 2 + _fold()
    # both sides read one shuffle of the texts by block
    asked = docs.select(block.alias("block"), "*").groupBy("block").applyInArrow(_asked, "block bigint, gram bigint")
    worth = probabilities(asked.select("gram").distinct(), model)
    worth = worth.select("gram", *[F.col(m).cast("float").alias(m) for m in worth.columns[1:]])
    unseen = F.when(F.col("block") % 2 == 0, F.col("half_1")).otherwise(F.col("half_0"))
    found = asked.join(worth.hint("merge"), "gram").select("block", "gram", F.col("all").alias("ppl"), unseen.alias("unseen"))
    more = [T.StructField(x, T.DoubleType()) for x in ("ppl", "unseen")]
    return docs.select(block.alias("own"), "*").groupBy("own").cogroup(found.groupBy("block")).applyInArrow(scored, T.StructType([*docs.schema.fields[:-1], *more]))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose every label has quality 1."""
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__trusted")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("__q")).filter("__q = 1").select("__trusted")


def limits_of(ppl: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, low, high) of the trusted texts `ppl` (lang, ppl); the row with lang null is for any other language."""
    both = [(F.percentile_approx("ppl", 1 - quantile, 10000) / margin).alias("low"), (F.percentile_approx("ppl", quantile, 10000) * margin).alias("high")]
    rest = ppl.agg(*both)
    few = F.col("n") < round(1 / (1 - quantile))
    per = ppl.filter("lang IS NOT NULL").groupBy("lang").agg(*both, F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(rest.select(F.col("low").alias("l"), F.col("high").alias("h"))))  # one row
    per = per.select("lang", F.when(few, F.least("low", "l")).otherwise(F.col("low")).alias("low"), F.when(few, F.greatest("high", "h")).otherwise(F.col("high")).alias("high"))
    return cut(per.unionByName(rest.select(F.lit(None).cast("string").alias("lang"), "low", "high")))


def judged(slim: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame | None:
    """`slim` (doc_id, ..., lang, empty, text) -> doc_id, ..., lang, empty, ppl, low, high, keep; None without trusted text.  Empty texts stay by rule."""
    ids = checked(trusted_ids(labels))
    trusted = F.col("doc_id") == F.col("__trusted")
    counts = gram_counts(slim.join(ids, trusted, "left_semi"))
    halves = counts.agg(F.sum("half_0"), F.sum("half_1")).first()
    if halves[0] is None:
        return None
    model = levels(counts)
    scored = cut(with_perplexity(slim, model, mean_loss(counts, model)))
    good = scored.filter("NOT empty").join(ids, trusted, "left_semi")
    limits = limits_of(good.select("lang", "ppl"), quantile, margin)
    if all(halves):
        limits = limits.unionByName(limits_of(good.select("lang", F.col("unseen").alias("ppl")), quantile, margin))
        limits = cut(limits.groupBy("lang").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    rest = limits.filter("lang IS NULL").select(F.col("low").alias("any_low"), F.col("high").alias("any_high"))
    own = limits.filter("lang IS NOT NULL").select(F.col("lang").alias("l"), F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    out = scored.join(checked(own), F.col("lang") == F.col("l"), "left").crossJoin(F.broadcast(rest))  # one row
    out = out.withColumns({"low": F.coalesce("own_low", "any_low"), "high": F.coalesce("own_high", "any_high")})
    keep = F.col("empty") | F.coalesce(F.col("ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("keep", keep).drop("unseen", "l", "own_low", "own_high", "any_low", "any_high")


def _empty():
    return (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty")


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, low, high, keep: one row per input row; perplexity is null for empty texts and without a model."""
    none = F.lit(None).cast("double")
    out = judged(docs.select("doc_id", "lang", _empty(), "text"), labels)
    if out is None:
        return docs.select("doc_id", "lang", none.alias("perplexity"), none.alias("low"), none.alias("high"), F.lit(True).alias("keep"))
    return out.select("doc_id", "lang", F.when(~F.col("empty"), F.col("ppl")).alias("perplexity"), "low", "high", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the filter keeps, as they are.

    A verdict depends on text and language alone, so rows are judged as (text key, language)
    and those rejected leave by an anti join: no text comes back from Python.
    """
    out = judged(docs.select("doc_id", text_key().alias("key"), "lang", _empty(), "text"), labels)
    if out is None:
        return docs
    bad = cut(out.filter("NOT keep").select(F.col("key").alias("__bad"), F.col("lang").alias("__bad_lang")).distinct())
    same = (text_key() == F.col("__bad")) & F.col("lang").eqNullSafe(F.col("__bad_lang"))
    return docs.join(checked(bad), same, "left_anti")
