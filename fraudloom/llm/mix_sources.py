"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code point order, null last, share all words by weight; a target stops
at `cap` times its source and the excess is shared anew by weight (water filling).  Within a
source whole epochs come first (every document floor(target / size) times), the rest is a
weighted sample without replacement: every document draws an exponential key
-ln(u) / quality, keys are sorted, and the longest prefix whose words fit into the rest is
taken once more.  What is still open goes to the one later document that fits it best.

The prefix is found without sorting a source: a histogram of the keys finds the bin in
which the rest ends, and only that bin's rows are ordered.  The outcome is one cut and one filler
key per source, so the documents themselves are never shuffled.  u is a hash of seed, id and
text: reruns agree, and rows repeated as a whole are taken alike.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, cut, text_key

BINS_A_DOUBLING = 128  # bins of the keys have a constant ratio, so none holds over 0.2 % of a source's rows, whatever their quality
SEED = 20240229


def word_count(text: str = "text") -> Column:
    """Number of runs of bytes other than space and 0x09-0x0D; null has none."""
    # the beginnings of words: what is left of the text when every run is one character
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def text_quality(text: str = "text") -> Column:
    """Default quality weight in [0.05, 1]: the share of letters, digits and spaces among the characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    odd = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,]+", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * odd / F.greatest(F.length(t), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target; one row per source, so the windows are as small as the list of sources."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * float(cap)).withColumn("fills", F.col("most") / F.col("weight"))
    fill = Window.orderBy("fills", F.col("source").isNull(), "source")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    w = w.withColumn("level", level)
    # the level of the first source that is not filled holds for it and all later ones
    open_level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("open", open_level["level"])
    return w.select("source", "source_size", "weight", F.least(F.col("most"), F.col("weight") * F.coalesce("open", F.lit(float("inf")))).alias("target"))


def _bin(key: str) -> Column:
    """Bin of a key; bins keep the order of the keys."""
    return F.floor(F.log2(key) * BINS_A_DOUBLING).cast("int")


def _up_to_cut(own_bin: str | Column, key: str, tie: str, cut_bin: str) -> Column:
    """Whether a document lies in the taken prefix of its source."""
    own, key, tie = F.col(own_bin) if isinstance(own_bin, str) else own_bin, F.col(key), F.col(tie)
    below = (own == F.col(cut_bin)) & ((key < F.col("cut_key")) | ((key == F.col("cut_key")) & (tie <= F.col("cut_tie"))))
    return F.coalesce(own < F.col(cut_bin), F.lit(False)) | F.coalesce(below, F.lit(False))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, quality: Column | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(`docs` with __size, __key, __tie; one row per source with target, epochs, cut_key, cut_tie)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", text_key()), 1 << 52) + 0.5) / float(1 << 52)
    key = -F.log(u) / (text_quality() if quality is None else F.greatest(quality, F.lit(1e-6)))
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], word_count().alias("__size"), key.alias("__key"), F.xxhash64("doc_id", text_key(), F.lit(seed + 1)).alias("__tie"))
    slim = cut(keyed.select("source", F.col("__size").alias("size"), F.col("__key").alias("key"), F.col("__tie").alias("tie"), _bin("__key").alias("bin")))
    bins = cut(slim.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size") + 1e-12)).cast("bigint")).otherwise(F.lit(0))
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    goal = cut(goal)
    run = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))  # keys lie between 2^-53 and 2^26: some 10,000 rows a source
    same = bins["source"].eqNullSafe(goal["source"])
    edge = bins.withColumn("upto", run).join(goal.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    edge = edge.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") > 0))
    edge = edge.groupBy("s").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("e")).select("s", "e.*")
    last = slim.join(checked(edge.withColumnRenamed("bin", "b")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    last = last.groupBy("s", "before", "rest", "key", "tie").agg(F.sum("size").alias("size"))
    inside = F.sum("size").over(Window.partitionBy("s").orderBy("key", "tie"))
    last = last.withColumn("upto", F.col("before") + inside)
    taken = last.filter(F.col("upto") <= F.col("rest"))
    cuts = taken.groupBy("s").agg(F.max(F.struct("key", "tie")).alias("c"), F.max("upto").alias("got"))
    # no row of the bin taken: the cut is the end of the bin before
    cuts = edge.select("s", "bin", "before", "rest").join(cuts.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
    cuts = cut(cuts.select("s", "bin", F.col("c.key").alias("cut_key"), F.col("c.tie").alias("cut_tie"), (F.col("rest") - F.coalesce("got", "before")).alias("open")))
    # one more document per source, the one after the cut that comes nearest to what is open
    after = slim.join(checked(cuts.withColumnRenamed("bin", "b")), F.col("source").eqNullSafe(F.col("s"))).filter(~_up_to_cut("bin", "key", "tie", "b"))
    filler = after.filter(F.col("size") < 2 * F.col("open")).groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - F.col("open")), "key", "tie")).alias("f"))
    cuts = cuts.join(filler.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select("s", "bin", "cut_key", "cut_tie", F.col("f.key").alias("fill_key"), F.col("f.tie").alias("fill_tie"))
    out = goal.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return keyed, cut(out)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """`docs` with __size, __source_size, __target and __times, how often the mix takes the document."""
    keyed, plan = plan_mix(docs, weights, cap, quality, seed)
    plan = plan.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "epochs", F.col("bin").alias("__cut_bin"), "cut_key", "cut_tie", "fill_key", "fill_tie")
    joined = keyed.join(checked(plan), F.col("source").eqNullSafe(F.col("__s")), "left")
    own_bin = _bin("__key")
    filler = (F.col("__key") == F.col("fill_key")) & (F.col("__tie") == F.col("fill_tie"))
    extra = _up_to_cut(own_bin, "__key", "__tie", "__cut_bin") | F.coalesce(filler, F.lit(False))
    return joined.withColumn("__times", F.col("epochs") + extra.cast("bigint")).drop("__s", "epochs", "__cut_bin", "cut_key", "cut_tie", "fill_key", "fill_tie", "__key", "__tie")


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    out = mix(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__times") * F.col("__size")).alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it. Documents without words are in no mix."""
    out = mix(docs, **how).filter((F.col("__times") > 0) & (F.col("__size") > 0))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
