"""Order-dependent operators that never put one whole group in one task.

A window partitioned by a business key is one task per key, so a key that holds a
third of the rows stalls the job.  These helpers cut each group into chunks of
consecutive rows, run the window inside (key, chunk), and carry the boundary state
between chunks over a table with one row per chunk.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut

CHUNK = "__chunk"


def n_chunks(df: DataFrame) -> int:
    """As many chunks per group as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantile_chunks(df: DataFrame, by: list[str], order: str, chunks: int | None = None) -> DataFrame:
    """Add a chunk number that grows with `order`, cut at approximate quantiles per group.

    Equal values of `order` share a chunk, so pre-aggregate a value that repeats a lot.
    The cut points are a bounded array per group, found with a mergeable sketch.  The sketch
    depends on the order in which its parts arrive, so the cut points are stored: every branch
    of a plan, and every repeated task, must see the same chunks.
    """
    k = chunks or n_chunks(df)
    cuts = df.groupBy(*by).agg(F.percentile_approx(order, [i / k for i in range(1, k)], 20 * k).alias("__cuts"))
    s = max(1, round(k**0.5))
    cuts = cut(cuts.withColumn("__every", F.filter("__cuts", lambda c, i: i % s == s - 1)))
    joined = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))  # one row when there is no group
    # cuts below the value, looked up in two steps: every s-th cut first, then s cuts, so 2 sqrt(k) comparisons a row instead of k
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(order)))
    coarse = joined.withColumn("__at", below("__every") * s)
    return coarse.withColumn(CHUNK, F.col("__at") + below(F.slice("__cuts", F.col("__at") + 1, s))).drop("__cuts", "__every", "__at")


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums per group over a frame that carries the chunk column.

    `totals` names extra columns that receive the group total of a running sum.
    """
    totals = totals or {}
    src = df.select("*", *[e.alias(f"__v_{n}") for n, e in sums.items()])
    per_chunk = src.groupBy(*by, CHUNK).agg(*[F.sum(f"__v_{n}").alias(f"__c_{n}") for n in sums])
    over = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_chunk.select(
        *by,
        CHUNK,
        *[F.coalesce(F.sum(f"__c_{n}").over(over), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__c_{n}").over(whole).alias(out) for out, n in totals.items()],
    )
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = src.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__r_{n}") for n in sums])
    keep = [c for c in df.columns if c != CHUNK]
    return local.join(offsets, [*by, CHUNK]).select(
        *keep, *[(F.col(f"__r_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums], *totals
    )


def row_numbers(df: DataFrame, by: list[str], order: str, tiebreak: list[str], name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact row_number per group (or over the whole frame when `by` is empty)."""
    chunked = quantile_chunks(df, by, order)
    return running_sums(chunked, by, [F.col(order), *map(F.col, tiebreak)], {name: F.lit(1).cast("bigint")}, {total: name} if total else None)


def neighbours(df: DataFrame, by: list[str], order: list[str], lag: dict[str, str] | None = None, lead: dict[str, str] | None = None) -> DataFrame:
    """lag(1)/lead(1) per group over a frame that carries the chunk column."""
    lag, lead = lag or {}, lead or {}
    key = F.struct(*order)
    edge = lambda pick, cols: pick(F.struct(*[F.col(c) for c in dict.fromkeys(cols)]), key)
    aggs = []
    if lag:
        aggs.append(edge(F.max_by, lag.values()).alias("__last"))
    if lead:
        aggs.append(edge(F.min_by, lead.values()).alias("__first"))
    per_chunk = df.groupBy(*by, CHUNK).agg(*aggs)
    over = Window.partitionBy(*by).orderBy(CHUNK)
    border = per_chunk.select(
        *by,
        CHUNK,
        *([F.lag("__last").over(over).alias("__before")] if lag else []),
        *([F.lead("__first").over(over).alias("__after")] if lead else []),
    )
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order)
    local = df.select(
        "*",
        F.row_number().over(inside).alias("__at"),
        F.lead(F.lit(1)).over(inside).isNull().alias("__ends"),
        *[F.lag(c).over(inside).alias(f"__l_{n}") for n, c in lag.items()],
        *[F.lead(c).over(inside).alias(f"__f_{n}") for n, c in lead.items()],
    )
    return local.join(border, [*by, CHUNK]).select(
        *df.columns,
        *[F.when(F.col("__at") == 1, F.col(f"__before.{c}")).otherwise(F.col(f"__l_{n}")).alias(n) for n, c in lag.items()],
        *[F.when(F.col("__ends"), F.col(f"__after.{c}")).otherwise(F.col(f"__f_{n}")).alias(n) for n, c in lead.items()],
    )


def exact_percentiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], stats: bool = False) -> DataFrame:
    """Linear-interpolation percentiles per group, exact, with no per-group value buffer.

    Repeated values are counted first; the counts are ranked by chunk; each percentile
    then picks its two neighbouring order statistics in one aggregation.
    `stats=True` adds n, mean, pop_std, lowest and highest from the same counts.
    """
    counted = cut(df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))  # read three times
    ranked = running_sums(quantile_chunks(counted, by, value), by, [F.col(value)], {"__upto": F.col("__n")}, {"__total": "__upto"})
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col(value)))
    pos = {n: F.lit(p) * (F.col("__total") - 1) for n, p in probs.items()}
    aggs = []
    for n in probs:
        aggs += [at(F.floor(pos[n])).alias(f"__lo_{n}"), at(F.ceil(pos[n])).alias(f"__hi_{n}")]
    v, w = F.col(value), F.col("__n")
    summary = ranked.groupBy(*by).agg(
        F.first("__total").alias("__total"),
        F.sum(v * w).alias("__s1"),
        F.min(v).alias("__min"),
        F.max(v).alias("__max"),
        *aggs,
    )
    frac = {n: F.lit(p) * (F.col("__total") - 1) - F.floor(F.lit(p) * (F.col("__total") - 1)) for n, p in probs.items()}
    out = [(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * frac[n]).alias(n) for n in probs]
    extra = []
    if stats:
        extra = [
            F.col("__total").alias("n"),
            (F.col("__s1") / F.col("__total")).alias("mean"),
            F.col("__min").alias("lowest"),
            F.col("__max").alias("highest"),
        ]
    return summary.select(*by, *extra, *out)


def cumulative_counts(df: DataFrame, by: list[str], score: str, label: str, count: str | None = None) -> DataFrame:
    """Per group and distinct score: n0, n1, how many lie at or below, and the group totals.

    The shared base of AUC, average precision, ROC and the threshold searches.  A row stands
    for as many as its column `count` says.
    """
    one = F.col(count) if count else F.lit(1)
    y = F.col(label).cast("int")
    counted = cut(  # read three times
        df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & y.isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.when(y == 1, one).otherwise(0)).alias("n1"), F.sum(F.when(y == 0, one).otherwise(0)).alias("n0"))
    )
    return running_sums(
        quantile_chunks(counted, by, "score"),
        by,
        [F.col("score")],
        {"cum0": F.col("n0"), "cum1": F.col("n1")},
        {"all0": "cum0", "all1": "cum1"},
    )
