"""Threshold calibration: false-accept budgets, k-fold, cost-optimal, face bands."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions.scalars import per_applicant_rate
from .metrics import threshold_counts
from .ordered import cumulative_counts, exact_percentiles, neighbours, quantile_chunks
from .similarity import UNIT, ScoreCounts

L = F.lit


def ceil4(c: Column) -> Column:
    return F.ceil(c * 10000) / 10000.0


def threshold_at_far(impostor: DataFrame, far, score: str = "sim", rounded: bool = False) -> DataFrame:
    """Lowest threshold whose impostor acceptance stays inside the budget, re-measured after
    rounding up to four places.

    k = budget x N is found from the score counts, so no global sort of the raw scores is needed.
    """
    counts = impostor.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count(L(1)).alias("n"))
    from .ordered import running_sums

    down = counts.withColumn("neg", -F.col("s"))
    ranked = running_sums(quantile_chunks(down, [], "neg"), [], [F.col("neg")], {"upto": F.col("n")}, {"total": "upto"})
    far_c = far if isinstance(far, Column) else L(float(far))
    budget = far_c * F.col("total")
    k = (F.rint(budget) if rounded else F.floor(budget)).cast("bigint")
    kth = F.max(F.when(F.col("upto") >= k, F.col("s")))
    cut = ranked.agg(F.first("total").alias("total"), F.when(F.first(budget) >= 1, kth).otherwise(F.max("s") + 1e-6).alias("raw"), (F.first(budget) >= 1).alias("resolved"))
    cut = cut.select("total", "resolved", ceil4(F.col("raw")).alias("threshold"))
    hit = counts.crossJoin(F.broadcast(cut)).groupBy("threshold", "total", "resolved").agg(F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("accepted"))  # one row
    return hit.select("threshold", (F.col("accepted") / F.col("total")).alias("far"), "accepted", "resolved", "total")


def best_threshold(pairs: DataFrame, score: str = "sim", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Accuracy-maximal midpoint of neighbouring distinct scores; the lowest wins a tie."""
    by = by or []
    c = cumulative_counts(pairs, by, score, label)
    # candidate between this score and the next: everything at or below is called different
    lead = neighbours(quantile_chunks(c, by, "score"), by, ["score"], lead={"up": "score"})
    right = F.col("cum0") + F.col("all1") - F.col("cum1")
    acc = right / (F.col("all0") + F.col("all1"))
    single = F.when(F.col("n0") + F.col("n1") == F.col("all0") + F.col("all1"), F.col("score"))  # one distinct score
    cand = F.coalesce((F.col("score") + F.col("up")) / 2.0, single)
    alone = F.when(F.col("up").isNull(), F.col("all1") / (F.col("all0") + F.col("all1"))).otherwise(acc)
    ranked = lead.select(*by, cand.alias("t"), alone.alias("a")).filter(F.col("t").isNotNull())
    return ranked.groupBy(*by).agg(F.max_by("t", F.struct(F.round("a", 12), -F.col("t"))).alias("threshold"), F.max("a").alias("accuracy"))


def score_threshold(pairs: DataFrame, t: Column, score: str = "sim", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """tar, far and accuracy of a threshold (a literal, or a column joined on beforehand)."""
    s, y = F.col(score), F.col(label)
    yes = lambda c: F.avg(c.cast("int"))
    return pairs.groupBy(*(by or [])).agg(
        yes(F.when(y == 1, s >= t)).alias("tar"), yes(F.when(y == 0, s >= t)).alias("far"), yes((s >= t) == (y == 1)).alias("accuracy")
    )


def rate_at_far(pairs: DataFrame, far: float, score: str = "sim", label: str = "label") -> DataFrame:
    cut = threshold_at_far(pairs.filter(F.col(label) == 0), far, score, rounded=True)
    gen = pairs.filter(F.col(label) == 1).select(F.col(score).alias("s"))
    tar = gen.crossJoin(F.broadcast(cut.select("threshold"))).agg(F.avg((F.col("s") >= F.col("threshold")).cast("int")).alias("tar"))  # one row
    return cut.select("threshold", "far").crossJoin(F.broadcast(tar))  # one row


def youden_split(low: DataFrame, high: DataFrame, score: str = "sim", by: list[str] | None = None) -> DataFrame:
    """Score with the best (share of high at or above) + (share of low below) - 1; the lowest wins a tie."""
    both = low.select(*(by or []), score, L(0).alias("y")).unionByName(high.select(*(by or []), score, L(1).alias("y")))
    c = cumulative_counts(both, by or [], score, "y")
    j = (F.col("all1") - F.col("cum1") + F.col("n1")) / F.col("all1") + (F.col("cum0") - F.col("n0")) / F.col("all0") - 1.0
    return c.filter((F.col("all0") > 0) & (F.col("all1") > 0)).groupBy(*(by or [])).agg(
        F.max_by("score", F.struct(F.round(j, 12), -F.col("score"))).alias("threshold"), F.max(j).alias("j")
    )


def kfold_threshold(pairs: DataFrame, folds: int, score: str = "sim", label: str = "label", fold: str = "fold") -> DataFrame:
    """For each fold: fit on the others, score the fold.

    Each row goes to the folds-1 training sets it belongs to as a pre-counted score, so
    what is repeated is (score, label) counts per fold, not rows.
    """
    counts = pairs.groupBy(fold, F.col(score).alias("sim"), F.col(label).alias("label")).agg(F.count(L(1)).alias("w"))
    train = counts.select(F.explode(F.sequence(L(0), L(folds - 1))).alias("held"), fold, "sim", "label", "w").filter(F.col("held") != F.col(fold))
    fitted = weighted_best_threshold(train, ["held"])
    test = pairs.join(fitted.select(F.col("held").alias(fold), "threshold"), fold)
    graded = score_threshold(test, F.col("threshold"), score, label, [fold, "threshold"])
    return graded.select(fold, "threshold", "accuracy", "tar", "far")


def weighted_best_threshold(counts: DataFrame, by: list[str]) -> DataFrame:
    from .ordered import running_sums

    c = counts.groupBy(*by, "sim").agg(F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0)).alias("n1"))
    r = running_sums(quantile_chunks(c, by, "sim"), by, [F.col("sim")], {"cum0": F.col("n0"), "cum1": F.col("n1")}, {"all0": "cum0", "all1": "cum1"})
    lead = neighbours(quantile_chunks(r, by, "sim"), by, ["sim"], lead={"up": "sim"}).filter(F.col("up").isNotNull())
    a = (F.col("cum0") + F.col("all1") - F.col("cum1")) / (F.col("all0") + F.col("all1"))
    return lead.groupBy(*by).agg(F.max_by((F.col("sim") + F.col("up")) / 2.0, F.struct(F.round(a, 12), -F.col("sim"))).alias("threshold"), F.max(a).alias("train_accuracy"))


def kfold_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.avg("threshold").alias("mean_threshold"), F.stddev_pop("threshold").alias("std_threshold"))


def grade(impostors: ScoreCounts, genuine: DataFrame, thresholds: dict[str, float], sizes=K.APPLICANT_SIZES) -> DataFrame:
    """far, tar and per-applicant rates at named thresholds of at most four places.

    impostors: the counts of all impostor pairs.  genuine: sim; one pass serves all thresholds.
    """
    spark = genuine.sparkSession
    rows = [(k, float(t), impostors.pairs, impostors.at_least(t)) for k, t in thresholds.items()]
    far = spark.createDataFrame(rows, "name string, threshold double, pairs bigint, accepted bigint").withColumn("far", F.col("accepted") / F.col("pairs"))
    tar = genuine.agg(F.create_map(*[x for k, t in thresholds.items() for x in (L(k), F.avg((F.col("sim") >= t).cast("int")))]).alias("tar"))
    both = far.crossJoin(F.broadcast(tar)).withColumn("tar", F.col("tar")[F.col("name")])  # one row
    return both.select("name", "threshold", "pairs", "accepted", "far", "tar", *[per_applicant_rate(F.col("far"), n).alias(f"per_applicant_{n}") for n in sizes])


def impostor_summary(impostors: ScoreCounts, spark: SparkSession) -> DataFrame:
    """Pairs, mean, p99, p99.99 and highest score of all impostor pairs; exact, from cells of scores."""
    q = impostors.percentiles([0.99, 0.9999, 1.0])
    return spark.createDataFrame([(impostors.pairs, impostors.mean, q[0.99], q[0.9999], q[1.0])], "pairs bigint, mean double, p99 double, p99_99 double, highest double")


def genuine_summary(genuine: DataFrame) -> DataFrame:
    """n, mean, p05 and p50 of the same-person scores (sim)."""
    return exact_percentiles(genuine, [], "sim", {"p05": 0.05, "p50": 0.5}, stats=True).select("n", "mean", "p05", "p50")


def fitted_threshold(impostors: ScoreCounts, budget: float = 0.01, records: int = 5000) -> tuple[float, float, bool]:
    """(search threshold that holds the per-applicant budget over `records` entries, rate it needs, whether the pairs resolve that rate).

    The k-th highest score, k the pairs inside the budget, rounded up to four places; with k
    under one the highest score plus 1e-6.
    """
    need = 1.0 - (1.0 - budget) ** (1.0 / records)
    k = int(need * impostors.pairs)
    last = impostors.pairs - 1
    raw = round(impostors.ranked([last - max(k, 1) + 1])[last - max(k, 1) + 1] * UNIT) + (0 if k else UNIT // 1_000_000)
    return -(-raw // (UNIT // 10_000)) / 10_000, need, k >= 1


def linkage_threshold(impostors: ScoreCounts, spark: SparkSession, budget: float = 0.01, records: int = 5000) -> DataFrame:
    """pairs, required_far, resolved, threshold and, measured again after rounding, accepted and far."""
    t, need, resolved = fitted_threshold(impostors, budget, records)
    hit = impostors.at_least(t)
    return spark.createDataFrame([(impostors.pairs, need, resolved, t, hit, hit / impostors.pairs)], "pairs bigint, required_far double, resolved boolean, threshold double, accepted bigint, far double")


def face_band(pairs: DataFrame) -> DataFrame:
    """low and high of the one-to-one band from genuine / mismatch similarities (bucket, sim)."""
    g, m = pairs.filter("bucket = 'genuine'"), pairs.filter("bucket = 'mismatch'")
    q = exact_percentiles(g, [], "sim", {"p02": 0.02, "p99": 0.99}, stats=True).select("p02", "p99", F.col("n").alias("n_genuine"))
    n_m = m.agg(F.count(L(1)).alias("n_mismatch"))
    split = youden_split(m, g).agg(F.max("threshold").alias("split"))
    low = F.when(F.col("n_mismatch") >= 3, F.coalesce("split", F.col("p02") - 0.05)).otherwise(F.col("p02") - 0.05)
    j = q.crossJoin(F.broadcast(n_m)).crossJoin(F.broadcast(split)).filter("n_genuine >= 5")  # one row each
    return j.select(low.alias("low"), F.least(L(0.9995), F.col("p99") + 0.005).alias("high"), "n_genuine", "n_mismatch")


def keep_better_low(fitted: DataFrame, existing_low: float | None) -> DataFrame:
    """A low bound from a better source stays; the fitted one is recorded beside it."""
    kept = F.col("low") if existing_low is None else L(existing_low)
    return fitted.select(kept.alias("low"), "high", F.col("low").alias("corpus_fitted_low"))


def threshold_for_fpr(human: DataFrame, budget: float, score: str = "score") -> DataFrame:
    q = exact_percentiles(human, [], score, {"q": 1.0 - budget})
    return q.select(F.greatest(F.coalesce("q", L(0.5)), L(0.5)).alias("threshold"))


POLICY_GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]


def policy_curve(oof: DataFrame, score: str = "score", label: str = "y", base_rate=0.03, loss=85000.0, ltv=42000.0, abandon=0.35, volume=10000) -> DataFrame:
    """Recall, false-positive rate (rounded to 4 places, as the choice is made on them) and net benefit."""
    c = threshold_counts(oof, score, label, POLICY_GRID)
    recall = F.round(F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0), 4)
    fpr = F.round(F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).otherwise(0.0), 4)
    net = volume * base_rate * recall * loss - volume * (1 - base_rate) * fpr * ltv * abandon
    return c.select("threshold", recall.alias("recall"), fpr.alias("fpr"), F.round(net, 0).alias("net_benefit"))


def fit_policy_thresholds(curve: DataFrame, review_budget: float = 0.25) -> DataFrame:
    """reject = argmax net benefit; review = lowest threshold up to it inside the review budget."""
    best = curve.agg(F.max_by("threshold", F.struct("net_benefit", -F.col("threshold"))).alias("reject"))
    tagged = curve.crossJoin(F.broadcast(best))  # one row
    ok = (F.col("fpr") <= review_budget) & (F.col("threshold") <= F.col("reject"))
    at_reject = F.col("threshold") == F.col("reject")
    return tagged.groupBy("reject").agg(
        F.coalesce(F.min(F.when(ok, F.col("threshold"))), F.col("reject")).alias("review"), F.max(F.when(at_reject, F.col("fpr"))).alias("fpr_at_reject"), F.max(F.when(at_reject, F.col("recall"))).alias("recall_at_reject")
    )


def transfer_check(oof_curve: DataFrame, held: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Does the chosen threshold keep its false-positive rate on data it was not chosen on."""
    chosen = fit_policy_thresholds(oof_curve)
    h = held.crossJoin(F.broadcast(chosen))  # one row
    out = h.groupBy("reject", "fpr_at_reject").agg(F.round(F.avg(F.when(F.col(label) == 0, (F.col(score) >= F.col("reject")).cast("int"))), 4).alias("held_out_fpr"))
    ratio = F.when(F.col("fpr_at_reject") > 0, F.round(F.col("held_out_fpr") / F.col("fpr_at_reject"), 1))
    return out.select("reject", F.col("fpr_at_reject").alias("out_of_fold_fpr"), "held_out_fpr", ratio.alias("optimism"), F.coalesce(ratio <= 1.5, L(False)).alias("deployable"))


def naive_comparison(naive_curve: DataFrame, curve: DataFrame) -> DataFrame:
    """The row-wise choice, with its false-positive rate measured both ways."""
    n = fit_policy_thresholds(naive_curve).select(F.col("reject").alias("threshold"), F.col("fpr_at_reject").alias("claimed_fpr"))
    return n.join(curve.select("threshold", F.col("fpr").alias("identity_disjoint_fpr")), "threshold")
