"""Evaluation: ranking quality, confusion, cost, leakage and slice reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions.scalars import box_cover, iou, literal_map, ratio, tone_bucket
from .ordered import cumulative_counts, exact_percentiles

L = F.lit


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


# --- ranking quality --------------------------------------------------------
def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """Exact ROC-AUC per group, ties one half, null when a class is absent."""
    by = by or []
    wins = F.sum(F.col("n1") * ((F.col("cum0") - F.col("n0")) + F.col("n0") / 2.0))
    out = cumulative_counts(df, by, score, label, count).groupBy(*by).agg(wins.alias("w"), F.max("all0").alias("n_neg"), F.max("all1").alias("n_pos"))
    value = F.when((F.col("n_neg") > 0) & (F.col("n_pos") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg").cast("double")))
    return out.select(*by, "n_neg", "n_pos", value.alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Step-wise average precision: sum of recall gained times precision at that score."""
    by = by or []
    tp = F.col("all1") - F.col("cum1") + F.col("n1")
    fp = F.col("all0") - F.col("cum0") + F.col("n0")
    out = cumulative_counts(df, by, score, label).groupBy(*by).agg(
        F.sum(F.col("n1") * tp / (tp + fp)).alias("s"), F.max("all1").alias("n_pos"), F.max("all0").alias("n_neg")
    )
    ap = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("s") / F.col("n_pos"))
    return out.select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", ap.alias("ap"))


def roc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Every ROC vertex (one per distinct score): the basis of WN9 and AG33."""
    by = by or []
    c = cumulative_counts(df, by, score, label)
    return c.filter((F.col("all0") > 0) & (F.col("all1") > 0)).select(
        *by,
        F.col("score").alias("threshold"),
        ((F.col("all0") - F.col("cum0") + F.col("n0")) / F.col("all0")).alias("fpr"),
        ((F.col("all1") - F.col("cum1") + F.col("n1")) / F.col("all1")).alias("tpr"),
    )


def roc_points(df: DataFrame, score: str, label: str, n: int = 60) -> DataFrame:
    """At most n evenly spaced ROC vertices after dropping collinear ones, highest threshold first."""
    from .ordered import CHUNK, neighbours, quantile_chunks, row_numbers

    full = roc(df, score, label).withColumn("down", -F.col("threshold"))
    start = df.select(L(float("-inf")).alias("down"), L(1.0).alias("threshold"), L(0.0).alias("fpr"), L(0.0).alias("tpr")).limit(1)
    full = full.select("down", "threshold", "fpr", "tpr").unionByName(start)
    near = neighbours(quantile_chunks(full, [], "down"), [], ["down"], {"f0": "fpr", "t0": "tpr"}, {"f1": "fpr", "t1": "tpr"}).drop(CHUNK)
    # a vertex whose steps before and after have the same class mix adds nothing to the curve
    eq = lambda a, b: F.abs(a - b) < 1e-12
    flat = (eq(F.col("fpr"), F.col("f0")) & eq(F.col("f1"), F.col("fpr"))) | (eq(F.col("tpr"), F.col("t0")) & eq(F.col("t1"), F.col("tpr")))
    corner = F.col("f0").isNull() | F.col("f1").isNull() | ~F.coalesce(flat, L(False))
    numbered = row_numbers(near.filter(corner).select("down", "threshold", "fpr", "tpr"), [], "down", [], "rn", "total")
    k = F.least(L(n), F.col("total")).cast("int")
    slots = F.when(k <= 1, F.array(L(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(L(0), k - 1), lambda i: F.floor(i * (F.col("total") - 1) / (k - 1)))
    )
    return numbered.filter(F.array_contains(slots, F.col("rn") - 1)).select((F.col("rn") - 1).alias("vertex"), "threshold", "fpr", "tpr")


def roc_on_grid(rocs: DataFrame, curve: str, grid: int = 20) -> DataFrame:
    """Highest tpr with fpr at or below each of grid+1 points, per curve.

    Each vertex goes to the first grid point at or above its fpr; a running maximum over
    the few grid points replaces a range join.
    """
    slot = F.ceil(F.round(F.col("fpr") * grid, 9)).cast("int")
    best = rocs.groupBy(curve, slot.alias("slot")).agg(F.max("tpr").alias("tpr"))
    axis = best.select(curve).distinct().select(curve, F.explode(F.sequence(L(0), L(grid))).alias("slot"))
    over = Window.partitionBy(curve).orderBy("slot")
    return axis.join(best, [curve, "slot"], "left").select(curve, (F.col("slot") / grid).alias("fpr_at_most"), F.coalesce(F.max("tpr").over(over), L(0.0)).alias("tpr"))


# --- confusion and rates -----------------------------------------------------
def confusion_columns(score: Column, y: Column, t) -> list[Column]:
    t = t if isinstance(t, Column) else L(t)
    return [
        count_when((score >= t) & (y == 1)).alias("tp"),
        count_when((score >= t) & (y == 0)).alias("fp"),
        count_when((score < t) & (y == 1)).alias("fn"),
        count_when((score < t) & (y == 0)).alias("tn"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """precision .. accuracy from tp, fp, fn, tn; denominators floored at one."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    at_least = lambda c, low: F.greatest(c.cast("double"), L(low))
    p, r = tp / at_least(tp + fp, 1.0), tp / at_least(tp + fn, 1.0)
    return df.select(
        "*",
        p.alias("precision"),
        r.alias("recall"),
        (2 * p * r / at_least(p + r, 1e-9)).alias("f1"),
        (fn / at_least(tp + fn, 1.0)).alias("false_accept_rate"),
        (fp / at_least(fp + tn, 1.0)).alias("false_reject_rate"),
        ((tp + tn) / at_least(tp + fp + fn + tn, 1.0)).alias("accuracy"),
    )


def confusion_at(df: DataFrame, score: str, label: str, t, by: list[str] | None = None) -> DataFrame:
    return rates(df.groupBy(*(by or [])).agg(*confusion_columns(F.col(score), F.col(label), t)))


def grid_step(score: Column, grid: list[float]) -> Column:
    """How many thresholds of an evenly spaced grid the score reaches, exactly.

    The position is guessed by division and corrected against the two neighbouring
    thresholds, so a rounding error of the division cannot move a score across one.
    """
    n, low, width = len(grid), grid[0], (grid[-1] - grid[0]) / (len(grid) - 1)
    cuts = F.array(*[L(float("-inf")), *[L(t) for t in grid], L(float("inf"))])
    guess = F.least(L(n), F.greatest(L(0), F.floor((score - low) / width).cast("int") + 1))
    above = (score >= F.get(cuts, guess + 1)).cast("int")
    below = (score < F.get(cuts, guess)).cast("int")
    return guess + above - below


def threshold_counts(df: DataFrame, score: str, label: str, grid: list[float]) -> DataFrame:
    """tp, fp, fn, tn at every grid threshold.

    One pass puts each score in the last grid step it reaches; the cumulative step runs
    over the grid (49 or 91 rows), not over the data.
    """
    step = grid_step(F.col(score), grid)
    hist = df.filter(F.col(score).isNotNull()).groupBy(step.alias("step")).agg(count_when(F.col(label) == 1).alias("p"), count_when(F.col(label) == 0).alias("g"))
    # fixed-size driver literal: the grid is a parameter, not data
    axis = hist.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "step int, threshold double")
    full = axis.join(hist, "step", "full").select("step", "threshold", F.coalesce("p", L(0)).alias("p"), F.coalesce("g", L(0)).alias("g"))
    up = Window.orderBy(F.desc("step"))  # len(grid)+1 rows
    whole = Window.partitionBy()
    return full.select(
        "threshold",
        F.sum("p").over(up).alias("tp"),
        F.sum("g").over(up).alias("fp"),
        (F.sum("p").over(whole) - F.sum("p").over(up)).alias("fn"),
        (F.sum("g").over(whole) - F.sum("g").over(up)).alias("tn"),
    ).filter(F.col("threshold").isNotNull())


COST_GRID = [round(0.02 + 0.02 * i, 2) for i in range(49)]


def cost_curve(df, score, label, loss=85000.0, ltv=42000.0, abandon=0.35, base_rate=0.03, per=1000) -> DataFrame:
    c = threshold_counts(df, score, label, COST_GRID)
    far = F.col("fn") / F.greatest(F.col("tp") + F.col("fn"), L(1))
    frr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), L(1))
    prevented, leaked = per * base_rate * (1 - far) * loss, per * base_rate * far * loss
    friction = per * (1 - base_rate) * frr * ltv * abandon
    return c.select(
        "*",
        far.alias("false_accept_rate"),
        frr.alias("false_reject_rate"),
        prevented.alias("fraud_prevented"),
        leaked.alias("fraud_leaked"),
        friction.alias("friction_cost"),
        (prevented - friction).alias("net_benefit"),
    )


def best_point(curve: DataFrame, value: str = "net_benefit") -> DataFrame:
    """The row with the highest value; the lowest threshold wins a tie."""
    pick = F.max_by(F.struct(*curve.columns), F.struct(F.round(value, 6), -F.col("threshold")))
    return curve.agg(pick.alias("best")).select("best.*")


def profitable_range(curve: DataFrame) -> DataFrame:
    gain = F.col("net_benefit") > 0
    t = F.when(gain, F.col("threshold"))
    return curve.agg(F.min(t).alias("lowest"), F.max(t).alias("highest"), F.count(t).alias("points"))


# --- slice reports -----------------------------------------------------------
def per_detector_report(outputs: DataFrame, targets: dict = K.DETECTOR_TARGETS) -> DataFrame:
    """One row per detector from long outputs joined with y and attack_type."""
    ok = F.col("status") == "ok"
    base = outputs.groupBy("detector").agg(
        F.count(L(1)).alias("rows"),
        (count_when(ok) / F.count(L(1))).alias("coverage"),
        count_when(F.col("status") == "error").alias("errors"),
        count_when(F.col("status") == "skipped").alias("skipped"),
        F.avg(F.when(ok & (F.col("y") == 0), F.col("score"))).alias("mean_genuine"),
        F.avg(F.when(ok & (F.col("y") == 1), F.col("score"))).alias("mean_fraud"),
    )
    wanted = F.try_element_at(literal_map({d: "|".join(a) for d, a in targets.items()}), F.col("detector"))
    aimed = (F.col("y") == 0) | F.array_contains(F.split(wanted, r"\|"), F.col("attack_type"))
    modes = F.array_compact(F.array(L("all"), F.when(ok, "ran"), F.when(wanted.isNotNull() & aimed, "target")))
    long = outputs.select("detector", "score", "y", F.explode(modes).alias("mode"))
    wide = auc(long, "score", "y", ["detector", "mode"]).groupBy("detector").agg(
        *[F.max(F.when(F.col("mode") == m, F.col("auc"))).alias(f"auc_{m}") for m in ("all", "ran", "target")]
    )
    return base.join(wide, "detector")


def one_vs_control(df: DataFrame, group: str, score: str, label: str, extra: list[Column]) -> DataFrame:
    """Per group of positives: aggregates plus AUC against every negative.

    The negatives are counted once per score and only those counts are repeated for each
    group, so the control population is never copied.
    """
    y = F.col(label)
    pos = df.filter((y == 1) & F.col(group).isNotNull())
    summary = pos.groupBy(group).agg(F.count(L(1)).alias("n"), *extra)
    counts = df.filter(y == 0).groupBy(F.col(score).alias("s")).agg(F.count(L(1)).alias("w"))
    hits = pos.groupBy(group, F.col(score).alias("s")).agg(F.count(L(1)).alias("p"))
    # rank every distinct positive score against the control once, whatever its group
    merged = counts.select("s", "w").unionByName(hits.select("s", L(0).cast("bigint").alias("w"))).groupBy("s").agg(F.sum("w").alias("w"))
    from .ordered import quantile_chunks, running_sums

    ranked = running_sums(quantile_chunks(merged, [], "s"), [], [F.col("s")], {"upto": F.col("w")}, {"all0": "upto"})
    won = F.sum(F.col("p") * (F.col("upto") - F.col("w") / 2.0)) / (F.sum("p") * F.first("all0").cast("double"))
    scored = hits.join(ranked, "s").groupBy(group).agg(F.when(F.first("all0") > 0, won).alias("auc_vs_control"))
    return summary.join(scored, group)


def per_attack_report(df: DataFrame, review: float, reject: float) -> DataFrame:
    s = F.col("score")
    return one_vs_control(
        df, "attack_type", "score", "y",
        [F.avg(s).alias("mean_score"), F.avg((s >= review).cast("int")).alias("caught_at_review"), F.avg((s >= reject).cast("int")).alias("caught_at_reject")],
    )


def per_capture_report(df: DataFrame, min_n: int = 6) -> DataFrame:
    """Per capture mode: detector, tamper-only and fused AUC (modes under min_n rows are left out)."""
    tamper = (F.col("y") == 0) | (F.col("attack_type") == "tampered_document")
    views = F.array_compact(
        F.array(
            F.struct(L("id_forensics").alias("k"), F.col("doc_score").alias("v")),
            F.struct(L("fused").alias("k"), F.col("score").alias("v")),
            F.when(tamper, F.struct(L("tamper_only").alias("k"), F.col("doc_score").alias("v"))),
        )
    )
    long = df.select("capture_mode", "y", F.explode(views).alias("e")).select("capture_mode", "y", "e.k", "e.v")
    a = auc(long, "v", "y", ["capture_mode", "k"])
    col = lambda k: F.max(F.when(F.col("k") == k, F.col("auc")))
    size = lambda k: F.max(F.when(F.col("k") == k, F.col("n_pos") + F.col("n_neg")))
    out = a.groupBy("capture_mode").agg(
        size("fused").alias("n"),
        col("id_forensics").alias("id_forensics_auc"),
        F.when(size("tamper_only") > min_n, col("tamper_only")).alias("tamper_only_auc"),
        col("fused").alias("fusion_auc"),
    )
    return out.filter(F.col("n") >= min_n)


def bias_audit(df: DataFrame, reject: float, min_n: int = 5) -> DataFrame:
    tagged = df.withColumn("bucket", tone_bucket(F.col("tone_angle")))
    agg = tagged.groupBy("bucket").agg(
        F.count(L(1)).alias("n"),
        *confusion_columns(F.col("score"), F.col("y"), reject),
        F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("mean_genuine"),
    )
    a = auc(tagged, "score", "y", ["bucket"]).select("bucket", "auc")
    shown = lambda c: F.when(F.col("n") >= min_n, F.col(c)).alias(c)
    return rates(agg).join(a, "bucket").select("bucket", "n", *[shown(c) for c in ("auc", "false_reject_rate", "false_accept_rate", "mean_genuine")])


def distribution(df: DataFrame, value: str, by: list[str] | None = None, probs: dict | None = None) -> DataFrame:
    probs = probs or {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p9999": 0.9999}
    return exact_percentiles(df, by or [], value, probs, stats=True)


def leak_audit(manifest: DataFrame, fields: list[str], label: str = "y", allow: dict = K.FRAUD_ONLY_VALUES, min_n: int = 10) -> DataFrame:
    """Class balance per categorical value; flags values that appear on one class only."""
    long = manifest.select(F.col(label).alias("__y"), F.explode(F.array(*[F.struct(L(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("e"))
    table = long.select("__y", "e.field", "e.value").filter(F.col("value").isNotNull()).groupBy("field", "value").agg(
        count_when(F.col("__y") == 0).alias("genuine"), count_when(F.col("__y") == 1).alias("fraud")
    )
    total = F.col("genuine") + F.col("fraud")
    p = F.col("fraud") / total
    one_sided = (total >= min_n) & ((p == 0) | (p == 1))
    why = F.try_element_at(literal_map(allow), F.col("value")) if allow else L(None).cast("string")
    size = manifest.agg(F.count(L(1)).alias("__size"))
    return table.crossJoin(F.broadcast(size)).select(  # one row
        "field", "value", "genuine", "fraud", p.alias("p_fraud"), one_sided.alias("one_sided"),
        F.when(one_sided, F.when(p == 1, "fraud").otherwise("genuine")).alias("only_class"),
        (one_sided & why.isNotNull()).alias("expected"), why.alias("justification"),
        (F.when(one_sided, total).otherwise(0) / F.greatest(F.col("__size"), L(1))).alias("share_of_corpus"),
    )


def balance_gate(audit: DataFrame) -> DataFrame:
    """Complaints of the build gate: unexpected one-sided values."""
    who = F.when(F.col("only_class") == "fraud", "fraudulent").otherwise("genuine")
    text = F.concat(F.col("field"), L("="), F.col("value"), L(" appears on "), (F.col("genuine") + F.col("fraud")).cast("string"), L(" packets, all "), who)
    return audit.filter(F.col("one_sided") & ~F.col("expected")).select("field", "value", text.alias("complaint"))


def leak_view(audit: DataFrame) -> DataFrame:
    """Per field: how many leaks and expected one-sided values, whether it is clean, and whether every field is."""
    leak, fine = F.col("one_sided") & ~F.col("expected"), F.col("one_sided") & F.col("expected")
    fields = audit.groupBy("field").agg(
        count_when(leak).alias("leaks"), count_when(fine).alias("expected_one_sided"), (count_when(leak) == 0).alias("clean"), F.sum("share_of_corpus").alias("share_of_corpus")
    )
    return fields.crossJoin(F.broadcast(audit.agg((count_when(leak) == 0).alias("corpus_clean"))))  # one row


def ranked_detectors(ablation: DataFrame) -> DataFrame:
    """ablation (detector, auc_drop, ...) ranked by the AUC that muting costs; harmful: muting helped."""
    order = Window.orderBy(F.desc("auc_drop"), "detector")  # one row a detector
    return ablation.withColumn("rank", F.row_number().over(order)).withColumn("harmful", F.col("auc_drop") < 0)


def family_report(df: DataFrame, family: str = "family", points=(0.4, 0.5, 0.75)) -> DataFrame:
    """Per generator family against the one genuine control (y = 0)."""
    s = F.col("score")
    name = lambda p, t: f"{p}_{int(round(t * 100))}"
    out = one_vs_control(df, family, "score", "y", [F.avg(s).alias("mean_fake"), *[F.avg((s >= t).cast("int")).alias(name("recall", t)) for t in points]])
    control = df.filter(F.col("y") == 0).agg(F.count(L(1)).alias("n_real"), F.avg(s).alias("mean_real"), *[F.avg((s >= t).cast("int")).alias(name("fpr", t)) for t in points])
    return out.crossJoin(F.broadcast(control))  # one row


def family_headline(report: DataFrame, family: str = "family", value: str = "auc_vs_control") -> DataFrame:
    r = report.filter(F.col(value).isNotNull())
    v = F.col(value)
    return r.agg(
        F.min_by(family, F.struct(v, F.col(family))).alias("worst_family"), F.min(v).alias("worst_auc"),
        F.max_by(family, F.struct(v, F.col(family))).alias("best_family"), F.max(v).alias("best_auc"), (F.max(v) - F.min(v)).alias("spread"),
    )


def group_shortcut_report(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Two genuine populations: how far apart a detector scores them."""
    s = F.col(score)
    basic = df.groupBy(group).agg(F.stddev_pop(s).alias("std"), *[F.avg((s >= t).cast("int")).alias(f"share_{int(t * 100)}") for t in (0.4, 0.5, 0.75)])
    dist = exact_percentiles(df, [group], score, {"median": 0.5, "p90": 0.9}, stats=True).select(group, "n", "mean", "median", "p90")
    return basic.join(dist, group)


def explained_by_control(naive: Column, controlled: Column) -> Column:
    return (F.abs(naive - 0.5) - F.abs(controlled - 0.5)) / F.greatest(L(1e-9), F.abs(naive - 0.5))


def signal_auc_report(df: DataFrame, signals: list[str], label: str = "y") -> DataFrame:
    long = df.unpivot([label], signals, "signal", "value").filter(F.col("value").isNotNull())
    return auc(long, "value", label, ["signal"]).filter(F.col("auc").isNotNull())


def region_hits(docs: DataFrame, top_k: int = 3, cover: float = 0.25) -> DataFrame:
    """Does one of the largest flagged boxes cover a quarter of the true one; best overlap.

    Works inside the row: `regions` is an array of structs with area_frac and box.
    """
    order = F.array_sort(F.transform("regions", lambda r, i: F.struct((-r["area_frac"]).alias("k"), i.alias("i"), r["box"].alias("box"))))
    top = F.slice(order, 1, top_k)
    best = F.coalesce(F.array_max(F.transform(top, lambda r: iou(r["box"], F.col("truth")))), L(0.0))
    hit = F.exists(top, lambda r: box_cover(r["box"], F.col("truth")) >= cover)
    return docs.select(*[c for c in docs.columns if c not in ("regions", "truth")], hit.alias("hit"), best.alias("best_iou"))


def tamper_report(df: DataFrame) -> DataFrame:
    """AUC, flag rates and localisation over three independent slices (capture, doc_type) and overall.

    Rows without a tamper score (not scored) are left out.  hit and iou are null where there is
    no true region; layout is the layout sub-score.
    """
    df = df.filter(F.col("tamper").isNotNull() & F.col("y").isNotNull())
    slices = F.array(
        F.struct(L("all").alias("slice"), L("all").alias("value")),
        F.struct(L("capture").alias("slice"), F.col("capture").alias("value")),
        F.struct(L("doc_type").alias("slice"), F.col("doc_type").alias("value")),
    )
    long = df.select("*", F.explode(slices).alias("e")).select("*", "e.slice", "e.value")
    by = ["slice", "value"]
    gen = F.col("y") == 0
    flags = long.groupBy(*by).agg(
        F.count(L(1)).alias("n"),
        F.avg(F.when(gen, ((F.col("tamper") > 0.45) & (F.col("n_regions") > 0)).cast("int"))).alias("false_flag_rate"),
        F.avg(F.when(F.col("hit").isNotNull(), F.col("hit").cast("int"))).alias("localised_rate"),
        F.avg(F.when(F.col("hit").isNotNull(), F.col("iou"))).alias("mean_best_iou"),
        F.avg(F.when(gen, (F.col("layout") > 0).cast("int"))).alias("layout_flag_rate"),
        *[F.avg(F.when(F.col("y") == 1, (F.col("tamper") >= t).cast("int"))).alias(f"recall_{int(t * 100)}") for t in (0.3, 0.45, 0.6)],
        *[F.avg(F.when(gen, (F.col("tamper") >= t).cast("int"))).alias(f"fpr_{int(t * 100)}") for t in (0.3, 0.45, 0.6)],
    )
    views = F.explode(F.array(F.struct(L("detector").alias("k"), F.col("score").alias("v")), F.struct(L("tamper").alias("k"), F.col("tamper").alias("v"))))
    a = auc(long.select(*by, "y", views.alias("m")).select(*by, "y", "m.k", "m.v"), "v", "y", [*by, "k"])
    wide = a.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("auc"))).alias(f"{k}_auc") for k in ("detector", "tamper")])
    return flags.join(wide, by)


def tamper_by_attack(df: DataFrame) -> DataFrame:
    """Per attack class, each against the whole genuine pool: n, AUC of both scores, mean tamper score, localisation."""
    df = df.filter(F.col("tamper").isNotNull() & F.col("y").isNotNull())
    seen = F.col("hit").isNotNull()
    extra = [F.avg("tamper").alias("mean_tamper"), F.avg(F.when(seen, F.col("hit").cast("int"))).alias("localised_rate"), F.avg(F.when(seen, F.col("iou"))).alias("mean_best_iou")]
    one = one_vs_control(df, "attack", "score", "y", extra).withColumnRenamed("auc_vs_control", "detector_auc")
    two = one_vs_control(df, "attack", "tamper", "y", []).select("attack", F.col("auc_vs_control").alias("tamper_auc"))
    return one.select("attack", "n", "detector_auc", "mean_tamper", "localised_rate", "mean_best_iou").join(two, "attack")


def model_leaderboard(df: DataFrame) -> DataFrame:
    """Per model AUC, class means and time per item; marks the selected neural model."""
    base = df.groupBy("model", "kind").agg(
        F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("mean_real"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("mean_fake"), F.avg("ms").alias("ms_per_item")
    )
    full = base.join(auc(df, "score", "y", ["model"]).select("model", "auc"), "model")
    neural = full.filter((F.col("kind") == "neural") & F.col("auc").isNotNull())
    best = neural.agg(F.max_by("model", F.struct("auc", "model")).alias("selected"), F.max("auc").alias("top"))
    return full.crossJoin(F.broadcast(best)).select(  # one row
        *full.columns, (F.col("model") == F.col("selected")).alias("selected"), F.coalesce((F.col("model") == F.col("selected")) & (F.col("top") < 0.6), L(False)).alias("near_chance")
    )


def region_z_diagnostic(cells: DataFrame, doc: str = "doc_id", attack: str = "attack") -> DataFrame:
    """Mean z inside and outside the edited box per document, then per attack class."""
    per_doc = cells.groupBy(doc, attack).agg(
        F.avg(F.when(F.col("inside"), F.col("z"))).alias("zi"), F.avg(F.when(~F.col("inside"), F.col("z"))).alias("zo"), F.max("z").alias("peak")
    ).filter(F.col("zi").isNotNull() & F.col("zo").isNotNull())
    diff = F.col("zi") - F.col("zo")
    agg = per_doc.groupBy(attack).agg(
        F.count(L(1)).alias("n"), F.avg("zi").alias("mean_inside"), F.avg("zo").alias("mean_outside"), F.avg(diff).alias("mean_difference"), F.avg((diff > 0).cast("int")).alias("share_hotter")
    )
    med = exact_percentiles(per_doc, [attack], "peak", {"median_peak": 0.5})
    return agg.join(med, attack)


def layout_consistency(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Typography checks per document from its recognised words; unchecked under four."""
    tall = F.col("y2") > F.col("y1")
    h = F.when(tall, (F.col("y2") - F.col("y1")).cast("double"))
    agg = words.groupBy(doc).agg(
        F.count(L(1)).alias("words"), F.count(h).alias("tall"), F.stddev_pop(h).alias("sd"), F.avg(h).alias("mh"),
        F.stddev_pop(F.rint(F.col("x1") / 8.0)).alias("left_spread"), F.avg(F.coalesce("conf", L(0.0))).alias("mean_conf"),
    )
    checked = (F.col("words") >= 4) & (F.col("tall") >= 4)
    cv = F.col("sd") / (F.col("mh") + 1e-6)
    from ..functions.scoring import layout_score

    return agg.select(
        doc, checked.alias("checked"), F.col("words").alias("word_count"), F.when(checked, cv).alias("height_cv"),
        F.when(checked, F.col("left_spread")).alias("left_spread"), F.when(checked, F.col("mean_conf")).alias("mean_conf"), layout_score(checked, cv).alias("layout_score"),
    )


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(L(k).alias("field"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e"))
    return long.groupBy("e.field", "e.value").agg(F.count(L(1)).alias("n"))


def latency_report(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return exact_percentiles(df.filter(F.col(value) > 0), by, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, stats=True)
