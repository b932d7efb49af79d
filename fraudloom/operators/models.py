"""Models: fusion, calibration, ablation, keystroke and spectral heads; logistic ones are fitted side by side."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions.scalars import clamp01, dig_json
from .durable import cut
from .metrics import auc, average_precision
from .newton import Fit, Linear, fit_many, load, save, score_by
from .ordered import exact_percentiles
from .sampling import leave_one_group_out, stratified_folds, subject_split

L = F.lit
FUSION_FEATURES = [f"{d}_{s}" for d in K.FUSED_DETECTORS for s in ("score", "conf")]


def probability(c: str = "probability") -> Column:
    return vector_to_array(F.col(c))[1]


def alike(df: DataFrame, cols: list[str]) -> DataFrame:
    """Equal rows once, with their number as `copies`: a fit reads its rows once an iteration."""
    return df.groupBy(*cols).agg(F.count(L(1)).alias("copies"))


def platt_fit(scored: DataFrame, score: str = "p", label: str = "y", count: str | None = None) -> Linear:
    """One-feature logistic curve on out-of-fold scores; strictly monotone."""
    return fit_many(scored, [score], [Fit("platt")], label, balanced=False, standardise=False, count=count)["platt"]


def platt_predict(model: Linear, scored: DataFrame, out: str = "calibrated") -> DataFrame:
    return scored.withColumn(out, clamp01(model.probability()))


def fold_fits(folds: int, fold: str = "fold", muted: tuple[str, ...] = (), tag: str = "") -> list[Fit]:
    """One fit on all rows and one without each fold."""
    return [Fit(f"{tag}all", muted=muted), *[Fit(f"{tag}{i}", ((fold, i),), muted=muted) for i in range(folds)]]


def out_of_fold(df: DataFrame, features: list[str], folds: int, fold: str = "fold", label: str = "y", balanced: bool = True, calibrate: bool = False) -> DataFrame:
    """Each row scored by a model that never saw its fold; all folds are fitted in the same jobs.

    With `calibrate`, every fold's calibrator comes from an inner split of the fold's own
    training rows: the fits of all (fold, inner fold) pairs are one batch too.
    """
    key = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    if not calibrate:
        df = cut(df)  # the fit reads it once an iteration
        return score_by(df, fit_many(df, features, fold_fits(folds, fold), label, balanced), key(fold))
    inner = cut(stratified_folds(df.withColumnRenamed(fold, "__outer"), 3, label).withColumnRenamed("fold", "__inner"))
    pairs = [Fit(f"{i}|{k}", (("__outer", i), ("__inner", k))) for i in range(folds) for k in range(3)]
    rows = cut(alike(inner, [label, *features, "__outer", "__inner"]))
    models = fit_many(rows, features, [*fold_fits(folds, "__outer"), *pairs], label, balanced, count="copies")
    # every row under the models of the folds that it trains, each without the row's inner fold
    long = rows.withColumn("__held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter(F.col("__held") != F.col("__outer"))
    raw = cut(score_by(long, models, key("__held", "__inner")).select("__held", "p", label, "copies"))
    curves = fit_many(raw, ["p"], [Fit(str(i), only=(("__held", i),)) for i in range(folds)], label, balanced=False, standardise=False, count="copies")
    first = score_by(inner, models, key("__outer"))
    return score_by(first, curves, key("__outer"), "__c").withColumn("p", clamp01(F.col("__c"))).withColumnRenamed("__outer", fold).drop("__inner", "__c")


def fit_logistic(train: DataFrame, features: list[str], label: str = "y", balanced: bool = True) -> Linear:
    return fit_many(train, features, [Fit("all")], label, balanced)["all"]


class FusionModel:
    """A fitted fusion model with its feature order and calibrator."""

    def __init__(self, model: Linear, calibrator: Linear):
        self.model, self.calibrator, self.features = model, calibrator, model.features

    def score(self, wide: DataFrame) -> DataFrame:
        """ML3: by-name features, calibrated, clipped to [0, 1]."""
        missing = [n for n in self.features if n not in wide.columns]
        if missing:
            raise ValueError(f"columns the model needs are absent: {missing}")
        return platt_predict(self.calibrator, wide.withColumn("p", self.model.probability()), "fused").drop("p")

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.features, self.model.coefficients))

    def save(self, spark: SparkSession, path: str) -> None:
        save(spark, path, model=self.model, calibrator=self.calibrator)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FusionModel":
        return cls(**load(spark, path))


def score_or_fuse(model: FusionModel | None, wide: DataFrame, heuristic: DataFrame) -> DataFrame:
    """The model's score, or, without a model, the weighted heuristic (id, fused); `fusion` says which."""
    if model is not None:
        return model.score(wide).withColumn("fusion", L("model"))
    return wide.join(heuristic.select("id", "fused"), "id", "left").withColumn("fusion", L("heuristic"))


def train_fusion(train: DataFrame, features: list[str] = FUSION_FEATURES, folds: int = 5, label: str = "y", seed: int = 0) -> FusionModel:
    """Balanced logistic regression; Platt calibration on out-of-fold predictions. Final and fold fits share their jobs."""
    rows = cut(alike(stratified_folds(train.select("id", label, *features), folds, label, seed), [label, *features, "fold"]))
    models = fit_many(rows, features, fold_fits(folds), label, count="copies")
    oof = cut(score_by(rows, models, F.col("fold").cast("string")).groupBy("p", label).agg(F.sum("copies").alias("copies")))
    return FusionModel(models["all"], platt_fit(oof, "p", label, "copies"))


def ablate(train: DataFrame, test: DataFrame, detectors=K.FUSED_DETECTORS, folds: int = 5, label: str = "y") -> DataFrame:
    """Held-out AUC with each detector muted, its drop, and its share of the above-chance part.

    All (detectors + 1) x (folds + 1) fits are one batch, all calibrators another.
    """
    rows = cut(alike(stratified_folds(train.select("id", label, *FUSION_FEATURES), folds, label), [label, *FUSION_FEATURES, "fold"]))
    names = ["", *detectors]
    fits = [f for n in names for f in fold_fits(folds, muted=(f"{n}_score", f"{n}_conf") if n else (), tag=f"{n}|")]
    models = fit_many(rows, FUSION_FEATURES, fits, label, count="copies")
    each = F.explode(F.array(*[F.struct(L(i).alias("code"), L(n).alias("muted")) for i, n in enumerate(names)])).alias("e")
    long = rows.select("fold", label, "copies", *FUSION_FEATURES, each).select("*", "e.code", "e.muted")
    oof = cut(score_by(long, models, F.concat("muted", L("|"), F.col("fold").cast("string"))).groupBy("code", "p", label).agg(F.sum("copies").alias("copies")))
    curves = fit_many(oof, ["p"], [Fit(n, only=(("code", i),)) for i, n in enumerate(names)], label, balanced=False, standardise=False, count="copies")
    held = score_by(alike(test, [label, *FUSION_FEATURES]).select(label, "copies", *FUSION_FEATURES, each).select("*", "e.muted"), models, F.concat("muted", L("|all")))
    held = score_by(held, curves, F.col("muted"), "fused").withColumn("fused", clamp01(F.col("fused")))
    out = auc(held, "fused", label, ["muted"], "copies").select("muted", "auc")
    full = out.filter("muted = ''").select(F.col("auc").alias("full_auc"))
    drop = F.col("full_auc") - F.col("auc")
    return out.filter("muted <> ''").crossJoin(F.broadcast(full)).select(  # one row
        F.col("muted").alias("detector"), "full_auc", "auc", drop.alias("auc_drop"), (drop / F.greatest(L(1e-9), F.col("full_auc") - 0.5)).alias("share_above_chance")
    )


# --- keystroke model -------------------------------------------------------------
def keystroke_pipeline(features: list[str] = K.CORE_FEATURES, depth: int = 3, trees: int = 30, step: float = 0.1, label: str = "y", seed: int = 0) -> Pipeline:
    gbt = GBTClassifier(featuresCol="v", labelCol=label, maxDepth=depth, maxIter=trees, stepSize=step, subsamplingRate=0.9, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="v"), gbt])


def score_keystrokes(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", probability()).select(*df.columns, "p")


def keystroke_report(scored: DataFrame, threshold: float, label: str = "y") -> DataFrame:
    """auc, average precision, recall on automation and false alarms on people at a threshold."""
    y, hit = F.col(label), (F.col("p") >= threshold).cast("int")
    r = scored.agg(F.avg(F.when(y == 1, hit)).alias("recall"), F.avg(F.when(y == 0, hit)).alias("fpr"))
    return auc(scored, "p", label).crossJoin(F.broadcast(average_precision(scored, "p", label).select("ap"))).crossJoin(F.broadcast(r))  # one row each


def keystroke_protocols(df: DataFrame, features: list[str], budget: float = 0.01, label: str = "y", seed: int = 0) -> DataFrame:
    """The three protocols over one feature set, logistic form, all fits in one batch.

    df: subject, y, strategy (automation only, null for people), population (int, people only:
    0 is the home population, 1 the one for transfer), features.  Rows (protocol, held_out,
    n_people, n_automation, auc, threshold, recall, false_positive_rate):
    * held_out: subject-disjoint test set of both classes;
    * leave_one_strategy_out: each strategy against people held out by another draw;
    * transfer: a fit without population 1, threshold from population 0, rates on population 1.
    A threshold is the 1 - budget percentile of the people scored by the same fit, at least 0.5.
    """
    y = F.col(label)
    first = subject_split(df, "subject", label, seed=seed).withColumnRenamed("held_out", "__test")
    both = subject_split(first, "subject", label, seed=seed + 7).withColumnRenamed("held_out", "__people")
    plan = leave_one_group_out(both.filter(y == 1), "strategy")
    codes = plan.select("strategy", F.col("code").alias("__strategy"))
    rows = cut(both.join(codes, "strategy", "left").withColumns({"__held": F.col("__test").cast("int"), "__pop": F.when(y == 0, F.col("population"))}).select(label, "strategy", *features, "__held", "__people", "__strategy", "__pop"))
    groups = [(r.strategy, r.code) for r in plan.collect()]  # at most 1,000, which leave_one_group_out makes sure of
    fits = [Fit("held_out", (("__held", 1),)), Fit("transfer", (("__pop", 1),)), *[Fit(f"without {c}", (("__strategy", c),)) for _, c in groups]]
    models = fit_many(rows, features, fits, label)
    people = F.col("__people") & (y == 0)
    as_test, as_people = F.when(F.col("__held") == 1, F.array(L("held_out"))), F.when(people, F.array(*[L(f"without {c}") for _, c in groups]).cast("array<string>"))
    own = F.when(F.col("__strategy").isNotNull(), F.array(F.concat(L("without "), F.col("__strategy").cast("string"))))
    move = F.when(y == 0, F.array(L("transfer")))
    long = rows.withColumn("fit", F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (as_test, as_people, own, move)])))
    scored = cut(score_by(long, models, F.col("fit")).select("fit", label, "__pop", "p"))
    judge = (y == 0) & ((F.col("fit") != "transfer") | (F.coalesce("__pop", L(0)) == 0))
    limit = exact_percentiles(scored.filter(judge), ["fit"], "p", {"q": 1.0 - budget}).select("fit", F.greatest("q", L(0.5)).alias("threshold"))
    shown = scored.filter((F.col("fit") != "transfer") | (F.col("__pop") == 1))
    hit = (F.col("p") >= F.col("threshold")).cast("int")
    rates = shown.join(limit, "fit").groupBy("fit", "threshold").agg(
        F.count(F.when(y == 0, 1)).alias("n_people"), F.count(F.when(y == 1, 1)).alias("n_automation"), F.avg(F.when(y == 1, hit)).alias("recall"), F.avg(F.when(y == 0, hit)).alias("false_positive_rate")
    )
    name = plan.select(F.concat(L("without "), F.col("code").cast("string")).alias("fit"), F.col("strategy").alias("held_out"))
    out = rates.join(auc(shown, "p", label, ["fit"]).select("fit", "auc"), "fit", "left").join(name, "fit", "left")
    protocol = F.when(F.col("fit").startswith("without "), "leave_one_strategy_out").otherwise(F.col("fit"))
    return out.select(protocol.alias("protocol"), "held_out", "n_people", "n_automation", "auc", "threshold", "recall", "false_positive_rate")


def keystroke_sweep(fit_on: DataFrame, transfer: DataFrame, configs: list[dict], budget: float, features=K.CORE_FEATURES, label: str = "y") -> DataFrame:
    """Per configuration: operating threshold on the fitted people, false alarms on unseen people."""
    from .calibrate import threshold_for_fpr

    out = None
    for i, c in enumerate(configs):
        model = keystroke_pipeline(features, label=label, **c).fit(fit_on)
        t = threshold_for_fpr(score_keystrokes(model, fit_on.filter(F.col(label) == 0)), budget, "p")
        fpr = score_keystrokes(model, transfer).crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.avg((F.col("p") >= F.col("threshold")).cast("int")).alias("transfer_fpr"))  # one row
        row = fpr.select(L(i).alias("config"), L(c.get("depth", 3)).alias("depth"), L(c.get("trees", 30)).alias("trees"), "threshold", "transfer_fpr")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("transfer_fpr", "trees", "depth")


# --- spectral and fingerprint heads -------------------------------------------------
def train_spectral(df: DataFrame, features: list[str], label: str = "y") -> Linear:
    return fit_logistic(df, features, label, balanced=True)


def train_fingerprint(df: DataFrame, features: list[str], label: str = "generator", min_rows: int = 8) -> PipelineModel:
    """Multinomial logistic regression over the generators with enough rows, every generator with the same weight."""
    from pyspark.ml.feature import StringIndexer

    big = df.groupBy(label).agg(F.count(L(1)).alias("__n")).filter(F.col("__n") >= min_rows)
    kept = df.join(big.select(label, (1.0 / F.col("__n")).alias("__w")), label)
    lr = LogisticRegression(featuresCol="z", labelCol="g", weightCol="__w", family="multinomial", regParam=0.001, maxIter=50)
    stages = [StringIndexer(inputCol=label, outputCol="g", handleInvalid="skip"), VectorAssembler(inputCols=features, outputCol="v"), StandardScaler(inputCol="v", outputCol="z", withMean=True), lr]
    return Pipeline(stages=stages).fit(kept)


# --- ML8 -----------------------------------------------------------------------------
def check_claims(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """claims(claim, report, path, scale, stated) against reports(report, body JSON).

    A claim holds within 0.0006 x scale; a missing report or path fails.
    """
    j = claims.join(reports, "report", "left")
    found = dig_path(F.col("body"), F.col("path")).try_cast("double") * F.col("scale")
    ok = F.coalesce(F.abs(found - F.col("stated")) <= 0.0006 * F.col("scale"), L(False))
    return j.select("claim", "report", "path", "stated", found.alias("found"), ok.alias("holds"))


def dig_path(js: Column, path: Column) -> Column:
    """JSON value at a dotted path held in a column; numeric steps index lists."""
    steps = F.transform(F.split(path, r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(L("["), p, L("]"))).otherwise(F.concat(L("['"), p, L("']"))))
    return F.call_function("get_json_object", js, F.concat(L("$"), F.array_join(steps, "")))
