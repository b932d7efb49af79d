"""Model queries.  Fits are iterative, so their checks are on stated bounds: the rows every fit saw, a
vanishing gradient, budgets kept.  Coefficients are compared with separate fits in the tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..operators import metrics as M
from ..operators import models as D
from ..operators import newton as W
from ..operators import sampling as G
from ..operators import scoring as R
from ..operators import telemetry as T
from ..operators.durable import cut
from ..operators.sampling import group_folds, stratified_folds, subject_split
from . import bindings as B
from .bindings import OUTPUTS, with_ctes
from .registry import query

L = F.lit
SMALL = 1e-6  # largest gradient of the mean loss at which a fit counts as converged

LABELLED = """feat AS (SELECT submission_id AS id, coalesce(max(score) FILTER (detector = 'selfie_deepfake' AND status = 'ok'), 0) AS selfie, coalesce(max(score) FILTER (detector = 'id_forensics' AND status = 'ok'), 0) AS doc FROM outputs GROUP BY 1),
 labelled AS (SELECT id, (selfie + doc * 1.5::DOUBLE + (id * 7919 % 1000) / 1000.0::DOUBLE > 1.1::DOUBLE)::INT AS y, id % 50 AS identity FROM feat), train AS (SELECT * FROM labelled WHERE identity < 33), test AS (SELECT * FROM labelled WHERE identity >= 33),
 classes AS (SELECT y, count(*) AS c FROM train GROUP BY y), perfold AS (SELECT i, sum(ceil((c - i) / 5.0))::BIGINT AS held FROM classes, range(0, 5) r(i) GROUP BY i)"""


def labelled_features(t):
    """Detector features with a label that the selfie and document scores partly explain."""
    w = R.wide_outputs(B.detector_outputs(t))
    noise = (F.col("submission_id") * 7919 % 1000) / 1000.0
    y = (F.col("selfie_deepfake_score") + F.col("id_forensics_score") * 1.5 + noise > 1.1).cast("int")
    return cut(w.select(F.col("submission_id").alias("id"), y.alias("y"), (F.col("submission_id") % 50).alias("identity"), *D.FUSION_FEATURES))


def train_test(t):
    df = labelled_features(t)
    return df.filter("identity < 33"), df.filter("identity >= 33")


def fit_rows(spark, models):
    return spark.createDataFrame([(k, m.rows, m.gradient < SMALL) for k, m in models.items()], "fit string, rows bigint, converged boolean")


@query("ml1_train_fusion", with_ctes(OUTPUTS, LABELLED) + "SELECT 'all' AS fit, sum(c)::BIGINT AS rows, true AS converged FROM classes UNION ALL SELECT i::VARCHAR, (SELECT sum(c) FROM classes)::BIGINT - held, true FROM perfold")
def train_fusion(t):
    """The rows that the final fit and each of five fold fits saw, all fitted in the same jobs."""
    folded = cut(stratified_folds(train_test(t)[0], 5))
    return fit_rows(t.spark, W.fit_many(folded, D.FUSION_FEATURES, D.fold_fits(5)))


@query("ml1_held_out_auc", with_ctes(OUTPUTS, LABELLED) + "SELECT count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos, true AS explains FROM test")
def fusion_auc(t):
    train, test = train_test(t)
    return M.auc(D.train_fusion(train).score(test), "fused", "y").select("n_neg", "n_pos", (F.col("auc") > 0.75).alias("explains"))


@query("ml2_platt_calibration", with_ctes(OUTPUTS, LABELLED) + "SELECT count(*) AS n, sum(y)::BIGINT AS positives, true AS mean_kept, true AS rising FROM labelled")
def platt(t):
    """Five-fold scores; the fitted curve keeps the mean of the label and rises."""
    p = cut(D.out_of_fold(stratified_folds(labelled_features(t), 5), D.FUSION_FEATURES, 5).select("p", "y"))
    curve = D.platt_fit(p)
    c = D.platt_predict(curve, p)
    return c.agg(F.count(L(1)).alias("n"), F.sum("y").alias("positives"), (F.abs(F.avg("calibrated") - F.avg("y")) < 1e-3).alias("mean_kept"), L(curve.coefficients[0] > 0).alias("rising"))


@query("ml3_score_fusion", with_ctes(OUTPUTS, LABELLED) + "SELECT id, y, true AS scored FROM test")
def score_fusion(t):
    train, test = train_test(t)
    return D.train_fusion(train).score(test).select("id", "y", F.col("fused").between(0, 1).alias("scored"))


@query("ml3_heuristic_fallback", with_ctes(OUTPUTS, """w AS (SELECT * FROM (VALUES %s) w(detector, w))""" % ", ".join(f"('{d}', {w}::DOUBLE)" for d, w in K.FUSION_WEIGHTS.items())) + """SELECT submission_id AS id, 'heuristic' AS fusion, CASE WHEN den > 0 THEN least(1, 0.65 * num / den + 0.35 * loud) ELSE 0.5 END::DOUBLE AS fused FROM
 (SELECT submission_id, sum(w * greatest(confidence, 0.05) * score) FILTER (status = 'ok') AS num, sum(w * greatest(confidence, 0.05)) FILTER (status = 'ok') AS den, coalesce(max(score) FILTER (status = 'ok' AND confidence >= 0.5), 0) AS loud FROM outputs JOIN w USING (detector) GROUP BY 1)""")
def fallback(t):
    """Without a fitted model the weighted heuristic decides."""
    o = B.detector_outputs(t)
    h = R.heuristic_fuse(o).select(F.col("submission_id").alias("id"), "fused")
    return D.score_or_fuse(None, R.wide_outputs(o).select(F.col("submission_id").alias("id")), h).select("id", "fusion", "fused")


@query("ml4_ablation", "SELECT detector, detector IN ('selfie_deepfake', 'id_forensics') AS matters FROM (VALUES %s) d(detector)" % ", ".join(f"('{d}')" for d in K.FUSED_DETECTORS))
def ablation(t):
    """Seven settings of six fits each, one batch; only the detectors behind the label lose over 0.02 of AUC when muted."""
    train, test = train_test(t)
    return D.ablate(train, test).select("detector", (F.col("auc_drop") > 0.02).alias("matters"))


# --- typing: two segments of customers against the others ------------------------------------
TYPISTS = """who AS (SELECT DISTINCT user_id, c_nationkey, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT AS y FROM events JOIN customer ON user_id = c_custkey)"""


def typing_population(t):
    """Sessions labelled by their customer's segment; the nation gives strategy (label 1) and population (label 0)."""
    f = T.keystroke_features(B.key_events(t), 5000.0)
    who = t.customer.select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("y"), "c_nationkey")
    j = f.join(who, "session")
    nation = F.col("c_nationkey")
    strategy = F.when(F.col("y") == 1, F.concat(L("s"), (nation % 5).cast("string")))
    return cut(j.select("session", "y", strategy.alias("strategy"), F.when(F.col("y") == 0, (nation % 2).cast("int")).alias("population"), F.col("session").cast("string").alias("subject"), *K.CORE_FEATURES, *K.CONTEXT_FEATURES))


FEATURE_SETS = {"core": K.CORE_FEATURES, "core_and_context": [*K.CORE_FEATURES, *K.CONTEXT_FEATURES]}
BUDGET = 0.05


@query("ml5_protocols", with_ctes(TYPISTS) + """SELECT features, protocol, held_out, n, within_budget FROM (VALUES ('core'), ('core_and_context')) f(features), (
 SELECT 'leave_one_strategy_out' AS protocol, 's' || (c_nationkey % 5) AS held_out, count(*) AS n, true AS within_budget FROM who WHERE y = 1 GROUP BY ALL UNION ALL SELECT 'transfer', NULL, count(*), NULL FROM who WHERE y = 0 AND c_nationkey % 2 = 1 UNION ALL SELECT 'held_out', NULL, NULL, true)""")
def protocols(t):
    """Protocols 1 to 3 over both feature sets: sizes, and whether people keep to the budget at the threshold read on them."""
    f, out = typing_population(t), None
    for name, features in FEATURE_SETS.items():
        p = D.keystroke_protocols(f, features, BUDGET)
        n = F.when(F.col("protocol") == "transfer", F.col("n_people")).when(F.col("protocol") == "leave_one_strategy_out", F.col("n_automation"))
        kept = F.when(F.col("protocol") != "transfer", F.col("false_positive_rate") <= BUDGET + 1.0 / F.col("n_people"))
        rows = p.select(L(name).alias("features"), "protocol", "held_out", n.cast("bigint").alias("n"), kept.alias("within_budget"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ml5_penalty_sweep", with_ctes(TYPISTS) + "SELECT i AS config, (SELECT count(*) FROM who)::BIGINT AS rows, true AS converged FROM range(0, 25) r(i)")
def penalties(t):
    """Twenty-five penalties from 0.001 to 1,000, fitted side by side."""
    fits = [W.Fit(str(i), penalty=10.0 ** (i / 4 - 3)) for i in range(25)]
    models = W.fit_many(typing_population(t), FEATURE_SETS["core_and_context"], fits)
    return fit_rows(t.spark, models).select(F.col("fit").cast("bigint").alias("config"), "rows", "converged")


@query("ml5_keystroke_model")
def keystroke(t):
    """Boosted form, with the operator's 30 trees."""
    f = subject_split(typing_population(t), "subject", "y")
    model = D.keystroke_pipeline().fit(f.filter(~F.col("held_out")))
    return D.keystroke_report(D.score_keystrokes(model, f.filter("held_out")), 0.5)


@query("ml5_sweep")
def sweep(t):
    f = typing_population(t).withColumn("held", F.coalesce(F.col("population") == 1, L(False)))
    grid = [{"depth": d, "trees": n} for d in (2, 3) for n in (15, 30)]
    return D.keystroke_sweep(f.filter("NOT held"), f.filter("held"), grid, BUDGET)


@query("sp4_leave_one_group_out", with_ctes(TYPISTS) + "SELECT 's' || (c_nationkey % 5) AS strategy, (SELECT count(*) FROM who) - count(*) AS n_train, count(*) AS n_test FROM who WHERE y = 1 GROUP BY 1")
def left_out(t):
    f = typing_population(t)
    return G.leave_one_group_out(f, "strategy").select("strategy", "n_train", "n_test")


@query("jn14_score_identity_join", """WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id))
SELECT id, split, id // 7 AS identity, CASE WHEN id % 3 = 0 THEN 'scan' ELSE 'photo' END AS capture, split = 'train' AS folded, 'identity' AS fold_kind FROM s""")
def identity_join(t):
    """Every training row has a fold, and no identity is in two."""
    s = B.scored(t).select("id", "y", F.when(F.col("id") % 4 == 3, "test").otherwise("train").alias("split"))
    d = F.col("doc_id")
    m = t.documents.select(d.alias("id"), F.floor(d / 7).alias("identity"), F.when(d % 3 == 0, "scan").otherwise("photo").alias("capture"))
    j = cut(G.score_identity_join(s, m))
    torn = j.filter("fold IS NOT NULL").groupBy("identity").agg(F.countDistinct("fold").alias("k")).filter("k > 1").select("identity", L(True).alias("torn"))
    return j.join(torn, "identity", "left").select("id", "split", "identity", "capture", (F.col("fold").isNotNull() & F.col("torn").isNull()).alias("folded"), "fold_kind")


@query("jn14_row_fallback", "SELECT split, 'row' AS fold_kind, count(*) AS n, count(*) FILTER (doc_id % 10 <> 0) AS known FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def identity_fallback(t):
    """A tenth of the ids is not in the manifest, so folds are row-wise."""
    s = B.scored(t).select("id", "y", F.when(F.col("id") % 4 == 3, "test").otherwise("train").alias("split"))
    m = t.documents.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 7).alias("identity"), L("photo").alias("capture"))
    return G.score_identity_join(s, m).groupBy("split", "fold_kind").agg(F.count(L(1)).alias("n"), F.count("identity").alias("known"))


DIMS = 64


def vector_columns(t):
    return cut(t.embeddings.select(F.col("vec_id").alias("id"), F.concat(L("g"), F.col("label").cast("string")).alias("generator"), (F.col("label") % 2).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)]))


@query("ml6_spectral_head", "SELECT count(*) FILTER (label % 2 = 0) AS n_neg, count(*) FILTER (label % 2 = 1) AS n_pos, true AS converged, true AS fits FROM embeddings")
def spectral(t):
    v = vector_columns(t)
    m = D.train_spectral(v, [f"e{i}" for i in range(DIMS)])
    return M.auc(v.withColumn("p", m.probability()), "p", "y").select("n_neg", "n_pos", L(m.gradient < SMALL).alias("converged"), (F.col("auc") > 0.5).alias("fits"))


@query("ml6_fingerprint_head", "SELECT 'g' || label AS generator, count(*) AS n, true AS above_chance FROM embeddings GROUP BY 1")
def fingerprint(t):
    v = vector_columns(t)
    m = D.train_fingerprint(v, [f"e{i}" for i in range(DIMS)])
    return m.transform(v).groupBy("generator").agg(F.count(L(1)).alias("n"), (F.avg((F.col("prediction") == F.col("g")).cast("int")) > 0.1).alias("above_chance"))


@query("ml7_out_of_fold", with_ctes(OUTPUTS, LABELLED) + "SELECT count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos, true AS explains FROM labelled")
def oof(t):
    """Five identity-disjoint folds, calibrated inside each fold's training rows: 5 + 15 fits in one batch."""
    df = cut(group_folds(labelled_features(t), 5, "identity"))
    return M.auc(D.out_of_fold(df, D.FUSION_FEATURES, 5, calibrate=True), "p", "y").select("n_neg", "n_pos", (F.col("auc") > 0.75).alias("explains"))


@query("ml8_check_claims", """WITH r AS (SELECT l_returnflag AS report, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY 1)
SELECT report || '-mean' AS claim, m * 100 AS found, true AS holds FROM r UNION ALL SELECT report || '-count', n, true FROM r UNION ALL SELECT report || '-wrong', m, false FROM r UNION ALL SELECT report || '-missing', NULL, false FROM r""")
def claims(t):
    agg = t.lineitem.groupBy(F.col("l_returnflag").alias("report")).agg(F.avg("l_discount").alias("m"), F.count(L(1)).alias("n"))
    one = lambda tag, path, scale, stated: F.struct(F.concat("report", L(f"-{tag}")).alias("claim"), L(path).alias("path"), L(scale).alias("scale"), stated.alias("stated"))
    flat = agg.select("report", F.to_json(F.struct(F.struct(F.col("m").alias("mean")).alias("stats"), F.array("n").alias("list"))).alias("body"), "m", "n")
    stated = flat.select(
        "report",
        F.explode(
            F.array(
                one("mean", "stats.mean", 100.0, F.round(F.col("m") * 100, 2)), one("count", "list.0", 1.0, F.col("n").cast("double")), one("wrong", "stats.mean", 1.0, F.col("m") + 0.01), one("missing", "stats.median", 1.0, F.col("m"))
            )
        ).alias("c"),
    ).select("report", "c.*")
    return D.check_claims(stated, flat.select("report", "body")).select("claim", "found", "holds")
