"""Evaluation, calibration, sampling and split queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions import scalars as X
from ..operators import calibrate as C
from ..operators import metrics as M
from ..operators import sampling as P
from ..operators.ordered import row_numbers
from . import bindings as B
from .bindings import FRAMES, OUTPUTS, SCORED, auc_sql, with_ctes
from .registry import query

L = F.lit
CM = "count(*) FILTER (WHERE s >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE s >= {t} AND y = 0) AS fp, count(*) FILTER (WHERE s < {t} AND y = 1) AS fn, count(*) FILTER (WHERE s < {t} AND y = 0) AS tn"
RATES = """tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall,
 2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-9, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)) AS f1,
 fn / greatest(1, tp + fn) AS false_accept_rate, fp / greatest(1, fp + tn) AS false_reject_rate, (tp + tn) / greatest(1, tp + fp + fn + tn) AS accuracy"""


@query("ag9_confusion_rates", with_ctes(SCORED) + f"SELECT lang, tp, fp, fn, tn, {RATES} FROM (SELECT lang, {CM.format(t=0.5)} FROM (SELECT lang, y, score AS s FROM scored) GROUP BY lang)")
def confusion(t):
    return M.confusion_at(B.scored(t), "score", "y", 0.5, ["lang"])


# the same score on every order of the large table: one AUC over many rows
BIG = "big AS (SELECT l_partkey, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, (l_extendedprice % 1009) / 1009.0::DOUBLE AS score FROM lineitem)"


def big(t):
    return t.lineitem.select("l_linestatus", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), ((F.col("l_extendedprice") % 1009) / 1009.0).alias("score"))


@query("ag10_auc", with_ctes(SCORED) + "SELECT * FROM " + auc_sql("scored", "score", "y", ["lang"]))
def auc_by_lang(t):
    return M.auc(B.scored(t), "score", "y", ["lang"])


@query("ag10_auc_lineitem", with_ctes(BIG) + "SELECT * FROM " + auc_sql("big", "score", "y", ["l_linestatus"]))
def auc_big(t):
    return M.auc(big(t), "score", "y", ["l_linestatus"])


@query("ag11_average_precision", with_ctes(BIG) + """, g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS n1, count(*) AS n FROM big GROUP BY score),
 c AS (SELECT n1, sum(n1) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC))
SELECT sum(n1 * tp::DOUBLE / seen) / (SELECT sum(n1) FROM g) AS ap, (SELECT sum(n1) FROM g)::BIGINT AS n_pos, (SELECT sum(n) FROM g)::BIGINT AS n FROM c""")
def ap(t):
    return M.average_precision(big(t), "score", "y")


ROC = """, g AS (SELECT source, score, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM scored GROUP BY ALL),
 roc AS (SELECT source, score AS threshold, sum(n0) OVER w / sum(n0) OVER (PARTITION BY source) AS fpr, sum(n1) OVER w / sum(n1) OVER (PARTITION BY source) AS tpr,
  sum(n0) OVER (PARTITION BY source) AS a0, sum(n1) OVER (PARTITION BY source) AS a1 FROM g WINDOW w AS (PARTITION BY source ORDER BY score DESC))"""


@query("wn9_cumulative_roc", with_ctes(SCORED) + ROC + " SELECT source, threshold, fpr, tpr FROM roc WHERE a0 > 0 AND a1 > 0".replace(" SELECT", "\nSELECT"))
def cum_roc(t):
    return M.roc(B.scored(t), "score", "y", ["source"])


@query("ag12_roc_points", with_ctes(SCORED) + """, g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM scored GROUP BY ALL),
 r AS (SELECT score AS threshold, -score AS down, sum(n0) OVER w AS fp, sum(n1) OVER w AS tp FROM g WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 1.0, '-infinity'::DOUBLE, 0, 0),
 a AS (SELECT *, lag(fp) OVER w AS f0, lead(fp) OVER w AS f1, lag(tp) OVER w AS t0, lead(tp) OVER w AS t1 FROM r WINDOW w AS (ORDER BY down)),
 k AS (SELECT *, row_number() OVER (ORDER BY down) - 1 AS vertex, count(*) OVER () AS total FROM a WHERE f0 IS NULL OR f1 IS NULL OR NOT ((fp = f0 AND f1 = fp) OR (tp = t0 AND t1 = tp)))
SELECT vertex, threshold, fp / (SELECT sum(n0) FROM g) AS fpr, tp / (SELECT sum(n1) FROM g) AS tpr FROM k WHERE list_contains(list_transform(range(0, least(60, total)), lambda i: floor(i * (total - 1) / (least(60, total) - 1))::BIGINT), vertex)""")
def roc_points(t):
    return M.roc_points(B.scored(t), "score", "y", 60)


@query("ag33_roc_on_grid", with_ctes(SCORED) + ROC + """, grid AS (SELECT i / 20.0::DOUBLE AS g FROM range(0, 21) t(i)), c AS (SELECT DISTINCT source FROM roc WHERE a0 > 0 AND a1 > 0)
SELECT c.source, g AS fpr_at_most, coalesce((SELECT max(tpr) FROM roc r WHERE r.source = c.source AND r.fpr <= g + 1e-12), 0) AS tpr FROM c, grid""")
def roc_grid(t):
    return M.roc_on_grid(M.roc(B.scored(t), "score", "y", ["source"]), "source", 20)


LABELLED = """lab AS (SELECT o.*, (o.submission_id % 2)::INT AS y, CASE WHEN o.submission_id % 2 = 1 THEN ['generated_selfie', 'face_swap_liveness', 'tampered_document', 'impersonation'][o.submission_id % 4 + 1] END AS attack_type FROM outputs o)"""


def labelled(t):
    k = F.col("submission_id")
    return B.detector_outputs(t).select("*", (k % 2).cast("int").alias("y"), F.when(k % 2 == 1, F.element_at(F.array(*[L(a) for a in B.ATTACKS]), (k % 4 + 1).cast("int"))).alias("attack_type"))


AIM = " OR ".join(f"(detector = '{d}' AND attack_type IN ({', '.join(repr(a) for a in v)}))" for d, v in K.DETECTOR_TARGETS.items())


@query("ag13_per_detector", with_ctes(OUTPUTS, LABELLED) + f"""SELECT l.detector, count(*) AS rows, count(*) FILTER (WHERE status = 'ok') / count(*) AS coverage, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'skipped') AS skipped,
 avg(score) FILTER (WHERE status = 'ok' AND y = 0) AS mean_genuine, avg(score) FILTER (WHERE status = 'ok' AND y = 1) AS mean_fraud, any_value(a.auc) AS auc_all, any_value(r.auc) AS auc_ran, any_value(g.auc) AS auc_target
FROM lab l JOIN {auc_sql('lab', 'score', 'y', ['detector'])} a USING (detector) JOIN {auc_sql('lab', 'score', 'y', ['detector'], "status = 'ok'")} r USING (detector)
LEFT JOIN {auc_sql('lab', 'score', 'y', ['detector'], f"detector <> 'behavioral' AND (y = 0 OR {AIM})")} g USING (detector) GROUP BY l.detector""")
def per_detector(t):
    return M.per_detector_report(labelled(t))


def control_auc_sql(src, group, score="score"):
    return f"""(SELECT p.{group}, (sum(CASE WHEN p.{score} > n.{score} THEN 1.0 WHEN p.{score} = n.{score} THEN 0.5 ELSE 0.0 END) / count(*))::DOUBLE AS auc FROM (SELECT * FROM {src} WHERE y = 1) p, (SELECT * FROM {src} WHERE y = 0) n GROUP BY 1)"""


@query("ag14_per_attack", with_ctes(SCORED) + f"""SELECT s.attack_type, count(*) AS n, avg(score) AS mean_score, avg((score >= 0.45)::INT) AS caught_at_review, avg((score >= 0.8)::INT) AS caught_at_reject, any_value(a.auc) AS auc_vs_control
FROM scored s JOIN {control_auc_sql('scored', 'attack_type')} a USING (attack_type) WHERE y = 1 GROUP BY s.attack_type""")
def per_attack(t):
    return M.per_attack_report(B.scored(t), 0.45, 0.8)


@query("ag15_per_capture", with_ctes(SCORED) + f"""SELECT capture_mode, (f.n_pos + f.n_neg) AS n, d.auc AS id_forensics_auc, CASE WHEN m.n_pos + m.n_neg > 6 THEN m.auc END AS tamper_only_auc, f.auc AS fusion_auc
FROM {auc_sql('scored', 'score', 'y', ['capture_mode'])} f JOIN {auc_sql('scored', 'doc_score', 'y', ['capture_mode'])} d USING (capture_mode)
LEFT JOIN {auc_sql('scored', 'doc_score', 'y', ['capture_mode'], "(y = 0 OR attack_type = 'tampered_document')")} m USING (capture_mode) WHERE f.n_pos + f.n_neg >= 6""")
def per_capture(t):
    return M.per_capture_report(B.scored(t))


TONE = "CASE WHEN tone_angle >= 55 THEN 'very_light' WHEN tone_angle >= 41 THEN 'light' WHEN tone_angle >= 28 THEN 'intermediate' WHEN tone_angle >= 10 THEN 'tan' WHEN tone_angle >= -30 THEN 'brown' ELSE 'dark' END"


@query("ag16_bias_audit", with_ctes(SCORED, f"tone AS (SELECT *, {TONE} AS bucket FROM scored)") + f"""SELECT bucket, n, CASE WHEN n >= 5 THEN auc END AS auc, CASE WHEN n >= 5 THEN fp / greatest(1, fp + tn) END AS false_reject_rate, CASE WHEN n >= 5 THEN fn / greatest(1, tp + fn) END AS false_accept_rate, CASE WHEN n >= 5 THEN g END AS mean_genuine
FROM (SELECT bucket, count(*) AS n, avg(s) FILTER (WHERE y = 0) AS g, {CM.format(t=0.8)} FROM (SELECT bucket, y, score AS s FROM tone) GROUP BY bucket) JOIN {auc_sql('tone', 'score', 'y', ['bucket'])} USING (bucket)""")
def bias(t):
    return M.bias_audit(B.scored(t), 0.8)


@query("sc29_tone_bucket", with_ctes(SCORED) + f"SELECT {TONE} AS bucket, count(*) AS n FROM scored GROUP BY 1")
def tone(t):
    return B.scored(t).groupBy(X.tone_bucket(F.col("tone_angle")).alias("bucket")).agg(F.count(L(1)).alias("n"))


Q = lambda p, c="v": f"quantile_cont({c}, {p})"


@query("ag17_latency_report", "SELECT o_orderstatus AS status, count(*) AS n, avg(o_totalprice) AS mean, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1")
def latency(t):
    return M.latency_report(t.orders.select(F.col("o_orderstatus").alias("status"), "o_totalprice"), ["status"], "o_totalprice")


@query("ag17_per_detector_median", with_ctes(OUTPUTS) + "SELECT detector, quantile_cont(score, 0.5) AS median FROM outputs WHERE score > 0 GROUP BY 1")
def detector_median(t):
    from ..operators.ordered import exact_percentiles

    return exact_percentiles(B.detector_outputs(t).filter("score > 0"), ["detector"], "score", {"median": 0.5})


AUDITED = """long AS (SELECT y, 'lang' AS field, lang AS value FROM scored UNION ALL SELECT y, 'source', source FROM scored UNION ALL SELECT y, 'marker', CASE WHEN y = 1 AND id % 3 = 0 THEN 'generated' WHEN y = 0 AND id % 5 = 0 THEN 'stale' ELSE 'camera' END FROM scored),
 tab AS (SELECT field, value, count(*) FILTER (WHERE y = 0) AS genuine, count(*) FILTER (WHERE y = 1) AS fraud FROM long GROUP BY ALL),
 leak AS (SELECT *, fraud / (genuine + fraud) AS p_fraud, genuine + fraud >= 10 AND (fraud = 0 OR genuine = 0) AS one_sided FROM tab),
 aud AS (SELECT field, value, genuine, fraud, p_fraud, one_sided, CASE WHEN one_sided THEN CASE WHEN p_fraud = 1 THEN 'fraud' ELSE 'genuine' END END AS only_class, one_sided AND value = 'generated' AS expected,
  CASE WHEN one_sided THEN genuine + fraud ELSE 0 END / greatest(1, (SELECT count(*) FROM scored)) AS share_of_corpus FROM leak)"""


def leak(t):
    y, i = F.col("y"), F.col("id")
    m = B.scored(t).withColumn("marker", F.when((y == 1) & (i % 3 == 0), "generated").when((y == 0) & (i % 5 == 0), "stale").otherwise("camera"))
    return M.leak_audit(m, ["lang", "source", "marker"])


@query("ag18_leak_audit", with_ctes(SCORED, AUDITED) + "SELECT * FROM aud")
def leak_audit(t):
    return leak(t).drop("justification")


@query("ag19_balance_gate", with_ctes(SCORED, AUDITED) + "SELECT field, value, field || '=' || value || ' appears on ' || (genuine + fraud) || ' packets, all ' || CASE WHEN only_class = 'fraud' THEN 'fraudulent' ELSE 'genuine' END AS complaint FROM aud WHERE one_sided AND NOT expected")
def gate(t):
    return M.balance_gate(leak(t))


@query("ag20_leak_view", with_ctes(SCORED, AUDITED) + "SELECT field, count(*) FILTER (WHERE one_sided AND NOT expected) AS leaks, count(*) FILTER (WHERE one_sided AND expected) AS expected_one_sided, count(*) FILTER (WHERE one_sided AND NOT expected) = 0 AS clean, sum(share_of_corpus) AS share_of_corpus, (SELECT count(*) = 0 FROM aud WHERE one_sided AND NOT expected) AS corpus_clean FROM aud GROUP BY field")
def leak_view(t):
    return M.leak_view(leak(t))


CURVE = f"""grid AS (SELECT round(0.02 + 0.02 * i, 2)::DOUBLE AS threshold FROM range(0, 49) t(i)),
 cm AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, count(*) FILTER (WHERE score < threshold AND y = 0) AS tn FROM big, grid GROUP BY 1),
 curve AS (SELECT *, fn / greatest(1, tp + fn) AS false_accept_rate, fp / greatest(1, fp + tn) AS false_reject_rate, 30 * (1 - fn / greatest(1, tp + fn)) * 85000 AS fraud_prevented, 30 * (fn / greatest(1, tp + fn)) * 85000 AS fraud_leaked,
  970 * (fp / greatest(1, fp + tn)) * 42000 * 0.35::DOUBLE AS friction_cost, 30 * (1 - fn / greatest(1, tp + fn)) * 85000 - 970 * (fp / greatest(1, fp + tn)) * 42000 * 0.35::DOUBLE AS net_benefit FROM cm)"""


@query("ag21_cost_curve", with_ctes(BIG, CURVE) + "SELECT * FROM curve", digits=4)
def cost_curve(t):
    return M.cost_curve(big(t), "score", "y")


@query("ag21_cost_optimum", with_ctes(BIG, CURVE) + "SELECT * FROM curve ORDER BY round(net_benefit, 6) DESC, threshold LIMIT 1", digits=4)
def cost_best(t):
    return M.best_point(M.cost_curve(big(t), "score", "y"))


@query("ag32_profitable_range", with_ctes(BIG, CURVE) + "SELECT min(threshold) FILTER (WHERE net_benefit > 0) AS lowest, max(threshold) FILTER (WHERE net_benefit > 0) AS highest, count(*) FILTER (WHERE net_benefit > 0) AS points FROM curve")
def profitable(t):
    return M.profitable_range(M.cost_curve(big(t), "score", "y"))


FAMILY = f"""fam AS (SELECT s.source AS family, count(*) AS n, avg(score) AS mean_fake, avg((score >= 0.4)::INT) AS recall_40, avg((score >= 0.5)::INT) AS recall_50, avg((score >= 0.75)::INT) AS recall_75, any_value(a.auc) AS auc_vs_control
 FROM scored s JOIN {control_auc_sql('scored', 'source')} a USING (source) WHERE y = 1 GROUP BY s.source),
 ctl AS (SELECT count(*) AS n_real, avg(score) AS mean_real, avg((score >= 0.4)::INT) AS fpr_40, avg((score >= 0.5)::INT) AS fpr_50, avg((score >= 0.75)::INT) AS fpr_75 FROM scored WHERE y = 0)"""


def family(t):
    return M.family_report(B.scored(t).withColumnRenamed("source", "family"))


@query("ag22_family_report", with_ctes(SCORED, FAMILY) + "SELECT * FROM fam, ctl")
def family_report(t):
    return family(t)


@query("ag23_family_headline", with_ctes(SCORED, FAMILY) + "SELECT (SELECT family FROM fam ORDER BY round(auc_vs_control, 12), family LIMIT 1) AS worst_family, min(auc_vs_control) AS worst_auc, (SELECT family FROM fam ORDER BY round(auc_vs_control, 12) DESC, family DESC LIMIT 1) AS best_family, max(auc_vs_control) AS best_auc, max(auc_vs_control) - min(auc_vs_control) AS spread FROM fam")
def headline(t):
    r = family(t)
    return M.family_headline(r.withColumn("auc_vs_control", F.round("auc_vs_control", 12)))


@query("ag24_group_shortcut", with_ctes(SCORED) + f"SELECT capture_mode, count(*) AS n, avg(score) AS mean, {Q(0.5, 'score')} AS median, {Q(0.9, 'score')} AS p90, stddev_pop(score) AS std, avg((score >= 0.4)::INT) AS share_40, avg((score >= 0.5)::INT) AS share_50, avg((score >= 0.75)::INT) AS share_75 FROM scored WHERE y = 0 GROUP BY 1")
def shortcut(t):
    return M.group_shortcut_report(B.scored(t).filter("y = 0"), "capture_mode")


@query("ag24_confound_share", with_ctes(SCORED, "g AS (SELECT CASE WHEN capture_mode = 'scan' THEN 1 ELSE 0 END AS grp, score, doc_score FROM scored WHERE y = 0)") + f"""SELECT n.auc AS frame_auc, c.auc AS face_auc, (abs(n.auc - 0.5) - abs(c.auc - 0.5)) / greatest(1e-9, abs(n.auc - 0.5)) AS explained
FROM {auc_sql('g', 'score', 'grp')} n, {auc_sql('g', 'doc_score', 'grp')} c""")
def confound(t):
    g = B.scored(t).filter("y = 0").withColumn("grp", (F.col("capture_mode") == "scan").cast("int"))
    a = M.signal_auc_report(g, ["score", "doc_score"], "grp").agg(*[F.max(F.when(F.col("signal") == s, F.col("auc"))).alias(n) for s, n in (("score", "frame_auc"), ("doc_score", "face_auc"))])
    return a.select("frame_auc", "face_auc", M.explained_by_control(F.col("frame_auc"), F.col("face_auc")).alias("explained"))


@query("ag25_signal_auc", with_ctes(SCORED) + " UNION ALL ".join(f"SELECT '{s}' AS signal, n_neg, n_pos, auc FROM {auc_sql('scored', s, 'y')}" for s in ("score", "doc_score", "tamper")))
def signals(t):
    return M.signal_auc_report(B.scored(t), ["score", "doc_score", "tamper"])


@query("ag25_method_auc", with_ctes(SCORED) + f"SELECT attack_type AS method, count(*) AS n, avg(score) AS mean_score, any_value(a.auc) AS auc_vs_control FROM scored s JOIN {control_auc_sql('scored', 'attack_type')} a USING (attack_type) WHERE y = 1 GROUP BY 1")
def methods(t):
    return M.one_vs_control(B.scored(t).withColumnRenamed("attack_type", "method"), "method", "score", "y", [F.avg("score").alias("mean_score")])


BOXES = """boxes AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, l_suppkey % 50 AS x1, l_partkey % 50 AS y1, l_suppkey % 50 + l_quantity::INT AS x2, l_partkey % 50 + (l_quantity::INT % 17) + 3 AS y2, round(l_discount * 100)::INT AS area, l_extendedprice AS tie FROM lineitem),
 truth AS (SELECT o_orderkey AS doc_id, o_custkey % 40 AS tx1, o_custkey % 30 AS ty1, o_custkey % 40 + 20 AS tx2, o_custkey % 30 + 15 AS ty2 FROM orders),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, tie) AS rn FROM boxes) WHERE rn <= 3),
 ov AS (SELECT t.doc_id, greatest(0, least(x2, tx2) - greatest(x1, tx1)) * greatest(0, least(y2, ty2) - greatest(y1, ty1)) AS inter, (x2 - x1) * (y2 - y1) AS a1, (tx2 - tx1) * (ty2 - ty1) AS a2 FROM top JOIN truth t USING (doc_id))"""


def boxes(t):
    """Flagged boxes per document; a document has few, so the array is bounded."""
    q = F.col("l_quantity").cast("int")
    b = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.round(F.col("l_discount") * 100).cast("int").alias("area"), F.col("l_extendedprice").alias("tie"),
        F.struct((F.col("l_suppkey") % 50).alias("x1"), (F.col("l_partkey") % 50).alias("y1"), (F.col("l_suppkey") % 50 + q).alias("x2"), (F.col("l_partkey") % 50 + q % 17 + 3).alias("y2")).alias("box"),
    )
    sortable = F.struct((-F.col("area")).alias("k"), "tie", F.col("area").alias("area_frac"), "box")
    regions = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(sortable)).alias("regions"))
    c = F.col("o_custkey")
    truth = F.struct((c % 40).alias("x1"), (c % 30).alias("y1"), (c % 40 + 20).alias("x2"), (c % 30 + 15).alias("y2"))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), truth.alias("truth")).join(regions, "doc_id")


@query("jn13_region_hits", with_ctes(BOXES) + "SELECT doc_id, bool_or(inter / greatest(1, a2) >= 0.25) AS hit, max(inter / greatest(1, a1 + a2 - inter)) AS best_iou FROM ov GROUP BY doc_id")
def region_hits(t):
    return M.region_hits(boxes(t))


@query("sc28_iou", with_ctes(BOXES) + "SELECT i, avg(inter / greatest(1, a1 + a2 - inter)) AS mean_iou FROM (SELECT i, greatest(0, least(x2, tx2) - greatest(x1, tx1)) * greatest(0, least(y2, ty2) - greatest(y1, ty1)) AS inter, (x2 - x1) * (y2 - y1) AS a1, (tx2 - tx1) * (ty2 - ty1) AS a2 FROM boxes JOIN truth USING (doc_id)) GROUP BY i")
def iou(t):
    q, c = F.col("l_quantity").cast("int"), F.col("o_custkey")
    a = F.struct((F.col("l_suppkey") % 50).alias("x1"), (F.col("l_partkey") % 50).alias("y1"), (F.col("l_suppkey") % 50 + q).alias("x2"), (F.col("l_partkey") % 50 + q % 17 + 3).alias("y2"))
    b = F.struct((c % 40).alias("x1"), (c % 30).alias("y1"), (c % 40 + 20).alias("x2"), (c % 30 + 15).alias("y2"))
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_linenumber").alias("i"), a.alias("a"), b.alias("b"))
    return j.groupBy("i").agg(F.avg(X.iou(F.col("a"), F.col("b"))).alias("mean_iou"))


@query("sc31_describe_region", "SELECT 'in the ' || CASE WHEN cy < 0.38 THEN 'upper' WHEN cy > 0.62 THEN 'lower' ELSE 'middle' END || '-' || CASE WHEN cx < 0.38 THEN 'left' WHEN cx > 0.62 THEN 'right' ELSE 'centre' END || ' of the card' AS where_, count(*) AS n FROM (SELECT (l_suppkey % 50 * 2 + l_quantity) / 2 / 100 AS cx, (l_partkey % 50 * 2 + l_quantity) / 2 / 100 AS cy FROM lineitem) GROUP BY 1")
def describe(t):
    q = F.col("l_quantity")
    box = F.struct((F.col("l_suppkey") % 50).alias("x1"), (F.col("l_partkey") % 50).alias("y1"), (F.col("l_suppkey") % 50 + q).alias("x2"), (F.col("l_partkey") % 50 + q).alias("y2"))
    return t.lineitem.select(box.alias("box")).groupBy(X.describe_region(F.col("box"), L(100), L(100)).alias("where_")).agg(F.count(L(1)).alias("n"))


TAMPER = "tam AS (SELECT y, score, tamper, (n_chars % 4)::INT AS n_regions, CASE WHEN y = 1 THEN id % 2 = 0 END AS hit, (id % 11) / 11.0::DOUBLE AS iou, (n_chars % 3) / 3.0::DOUBLE AS layout, attack_type AS attack, capture_mode AS capture, lang AS doc_type FROM scored), lng AS (SELECT 'all' AS slice, 'all' AS value, * FROM tam UNION ALL SELECT 'capture', capture, * FROM tam UNION ALL SELECT 'doc_type', doc_type, * FROM tam)"


@query("ag26_tamper_report", with_ctes(SCORED, TAMPER) + f"""SELECT l.slice, l.value, count(*) AS n, avg((tamper > 0.45 AND n_regions > 0)::INT) FILTER (WHERE y = 0) AS false_flag_rate, avg(hit::INT) AS localised_rate, avg(iou) FILTER (WHERE hit IS NOT NULL) AS mean_best_iou, avg((layout > 0)::INT) FILTER (WHERE y = 0) AS layout_flag_rate,
 avg((tamper >= 0.3)::INT) FILTER (WHERE y = 1) AS recall_30, avg((tamper >= 0.45)::INT) FILTER (WHERE y = 1) AS recall_45, avg((tamper >= 0.6)::INT) FILTER (WHERE y = 1) AS recall_60,
 avg((tamper >= 0.3)::INT) FILTER (WHERE y = 0) AS fpr_30, avg((tamper >= 0.45)::INT) FILTER (WHERE y = 0) AS fpr_45, avg((tamper >= 0.6)::INT) FILTER (WHERE y = 0) AS fpr_60, any_value(d.auc) AS detector_auc, any_value(m.auc) AS tamper_auc
FROM lng l JOIN {auc_sql('lng', 'score', 'y', ['slice', 'value'])} d USING (slice, value) JOIN {auc_sql('lng', 'tamper', 'y', ['slice', 'value'])} m USING (slice, value) GROUP BY ALL""")
def tamper(t):
    return M.tamper_report(tampered(t))


def tampered(t):
    d = F.col("id")
    return B.scored(t).select(
        "y", "score", "tamper", (F.col("n_chars") % 4).cast("int").alias("n_regions"), F.when(F.col("y") == 1, d % 2 == 0).alias("hit"), ((d % 11) / 11.0).alias("iou"), ((F.col("n_chars") % 3) / 3.0).alias("layout"),
        F.col("attack_type").alias("attack"), F.col("capture_mode").alias("capture"), F.col("lang").alias("doc_type"),
    )


VERSUS = "vs AS (SELECT a.attack AS slice, t.* FROM tam t, (SELECT DISTINCT attack FROM tam WHERE attack IS NOT NULL) a WHERE t.y = 0 OR t.attack = a.attack)"


@query("ag26_tamper_by_attack", with_ctes(SCORED, TAMPER, VERSUS) + f"""SELECT v.slice AS attack, count(*) FILTER (y = 1) AS n, any_value(d.auc) AS detector_auc, avg(tamper) FILTER (y = 1) AS mean_tamper, avg(hit::INT) AS localised_rate, avg(iou) FILTER (hit IS NOT NULL) AS mean_best_iou, any_value(m.auc) AS tamper_auc
FROM vs v JOIN {auc_sql('vs', 'score', 'y', ['slice'])} d USING (slice) JOIN {auc_sql('vs', 'tamper', 'y', ['slice'])} m USING (slice) GROUP BY v.slice""")
def tamper_attacks(t):
    return M.tamper_by_attack(tampered(t))


@query("ag20_ranked_detectors", with_ctes(OUTPUTS) + "SELECT detector, avg(score) - 0.5 AS auc_drop, row_number() OVER (ORDER BY round(avg(score) - 0.5, 9) DESC, detector) AS rank, avg(score) < 0.5 AS harmful FROM outputs GROUP BY detector")
def ranked(t):
    drop = F.round(F.avg("score") - 0.5, 9)
    return M.ranked_detectors(B.detector_outputs(t).groupBy("detector").agg(drop.alias("auc_drop")))


DIST = ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p9999", 0.9999)))


@query("ag27_distribution", f"SELECT l_returnflag, count(*) AS n, avg(v) AS mean, min(v) AS lowest, max(v) AS highest, {DIST} FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY 1", digits=4)
def distribution(t):
    return M.distribution(t.lineitem.select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"])


BOARDM = "runs AS (SELECT 'spectral' AS model, 'classical' AS kind, y, score, n_chars / 1000.0::DOUBLE AS ms FROM scored UNION ALL SELECT 'net_a', 'neural', y, doc_score, n_chars / 500.0::DOUBLE FROM scored UNION ALL SELECT 'net_b', 'neural', y, tamper, n_chars / 250.0::DOUBLE FROM scored)"


@query("ag28_model_leaderboard", with_ctes(SCORED, BOARDM, f"lb AS (SELECT model, any_value(kind) AS kind, avg(score) FILTER (WHERE y = 0) AS mean_real, avg(score) FILTER (WHERE y = 1) AS mean_fake, avg(ms) AS ms_per_item, any_value(a.auc) AS auc FROM runs JOIN {auc_sql('runs', 'score', 'y', ['model'])} a USING (model) GROUP BY model)") + """
SELECT *, model = (SELECT model FROM lb WHERE kind = 'neural' ORDER BY auc DESC, model DESC LIMIT 1) AS selected, model = (SELECT model FROM lb WHERE kind = 'neural' ORDER BY auc DESC, model DESC LIMIT 1) AND auc < 0.6 AS near_chance FROM lb""")
def leaderboard(t):
    s = B.scored(t)
    run = lambda m, k, c, d: s.select(L(m).alias("model"), L(k).alias("kind"), "y", F.col(c).alias("score"), (F.col("n_chars") / d).alias("ms"))
    return M.model_leaderboard(run("spectral", "classical", "score", 1000.0).unionByName(run("net_a", "neural", "doc_score", 500.0)).unionByName(run("net_b", "neural", "tamper", 250.0)))


@query("ag29_region_z", """WITH cells AS (SELECT l_orderkey AS doc_id, 'a' || (l_orderkey % 4) AS attack, l_quantity > 25 AS inside, l_extendedprice / 1000.0::DOUBLE AS z FROM lineitem),
 d AS (SELECT doc_id, attack, avg(z) FILTER (WHERE inside) AS zi, avg(z) FILTER (WHERE NOT inside) AS zo, max(z) AS peak FROM cells GROUP BY ALL)
SELECT attack, count(*) AS n, avg(zi) AS mean_inside, avg(zo) AS mean_outside, avg(zi - zo) AS mean_difference, avg((zi > zo)::INT) AS share_hotter, quantile_cont(peak, 0.5) AS median_peak FROM d WHERE zi IS NOT NULL AND zo IS NOT NULL GROUP BY attack""")
def region_z(t):
    cells = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(L("a"), (F.col("l_orderkey") % 4).cast("string")).alias("attack"), (F.col("l_quantity") > 25).alias("inside"), (F.col("l_extendedprice") / 1000.0).alias("z"))
    return M.region_z_diagnostic(cells)


@query("ag30_layout_consistency", """WITH w AS (SELECT l_orderkey AS doc_id, l_suppkey % 90 AS x1, l_quantity::INT - 10 AS h, l_tax * 10 AS conf FROM lineitem),
 a AS (SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE h > 0) AS tall, stddev_pop(h) FILTER (WHERE h > 0) / (avg(h) FILTER (WHERE h > 0) + 1e-6) AS cv, stddev_pop(round_even(x1 / 8.0, 0)) AS ls, avg(conf) AS mc FROM w GROUP BY doc_id)
SELECT doc_id, words >= 4 AND tall >= 4 AS checked, words AS word_count, CASE WHEN words >= 4 AND tall >= 4 THEN cv END AS height_cv, CASE WHEN words >= 4 AND tall >= 4 THEN ls END AS left_spread, CASE WHEN words >= 4 AND tall >= 4 THEN mc END AS mean_conf,
 CASE WHEN words >= 4 AND tall >= 4 AND cv > 0.55 THEN 0.55 WHEN words >= 4 AND tall >= 4 AND cv < 0.03 THEN 0.35 ELSE 0 END AS layout_score FROM a""")
def layout(t):
    w = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 90).alias("x1"), L(0).alias("y1"), (F.col("l_quantity").cast("int") - 10).alias("y2"), (F.col("l_tax") * 10).alias("conf"))
    return M.layout_consistency(w)


# --- calibration -----------------------------------------------------------------
PAIRS = "pairs AS (SELECT id AS pair_id, score AS sim, y AS label, fold FROM scored)"


def pairs(t):
    return B.scored(t).select(F.col("id").alias("pair_id"), F.col("score").alias("sim"), F.col("y").alias("label"), "fold")


@query("tk2_threshold_at_far", with_ctes(BIG) + """, imp AS (SELECT score AS s FROM big WHERE y = 0), n AS (SELECT count(*) AS total FROM imp), k AS (SELECT *, row_number() OVER (ORDER BY s DESC) AS rn FROM imp),
 cut AS (SELECT ceil((CASE WHEN 0.001::DOUBLE * total >= 1 THEN (SELECT s FROM k WHERE rn = floor(0.001::DOUBLE * total)) ELSE (SELECT max(s) + 1e-6 FROM imp) END) * 10000) / 10000.0::DOUBLE AS threshold, 0.001::DOUBLE * total >= 1 AS resolved, total FROM n)
SELECT threshold, count(*) FILTER (WHERE s >= threshold) / total AS far, count(*) FILTER (WHERE s >= threshold) AS accepted, resolved, total FROM imp, cut GROUP BY threshold, resolved, total""")
def far_threshold(t):
    return C.threshold_at_far(big(t).filter("y = 0"), 0.001, "score")


@query("cal1_best_threshold", with_ctes(SCORED, PAIRS) + """, d AS (SELECT DISTINCT sim FROM pairs), c AS (SELECT (sim + lead(sim) OVER (ORDER BY sim)) / 2 AS t FROM d),
 a AS (SELECT t, avg(((sim >= t) = (label = 1))::INT) AS accuracy FROM c, pairs WHERE t IS NOT NULL GROUP BY t) SELECT t AS threshold, accuracy FROM a ORDER BY round(accuracy, 12) DESC, t LIMIT 1""")
def best_threshold(t):
    return C.best_threshold(pairs(t))


@query("cal2_rate_at_far", with_ctes(SCORED, PAIRS) + """, k AS (SELECT sim, row_number() OVER (ORDER BY sim DESC) AS rn, count(*) OVER () AS total FROM pairs WHERE label = 0),
 cut AS (SELECT ceil(max(CASE WHEN rn >= round_even(0.05 * total, 0) THEN sim END) * 10000) / 10000.0::DOUBLE AS threshold FROM k)
SELECT threshold, avg((sim >= threshold)::INT) FILTER (WHERE label = 0) AS far, avg((sim >= threshold)::INT) FILTER (WHERE label = 1) AS tar FROM pairs, cut GROUP BY threshold""")
def rate_at_far(t):
    return C.rate_at_far(pairs(t), 0.05)


@query("cal2_score_threshold", with_ctes(SCORED, PAIRS) + "SELECT fold, avg((sim >= 0.5)::INT) FILTER (WHERE label = 1) AS tar, avg((sim >= 0.5)::INT) FILTER (WHERE label = 0) AS far, avg(((sim >= 0.5) = (label = 1))::INT) AS accuracy FROM pairs GROUP BY fold")
def score_threshold(t):
    return C.score_threshold(pairs(t), L(0.5), by=["fold"])


@query("cal3_youden_split", with_ctes(SCORED, PAIRS) + """, j AS (SELECT t, avg((sim >= t)::INT) FILTER (WHERE label = 1) + avg((sim < t)::INT) FILTER (WHERE label = 0) - 1 AS j FROM pairs, (SELECT DISTINCT sim AS t FROM pairs) GROUP BY t)
SELECT t AS threshold, j FROM j ORDER BY round(j, 12) DESC, t LIMIT 1""")
def youden(t):
    p = pairs(t)
    return C.youden_split(p.filter("label = 0"), p.filter("label = 1"))


KFOLD = """, d AS (SELECT DISTINCT h.fold AS held, sim FROM (SELECT DISTINCT fold FROM pairs) h, pairs p WHERE p.fold <> h.fold), c AS (SELECT held, sim, (sim + lead(sim) OVER (PARTITION BY held ORDER BY sim)) / 2 AS t FROM d),
 a AS (SELECT held, t, avg(((p.sim >= t) = (label = 1))::INT) AS acc FROM c, pairs p WHERE t IS NOT NULL AND p.fold <> held GROUP BY ALL), b AS (SELECT held, t FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY round(acc, 12) DESC, t) AS rn FROM a) WHERE rn = 1),
 f AS (SELECT fold, any_value(t) AS threshold, avg(((sim >= t) = (label = 1))::INT) AS accuracy, avg((sim >= t)::INT) FILTER (WHERE label = 1) AS tar, avg((sim >= t)::INT) FILTER (WHERE label = 0) AS far FROM pairs JOIN b ON b.held = fold GROUP BY fold)"""


@query("cal4_kfold_threshold", with_ctes(SCORED, PAIRS) + KFOLD.lstrip("\n") + "\nSELECT * FROM f")
def kfold(t):
    return C.kfold_threshold(pairs(t), 5)


@query("cal4_kfold_summary", with_ctes(SCORED, PAIRS) + KFOLD + "\nSELECT avg(accuracy) AS mean_accuracy, stddev_pop(accuracy) AS std_accuracy, avg(threshold) AS mean_threshold, stddev_pop(threshold) AS std_threshold FROM f")
def kfold_summary(t):
    return C.kfold_summary(C.kfold_threshold(pairs(t), 5))


@query("sc27_per_applicant", "SELECT l_discount, n, -(exp(n * ln(1 - l_discount / 1000)) - 1) AS rate, 1 - (1 - l_discount / 1000) ** (1.0 / n) AS far FROM (SELECT DISTINCT l_discount FROM lineitem), (VALUES (20), (5000)) v(n)", digits=9)
def per_applicant(t):
    d = t.lineitem.select("l_discount").distinct().select("l_discount", F.explode(F.array(L(20), L(5000))).alias("n"))
    p = F.col("l_discount") / 1000
    return d.select("l_discount", "n", X.per_applicant_rate(p, F.col("n")).alias("rate"), X.far_for_budget(p, F.col("n")).alias("far"))


BAND = "bands AS (SELECT CASE WHEN y = 0 THEN 'genuine' WHEN attack_type IN ('impersonation', 'generated_selfie') THEN 'mismatch' ELSE 'duplicate' END AS bucket, score AS sim FROM scored)"


def bands(t):
    return B.scored(t).select(F.when(F.col("y") == 0, "genuine").when(F.col("attack_type").isin("impersonation", "generated_selfie"), "mismatch").otherwise("duplicate").alias("bucket"), F.col("score").alias("sim"))


@query("cal7_face_band", with_ctes(SCORED, BAND) + """, j AS (SELECT t, avg((sim >= t)::INT) FILTER (WHERE bucket = 'genuine') + avg((sim < t)::INT) FILTER (WHERE bucket = 'mismatch') - 1 AS j FROM bands, (SELECT DISTINCT sim AS t FROM bands WHERE bucket <> 'duplicate') WHERE bucket <> 'duplicate' GROUP BY t)
SELECT (SELECT t FROM j ORDER BY round(j, 12) DESC, t LIMIT 1) AS low, least(0.9995, quantile_cont(sim, 0.99) FILTER (WHERE bucket = 'genuine') + 0.005) AS high, count(*) FILTER (WHERE bucket = 'genuine') AS n_genuine, count(*) FILTER (WHERE bucket = 'mismatch') AS n_mismatch FROM bands""")
def face_band(t):
    return C.face_band(bands(t))


@query("cal7_keep_better_low", with_ctes(SCORED, BAND) + """, j AS (SELECT t, avg((sim >= t)::INT) FILTER (WHERE bucket = 'genuine') + avg((sim < t)::INT) FILTER (WHERE bucket = 'mismatch') - 1 AS j FROM bands, (SELECT DISTINCT sim AS t FROM bands WHERE bucket <> 'duplicate') WHERE bucket <> 'duplicate' GROUP BY t)
SELECT 0.4065::DOUBLE AS low, least(0.9995, quantile_cont(sim, 0.99) FILTER (WHERE bucket = 'genuine') + 0.005) AS high, (SELECT t FROM j ORDER BY round(j, 12) DESC, t LIMIT 1) AS corpus_fitted_low FROM bands""")
def keep_low(t):
    return C.keep_better_low(C.face_band(bands(t)), 0.4065)


@query("cal8_threshold_for_fpr", with_ctes(BIG) + "SELECT greatest(0.5, quantile_cont(score, 0.95)) AS threshold FROM big WHERE y = 0")
def fpr_threshold(t):
    return C.threshold_for_fpr(big(t).filter("y = 0"), 0.05)


def pol_sql(src, name):
    return f"""{name}_cm AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) / count(*) FILTER (WHERE y = 1) AS r, count(*) FILTER (WHERE score >= threshold AND y = 0) / count(*) FILTER (WHERE y = 0) AS f FROM {src}, (SELECT round(0.05 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(0, 91) t(i)) GROUP BY 1),
 {name} AS (SELECT threshold, round(r, 4) AS recall, round(f, 4) AS fpr, round(300 * round(r, 4) * 85000 - 9700 * round(f, 4) * 42000 * 0.35::DOUBLE, 0) AS net_benefit FROM {name}_cm),
 {name}_best AS (SELECT threshold AS reject, fpr AS fpr_at_reject, recall AS recall_at_reject FROM {name} ORDER BY net_benefit DESC, threshold LIMIT 1)"""


@query("cal9_policy_curve", with_ctes(BIG, pol_sql("big", "pc")) + "SELECT * FROM pc")
def policy_curve(t):
    return C.policy_curve(big(t))


@query("cal9_fit_policy_thresholds", with_ctes(BIG, pol_sql("big", "pc")) + "SELECT reject, coalesce((SELECT min(threshold) FROM pc WHERE fpr <= 0.25 AND threshold <= reject), reject) AS review, fpr_at_reject, recall_at_reject FROM pc_best")
def fit_policy(t):
    return C.fit_policy_thresholds(C.policy_curve(big(t)))


@query("cal10_transfer_check", with_ctes(BIG, "tr AS (SELECT * FROM big WHERE l_linestatus = 'O')", "te AS (SELECT * FROM big WHERE l_linestatus = 'F')", pol_sql("tr", "pc")) + """, h AS (SELECT reject, fpr_at_reject, round(avg((score >= reject)::INT) FILTER (WHERE y = 0), 4) AS held FROM te, pc_best GROUP BY ALL)
SELECT reject, fpr_at_reject AS out_of_fold_fpr, held AS held_out_fpr, CASE WHEN fpr_at_reject > 0 THEN round(held / fpr_at_reject, 1) END AS optimism, coalesce(CASE WHEN fpr_at_reject > 0 THEN round(held / fpr_at_reject, 1) END <= 1.5, false) AS deployable FROM h""")
def transfer(t):
    b = big(t)
    return C.transfer_check(C.policy_curve(b.filter("l_linestatus = 'O'")), b.filter("l_linestatus = 'F'"))


@query("cal10_naive_comparison", with_ctes(SCORED, pol_sql("scored", "a"), "alt AS (SELECT y, doc_score AS score FROM scored)", pol_sql("alt", "b")) + "SELECT a_best.reject AS threshold, a_best.fpr_at_reject AS claimed_fpr, b.fpr AS identity_disjoint_fpr FROM a_best JOIN b ON b.threshold = a_best.reject")
def naive(t):
    s = B.scored(t)
    return C.naive_comparison(C.policy_curve(s), C.policy_curve(s, "doc_score"))


# --- sampling, splits, sets ---------------------------------------------------------
@query("tk3_round_robin", """SELECT l_returnflag, 34 - (l_returnflag <> 'A')::INT AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem)""", digits=None)
def round_robin(t):
    e = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", "l_partkey")
    return P.round_robin(e, "l_returnflag", 100).groupBy("l_returnflag").agg(F.count(L(1)).cast("int").alias("n"))


@query("tk4_pick_disjoint", "SELECT 100 AS picked, 0 AS from_taken", digits=None)
def disjoint(t):
    e = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("identity"))
    taken = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("identity")).distinct().filter("identity % 2 = 0")
    return P.pick_disjoint(e, "identity", taken, 100).agg(F.count(L(1)).cast("int").alias("picked"), F.sum("taken").cast("int").alias("from_taken"))


@query("tk5_balance", "SELECT CASE WHEN event_type = 'view' THEN 'real' ELSE 'fake' END AS label, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS method, least(n, CASE WHEN event_type = 'view' THEN 300 ELSE 75 END) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)", digits=None)
def balance(t):
    c = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "real").otherwise("fake").alias("label"), F.col("event_type").alias("method"))
    return P.balance(c, 300).groupBy("label", "method").agg(F.count(L(1)).alias("n"))


@query("tk6_cap_imbalance", "SELECT y, CASE WHEN y = 1 THEN n ELSE least(n, 4 * max(n) FILTER (WHERE y = 1) OVER ()) END AS n FROM (SELECT (event_id % 9 = 0)::INT AS y, count(*) AS n FROM events GROUP BY 1)", digits=None)
def cap(t):
    e = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 9 == 0).cast("int").alias("y"))
    return P.cap_imbalance(e).groupBy("y").agg(F.count(L(1)).alias("n"))


@query("tk7_spaced_subsample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS total FROM events) WHERE list_contains(list_transform(range(0, 200), lambda k: k * (total - 1) // 199), i)")
def spaced(t):
    return P.spaced_subsample(t.events.select("event_id"), "event_id", 200)


@query("tk8_one_per_identity", "SELECT o_custkey AS identity, min(o_orderkey) AS photo, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def one_per(t):
    return P.one_per_identity(t.orders.select(F.col("o_custkey").alias("identity"), F.col("o_orderkey").alias("photo"), F.col("o_totalprice").alias("price")), "identity", "photo")


@query("so1_paired_keys", "SELECT paired, count(*) AS n FROM (SELECT l_partkey, count(DISTINCT l_returnflag) = 3 AS paired FROM lineitem GROUP BY 1) GROUP BY 1")
def paired(t):
    return P.paired_keys(t.lineitem, "l_partkey", "l_returnflag", 3).groupBy("paired").agg(F.count(L(1)).alias("n"))


@query("so3_union_populations", "SELECT pop, count(*) AS n, avg(v) AS mean FROM (SELECT 'documents' AS pop, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT 'events', value FROM events) GROUP BY pop")
def union(t):
    u = P.union_populations(t.documents.select(L("documents").alias("pop"), F.col("n_chars").cast("double").alias("v")), t.events.select(L("events").alias("pop"), F.col("value").alias("v")))
    return u.groupBy("pop").agg(F.count(L(1)).alias("n"), F.avg("v").alias("mean"))


@query("so4_report_availability", "SELECT r_name AS name, r_name IN (SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0) AS available FROM region")
def availability(t):
    found = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).filter("s_suppkey % 2 = 0").select(F.col("r_name").alias("name"))
    return P.report_availability(t.region.select(F.col("r_name").alias("name")), found)


@query("src8_labelled_balanced", "SELECT toxic, least(count(*), 50) AS n FROM labels GROUP BY 1", digits=None)
def balanced_read(t):
    from ..sources.readers import read_labelled_balanced

    return read_labelled_balanced(t.labels, ["doc_id"], "toxic", 50).groupBy("toxic").agg(F.count(L(1)).alias("n"))


@query("sp1_identity_split", "SELECT CASE WHEN label >= 6 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM embeddings GROUP BY 1")
def id_split(t):
    return P.identity_split(t.embeddings.select("label"), "label", 10).groupBy("split").agg(F.count(L(1)).alias("n"))


@query("sp2_subject_split", "SELECT label, greatest(1, round_even(count(DISTINCT user_id) * 0.3, 0))::BIGINT AS held_subjects, count(DISTINCT user_id) AS subjects FROM (SELECT user_id, user_id % 2 AS label FROM events) GROUP BY label", digits=None)
def subj_split(t):
    e = t.events.select(F.col("user_id").alias("subject"), (F.col("user_id") % 2).alias("label"))
    return P.subject_split(e).groupBy("label").agg(F.countDistinct(F.when(F.col("held_out"), F.col("subject"))).alias("held_subjects"), F.countDistinct("subject").alias("subjects"))


@query("sp3_stratified_folds", "SELECT y, fold, (n // 5 + (fold < n % 5)::INT)::BIGINT AS n FROM (SELECT toxic::INT AS y, count(*) AS n FROM labels GROUP BY 1), (SELECT unnest(range(0, 5))::INT AS fold)", digits=None)
def strat(t):
    return P.stratified_folds(t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")), 5).groupBy("y", "fold").agg(F.count(L(1)).alias("n"))


@query("sp3_group_folds", """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS i FROM g)
SELECT CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END::INT AS fold, sum(n)::BIGINT AS rows, count(*) AS groups FROM r GROUP BY 1""")
def groups(t):
    f = P.group_folds(t.orders.select("o_orderkey", "o_custkey"), 5, "o_custkey")
    return f.groupBy("fold").agg(F.count(L(1)).alias("rows"), F.countDistinct("o_custkey").alias("groups"))


@query("wn10_cmu_sessionise", "SELECT subject, session, count(*) AS rows FROM (SELECT user_id AS subject, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS session, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE (session + 1) * 10 <= total GROUP BY ALL")
def cmu(t):
    return P.cmu_sessionise(t.events.select(F.col("user_id").alias("subject"), F.col("event_id").alias("rep")), 11).groupBy("subject", "session").agg(F.count(L(1)).alias("rows"))


@query("wn11_aalto_sessionise", """WITH RECURSIVE sec AS (SELECT user_id AS subject, (event_id // 500)::VARCHAR AS section, count(*) * 20 AS n FROM events GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY section) AS rn FROM sec),
 w AS (SELECT subject, rn, section, 0 AS session, n AS have FROM o WHERE rn = 1 UNION ALL SELECT o.subject, o.rn, o.section, w.session + (w.have >= 110)::INT, CASE WHEN w.have >= 110 THEN o.n ELSE w.have + o.n END FROM w JOIN o ON o.subject = w.subject AND o.rn = w.rn + 1)
SELECT subject, session, count(*) AS sections, max(have)::BIGINT AS keys FROM w GROUP BY ALL HAVING max(have) >= 110""")
def aalto(t):
    sec = t.events.groupBy(F.col("user_id").alias("subject"), F.floor(F.col("event_id") / 500).cast("string").alias("section")).agg((F.count(L(1)) * 20).alias("n_keys"))
    s = P.aalto_sessionise(sec)
    return s.join(sec, ["subject", "section"]).groupBy("subject", "session").agg(F.count(L(1)).alias("sections"), F.sum("n_keys").alias("keys"))
