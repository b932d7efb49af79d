"""Relational views: projections, filters, joins, operational aggregates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import sampling, scoring, views
from ..sources.policy import FIELDS, policy_struct
from . import bindings as B
from .bindings import AUDIT, HASHES, OUTPUTS, POLICIES, SUBS, VERD, with_ctes
from .registry import query

L = F.lit
AS_OF = "2001-08-01 00:00:00"
day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
DAY = "strftime({}, '%Y-%m-%d') AS day"


@query("prj1_browse_submissions", with_ctes(SUBS, VERD) + f"""SELECT s.submission_id, merchant_id, {DAY.format('created_at')}, source, claimed_name, verdict, final_score, attack_pattern
FROM subs s LEFT JOIN verd v USING (submission_id) WHERE merchant_id = 'BUILDING' AND verdict = 'REVIEW' AND source = 'api' ORDER BY created_at DESC, submission_id DESC LIMIT 50 OFFSET 10""")
def browse(t):
    df = views.browse_submissions(B.submissions(t), B.verdicts(t), merchant="BUILDING", verdict="REVIEW", source="api", limit=50, offset=10)
    return df.select("submission_id", "merchant_id", day("created_at"), "source", "claimed_name", "verdict", "final_score", "attack_pattern")


@query("prj2_submission_detail", with_ctes(SUBS, VERD) + f"SELECT s.submission_id, merchant_id, {DAY.format('created_at')}, label, external_ref, verdict, final_score, abstained FROM subs s LEFT JOIN verd v USING (submission_id) WHERE s.submission_id = 42")
def detail(t):
    return views.submission_detail(B.submissions(t), B.verdicts(t), 42).select("submission_id", "merchant_id", day("created_at"), "label", "external_ref", "verdict", "final_score", "abstained")


@query("prj3_audit_stream", with_ctes(AUDIT) + f"SELECT id, submission_id, event, {DAY.format('created_at')} FROM audit ORDER BY created_at DESC, id DESC LIMIT 100")
def audit_stream(t):
    return views.audit_stream(B.audit(t), 100).select("id", "submission_id", "event", day("created_at"))


@query("prj4_sweep_candidates", with_ctes(SUBS, VERD) + """, newest AS (SELECT * FROM subs WHERE merchant_id = 'MACHINERY' AND created_at >= TIMESTAMP '1997-01-01' ORDER BY created_at DESC, submission_id DESC LIMIT 200)
SELECT n.submission_id, v.verdict AS previous_verdict, v.final_score AS previous_score FROM newest n LEFT JOIN verd v USING (submission_id) WHERE v.verdict IS NULL OR v.verdict = 'PASS'""")
def sweep(t):
    df = views.sweep_candidates(B.submissions(t), B.verdicts(t), merchant="MACHINERY", since="1997-01-01", limit=200)
    return df.select("submission_id", "previous_verdict", "previous_score")


@query("prj5_effective_policy", with_ctes(POLICIES) + "SELECT merchant_id, " + ", ".join(FIELDS) + " FROM policies")
def policy(t):
    return B.policies(t)


@query("prj7_clamp_and_status", with_ctes("x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 20 - 0.5 AS raw, l_quantity AS q, l_returnflag AS f FROM lineitem)") + """
SELECT status, count(*) AS n, sum(score) AS total_score, sum(confidence) AS total_confidence FROM (
  SELECT CASE WHEN f = 'N' THEN 'skipped' WHEN q = 13 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN f = 'N' OR q = 13 THEN 0 ELSE greatest(0, least(1, raw)) END AS score, CASE WHEN f = 'N' OR q = 13 THEN 0 ELSE greatest(0, least(1, q / 40)) END AS confidence FROM x) GROUP BY status""")
def status(t):
    q = F.col("l_quantity")
    df = t.lineitem.select(F.col("l_orderkey").alias("submission_id"), "l_returnflag", "l_quantity", "l_discount")
    # a failing expression yields null, here for quantity 13
    ran = scoring.run_detector(df, "demo", F.col("l_returnflag") != "N", F.col("l_discount") * 20 - 0.5, F.when(q != 13, q / 40))
    return ran.groupBy("status").agg(F.count(L(1)).alias("n"), F.sum("score").alias("total_score"), F.sum("confidence").alias("total_confidence"))


@query("prj9_fusion_features", with_ctes(OUTPUTS) + "SELECT submission_id, " + ", ".join(
    f"coalesce(max(CASE WHEN detector = '{d}' AND status = 'ok' THEN {src} END), 0) AS {d}_{suffix}" for d in ["selfie_deepfake", "liveness_video", "id_forensics", "face_match", "metadata_exif"] for src, suffix in (("score", "score"), ("confidence", "conf"))
) + " FROM outputs GROUP BY submission_id")
def fusion_features(t):
    return scoring.fusion_features(scoring.wide_outputs(B.detector_outputs(t)))


@query("prj11_fixture_manifest", with_ctes(SUBS, VERD) + """SELECT s.submission_id, coalesce(display_name, external_ref, substr(s.submission_id::VARCHAR, 1, 8)) AS name, label, attack_type, verdict AS last_verdict, final_score AS last_score,
 (SELECT count(*) FROM subs WHERE source = 'gauntlet' AND label = 'real') AS n_real, (SELECT count(*) FROM subs WHERE source = 'gauntlet' AND label = 'fake') AS n_fake
 FROM subs s LEFT JOIN verd v USING (submission_id) WHERE source = 'gauntlet'""")
def fixtures(t):
    return views.fixture_manifest(B.submissions(t), B.verdicts(t)).drop("created_at")


@query("jn1_submission_verdict", with_ctes(SUBS, VERD) + "SELECT merchant_id, verdict, count(*) AS n, avg(final_score) AS mean_score FROM subs JOIN verd USING (submission_id) GROUP BY ALL")
def inner(t):
    return views.with_verdict(B.submissions(t), B.verdicts(t), "inner").groupBy("merchant_id", "verdict").agg(F.count(L(1)).alias("n"), F.avg("final_score").alias("mean_score"))


@query("jn2_graph_nodes", with_ctes(SUBS, VERD) + "SELECT s.submission_id, merchant_id, claimed_name, coalesce(verdict, 'REVIEW') AS verdict, coalesce(final_score, 0.0) AS final_score, generator_guess FROM subs s LEFT JOIN verd v USING (submission_id)")
def nodes(t):
    return views.graph_defaults(views.with_verdict(B.submissions(t), B.verdicts(t))).select("submission_id", "merchant_id", "claimed_name", "verdict", "final_score", "generator_guess")


@query("jn3_undecided", with_ctes(VERD, AUDIT) + "SELECT submission_id, final_score FROM verd WHERE verdict = 'REVIEW' AND submission_id NOT IN (SELECT submission_id FROM audit WHERE event = 'analyst_decision')")
def undecided(t):
    return views.undecided(B.verdicts(t).filter("verdict = 'REVIEW'"), B.audit(t)).select("submission_id", "final_score")


NEWVERD = """newv AS (SELECT submission_id, (final_score * 7) % 1 AS final_score, CASE WHEN (final_score * 7) % 1 >= 0.8 THEN 'REJECT' WHEN (final_score * 7) % 1 >= 0.45 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM
  (SELECT o_orderkey AS submission_id, (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000.0::DOUBLE AS final_score FROM orders))"""
DIFF = """diff AS (SELECT n.submission_id, p.verdict AS previous_verdict, p.final_score AS previous_score, n.verdict AS new_verdict, n.final_score AS new_score,
  n.verdict <> 'PASS' AND (p.verdict IS NULL OR p.verdict = 'PASS') AS newly_flagged FROM newv n LEFT JOIN verd p USING (submission_id))"""


def new_verdicts(t):
    s = ((F.round(F.col("o_totalprice") * 100).cast("bigint") % 1000) / 1000.0 * 7) % 1
    return t.orders.select(F.col("o_orderkey").alias("submission_id"), s.alias("final_score"), F.when(s >= 0.8, "REJECT").when(s >= 0.45, "REVIEW").otherwise("PASS").alias("verdict"))


@query("jn11_verdict_diff", with_ctes(VERD, NEWVERD, DIFF) + "SELECT * FROM diff")
def diff(t):
    return views.verdict_diff(B.verdicts(t), new_verdicts(t))


@query("ag6_sweep_summary", with_ctes(VERD, NEWVERD, DIFF) + "SELECT count(*) AS scanned, count(*) FILTER (WHERE newly_flagged) AS newly_flagged FROM diff")
def sweep_summary(t):
    return views.sweep_summary(views.verdict_diff(B.verdicts(t), new_verdicts(t)))


@query("jn10_telemetry_attach", with_ctes(SUBS) + """, sess AS (SELECT user_id AS token, count(*) AS event_count FROM events GROUP BY user_id)
SELECT submission_id, submission_id % 200 AS token, event_count, event_count IS NOT NULL AS telemetry_present FROM subs LEFT JOIN sess ON sess.token = submission_id % 200""")
def attach(t):
    sessions = t.events.groupBy(F.col("user_id").alias("token")).agg(F.count(L(1)).alias("event_count"))
    subs = B.submissions(t).select("submission_id", (F.col("submission_id") % 200).alias("token"))
    return views.telemetry_attach(subs, sessions)


@query("jn12_red_team_unused", with_ctes(SUBS) + "SELECT count(*) AS picked, 0 AS already_used FROM (SELECT 1 FROM subs WHERE source = 'redteam' AND external_ref IS NULL LIMIT 25)", digits=None)
def red_team(t):
    s = B.submissions(t).filter("source = 'redteam'").withColumnRenamed("submission_id", "id")
    used = s.filter(F.col("external_ref").isNotNull())
    picked = sampling.red_team_unused(s, used.select("id"), 25)
    return picked.agg(F.count(L(1)).alias("picked"), F.count("external_ref").cast("int").alias("already_used"))


@query("jn16_neighbour_feed", with_ctes(SUBS) + f"""SELECT submission_id, {DAY.format('created_at')} FROM subs WHERE submission_id = 7 OR submission_id IN
 (SELECT o2.o_orderkey FROM orders o1 JOIN orders o2 ON o1.o_custkey = o2.o_custkey AND o1.o_orderkey <> o2.o_orderkey WHERE o1.o_orderkey = 7) ORDER BY created_at DESC, submission_id DESC LIMIT 60""")
def feed(t):
    # star edges: every order hangs on the selected order of the same customer
    o = t.orders.select("o_orderkey", "o_custkey")
    hub = o.filter("o_orderkey = 7").select(F.col("o_orderkey").alias("source"), "o_custkey")
    edges = o.join(hub, "o_custkey").filter("o_orderkey <> source").select("source", F.col("o_orderkey").alias("target"))
    return views.neighbour_feed(B.submissions(t), edges, 7).select("submission_id", day("created_at"))


GALLERY = VERD + ", " + SUBS + f""", flagged AS (SELECT s.merchant_id, v.*, coalesce(attack_pattern, 'unclassified') AS pattern FROM verd v JOIN subs s USING (submission_id)
  WHERE verdict <> 'PASS' AND decided_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2400 HOUR)"""


def gallery(t):
    return views.attack_gallery(B.submissions(t), B.verdicts(t), AS_OF, hours=2400)


@query("ag1_attack_gallery", with_ctes(GALLERY) + """SELECT pattern, CASE pattern WHEN 'impersonation' THEN 'Impersonation (selfie ≠ ID holder)' WHEN 'generated_selfie' THEN 'AI-generated selfie' WHEN 'clean' THEN 'No attack pattern detected'
 WHEN 'tampered_document' THEN 'Tampered ID document' ELSE 'Unclassified' END AS label, count(*) AS count, avg(final_score) AS mean_score, string_agg(DISTINCT merchant_id, ',' ORDER BY merchant_id) AS merchants FROM flagged GROUP BY pattern""")
def gallery_groups(t):
    return gallery(t)["groups"].withColumn("merchants", F.array_join("merchants", ","))


@query("ag1_gallery_generators", with_ctes(GALLERY) + "SELECT pattern, generator_guess, count(*) AS n FROM flagged WHERE generator_guess IS NOT NULL GROUP BY ALL")
def gallery_generators(t):
    return gallery(t)["generators"]


@query("ag1_gallery_samples", with_ctes(GALLERY) + "SELECT pattern, rn::INT AS rn, submission_id, final_score FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY decided_at DESC, submission_id DESC) AS rn FROM flagged) WHERE rn <= 8")
def gallery_samples(t):
    return gallery(t)["samples"].select("pattern", "rn", "submission_id", "final_score")


DECILES = ", ".join(f"quantile_cont(final_score, {i / 10}) AS score_d{i}" for i in range(11))


@query("ag2_live_stats", with_ctes(VERD) + f"""SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'REVIEW') AS n_review, count(*) FILTER (WHERE verdict = 'REJECT') AS n_reject,
 count(*) FILTER (WHERE abstained) / count(*) AS abstention_rate, (SELECT quantile_cont(latency_ms, 0.5) FROM verd WHERE latency_ms <> 0) AS latency_p50, (SELECT quantile_cont(latency_ms, 0.9) FROM verd WHERE latency_ms <> 0) AS latency_p90,
 (SELECT quantile_cont(latency_ms, 0.99) FROM verd WHERE latency_ms <> 0) AS latency_p99, (SELECT avg(latency_ms) FROM verd WHERE latency_ms <> 0) AS latency_mean, max(latency_ms) AS latency_max, {DECILES} FROM verd""")
def live_stats(t):
    return views.live_stats(B.verdicts(t))


@query("ag2_pattern_totals", with_ctes(VERD) + "SELECT attack_pattern, count(*) AS n FROM verd GROUP BY ALL")
def pattern_totals(t):
    return views.pattern_totals(B.verdicts(t))


@query("ag3_latency_histogram", with_ctes(VERD) + """, b AS (SELECT min(latency_ms) AS lo, (max(latency_ms) - min(latency_ms)) / 12 AS w FROM verd WHERE latency_ms <> 0)
SELECT least(floor((latency_ms - lo) / w), 11)::INT AS bin, count(*) AS n, any_value(lo + least(floor((latency_ms - lo) / w), 11) * w) AS from_ms FROM verd, b WHERE latency_ms <> 0 GROUP BY 1""")
def histogram(t):
    return views.latency_histogram(B.verdicts(t))


@query("ag4_review_agreement", with_ctes(AUDIT) + """SELECT count(*) AS decisions, count(*) FILTER (WHERE (decision = 'reject' AND model_score >= 0.5) OR (decision = 'approve' AND model_score < 0.5)) / count(*) AS agreement_rate,
 count(*) FILTER (WHERE decision = 'approve') AS n_approve, count(*) FILTER (WHERE decision = 'reject') AS n_reject, count(*) FILTER (WHERE decision = 'escalate') AS n_escalate FROM audit WHERE event = 'analyst_decision'""")
def agreement(t):
    return views.review_agreement(B.audit(t))


BOARD = """SELECT merchant_id, count(*) AS total, count(*) FILTER (WHERE label = 'fake' AND verdict <> 'PASS') AS fakes_caught, count(*) FILTER (WHERE label = 'fake') AS fakes_total,
 count(*) FILTER (WHERE label = 'real' AND verdict = 'PASS') AS reals_passed, count(*) FILTER (WHERE label = 'real' AND verdict = 'REVIEW') AS reals_reviewed, count(*) FILTER (WHERE label = 'real' AND verdict = 'REJECT') AS reals_rejected,
 count(*) FILTER (WHERE label = 'real') AS reals_total, avg(latency_ms) AS mean_latency_ms, count(*) FILTER (WHERE label = 'fake' AND verdict <> 'PASS') / count(*) FILTER (WHERE label = 'fake') AS detection_rate,
 count(*) FILTER (WHERE label = 'fake' AND verdict = 'PASS') / count(*) FILTER (WHERE label = 'fake') AS false_accept_rate, count(*) FILTER (WHERE label = 'real' AND verdict <> 'PASS') / count(*) FILTER (WHERE label = 'real') AS false_reject_rate,
 count(*) FILTER (WHERE (label = 'fake') = (verdict <> 'PASS')) / count(*) AS accuracy FROM subs JOIN verd USING (submission_id) GROUP BY merchant_id"""


def results(t):
    return views.with_verdict(B.submissions(t), B.verdicts(t), "inner").withColumnRenamed("label", "truth")


@query("ag5_scoreboard", with_ctes(SUBS, VERD) + BOARD)
def scoreboard(t):
    return views.scoreboard(results(t), ["merchant_id"])


@query("ag7_pattern_counts", with_ctes(VERD) + "SELECT CASE WHEN attack_pattern IS NULL OR attack_pattern = 'clean' THEN 'unclassified' ELSE attack_pattern END AS pattern, count(*) AS n FROM verd WHERE verdict <> 'PASS' GROUP BY 1 ORDER BY n DESC, pattern LIMIT 6")
def patterns(t):
    return views.pattern_counts(B.verdicts(t))


@query("ag7_generator_counts", with_ctes(VERD) + "SELECT generator_guess, count(*) AS n FROM verd WHERE generator_guess IS NOT NULL GROUP BY 1")
def generators(t):
    return views.generator_counts(B.verdicts(t))


@query("ag7_merchants_hit", with_ctes(SUBS, VERD) + "SELECT count(DISTINCT merchant_id) AS merchants FROM subs JOIN verd USING (submission_id) WHERE verdict <> 'PASS'")
def merchants(t):
    return views.merchants_hit(results(t))


@query("ag31_status_counts", with_ctes(VERD) + "SELECT 'verdict' AS field, verdict AS value, count(*) AS n FROM verd GROUP BY 2 UNION ALL SELECT 'attack_pattern', attack_pattern, count(*) FROM verd GROUP BY 2")
def status_counts(t):
    from ..operators.metrics import status_counts as sc

    return sc(B.verdicts(t), ["verdict", "attack_pattern"])


@query("tk1_review_queue", with_ctes(SUBS, VERD, AUDIT) + "SELECT submission_id, merchant_id, claimed_name, final_score, abstained, attack_pattern FROM subs JOIN verd USING (submission_id) WHERE verdict = 'REVIEW' AND submission_id NOT IN (SELECT submission_id FROM audit WHERE event = 'analyst_decision') ORDER BY final_score DESC, submission_id LIMIT 50")
def queue(t):
    return views.review_queue(B.submissions(t), B.verdicts(t), B.audit(t)).select("submission_id", "merchant_id", "claimed_name", "final_score", "abstained", "attack_pattern")


QUEUE = """queue AS (SELECT submission_id FROM subs JOIN verd USING (submission_id) WHERE verdict = 'REVIEW' AND submission_id NOT IN (SELECT submission_id FROM audit WHERE event = 'analyst_decision') ORDER BY final_score DESC, submission_id LIMIT 50)"""


def full_queue(t):
    hashes = B.asset_hashes(t).withColumn("kind", L("selfie"))
    return views.review_queue(B.submissions(t), B.verdicts(t), B.audit(t), outputs=B.detector_outputs(t), hashes=hashes)


@query("tk1_detector_summary", with_ctes(SUBS, VERD, AUDIT, OUTPUTS, QUEUE) + "SELECT submission_id, detector, round(score, 3) AS score, status FROM outputs WHERE submission_id IN (FROM queue)")
def queue_detectors(t):
    return full_queue(t).select("submission_id", F.explode("detector_summary").alias("e")).select("submission_id", "e.*")


@query("tk1_shared_selfies", with_ctes(SUBS, VERD, AUDIT, HASHES, QUEUE) + """, s AS (SELECT h.submission_id, h.content_hash, subs.claimed_name AS name FROM hashes h LEFT JOIN subs USING (submission_id))
SELECT q.submission_id, nullif((SELECT count(*) FROM s o WHERE o.content_hash = s.content_hash AND o.submission_id <> s.submission_id), 0) AS shared_selfie_with,
 CASE WHEN EXISTS (FROM s o WHERE o.content_hash = s.content_hash AND o.submission_id <> s.submission_id) THEN (SELECT count(DISTINCT o.name) FROM s o WHERE o.content_hash = s.content_hash AND o.submission_id <> s.submission_id) END AS n_other_names FROM queue q LEFT JOIN s ON s.submission_id = q.submission_id""")
def queue_selfies(t):
    return full_queue(t).select("submission_id", "shared_selfie_with", "n_other_names")


@query("snk5_alert_rows", with_ctes(SUBS, VERD, POLICIES) + "SELECT submission_id, merchant_id, final_score FROM subs JOIN verd USING (submission_id) JOIN policies USING (merchant_id) WHERE verdict = 'REJECT' AND final_score >= webhook_min_score")
def alert_rows(t):
    return views.alert_rows(results(t), B.policies(t)).select("submission_id", "merchant_id", "final_score")


@query("snk6_decisions", with_ctes(VERD) + """, dec AS (SELECT o_orderkey AS submission_id, CASE (o_orderkey // 3) % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'escalate' ELSE 'ponder' END AS decision FROM orders WHERE o_orderkey % 3 = 0)
SELECT d.submission_id, 'HUMAN_' || upper(d.decision) AS status FROM dec d WHERE d.decision <> 'ponder'""")
def decisions(t):
    k = F.col("o_orderkey")
    step = F.floor(k / 3) % 4
    made = t.orders.filter(k % 3 == 0).select(
        k.alias("submission_id"), F.when(step == 0, "approve").when(step == 1, "reject").when(step == 2, "escalate").otherwise("ponder").alias("decision"), L("ops").alias("analyst"), L(None).cast("string").alias("note"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    return views.human_status(views.decision_events(made, B.verdicts(t)))


# --- decision functions over the same tables ------------------------------------
@query("sc20_ceiling", with_ctes(POLICIES) + "SELECT merchant_id, greatest(min_risk_for_review, min_risk_for_reject - abstain_band - 0.000001) AS ceiling FROM policies", digits=9)
def ceiling(t):
    return B.policies(t).select("merchant_id", S.ceiling(F.col("min_risk_for_review"), F.col("min_risk_for_reject"), F.col("abstain_band")).alias("ceiling"))


@query("sc24_decide", with_ctes(SUBS, VERD, POLICIES) + """SELECT submission_id,
 CASE WHEN v0 = 'PASS' AND forced THEN 'REVIEW' ELSE v0 END AS verdict, band OR (v0 = 'PASS' AND forced) AS abstained FROM (
 SELECT submission_id, CASE WHEN band THEN 'REVIEW' WHEN s >= rej THEN 'REJECT' WHEN s >= rev THEN 'REVIEW' ELSE 'PASS' END AS v0, band, (live AND submission_id % 5 = 0) OR (doc AND submission_id % 7 = 0) OR submission_id % 11 = 0 AS forced FROM (
 SELECT submission_id, final_score AS s, min_risk_for_reject AS rej, min_risk_for_review AS rev, require_liveness AS live, require_id_document AS doc,
  (final_score >= min_risk_for_reject AND final_score < min_risk_for_reject + abstain_band) OR (final_score < min_risk_for_reject AND final_score < min_risk_for_review AND final_score > min_risk_for_review - abstain_band) AS band
 FROM subs JOIN verd USING (submission_id) JOIN policies USING (merchant_id)))""")
def decide(t):
    k = F.col("submission_id")
    j = results(t).select("submission_id", "merchant_id", "final_score").join(B.policies(t), "merchant_id")
    d = S.decide(F.col("final_score"), policy_struct(), k % 5 != 0, k % 7 != 0, None, k % 11 == 0)
    return j.select("submission_id", d.alias("d")).select("submission_id", "d.verdict", "d.abstained")
