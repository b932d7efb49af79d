"""How the given tables play the roles the operators expect, in Spark and in SQL.

Each role is plain arithmetic on real columns, so both engines derive the same values.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..operators.durable import spread
from ..sources.policy import FIELDS, effective_policies, overlay_rows
from .registry import Tables  # noqa: F401

L = F.lit
# the shipped overlays, attached to two of the market segments
OVERLAYS = {"MACHINERY": K.SHIPPED_OVERLAYS["crypto_exchange_01"], "HOUSEHOLD": K.SHIPPED_OVERLAYS["gig_marketplace_02"]}


def cents():
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


def submissions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    source = F.when(k % 4 == 0, "api").when(k % 4 == 1, "gauntlet").when(k % 4 == 2, "redteam").otherwise("batch")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("submission_id"), F.col("c_mktsegment").alias("merchant_id"), F.col("c_name").alias("claimed_name"), F.col("o_orderdate").cast("timestamp").alias("created_at"), source.alias("source"),
        F.when(k % 2 == 0, "real").otherwise("fake").alias("label"), F.when(k % 2 == 1, F.col("o_orderpriority")).alias("attack_type"),
        F.when(k % 3 == 0, F.concat(L("ref-"), k.cast("string"))).alias("external_ref"), F.when(k % 5 == 0, F.concat(L("Case "), k.cast("string"))).alias("display_name"),
    )


SUBS = """subs AS (
  SELECT o_orderkey AS submission_id, c_mktsegment AS merchant_id, c_name AS claimed_name, o_orderdate AS created_at,
    CASE o_orderkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'gauntlet' WHEN 2 THEN 'redteam' ELSE 'batch' END AS source,
    CASE WHEN o_orderkey % 2 = 0 THEN 'real' ELSE 'fake' END AS label, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS attack_type,
    CASE WHEN o_orderkey % 3 = 0 THEN 'ref-' || o_orderkey END AS external_ref, CASE WHEN o_orderkey % 5 = 0 THEN 'Case ' || o_orderkey END AS display_name
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def verdicts(t: Tables) -> DataFrame:
    k, pr, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    score = (F.round(F.col("o_totalprice") * 100).cast("bigint") % 1000) / 1000.0
    return t.orders.filter(k % 17 != 0).select(
        k.alias("submission_id"), score.alias("final_score"),
        F.when(score >= 0.8, "REJECT").when(score >= 0.45, "REVIEW").otherwise("PASS").alias("verdict"),
        F.when(pr == "1-URGENT", "impersonation").when(pr == "2-HIGH", "generated_selfie").when(pr == "3-MEDIUM", "clean").when(pr == "5-LOW", "tampered_document").alias("attack_pattern"),
        F.when(st == "F", K.GENERATOR_LABELS["sdxl"]).when(st == "P", K.GENERATOR_LABELS["stylegan"]).alias("generator_guess"),
        (k % 10 == 0).alias("abstained"), F.when(k % 13 == 0, 0.0).otherwise(F.col("o_totalprice") / 100.0).alias("latency_ms"), F.col("o_orderdate").cast("timestamp").alias("decided_at"),
    )


VERD = """verd AS (
  SELECT submission_id, final_score, CASE WHEN final_score >= 0.8 THEN 'REJECT' WHEN final_score >= 0.45 THEN 'REVIEW' ELSE 'PASS' END AS verdict,
    attack_pattern, generator_guess, abstained, latency_ms, decided_at
  FROM (SELECT o_orderkey AS submission_id, (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000.0::DOUBLE AS final_score,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'impersonation' WHEN '2-HIGH' THEN 'generated_selfie' WHEN '3-MEDIUM' THEN 'clean' WHEN '5-LOW' THEN 'tampered_document' END AS attack_pattern,
    CASE o_orderstatus WHEN 'F' THEN 'SDXL / SDXL-Turbo' WHEN 'P' THEN 'StyleGAN family' END AS generator_guess,
    o_orderkey % 10 = 0 AS abstained, CASE WHEN o_orderkey % 13 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 100.0::DOUBLE END AS latency_ms, o_orderdate AS decided_at
    FROM orders WHERE o_orderkey % 17 <> 0))"""


def audit(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    step = F.floor(k / 3) % 3
    decision = F.when(step == 0, "approve").when(step == 1, "reject").otherwise("escalate")
    score = F.when(k % 7 != 0, (F.round(F.col("o_totalprice") * 100).cast("bigint") % 1000) / 1000.0)
    event = F.when(k % 3 == 0, "analyst_decision").when(k % 3 == 1, "verdict").otherwise("received")
    return t.orders.select(
        k.alias("id"), k.alias("submission_id"), event.alias("event"), F.to_json(F.struct(decision.alias("decision"), score.alias("model_score"))).alias("payload"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )


AUDIT = """audit AS (
  SELECT o_orderkey AS id, o_orderkey AS submission_id, CASE o_orderkey % 3 WHEN 0 THEN 'analyst_decision' WHEN 1 THEN 'verdict' ELSE 'received' END AS event,
    CASE (o_orderkey // 3) % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'escalate' END AS decision,
    CASE WHEN o_orderkey % 7 <> 0 THEN (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000.0::DOUBLE END AS model_score, o_orderdate AS created_at
  FROM orders)"""


def policies(t: Tables) -> DataFrame:
    return effective_policies(t.customer.select(F.col("c_mktsegment").alias("merchant_id")), overlay_rows(t.spark, OVERLAYS))


POLICIES = """policies AS (
  SELECT m.merchant_id,
    CASE m.merchant_id WHEN 'MACHINERY' THEN 0.60 WHEN 'HOUSEHOLD' THEN 0.88 ELSE 0.80 END::DOUBLE AS min_risk_for_reject,
    CASE m.merchant_id WHEN 'MACHINERY' THEN 0.25 ELSE 0.45 END::DOUBLE AS min_risk_for_review,
    m.merchant_id <> 'HOUSEHOLD' AS require_liveness, true AS require_id_document, false AS require_behavioral,
    0.05::DOUBLE AS abstain_band, 0.90::DOUBLE AS webhook_min_score, 365 AS audit_retention_days,
    CASE m.merchant_id WHEN 'MACHINERY' THEN 250000 WHEN 'HOUSEHOLD' THEN 12000 ELSE 85000 END::DOUBLE AS avg_fraud_loss_inr,
    CASE m.merchant_id WHEN 'HOUSEHOLD' THEN 9000 ELSE 42000 END::DOUBLE AS merchant_ltv_inr, 0.35::DOUBLE AS false_reject_abandon_prob
  FROM (SELECT DISTINCT c_mktsegment AS merchant_id FROM customer) m)"""


def detector_outputs(t: Tables) -> DataFrame:
    n = F.col("detector_no")
    flag = F.col("l_returnflag")
    least = lambda v: F.coalesce(F.max(flag == v) & ~F.max(flag < v), L(False))  # min(flag) = v without a string buffer, which only a sort aggregates
    # spread by order once: what follows by submission needs no further exchange
    lines = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_quantity"), t.lineitem.count(), "l_orderkey")
    one = lines.withColumn("detector_no", (F.col("l_linenumber") - 1) % 6 + 1).groupBy("l_orderkey", "detector_no").agg(
        F.max("l_discount").alias("d"), F.max("l_tax").alias("x"), least("R").alias("r"), least("N").alias("n"), F.min("l_quantity").alias("q")
    )
    status = F.when(F.col("r") & (F.col("q") < 10), "error").when(F.col("n") & (F.col("q") < 25), "skipped").otherwise("ok")
    name = F.element_at(F.array(*[L(d) for d in K.DETECTORS]), n)
    return one.select(F.col("l_orderkey").alias("submission_id"), name.alias("detector"), F.least(L(1.0), F.round(F.col("d") * 10, 4)).alias("score"), F.least(L(1.0), F.round(F.col("x") * 10, 4)).alias("confidence"), status.alias("status"))


OUTPUTS = """outputs AS (
  SELECT l_orderkey AS submission_id,
    CASE (l_linenumber - 1) % 6 + 1 WHEN 1 THEN 'selfie_deepfake' WHEN 2 THEN 'liveness_video' WHEN 3 THEN 'id_forensics' WHEN 4 THEN 'face_match' WHEN 5 THEN 'metadata_exif' ELSE 'behavioral' END AS detector,
    least(1.0::DOUBLE, round(max(l_discount) * 10, 4)) AS score, least(1.0::DOUBLE, round(max(l_tax) * 10, 4)) AS confidence,
    CASE WHEN min(l_returnflag) = 'R' AND min(l_quantity) < 10 THEN 'error' WHEN min(l_returnflag) = 'N' AND min(l_quantity) < 25 THEN 'skipped' ELSE 'ok' END AS status
  FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) % 6 + 1)"""


def scored(t: Tables) -> DataFrame:
    """Labelled scores with ties on purpose, plus categorical slices."""
    d = t.documents.join(t.labels, "doc_id")
    n = F.col("n_chars")
    return d.select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"), F.col("quality").cast("int").alias("quality"), ((n % 97) / 97.0).alias("score"), ((n % 89) / 89.0).alias("doc_score"), ((n % 83) / 83.0).alias("tamper"),
        F.when(F.col("toxic") == 1, F.element_at(F.array(*[L(a) for a in ATTACKS]), (F.col("doc_id") % 4 + 1).cast("int"))).alias("attack_type"),
        "lang", "source", F.when(F.col("doc_id") % 3 == 0, "scan").otherwise("photo").alias("capture_mode"), ((n % 120) - 50).cast("double").alias("tone_angle"), (F.col("doc_id") % 5).cast("int").alias("fold"), n.alias("n_chars"),
    )


ATTACKS = ["generated_selfie", "face_swap_liveness", "tampered_document", "impersonation"]
SCORED = """scored AS (
  SELECT d.doc_id AS id, toxic::INT AS y, quality::INT AS quality, (n_chars % 97) / 97.0::DOUBLE AS score, (n_chars % 89) / 89.0::DOUBLE AS doc_score, (n_chars % 83) / 83.0::DOUBLE AS tamper,
    CASE WHEN toxic = 1 THEN ['generated_selfie', 'face_swap_liveness', 'tampered_document', 'impersonation'][d.doc_id % 4 + 1] END AS attack_type, lang, source,
    CASE WHEN d.doc_id % 3 = 0 THEN 'scan' ELSE 'photo' END AS capture_mode, ((n_chars % 120) - 50)::DOUBLE AS tone_angle, (d.doc_id % 5)::INT AS fold, n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def embeddings(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("submission_id"), F.col("embedding").alias("vector"), F.concat(L("p"), F.col("label").cast("string")).alias("claimed_name"),
        F.concat(L("m"), (F.col("vec_id") % 5).cast("string")).alias("merchant_id"), F.timestamp_seconds(1704067200 + (F.col("vec_id") * 7919 % 1000) * 3600).alias("created_at"), F.col("label").alias("identity"),
    )


EMB = """emb AS (
  SELECT vec_id AS submission_id, embedding::DOUBLE[] AS vector, 'p' || label AS claimed_name, 'm' || (vec_id % 5) AS merchant_id, vec_id * 7919 % 1000 AS at, label AS identity FROM embeddings)"""
FACE_T = 0.35  # the shipped 0.8169 has no hits in this data, which is checked too


def asset_hashes(t: Tables) -> DataFrame:
    """Bytes = the text, image hash = a template (the source) plus two varying hex digits."""
    vary = F.lpad(F.lower(F.hex(F.col("n_chars") % 50)), 2, "0")
    return t.documents.select(
        F.col("doc_id").alias("submission_id"), F.col("lang").alias("kind"), F.sha2("text", 256).alias("content_hash"), F.concat(vary, F.substring(F.sha2("source", 256), 1, 14)).alias("phash"), F.col("source").alias("claimed_name")
    )


HASHES = """hashes AS (
  SELECT doc_id AS submission_id, lang AS kind, sha256(text) AS content_hash, lpad(printf('%x', n_chars % 50), 2, '0') || substr(sha256(source), 1, 14) AS phash, source AS claimed_name FROM documents)"""


def vector_hashes(t: Tables) -> DataFrame:
    """64-bit fingerprints: the sign bits of the vectors."""
    bit = F.array_join(F.transform("embedding", lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    half = lambda at: F.lpad(F.lower(F.conv(F.substring(bit, at, 32), 2, 16)), 8, "0")
    return t.embeddings.select(F.col("vec_id").alias("submission_id"), L("selfie").alias("kind"), F.concat(half(1), half(33)).alias("phash"), L("").alias("content_hash"))


def event_clock():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def key_events(t: Tables) -> DataFrame:
    """Events of a user as keystrokes on a compressed clock (1e8 microseconds become one ms)."""
    down = event_clock() / 1e8
    kind = F.when(F.col("event_type") == "error", "Backspace").when(F.col("event_type") == "signup", "Shift").otherwise("a")
    return t.events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("pos"), kind.alias("key"), down.alias("down"), F.when(F.col("event_id") % 50 != 0, down + F.col("value")).alias("up")
    )


KEYS = """keys AS (
  SELECT user_id AS session, event_id AS pos, CASE event_type WHEN 'error' THEN 'Backspace' WHEN 'signup' THEN 'Shift' ELSE 'a' END AS key,
    epoch_us(ts) / 1e8::DOUBLE AS down, CASE WHEN event_id % 50 <> 0 THEN epoch_us(ts) / 1e8::DOUBLE + value END AS up FROM events)"""


def prop_k():
    return F.get_json_object("props", "$.k").cast("double")


def mouse_events(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), (event_clock() / 1e8).alias("t"), F.col("value").alias("x"), prop_k().alias("y"))


MOUSE = """mouse AS (SELECT user_id AS session, event_id AS pos, epoch_us(ts) / 1e8::DOUBLE AS t, value AS x, json_extract(props, '$.k')::DOUBLE AS y FROM events)"""


def focus_events(t: Tables) -> DataFrame:
    t_in = event_clock() / 1e8
    return t.events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.concat(F.col("event_type"), (prop_k() % 7).cast("int").cast("string")).alias("field"), prop_k().cast("int").alias("index"), t_in.alias("t_in"), (t_in + F.col("value")).alias("t_out")
    )


FOCUS = """focus AS (SELECT user_id AS session, event_id AS pos, event_type || (json_extract(props, '$.k')::INT % 7) AS field, json_extract(props, '$.k')::INT AS index,
    epoch_us(ts) / 1e8::DOUBLE AS t_in, epoch_us(ts) / 1e8::DOUBLE + value AS t_out FROM events)"""


def paste_events(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "purchase").select(F.col("user_id").alias("session"), F.when(prop_k() % 20 == 0, "pan").otherwise("address").alias("field"))


PASTES = """pastes AS (SELECT user_id AS session, CASE WHEN json_extract(props, '$.k')::INT % 20 = 0 THEN 'pan' ELSE 'address' END AS field FROM events WHERE event_type = 'purchase')"""


def frames(t: Tables) -> DataFrame:
    """Events of a user in time order as video frames; the order column is the event id."""
    v = F.col("value")
    return t.events.select(
        F.col("user_id").alias("clip"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 11 != 0, v).alias("roll"), v.alias("eye"), (v + prop_k()).alias("flow"), (v / 500.0).alias("p_fake")
    )


FRAMES = """frames AS (SELECT user_id AS clip, event_id AS pos, CASE WHEN event_id % 11 <> 0 THEN value END AS roll, value AS eye, value + json_extract(props, '$.k')::DOUBLE AS flow, value / 500.0::DOUBLE AS p_fake FROM events)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def auc_sql(src: str, score: str, y: str, by: list[str] = (), where: str = "true") -> str:
    """Rank form of ROC-AUC with mid-ranks for ties."""
    keys = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    tie = f"PARTITION BY {keys}{score}"
    return f"""(SELECT {keys}count(*) FILTER (WHERE y1 = 0) AS n_neg, count(*) FILTER (WHERE y1 = 1) AS n_pos,
      CASE WHEN count(*) FILTER (WHERE y1 = 1) > 0 AND count(*) FILTER (WHERE y1 = 0) > 0 THEN
        (sum(mid) FILTER (WHERE y1 = 1) - count(*) FILTER (WHERE y1 = 1) * (count(*) FILTER (WHERE y1 = 1) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (WHERE y1 = 1) * count(*) FILTER (WHERE y1 = 0)) END AS auc
    FROM (SELECT {keys}{y} AS y1, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS mid FROM {src} WHERE {where} AND {score} IS NOT NULL) {group})"""
