"""From detector outputs to verdicts: pivot, fusion, channels, policy, explanation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions import scoring as S
from ..functions.scalars import clamp01, cosine, literal_map, pct, plural
from .durable import spread

L = F.lit


# --- PRJ8 / UD1: the detector contract ---------------------------------------
def run_detector(df: DataFrame, name: str, applicable: Column, score: Column, confidence: Column) -> DataFrame:
    """A detector is three expressions. Absent inputs are skipped, a null result is an error,
    and both score 0; a bad row never fails the job (write the expressions with try_*)."""
    use = F.coalesce(applicable, L(False))
    failed = score.isNull() | confidence.isNull() | F.isnan(score) | F.isnan(confidence)
    status = F.when(~use, "skipped").when(failed, "error").otherwise("ok")
    value = lambda c: F.when(status == "ok", clamp01(c)).otherwise(0.0)
    return df.select("submission_id", L(name).alias("detector"), value(score).alias("score"), value(confidence).alias("confidence"), status.alias("status"))


class DetectorRegistry:
    """UD1/UD2: plug-in detectors and rules, all column expressions."""

    def __init__(self):
        self.detectors: dict[str, tuple] = {}
        self.rules: list[Column] = []

    def register_detector(self, name, applicable, score, confidence):
        self.detectors[name] = (applicable, score, confidence)

    def register_rule(self, name, when, weight, reason):
        from ..functions.scalars import rule

        self.rules.append(rule(name, when, weight, reason))

    def run(self, df: DataFrame) -> DataFrame:
        """All registered detectors in one pass: one array of structs, exploded."""
        entry = lambda n, a, s, c: F.struct(L(n).alias("d"), F.coalesce(a, L(False)).alias("a"), s.cast("double").alias("s"), c.cast("double").alias("c"))
        long = df.select("submission_id", F.explode(F.array(*[entry(n, *t) for n, t in self.detectors.items()])).alias("e"))
        bad = F.col("e.s").isNull() | F.col("e.c").isNull() | F.isnan("e.s") | F.isnan("e.c")
        status = F.when(~F.col("e.a"), "skipped").when(bad, "error").otherwise("ok")
        value = lambda c: F.when(status == "ok", clamp01(F.col(c))).otherwise(0.0)
        return long.select("submission_id", F.col("e.d").alias("detector"), value("e.s").alias("score"), value("e.c").alias("confidence"), status.alias("status"))


# --- PRJ9, SC22 ----------------------------------------------------------------
def wide_outputs(outputs: DataFrame, detectors=K.DETECTORS) -> DataFrame:
    """One row per submission: {d}_score, {d}_conf (0 unless ok) and {d}_status.

    A pivot with a fixed list: one partial aggregation, one shuffle.
    """
    ok = F.col("status") == "ok"
    aggs = []
    for d in detectors:
        here = F.col("detector") == d
        aggs += [
            F.coalesce(F.max(F.when(here & ok, F.col("score"))), L(0.0)).alias(f"{d}_score"),
            F.coalesce(F.max(F.when(here & ok, F.col("confidence"))), L(0.0)).alias(f"{d}_conf"),
            F.max(F.when(here, F.col("status"))).alias(f"{d}_status"),
        ]
    return outputs.groupBy("submission_id").agg(*aggs)


def fusion_features(wide: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Features by name in the model's stored order; an unknown name is an error."""
    order = order or [f"{d}_{s}" for d in K.FUSED_DETECTORS for s in ("score", "conf")]
    missing = [n for n in order if n not in wide.columns]
    if missing:
        raise ValueError(f"columns the model needs are absent: {missing}")
    return wide.select("submission_id", *order)


def heuristic_fuse(outputs: DataFrame) -> DataFrame:
    """0.65 x weighted mean + 0.35 x strongest confident score; 0.5 without any usable detector."""
    weight = F.try_element_at(literal_map(K.FUSION_WEIGHTS), F.col("detector"))
    used = (F.col("status") == "ok") & weight.isNotNull()
    eff = F.when(used, weight * F.greatest(F.col("confidence"), L(0.05)))
    loud = F.max(F.when(used & (F.col("confidence") >= 0.5), F.col("score")))
    agg = outputs.groupBy("submission_id").agg(F.sum(eff * F.col("score")).alias("num"), F.sum(eff).alias("den"), loud.alias("loud"))
    mix = clamp01(0.65 * F.col("num") / F.col("den") + 0.35 * F.greatest(F.coalesce("loud", L(0.0)), L(0.0)))
    return agg.select("submission_id", F.when(F.col("den") > 0, mix).otherwise(0.5).alias("fused"))


def heuristic_from_wide(w=None) -> Column:
    """SC22 over wide columns: no second shuffle when the pivot already exists."""
    num, den, loud = L(0.0), L(0.0), L(0.0)
    for d, wt in K.FUSION_WEIGHTS.items():
        ok = F.coalesce(F.col(f"{d}_status") == "ok", L(False))
        eff = F.when(ok, wt * F.greatest(F.col(f"{d}_conf"), L(0.05))).otherwise(0.0)
        num, den = num + eff * F.col(f"{d}_score"), den + eff
        loud = F.greatest(loud, F.when(ok & (F.col(f"{d}_conf") >= 0.5), F.col(f"{d}_score")).otherwise(0.0))
    return F.when(den > 0, clamp01(0.65 * num / den + 0.35 * loud)).otherwise(0.5)


# --- JN17 ----------------------------------------------------------------------
def face_match_pair(emb: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Selfie against document portrait of the same submission: a pivot on the id, no self-join."""
    v = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("vector")), F.when(F.col("kind") == k, 1).otherwise(0))
    both = emb.filter(F.col("kind").isin("selfie", "id_photo")).groupBy("submission_id").agg(v("selfie").alias("a"), v("id_photo").alias("b"))
    usable = (F.size(F.coalesce("a", F.array().cast("array<float>"))) > 0) & (F.size(F.coalesce("b", F.array().cast("array<float>"))) > 0)
    sim = both.withColumn("similarity", F.when(usable, cosine(F.col("a"), F.col("b")))).drop("a", "b")
    if hashes is not None:
        sim = sim.join(hashes.select("submission_id", "phash_distance"), "submission_id", "left")
    else:
        sim = sim.withColumn("phash_distance", L(64))
    return sim.select("submission_id", "similarity", S.face_match_score(F.col("similarity"), F.coalesce("phash_distance", L(64))).alias("m")).select("submission_id", "similarity", "m.*")


# --- WN4 -----------------------------------------------------------------------
def reason_rank(outputs: DataFrame, extras: DataFrame | None = None, top: int = 3, rows: int = 0) -> DataFrame:
    """The `top` heaviest distinct reasons per submission.

    outputs: submission_id, detector, score, confidence, status, reasons.
    extras: submission_id, weight, reason (channel reasons, already weighted).
    rows: about how many reasons there are; tasks grow in number with it, not in size.
    """
    w = F.col("score") * F.greatest(F.col("confidence"), L(0.1))
    long = outputs.filter(F.col("status") == "ok").select("submission_id", "detector", w.alias("w"), F.posexplode("reasons").alias("i", "reason"))
    long = long.select("submission_id", (F.col("w") * (1.0 - 0.15 * F.col("i"))).alias("weight"), "reason", "detector", "i")
    if extras is not None:
        long = extras.select("submission_id", "weight", "reason", L("").alias("detector"), L(0).alias("i")).unionByName(long)
    long = spread(long, rows, "submission_id")  # one exchange for both steps
    order = F.struct(-F.col("weight"), "detector", "i")
    best = long.groupBy("submission_id", F.lower(F.substring("reason", 1, 60)).alias("k")).agg(F.min_by(F.struct("weight", "reason", "detector", "i"), order).alias("e"))
    flat = best.select("submission_id", "e.*")
    rank = Window.partitionBy("submission_id").orderBy(F.desc("weight"), "detector", "i")
    return flat.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select("submission_id", "rank", "weight", "reason")


# --- SC26 ----------------------------------------------------------------------
def narrate(verdict, score, items: Column, pattern, generator, n_face, n_exact, n_near, abstained, behav_seen=None) -> Column:
    """Plain-language explanation from the signals that exist.

    `items` is an array of structs (detector, score, confidence, status, reason).
    """
    label = lambda d: F.element_at(literal_map(K.DETECTOR_LABELS), d)
    verb = F.when(verdict == "REJECT", "rejected").when(verdict == "REVIEW", "sent to human review").otherwise("approved")
    lead = F.concat(L("The submission was "), verb, L(" at an overall risk of "), F.format_string("%.2f", score), L("."))
    names = lambda arr: F.array_join(F.transform(arr, lambda e: label(e["detector"])), ", ")

    clean = F.filter(items, lambda e: (e["status"] == "ok") & (e["score"] < 0.35) & e["detector"].isin("selfie_deepfake", "id_forensics", "face_match", "liveness_video"))
    skipped = F.filter(items, lambda e: e["status"] == "skipped")
    quiet = F.when(F.size(clean) > 0, F.concat(L(" No material concern; in the clean range: "), F.lower(names(clean)), L("."))).otherwise(" No material concern.")
    quiet = F.concat(quiet, F.when(F.size(skipped) > 0, F.concat(L(" Not run for lack of input: "), names(skipped), L("."))).otherwise(""))

    loud = F.filter(items, lambda e: (e["status"] == "ok") & (e["score"] >= 0.4))
    keyed = F.transform(loud, lambda e, i: F.struct((-e["score"] * e["confidence"]).alias("k"), i.alias("i"), e.alias("e")))
    top = F.slice(F.array_sort(keyed), 1, 3)
    clause = lambda x: F.concat(F.coalesce(x["e"]["reason"], F.concat(label(x["e"]["detector"]), L(" flagged it"))), L(" ("), pct(x["e"]["score"]), L(" risk)"))
    body = F.when(F.size(top) > 0, F.concat(L(" Driven by "), F.array_join(F.transform(top, clause), "; "), L("."))).otherwise(" Driven by weak signals in combination.")
    known = F.try_element_at(literal_map(K.PATTERN_LABELS), pattern)
    extra = F.concat(
        F.when((pattern != "clean") & known.isNotNull(), F.concat(L(" Matches the pattern: "), known, L("."))).otherwise(""),
        F.when(generator.isNotNull(), F.concat(L(" Imagery attributed to "), generator, L("."))).otherwise(""),
    )
    behav = F.get(F.filter(items, lambda e: e["detector"] == "behavioral"), 0)
    seen = behav_seen if behav_seen is not None else L(None).cast("int")
    telemetry = (
        F.when(
            (behav["status"] == "ok") & (behav["score"] >= 0.5),
            F.concat(L(" Form behaviour scored "), pct(behav["score"]), L(" anomalous"), F.when(seen > 0, F.concat(L(" over "), seen.cast("string"), L(" events"))).otherwise(""), L(".")),
        )
        .when(behav["status"] == "skipped", " No form telemetry came with this packet.")
        .otherwise("")
    )
    parts = F.array_compact(
        F.array(plural(n_face, "face match", "face matches"), F.when(n_exact > 0, plural(n_exact, "identical asset")), F.when(n_near > 0, plural(n_near, "near-identical asset")))
    )
    linked = F.when((n_face > 0) | (n_exact > 0) | (n_near > 0), F.concat(L(" Earlier submissions hold "), F.array_join(parts, ", "), L("."))).otherwise("")
    broken = F.filter(items, lambda e: e["status"] == "error")
    caveat = F.concat(
        F.when(F.size(broken) > 0, F.concat(L(" "), names(broken), L(" failed, so the evidence is partial."))).otherwise(""),
        F.when(abstained, " The score fell in the abstention band, so a human decides.").otherwise(""),
    )
    return F.when(verdict == "PASS", F.concat(lead, quiet)).otherwise(F.concat(lead, body, extra, telemetry, linked, caveat))


# --- the whole verdict ----------------------------------------------------------
def score_submissions(subs: DataFrame, outputs: DataFrame, links: DataFrame, policies: DataFrame, fused: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Final score, verdict, pattern and explanation for every submission in one plan.

    outputs: long detector outputs; may carry `reason` and `rule_hits`.
    links: linkage_signal output. policies: one row per merchant, joined on merchant_id.
    fused: submission_id, fused from a trained model; the heuristic is used without it.
    signals: optional direction, id_photo_fake, temporal, tamper, fields, generator.
    """
    hits = F.col("rule_hits") if "rule_hits" in outputs.columns else F.array().cast("array<struct<rule:string,weight:double,reason:string>>")
    reason = F.col("reason") if "reason" in outputs.columns else L(None).cast("string")
    o = outputs.select("*", hits.alias("__hits"), reason.alias("__reason"))
    pick = lambda d: F.first(F.when(F.col("detector") == d, F.col("__hits")), ignorenulls=True)
    ok = F.col("status") == "ok"
    aggs = []
    for d in K.DETECTORS:
        here = F.col("detector") == d
        aggs += [
            F.coalesce(F.max(F.when(here & ok, F.col("score"))), L(0.0)).alias(f"{d}_score"),
            F.coalesce(F.max(F.when(here & ok, F.col("confidence"))), L(0.0)).alias(f"{d}_conf"),
            # the greatest status is "ok"; a string buffer would make every submission pass through a sort
            F.when(F.max(here & ok) & ~F.max(here & (F.col("status") > "ok")), "ok").alias(f"{d}_status"),
        ]
    aggs.append(F.max(F.col("status") == "error").alias("any_error"))
    if "rule_hits" in outputs.columns:
        aggs += [pick("metadata_exif").alias("meta_hits"), pick("behavioral").alias("behav_hits")]
    item = F.struct("detector", "score", "confidence", "status", F.col("__reason").alias("reason"))
    wide = o.groupBy("submission_id").agg(
        *aggs, F.array_sort(F.collect_list(item)).alias("items")  # one item per detector
    )
    j = subs.join(wide, "submission_id", "left").join(links, "submission_id", "left").join(policies.select("merchant_id", F.struct(*[c for c in policies.columns if c != "merchant_id"]).alias("policy")), "merchant_id", "left")
    j = j.join(fused, "submission_id", "left") if fused is not None else j.withColumn("fused", heuristic_from_wide())
    needed = {"direction": "string", "id_photo_fake": "double", "temporal": "double", "tamper": "double", "fields": "double", "generator": "string"}
    if signals is not None:
        j = j.join(signals, "submission_id", "left")
    for name, kind in needed.items():
        if name not in j.columns:
            j = j.withColumn(name, L(None).cast(kind))
    z = lambda n: F.coalesce(F.col(n), L(0))
    okd = lambda d: F.coalesce(F.col(f"{d}_status") == "ok", L(False))
    cap = S.ceiling(F.col("policy.min_risk_for_review"), F.col("policy.min_risk_for_reject"), F.col("policy.abstain_band"))
    none = F.array().cast("array<struct<rule:string,weight:double,reason:string>>")
    hit = lambda n: F.coalesce(F.col(n), none) if n in j.columns else none
    j = j.withColumns({"meta_hits": hit("meta_hits"), "behav_hits": hit("behav_hits"), "ceiling": cap, "link_exact": F.coalesce("link_exact", L(False)), "link_score": F.coalesce("link_score", L(0.0))})
    categorical = F.exists("behav_hits", lambda h: h["weight"] >= K.HARD_WEIGHT)
    j = j.withColumn("behav_channel", S.behavioral_channel(F.col("behavioral_score"), F.col("behavioral_conf"), okd("behavioral"), categorical, F.col("ceiling")))
    j = j.withColumn("final_score", S.final_score(F.col("fused"), F.col("link_score"), F.col("link_exact"), F.col("behav_channel"), F.col("ceiling")))
    j = j.withColumn("d", S.decide(F.col("final_score"), F.col("policy"), okd("liveness_video"), okd("id_forensics"), okd("behavioral"), F.coalesce("any_error", L(False))))
    sig = {
        "n_exact": z("n_exact"), "n_conflict": z("n_conflict"), "meta_hits": F.col("meta_hits"), "behav_hits": F.col("behav_hits"), "behavioral": F.col("behavioral_score"),
        "direction": F.coalesce("direction", L("")), "selfie": F.col("selfie_deepfake_score"), "video": F.col("liveness_video_score"), "doc": F.col("id_forensics_score"), "meta": F.col("metadata_exif_score"),
        "id_photo_fake": z("id_photo_fake"), "temporal": z("temporal"), "tamper": z("tamper"), "fields": z("fields"),
    }
    j = j.withColumn("attack_pattern", S.classify_attack(sig))
    text = narrate(F.col("d.verdict"), F.col("final_score"), F.col("items"), F.col("attack_pattern"), F.col("generator"), z("n_face"), z("n_exact"), z("n_near"), F.col("d.abstained"))
    return j.select(
        *subs.columns, "fused", "link_score", "link_exact", "behav_channel", "ceiling", "final_score", F.col("d.verdict").alias("verdict"), F.col("d.abstained").alias("abstained"), "attack_pattern", text.alias("explanation")
    )
