"""Detector scores, fusion channels and the policy decision as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as K
from .scalars import clamp01, contains_any, fired, has_rule, noisy_or, plural, rule, weights_of


# --- detector level --------------------------------------------------------
def id_forensics_score(fields, tamper, photo, layout, ocr_present, portrait_found) -> Column:
    portrait = F.when(portrait_found, photo).otherwise(0.35)
    score = clamp01(0.34 * fields + 0.30 * tamper + 0.24 * portrait + 0.12 * layout)
    conf = F.when(ocr_present, 0.8).otherwise(0.5) * F.when(portrait_found, 1.0).otherwise(0.85)
    return F.struct(score.alias("score"), conf.alias("confidence"))


def layout_score(checked: Column, height_cv: Column) -> Column:
    return F.when(checked & (height_cv > 0.55), 0.55).when(checked & (height_cv < 0.03), 0.35).otherwise(0.0)


def spectral_heuristic(grid: Column, ripple: Column, laplacian: Column) -> Column:
    g = clamp01((F.coalesce(grid, F.lit(1.0)) - 1.15) / 1.6)
    r = clamp01((F.coalesce(ripple, F.lit(0.0)) - 0.30) / 0.35)
    s = clamp01((F.lit(260.0) - F.coalesce(laplacian, F.lit(260.0))) / 240.0)
    return clamp01(0.45 * g + 0.35 * r + 0.20 * s)


def selfie_score(cnn_p, spec_p, face_found, screen, clip: bool = True) -> Column:
    """`clip` matters for a cnn_p over 1 only: blends of probabilities are within 0 and 1."""
    bound = clamp01 if clip else lambda c: c
    score = F.when(cnn_p.isNull(), spec_p).otherwise(bound(0.62 * cnn_p + 0.38 * spec_p))
    conf = F.when(cnn_p.isNull(), 0.45).otherwise(bound(0.45 + 0.5 * (1.0 - F.abs(cnn_p - spec_p))))
    return F.struct(
        F.when(screen, F.greatest(score, F.lit(0.55))).otherwise(score).alias("score"),
        F.when(face_found, conf).otherwise(conf * 0.5).alias("confidence"),
    )


def liveness_score(frames, faces, frame_mean, frame_p90, drift, jitter, spike, blinks, duration_s) -> Column:
    rate = faces / frames
    appearance = clamp01(0.6 * frame_mean + 0.4 * frame_p90)
    temporal = clamp01(
        0.45 * clamp01((drift - 0.06) / 0.22) + 0.30 * clamp01((jitter - 2.5) / 9.0) + 0.25 * clamp01((spike - 2.2) / 3.5)
    )
    full = clamp01(0.55 * appearance + 0.45 * temporal)
    full = F.when((duration_s > 6) & (blinks == 0), clamp01(full + 0.08)).otherwise(full)
    conf = clamp01(0.35 + 0.45 * rate + 0.2 * F.least(F.lit(1.0), faces / 12.0))
    short, blind = frames < 3, rate < 0.4
    return F.struct(
        F.when(short, 0.5).when(blind, 0.55).otherwise(full).alias("score"),
        F.when(short, 0.15).when(blind, 0.25).otherwise(conf).alias("confidence"),
        F.when(~short & ~blind, temporal).alias("temporal"),
    )


def face_match_score(sim, phash_distance, low=K.FACE_BAND[0], high=K.FACE_BAND[1]) -> Column:
    """direction, score and confidence of the one-to-one selfie/document comparison."""
    direction = F.when(sim.isNull(), F.lit(None).cast("string")).when(sim < low, "mismatch").when(sim > high, "duplicate").otherwise("match")
    copy = clamp01(0.55 + (sim - high) * 12.0)
    copy = F.when(phash_distance <= K.SAME_IMAGE_BITS, clamp01(copy + 0.2)).otherwise(copy)
    mid, width = (low + high) / 2, max(1e-6, high - low)
    score = (
        F.when(sim.isNull(), 0.5)
        .when(sim < low, clamp01(0.55 + (low - sim) * 1.4))
        .when(sim > high, copy)
        .otherwise(clamp01(F.abs(sim - mid) / width * 0.5))
    )
    conf = F.when(sim.isNull(), 0.2).when(direction == "match", 0.7).otherwise(0.85)
    return F.struct(direction.alias("direction"), score.alias("score"), conf.alias("confidence"))


def live_match(sim, low=K.FACE_BAND[0], high=K.FACE_BAND[1]) -> Column:
    margin = sim - low
    strength = F.when(F.abs(margin) >= 0.10, "strong").when(F.abs(margin) >= 0.03, "borderline").otherwise("weak")
    return F.struct(((sim >= low) & (sim < high)).alias("match"), margin.alias("margin"), strength.alias("confidence"))


# --- metadata rules --------------------------------------------------------
def metadata_hits(tag: str, m: Column, submitted_at: Column, extra_rules=()) -> Column:
    """Fired metadata rules of one file.

    `m` has software, png_text, has_exif, format, captured, make, model, width,
    height, gps_present, screenshot, effective_scale and nominal_px.
    """
    hay = F.concat_ws(" ", F.lower(F.coalesce(m["software"], F.lit(""))), F.lower(F.coalesce(m["png_text"], F.lit(""))))
    generated = contains_any(hay, K.GENERATOR_TOKENS)
    no_text = F.coalesce(m["png_text"], F.lit("")) == ""
    captured = F.try_to_timestamp(F.trim(m["captured"]), F.lit("yyyy:MM:dd HH:mm:ss"))
    age = (F.unix_micros(submitted_at) - F.unix_micros(captured)) / 86400e6
    device = F.lower(F.concat_ws(" ", F.coalesce(m["make"], F.lit("")), F.coalesce(m["model"], F.lit(""))))
    longest = F.greatest(m["width"], m["height"])
    small_phone = (m["width"] > 0) & (m["height"] > 0) & (longest < 900) & F.contains(device, F.lit("iphone"))
    sized = m["nominal_px"] >= 400
    scale = m["effective_scale"]
    stale = F.least(F.lit(0.6), 0.25 + age / 400.0)
    selfie = F.lit(tag == "selfie")
    return fired(
        rule(f"{tag}:generator_tag", generated, 0.95, f"{tag}: file metadata names an image generator"),
        rule(f"{tag}:editor_tag", ~generated & contains_any(hay, K.EDITOR_TOKENS), 0.55, f"{tag}: last saved by image-editing software"),
        rule(f"{tag}:no_exif", ~m["has_exif"] & no_text, 0.22, f"{tag}: carries no camera metadata"),
        rule(f"{tag}:png_selfie", selfie & (F.upper(m["format"]) == "PNG"), 0.30, f"{tag}: PNG files do not come straight from a camera"),
        rule(f"{tag}:stale", age > 30, stale, F.concat(F.lit(f"{tag}: captured "), F.round(age, 0).cast("bigint").cast("string"), F.lit(" days before submission"))),
        rule(f"{tag}:future", age < -1, 0.5, f"{tag}: capture time lies after submission"),
        rule(f"{tag}:device_mismatch", small_phone, 0.45, f"{tag}: too small for the camera it claims"),
        rule(f"{tag}:no_gps", selfie & m["has_exif"] & ~F.coalesce(m["gps_present"], F.lit(False)), 0.12, None),
        rule(f"{tag}:screenshot", m["screenshot"], 0.4, f"{tag}: looks like a screenshot"),
        rule(f"{tag}:upscaled", sized & (scale < K.UPSCALED_BELOW), 0.62, f"{tag}: enlarged from a much smaller source"),
        rule(f"{tag}:soft_detail", sized & (scale >= K.UPSCALED_BELOW) & (scale < K.SOFT_BELOW), 0.24, f"{tag}: softer than its resolution implies"),
        *extra_rules,
    )


def metadata_score(hits: Column) -> Column:
    hard = F.exists(weights_of(hits), lambda w: w >= K.HARD_WEIGHT)
    conf = F.when(hard, 0.9).when(F.size(hits) > 0, 0.6).otherwise(0.5)
    return F.struct(noisy_or(weights_of(hits), K.METADATA_CAP).alias("score"), conf.alias("confidence"))


# --- fusion, channels, decision --------------------------------------------
def ceiling(review: Column, reject: Column, band: Column) -> Column:
    return F.greatest(review, reject - F.greatest(F.lit(0.0), band) - 1e-6)


def behavioral_channel(score, confidence, ok, categorical, cap) -> Column:
    value = score * confidence
    return F.when(ok, F.when(categorical, value).otherwise(F.least(value, cap))).otherwise(0.0)


def linkage_score(n_face, n_conflict, n_exact, n_near) -> Column:
    face = F.when(n_conflict > 0, F.least(F.lit(0.95), 0.55 + 0.12 * n_conflict)).when(n_face > 0, 0.30).otherwise(0.0)
    asset = F.when(n_exact > 0, F.least(F.lit(0.9), 0.6 + 0.1 * n_exact)).when(n_near > 0, 0.35).otherwise(0.0)
    return F.greatest(face, asset)


def linkage_reasons(n_face, n_conflict, n_names, n_merchants, n_comparable, n_exact, n_near) -> Column:
    earlier = plural(n_face, "earlier submission")
    face = (
        F.when(
            (n_conflict > 0) & (n_names >= 2),
            F.concat(F.lit("Face seen before under "), plural(n_names, "different name"), F.lit(" at "), plural(n_merchants, "merchant account"), F.lit(": likely onboarding ring")),
        )
        .when(n_conflict > 0, F.concat(F.lit("Face seen before under one other name at "), plural(n_merchants, "merchant account")))
        .when((n_face > 0) & (n_comparable == 0), F.concat(F.lit("Face matches "), earlier, F.lit("; no claimed names to compare")))
        .when((n_face > 0) & (n_comparable == n_face), F.concat(F.lit("Face matches "), earlier, F.lit(" under the same name")))
        .when(n_face > 0, F.concat(F.lit("Face matches "), earlier, F.lit(", "), n_comparable.cast("string"), F.lit(" under the same name, the rest unnamed")))
    )
    asset = F.when(n_exact > 0, F.concat(F.lit("The exact same image file was used in "), plural(n_exact, "earlier submission"))).when(
        n_near > 0, F.concat(F.lit("A near-identical image appeared in "), plural(n_near, "earlier submission"))
    )
    return F.array_compact(F.array(face, asset))


def final_score(base, link, link_exact, behav, cap) -> Column:
    return F.greatest(base, F.when(link_exact, link).otherwise(F.least(link, cap)), behav)


def decide(score, policy: Column, liveness_ok=None, document_ok=None, behavior_ok=None, any_error=None) -> Column:
    """verdict and abstained under one merchant's policy (struct column)."""
    no, yes = F.lit(False), F.lit(True)
    given = lambda c, default: default if c is None else F.coalesce(c, no)
    band = F.greatest(F.lit(0.0), policy["abstain_band"])
    reject, review = policy["min_risk_for_reject"], policy["min_risk_for_review"]
    in_reject_band = (score >= reject) & (score < reject + band)
    in_review_band = (score < reject) & (score < review) & (score > review - band)
    raw = F.when(score >= reject, "REJECT").when(score >= review, "REVIEW").otherwise("PASS")
    first = F.when(in_reject_band | in_review_band, "REVIEW").otherwise(raw)
    missing = (
        (policy["require_liveness"] & ~given(liveness_ok, yes))
        | (policy["require_id_document"] & ~given(document_ok, yes))
        | (policy["require_behavioral"] & ~given(behavior_ok, yes))
        | given(any_error, no)
    )
    forced = (first == "PASS") & missing
    return F.struct(
        F.when(forced, "REVIEW").otherwise(first).alias("verdict"),
        (in_reject_band | in_review_band | forced).alias("abstained"),
    )


def classify_attack(s) -> Column:
    """First matching pattern. `s` maps signal name to Column; see `operators.scoring`."""
    meta_hits, behav_hits = s["meta_hits"], s["behav_hits"]
    upscaled = F.coalesce(F.exists(meta_hits, lambda h: h["rule"].startswith("selfie:upscaled")), F.lit(False))
    shot = F.coalesce(F.exists(meta_hits, lambda h: F.contains(h["rule"], F.lit("screenshot"))), F.lit(False))
    return (
        F.when(s["n_exact"] > 0, "reused_kyc_kit")
        .when(s["n_conflict"] > 0, "onboarding_ring")
        .when(has_rule(behav_hits, K.BOT_RULES), "automated_submission")
        .when(has_rule(behav_hits, ["form:pasted_identity"]) & (s["behavioral"] >= 0.5), "assisted_submission")
        .when((s["direction"] == "duplicate") | (upscaled & (s["direction"] == "match")), "reused_id_selfie")
        .when(s["direction"] == "mismatch", "impersonation")
        .when((s["selfie"] > 0.65) & (s["id_photo_fake"] > 0.65), "synthetic_identity")
        .when((s["video"] > 0.6) & (s["temporal"] > 0.5), "face_swap_liveness")
        .when(s["selfie"] > 0.65, "generated_selfie")
        .when((s["doc"] > 0.5) & (s["tamper"] > 0.45), "tampered_document")
        .when((s["doc"] > 0.5) & (s["fields"] > 0.5), "invalid_document")
        .when(shot, "recaptured_screen")
        .when(s["meta"] > 0.5, "stale_or_edited_media")
        .otherwise("clean")
    )
