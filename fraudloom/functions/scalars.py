"""Small column expressions shared by every operator."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as K


def clamp01(c: Column) -> Column:
    """Clip to [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def ratio(a: Column, b: Column, empty=0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def pct(c: Column) -> Column:
    return F.concat(F.round(c * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def plural(n: Column, singular: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" " + singular)).otherwise(F.lit(" " + (many or singular + "s"))))


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column, tokens) -> Column:
    """One pattern over all tokens, so that the text expression is evaluated once."""
    return c.rlike("|".join(re.escape(t) for t in tokens))


def name_norm(c: Column) -> Column:
    """Lower case with whitespace runs collapsed (linkage comparison)."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), r"(?U)\s+", " ")


def name_trim(c: Column) -> Column:
    """Lower case and trimmed only (graph comparison)."""
    return F.lower(F.trim(c))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 when either is empty or the lengths differ."""
    prod = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, prod / (norm(a) * norm(b) + 1e-9)).otherwise(0.0)


def _half(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")


def is_hash64(h: Column) -> Column:
    return F.coalesce(h.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def hash64_bits(h: Column) -> Column:
    """16 hex digits as one signed 64-bit integer, null when not 16 hex digits."""
    return F.when(is_hash64(h), F.shiftleft(_half(h, 1), 32).bitwiseOR(_half(h, 9)))


def hamming64(a: Column, b: Column) -> Column:
    """Bit distance of two 16-hex-digit hashes; anything unparsable is 64 apart."""
    bits = F.bit_count(hash64_bits(a).bitwiseXOR(hash64_bits(b)))
    return F.coalesce(bits, F.lit(64)).cast("int")


def iou(a: Column, b: Column) -> Column:
    """Overlap of two x1,y1,x2,y2 boxes."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = w * h
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter / F.greatest(F.lit(1), area(a) + area(b) - inter))


def box_cover(box: Column, truth: Column) -> Column:
    """Share of the truth box that the flagged box covers."""
    w = F.greatest(F.lit(0), F.least(box["x2"], truth["x2"]) - F.greatest(box["x1"], truth["x1"]))
    h = F.greatest(F.lit(0), F.least(box["y2"], truth["y2"]) - F.greatest(box["y1"], truth["y1"]))
    return w * h / F.greatest(F.lit(1), (truth["x2"] - truth["x1"]) * (truth["y2"] - truth["y1"]))


def describe_region(box: Column, w: Column, h: Column) -> Column:
    cx = (box["x1"] + box["x2"]) / 2 / w
    cy = (box["y1"] + box["y2"]) / 2 / h
    vert = F.when(cy < 0.38, "upper").when(cy > 0.62, "lower").otherwise("middle")
    horiz = F.when(cx < 0.38, "left").when(cx > 0.62, "right").otherwise("centre")
    return F.concat(F.lit("in the "), vert, F.lit("-"), horiz, F.lit(" of the card"))


def tone_bucket(angle: Column) -> Column:
    out = F.when(angle.isNull() | (angle >= 999.0), F.lit("unknown"))
    for low, name in K.TONE_BINS:
        out = out.when(angle >= low, F.lit(name))
    return out.otherwise("unknown")


def generator_guess(key: Column, conf: Column) -> Column:
    return F.when((key != "real") & (conf >= 0.5), F.try_element_at(literal_map(K.GENERATOR_LABELS), key))


def per_applicant_rate(p: Column, n) -> Column:
    """Chance of at least one false link among n records: 1-(1-p)^n, stable for tiny p."""
    return -F.expm1(F.lit(n) * F.log1p(-p))


def far_for_budget(q: Column, n) -> Column:
    """Pairwise rate that keeps the per-applicant rate at q over n records."""
    return -F.expm1(F.log1p(-q) / F.lit(n))


def noisy_or(weights: Column, cap: float) -> Column:
    """1 - prod(1-w), held at `cap` unless one weight is categorical."""
    score = F.lit(1.0) - F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (F.lit(1.0) - w))
    hard = F.exists(weights, lambda w: w >= K.HARD_WEIGHT)
    return F.when(hard, clamp01(score)).otherwise(F.least(clamp01(score), F.lit(cap)))


def dig_json(js: Column, path) -> Column:
    """Value at a dotted or list path of a JSON string; list indexes allowed; null when missing."""
    parts = path if isinstance(path, (list, tuple)) else path.split(".")
    steps = "".join(f"[{p}]" if isinstance(p, int) or str(p).isdigit() else f"['{p}']" for p in parts)
    return F.get_json_object(js, "$" + steps)


# --- rules -----------------------------------------------------------------
def rule(name, when: Column, weight, reason) -> Column:
    """One entry of a rule list: a struct when it fires, null otherwise."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    hit = F.struct(as_col(name).alias("rule"), as_col(weight).cast("double").alias("weight"), as_col(reason).cast("string").alias("reason"))
    return F.when(F.coalesce(when, F.lit(False)), hit)


def fired(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def weights_of(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["weight"])


def has_rule(hits: Column, names) -> Column:
    return F.coalesce(F.exists(hits, lambda h: h["rule"].isin(list(names))), F.lit(False))


def reasons_by_weight(hits: Column, fallback: str) -> Column:
    """Reasons of the fired rules, heaviest first, list order inside a tie."""
    keyed = F.transform(hits, lambda h, i: F.struct((-h["weight"]).alias("w"), i.alias("i"), h["reason"].alias("reason")))
    texts = F.transform(F.array_sort(keyed), lambda h: h["reason"])
    return F.when(F.size(hits) > 0, texts).otherwise(F.array(F.lit(fallback)))
