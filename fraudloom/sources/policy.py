"""Merchant policies: a default block overlaid by per-merchant blocks."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as K

FIELDS = {
    "min_risk_for_reject": "double", "min_risk_for_review": "double", "require_liveness": "boolean", "require_id_document": "boolean",
    "require_behavioral": "boolean", "abstain_band": "double", "webhook_min_score": "double", "audit_retention_days": "int",
    "avg_fraud_loss_inr": "double", "merchant_ltv_inr": "double", "false_reject_abandon_prob": "double",
}


def overlay_rows(spark: SparkSession, overlays: dict[str, dict]) -> DataFrame:
    """Overlay blocks as rows; absent fields are null. Policy files are configuration, not data."""
    schema = "merchant_id string, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())
    return spark.createDataFrame([(m, *[o.get(n) for n in FIELDS]) for m, o in overlays.items()], schema)


def effective_policies(merchants: DataFrame, overlays: DataFrame, default: dict = K.SHIPPED_DEFAULTS) -> DataFrame:
    """One resolved row per merchant: overlay value, else default value."""
    known = merchants.select("merchant_id").distinct()
    joined = known.join(overlays, "merchant_id", "left")
    return joined.select("merchant_id", *[F.coalesce(F.col(n), F.lit(default[n]).cast(t)).alias(n) for n, t in FIELDS.items()])


def load_policy(spark: SparkSession, path: str, merchants: DataFrame) -> DataFrame:
    """SRC6: policy JSON {"default": {...}, "merchants": {id: {...}}} resolved per merchant."""
    text = spark.read.text(path, wholetext=True).first()[0]
    blocks = json.loads(text)
    return effective_policies(merchants, overlay_rows(spark, blocks.get("merchants", {})), {**K.CLASS_DEFAULTS, **blocks.get("default", {})})


def policy_struct():
    return F.struct(*[F.col(n) for n in FIELDS])
