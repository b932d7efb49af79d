"""Per-clip signals from per-frame feature rows (clip, pos, ...), decoded upstream."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from .ordered import CHUNK, exact_percentiles, neighbours

L = F.lit
FRAMES_PER_CHUNK = 4096


def _chunked(frames: DataFrame, keep) -> DataFrame:
    return frames.filter(keep).withColumn(CHUNK, F.floor(F.col("pos") / FRAMES_PER_CHUNK))


def identity_drift(frames: DataFrame) -> DataFrame:
    """1 - mean cosine of consecutive face vectors, and the lowest; faceless frames are skipped."""
    f = neighbours(_chunked(frames, F.col("vector").isNotNull()), ["clip"], ["pos"], lag={"before": "vector"})
    s = f.filter(F.col("before").isNotNull()).select("clip", cosine(F.col("before"), F.col("vector")).alias("s"))
    return s.groupBy("clip").agg((1.0 - F.avg("s")).alias("identity_drift"), F.min("s").alias("min_similarity"))


def pose_jitter(frames: DataFrame) -> DataFrame:
    """Population std of the second difference of roll (four values or more), and its range."""
    base = _chunked(frames, F.col("roll").isNotNull())
    d1 = neighbours(base, ["clip"], ["pos"], lag={"r0": "roll"}).select("clip", "pos", CHUNK, (F.col("roll") - F.col("r0")).alias("d"))
    d2 = neighbours(d1.filter(F.col("d").isNotNull()), ["clip"], ["pos"], lag={"d0": "d"}).select("clip", (F.col("d") - F.col("d0")).alias("dd"))
    spread = d2.filter(F.col("dd").isNotNull()).groupBy("clip").agg(F.stddev_pop("dd").alias("sd"))
    size = base.groupBy("clip").agg(F.count(L(1)).alias("n"), (F.max("roll") - F.min("roll")).alias("range"))
    enough = F.col("n") >= 4
    return size.join(spread, "clip", "left").select("clip", F.when(enough, F.coalesce("sd", L(0.0))).otherwise(0.0).alias("pose_jitter"), F.when(enough, F.col("range")).alias("roll_range"))


def flow_spike(frames: DataFrame) -> DataFrame:
    """Largest over median flow residual."""
    p = exact_percentiles_by_clip(frames, "flow")
    return p.select("clip", (F.col("highest") / (F.col("median") + 1e-6)).alias("flow_spike"))


def exact_percentiles_by_clip(frames: DataFrame, value: str) -> DataFrame:
    """median, highest, pop std, n per clip; values are counted and ranked in chunks, no clip is held in one buffer."""
    known = frames.filter(F.col(value).isNotNull()).select("clip", F.col(value).cast("double").alias(value))
    q = exact_percentiles(known, ["clip"], value, {"median": 0.5}, stats=True).select("clip", "median", "highest", "n")
    return q.join(known.groupBy("clip").agg(F.stddev_pop(value).alias("sd")), "clip")


def blink_count(frames: DataFrame) -> DataFrame:
    """Rising edges of eye brightness under median - 1.2 (std + 1e-6); five values or more."""
    eyes = frames.filter(F.col("eye").isNotNull())
    stats = exact_percentiles_by_clip(eyes, "eye")
    flagged = eyes.join(stats.select("clip", "median", "sd", "n"), "clip").select(
        "clip", "pos", "n", (F.col("eye") < F.col("median") - 1.2 * (F.col("sd") + 1e-6)).cast("int").alias("dip")
    )
    steps = neighbours(_chunked(flagged, F.col("dip").isNotNull()), ["clip"], ["pos"], lag={"d0": "dip"})
    edge = (F.col("dip") == 1) & (F.col("d0") == 0)
    return steps.groupBy("clip").agg(F.when(F.max("n") >= 5, F.count(F.when(edge, 1))).otherwise(0).alias("blinks"))


def frame_appearance(frames: DataFrame) -> DataFrame:
    base = frames.groupBy("clip").agg(F.count(L(1)).alias("frames"), F.count("p_fake").alias("faces"), F.avg("p_fake").alias("frame_mean"))
    return base.join(exact_percentiles(frames, ["clip"], "p_fake", {"frame_p90": 0.9}), "clip", "left")
