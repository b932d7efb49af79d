"""Operational views: browsing, gallery, queue, agreement, live statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions.scalars import literal_map, ratio
from .durable import cut
from .linkage import ring_siblings
from .metrics import count_when
from .ordered import exact_percentiles

L = F.lit


def newest() -> list:
    return [F.desc("created_at"), F.desc("submission_id")]


def with_verdict(subs: DataFrame, verdicts: DataFrame, how: str = "left") -> DataFrame:
    """JN1/JN2: the join every view starts from."""
    return subs.join(verdicts, "submission_id", how)


def graph_defaults(df: DataFrame) -> DataFrame:
    """Submissions without a verdict show as REVIEW at score 0."""
    return df.withColumns({"verdict": F.coalesce("verdict", L("REVIEW")), "final_score": F.coalesce("final_score", L(0.0))})


def browse_submissions(subs, verdicts, merchant=None, verdict=None, pattern=None, source=None, limit=50, offset=0) -> DataFrame:
    df = with_verdict(subs, verdicts)
    for column, wanted in (("merchant_id", merchant), ("verdict", verdict), ("attack_pattern", pattern), ("source", source)):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    return df.orderBy(*newest()).offset(offset).limit(limit) if offset else df.orderBy(*newest()).limit(limit)


def submission_detail(subs, verdicts, submission_id) -> DataFrame:
    one = F.col("submission_id") == submission_id
    return subs.filter(one).join(verdicts.filter(one), "submission_id", "left")


def audit_stream(audit, limit=100, submission_id=None) -> DataFrame:
    df = audit if submission_id is None else audit.filter(F.col("submission_id") == submission_id)
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def sweep_candidates(subs, verdicts, ids: DataFrame | None = None, merchant=None, since=None, limit=500, only_passed=True) -> DataFrame:
    """Ids win over filters; the limit is taken before already-flagged rows are dropped."""
    df = subs
    if ids is not None:
        df = df.join(ids.select("submission_id").distinct(), "submission_id", "left_semi")
    else:
        if merchant is not None:
            df = df.filter(F.col("merchant_id") == merchant)
        if since is not None:
            df = df.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    recent = df.orderBy(*newest()).limit(limit)
    prev = verdicts.select("submission_id", F.col("verdict").alias("previous_verdict"), F.col("final_score").alias("previous_score"))
    out = recent.join(prev, "submission_id", "left")
    return out.filter(F.col("previous_verdict").isNull() | (F.col("previous_verdict") == "PASS")) if only_passed else out


def fixture_manifest(subs, verdicts) -> DataFrame:
    """Fixtures oldest first with their last verdict; counts of real and fake on every row."""
    fx = subs.filter(F.col("source") == "gauntlet")
    name = F.coalesce("display_name", "external_ref", F.substring(F.col("submission_id").cast("string"), 1, 8))
    counts = fx.agg(count_when(F.col("label") == "real").alias("n_real"), count_when(F.col("label") == "fake").alias("n_fake"))
    v = verdicts.select("submission_id", F.col("verdict").alias("last_verdict"), F.col("final_score").alias("last_score"))
    return fx.join(v, "submission_id", "left").crossJoin(F.broadcast(counts)).select(  # one row
        "submission_id", name.alias("name"), "label", "attack_type", "last_verdict", "last_score", "n_real", "n_fake", "created_at"
    )


def undecided(reviews: DataFrame, audit: DataFrame) -> DataFrame:
    decided = audit.filter(F.col("event") == "analyst_decision").select("submission_id")
    return reviews.join(decided, "submission_id", "left_anti")


def verdict_diff(prev: DataFrame, new: DataFrame) -> DataFrame:
    p = prev.select("submission_id", F.col("verdict").alias("previous_verdict"), F.col("final_score").alias("previous_score"))
    n = new.select("submission_id", F.col("verdict").alias("new_verdict"), F.col("final_score").alias("new_score"))
    newly = (F.col("new_verdict") != "PASS") & (F.col("previous_verdict").isNull() | (F.col("previous_verdict") == "PASS"))
    return n.join(p, "submission_id", "left").withColumn("newly_flagged", newly)


def sweep_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count(L(1)).alias("scanned"), count_when(F.col("newly_flagged")).alias("newly_flagged"))


def telemetry_attach(subs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bind by token; a token that does not resolve leaves the telemetry null."""
    return subs.join(sessions, "token", "left").withColumn("telemetry_present", F.col("event_count").isNotNull())


def attack_gallery(subs, verdicts, as_of, hours=24, per_group=8) -> dict[str, DataFrame]:
    """Flagged submissions of the window by pattern: totals, generator counts, newest samples."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    flagged = with_verdict(subs.drop("created_at"), verdicts.filter((F.col("verdict") != "PASS") & (F.col("decided_at") >= since)), "inner")
    flagged = flagged.withColumn("pattern", F.coalesce("attack_pattern", L("unclassified")))
    label = F.coalesce(F.try_element_at(literal_map(K.PATTERN_LABELS), F.col("pattern")), F.initcap(F.replace(F.col("pattern"), L("_"), L(" "))))
    groups = flagged.groupBy("pattern").agg(F.count(L(1)).alias("count"), F.avg("final_score").alias("mean_score"), F.array_sort(F.collect_set("merchant_id")).alias("merchants"))
    gens = flagged.filter(F.col("generator_guess").isNotNull()).groupBy("pattern", "generator_guess").agg(F.count(L(1)).alias("n"))
    recency = Window.partitionBy("pattern").orderBy(F.desc("decided_at"), F.desc("submission_id"))
    samples = flagged.withColumn("rn", F.row_number().over(recency)).filter(F.col("rn") <= per_group)
    return {"groups": groups.withColumn("label", label), "generators": gens, "samples": samples}


def review_queue(subs, verdicts, audit, limit=50, outputs=None, hashes=None) -> DataFrame:
    """Undecided REVIEW verdicts, riskiest first; decided ones are removed before the limit.

    With `outputs` every row has detector_summary, an array of (detector, score, status) by
    name; with `hashes` (selfie rows) shared_selfie_with and n_other_names, null where the
    selfie occurs once.  Both read only what belongs to the queue.
    """
    reviews = with_verdict(subs, verdicts.filter(F.col("verdict") == "REVIEW"), "inner")
    queue = undecided(reviews, audit).orderBy(F.desc("final_score"), F.asc("submission_id")).limit(limit)
    if outputs is None and hashes is None:
        return queue
    queue = cut(queue)
    ids = F.broadcast(queue.select("submission_id"))  # at most `limit` rows
    if outputs is not None:
        mine = outputs.join(ids, "submission_id", "left_semi")
        entry = F.struct("detector", F.round(F.coalesce("score", L(0.0)), 3).alias("score"), "status")
        queue = queue.join(mine.groupBy("submission_id").agg(F.array_sort(F.collect_list(entry)).alias("detector_summary")), "submission_id", "left")  # one entry a detector
    if hashes is not None:
        files = hashes.join(ids, "submission_id", "left_semi").select("content_hash").distinct()
        same = hashes.join(F.broadcast(files), "content_hash", "left_semi")  # at most `limit` files
        rings = ring_siblings(same, subs.select("submission_id", "claimed_name").join(same.select("submission_id"), "submission_id", "left_semi"))
        queue = queue.join(rings.join(ids, "submission_id", "left_semi").select("submission_id", "shared_selfie_with", "n_other_names"), "submission_id", "left")
    return queue.orderBy(F.desc("final_score"), F.asc("submission_id"))


def live_stats(verdicts: DataFrame) -> DataFrame:
    """One row: totals, verdict counts, abstention rate, latency and score quantiles."""
    base = verdicts.agg(
        F.count(L(1)).alias("total"),
        *[count_when(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("PASS", "REVIEW", "REJECT")],
        (count_when(F.col("abstained")) / F.greatest(F.count(L(1)), L(1))).alias("abstention_rate"),
    )
    lat = exact_percentiles(verdicts.filter(F.col("latency_ms") != 0), [], "latency_ms", {"latency_p50": 0.5, "latency_p90": 0.9, "latency_p99": 0.99}, stats=True)
    lat = lat.select("latency_p50", "latency_p90", "latency_p99", F.col("mean").alias("latency_mean"), F.col("highest").alias("latency_max"))
    dec = exact_percentiles(verdicts, [], "final_score", {f"score_d{i}": i / 10 for i in range(11)})
    return base.crossJoin(F.broadcast(lat)).crossJoin(F.broadcast(dec))  # one row each


def pattern_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("attack_pattern").agg(F.count(L(1)).alias("n"))


def latency_histogram(verdicts: DataFrame, bins: int = 12) -> DataFrame:
    v = verdicts.filter(F.col("latency_ms") != 0)
    span = v.agg(F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col("latency_ms") - F.col("lo")) / width), L(bins - 1))).otherwise(0)
    out = v.crossJoin(F.broadcast(span)).groupBy(slot.cast("int").alias("bin"), "lo", "hi").agg(F.count(L(1)).alias("n"))  # span: one row
    return out.select("bin", "n", (F.col("lo") + F.col("bin") * width).alias("from_ms"))


def review_agreement(audit: DataFrame) -> DataFrame:
    e = audit.filter(F.col("event") == "analyst_decision")
    decision = F.get_json_object("payload", "$.decision")
    score = F.get_json_object("payload", "$.model_score").try_cast("double")
    agrees = ((decision == "reject") & (score >= 0.5)) | ((decision == "approve") & (score < 0.5))
    return e.agg(
        F.count(L(1)).alias("decisions"),
        ratio(count_when(agrees), F.count(L(1))).alias("agreement_rate"),
        *[count_when(decision == d).alias(f"n_{d}") for d in ("approve", "reject", "escalate")],
    )


def scoreboard(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A fake is caught by REJECT or REVIEW; rates are 0.0 for an empty run."""
    fake, real = F.col("truth") == "fake", F.col("truth") == "real"
    flagged = F.col("verdict").isin("REJECT", "REVIEW")
    agg = results.groupBy(*(by or [])).agg(
        F.count(L(1)).alias("total"),
        count_when(fake & flagged).alias("fakes_caught"),
        count_when(fake).alias("fakes_total"),
        count_when(real & (F.col("verdict") == "PASS")).alias("reals_passed"),
        count_when(real & (F.col("verdict") == "REVIEW")).alias("reals_reviewed"),
        count_when(real & (F.col("verdict") == "REJECT")).alias("reals_rejected"),
        count_when(real).alias("reals_total"),
        count_when(F.when(fake, flagged).otherwise(F.col("verdict") == "PASS")).alias("correct"),
        F.coalesce(F.avg("latency_ms"), L(0.0)).alias("mean_latency_ms"),
    )
    share = lambda a, b: ratio(a.cast("double"), b)
    c = F.col
    return agg.select(
        *[x for x in agg.columns if x != "correct"],
        share(c("fakes_caught"), c("fakes_total")).alias("detection_rate"),
        share(c("fakes_total") - c("fakes_caught"), c("fakes_total")).alias("false_accept_rate"),
        share(c("reals_total") - c("reals_passed"), c("reals_total")).alias("false_reject_rate"),
        share(c("correct"), c("total")).alias("accuracy"),
    )


def pattern_counts(flagged: DataFrame, top: int = 6) -> DataFrame:
    """Flagged rows by pattern; clean and null count as unclassified."""
    p = F.when(F.col("attack_pattern").isNull() | (F.col("attack_pattern") == "clean"), "unclassified").otherwise(F.col("attack_pattern"))
    return flagged.filter(F.col("verdict") != "PASS").groupBy(p.alias("pattern")).agg(F.count(L(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(top)


def generator_counts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("generator_guess").isNotNull()).groupBy("generator_guess").agg(F.count(L(1)).alias("n"))


def merchants_hit(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("verdict") != "PASS").agg(F.countDistinct("merchant_id").alias("merchants"))


def alert_rows(verdicts_with_merchant: DataFrame, policies: DataFrame) -> DataFrame:
    """Rejections at or above their merchant's notification score (`policies`: one row per merchant)."""
    rejects = verdicts_with_merchant.filter(F.col("verdict") == "REJECT")
    return rejects.join(policies.select("merchant_id", "webhook_min_score"), "merchant_id").filter(F.col("final_score") >= F.col("webhook_min_score"))


def decision_events(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Valid analyst decisions as audit events carrying the model's verdict and score."""
    ok = decisions.filter(F.col("decision").isin("approve", "reject", "escalate"))
    v = verdicts.select("submission_id", F.col("verdict").alias("model_verdict"), F.round("final_score", 4).alias("model_score"))
    payload = F.to_json(F.struct("decision", "note", "model_verdict", "model_score"), {"ignoreNullFields": "false"})
    return ok.join(v, "submission_id", "left").select("submission_id", F.col("analyst").alias("actor"), L("analyst_decision").alias("event"), payload.alias("payload"), "created_at", "decision")


def human_status(events: DataFrame) -> DataFrame:
    """Status from the newest decision of each submission."""
    newest = F.max_by("decision", F.struct("created_at", "decision"))
    return events.groupBy("submission_id").agg(F.concat(L("HUMAN_"), F.upper(newest)).alias("status"))


def neighbour_feed(rows: DataFrame, edges: DataFrame, selected, limit=60) -> DataFrame:
    """The selected node and everything one edge away, newest first."""
    a, b = F.col("source"), F.col("target")
    near = edges.filter((a == selected) | (b == selected)).select(F.when(a == selected, b).otherwise(a).alias("submission_id")).distinct()
    hit = rows.join(near.withColumn("__n", L(True)), "submission_id", "left").filter(F.col("__n") | (F.col("submission_id") == selected))
    return hit.drop("__n").orderBy(*newest()).limit(limit)
