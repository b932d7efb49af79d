"""Form telemetry: keystroke, pointer and form features, and the behaviour rules.

Input is one row per session with nested arrays (keys, mouse, focus, paste, env) or the
long event tables those explode to.  Long tables carry a chunk column so that a very
long session is still spread over tasks (see `ordered`).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as K
from ..functions.scalars import clamp01, contains_any, fired, literal_map, noisy_or, pct, reasons_by_weight, rule, weights_of
from .ordered import CHUNK, neighbours, running_sums

L = F.lit


def chunk_by(df: DataFrame, order: str, width: float) -> DataFrame:
    """Chunks of fixed width on the order column (milliseconds for key events)."""
    return df.withColumn(CHUNK, F.floor(F.col(order) / width))


# --- exploding the nested buffer ----------------------------------------------
def key_events(sessions: DataFrame) -> DataFrame:
    return sessions.select("session", F.posexplode("keys").alias("pos", "e")).select(
        "session", "pos", F.col("e.key").alias("key"), F.col("e.down").cast("double").alias("down"), F.col("e.up").cast("double").alias("up")
    )


def mouse_events(sessions: DataFrame) -> DataFrame:
    e = sessions.select("session", F.posexplode("mouse").alias("pos", "e")).select("session", "pos", "e.t", "e.x", "e.y")
    return e.filter(F.col("t").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())


def focus_events(sessions: DataFrame) -> DataFrame:
    e = F.col("e")
    return sessions.select("session", F.posexplode("focus").alias("pos", "e")).select(
        "session", "pos", e["field"].alias("field"), e["index"].alias("index"), e["in"].alias("t_in"), e["out"].alias("t_out")
    )


# --- WN1 flights ----------------------------------------------------------------
def flights(keys: DataFrame, width_ms: float = 60_000.0, cut: tuple[float, float] | None = K.FLIGHT_CUT_MS) -> DataFrame:
    """Gap from releasing a key to pressing the next; `cut` drops pauses and clock glitches."""
    pressed = chunk_by(keys.filter(F.col("down").isNotNull()), "down", width_ms)
    nxt = neighbours(pressed, ["session"], ["down", "pos"], lead={"next_down": "down"})
    end = F.when(F.col("up") >= F.col("down"), F.col("up")).otherwise(F.col("down"))
    out = nxt.filter(F.col("next_down").isNotNull()).select("session", "pos", "down", (F.col("next_down") - end).alias("flight"))
    return out.filter((F.col("flight") > cut[0]) & (F.col("flight") < cut[1])) if cut else out


def _spread(value: Column, p: str) -> list[Column]:
    """mean .. iqr of one timing; the percentile buffer is bounded because timings are
    limited to a few seconds at browser clock resolution."""
    q = F.percentile(value, F.array(*[L(x) for x in (0.10, 0.25, 0.50, 0.75, 0.90)]))
    return [
        F.avg(value).alias(f"{p}_mean"), F.stddev_pop(value).alias(f"{p}_std"), q.alias(f"__{p}_q"),
        F.min(value).alias(f"{p}_min"), F.max(value).alias(f"{p}_max"), F.count(value).alias(f"__{p}_n"),
        F.countDistinct(F.rint(value * 10)).alias(f"__{p}_u"),
    ]


def _finish(p: str) -> list[Column]:
    z = lambda c: F.coalesce(c, L(0.0))
    mean, std, q, n = F.col(f"{p}_mean"), F.col(f"{p}_std"), F.col(f"__{p}_q"), F.col(f"__{p}_n")
    return [
        z(mean).alias(f"{p}_mean"), z(std).alias(f"{p}_std"), z(F.when(F.abs(mean) > 1e-9, std / mean)).alias(f"{p}_cv"),
        z(q[2]).alias(f"{p}_median"), z(q[0]).alias(f"{p}_p10"), z(q[4]).alias(f"{p}_p90"), z(F.col(f"{p}_min")).alias(f"{p}_min"),
        z(F.col(f"{p}_max")).alias(f"{p}_max"), z(q[3] - q[1]).alias(f"{p}_iqr"),
        z(F.when(n > 0, F.col(f"__{p}_u") / n)).alias(f"{p}_unique_ratio"),
    ]


def _aligned_correlation(dwell: DataFrame, flight: DataFrame, width_ms: float) -> DataFrame:
    """Correlation of the i-th kept dwell with the i-th kept flight, over the common length."""
    one = {"i": L(1).cast("bigint")}
    d = running_sums(chunk_by(dwell, "down", width_ms), ["session"], [F.col("down"), F.col("pos")], one).select("session", "i", "dwell")
    f = running_sums(chunk_by(flight, "down", width_ms), ["session"], [F.col("down"), F.col("pos")], one).select("session", "i", "flight")
    pair = d.join(f, ["session", "i"]).groupBy("session").agg(
        F.count(L(1)).alias("n"), F.covar_pop("dwell", "flight").alias("c"), F.stddev_pop("dwell").alias("sd"), F.stddev_pop("flight").alias("sf")
    )
    # corr() fails on a constant side in ANSI mode, and a constant dwell is what a bot produces
    ok = (F.col("n") >= 4) & (F.col("sd") > 1e-9) & (F.col("sf") > 1e-9)
    return pair.select("session", F.when(ok, F.col("c") / (F.col("sd") * F.col("sf"))).otherwise(0.0).alias("dwell_flight_corr"))


def keystroke_features(keys: DataFrame, width_ms: float = 60_000.0, cut=K.FLIGHT_CUT_MS) -> DataFrame:
    """The fitted feature row of each typing session, plus the basics the rules read."""
    dwell = F.when(F.col("up") >= F.col("down"), F.col("up") - F.col("down"))
    kept = F.when(dwell.between(K.MIN_DWELL_MS, K.MAX_DWELL_MS), dwell)
    name = F.coalesce("key", L(""))
    a = keys.select("*", dwell.alias("__d"), kept.alias("__k")).groupBy("session").agg(
        F.count(L(1)).alias("n_keys"),
        F.count(F.when(name == "Backspace", 1)).alias("backspaces"),
        F.count(F.when(F.length(name) == 1, 1)).alias("printable"),
        ((F.max("down") - F.min("down")) / 1000.0).alias("span_s"),
        F.count("down").alias("__downs"),
        F.count("__d").alias("dwell_samples"), F.avg("__d").alias("dwell_mean_ms"), F.stddev_pop("__d").alias("__d_sd"),
        *_spread(F.col("__k"), "dwell"),
    )
    fl = flights(keys, width_ms, cut)
    short, rhythm = F.when(F.col("flight") <= K.PAUSE_MS, F.col("flight")), F.when(F.col("flight") >= 0, F.col("flight"))
    b = fl.select("session", "flight", short.alias("__f")).groupBy("session").agg(
        F.count(L(1)).alias("__all"), F.count(F.when(F.col("flight") > K.PAUSE_MS, 1)).alias("__pauses"), F.count(F.when(F.col("__f") < 0, 1)).alias("__roll"),
        F.count(rhythm).alias("flight_samples"), F.avg(rhythm).alias("flight_mean_ms"), F.stddev_pop(rhythm).alias("__r_sd"), F.min("flight").alias("flight_min_ms"),
        *_spread(F.col("__f"), "flight"),
    )
    corr = _aligned_correlation(
        keys.select("session", "pos", "down", kept.alias("dwell")).filter(F.col("dwell").isNotNull()), fl.filter(F.col("flight") <= K.PAUSE_MS), width_ms
    )
    z = lambda c: F.coalesce(c, L(0.0))
    n, span = F.col("n_keys"), F.col("span_s")
    j = a.join(b, "session", "left").join(corr, "session", "left")
    return j.select(
        "session", "n_keys", "backspaces", "printable", z(span).alias("span_s"),
        *_finish("dwell"), *_finish("flight"),
        z(F.when(F.col("__flight_n") > 0, F.col("__roll") / F.col("__flight_n"))).alias("rollover_rate"),
        z(F.when(F.col("__all") > 0, F.col("__pauses") / F.col("__all"))).alias("pause_rate"),
        z(F.col("dwell_flight_corr")).alias("dwell_flight_corr"),
        z(F.when((F.col("__downs") >= 2) & (span > 0.5), F.col("printable") / span)).alias("typing_speed_cps"),
        z(F.when(n > 0, F.col("backspaces") / n)).alias("backspace_rate"),
        "dwell_samples", z(F.col("dwell_mean_ms")).alias("dwell_mean_ms"),
        z(F.when(F.col("dwell_mean_ms") > 1e-9, F.col("__d_sd") / F.col("dwell_mean_ms"))).alias("serve_dwell_cv"),
        F.coalesce("flight_samples", L(0)).alias("flight_samples"), z(F.col("flight_mean_ms")).alias("flight_mean_ms"),
        z(F.when(F.col("flight_mean_ms") > 1e-9, F.col("__r_sd") / F.col("flight_mean_ms"))).alias("serve_flight_cv"),
        z(F.col("flight_min_ms")).alias("flight_min_ms"),
    )


def session_basics(features: DataFrame) -> DataFrame:
    """The rule-facing subset, rounded the way it is stored."""
    r = lambda c, d, a=None: F.round(c, d).alias(a or c)
    return features.select(
        "session", F.col("n_keys").alias("keystroke_count"), "dwell_samples", r("dwell_mean_ms", 2), r("serve_dwell_cv", 4, "dwell_cv"), "flight_samples",
        r("flight_mean_ms", 2), r("serve_flight_cv", 4, "flight_cv"), r("flight_min_ms", 2), r("backspace_rate", 4), r("typing_speed_cps", 3), "rollover_rate",
    )


# --- WN2 and pointer features ---------------------------------------------------
def pointer_segments(mouse: DataFrame, width_ms: float = 60_000.0) -> DataFrame:
    """One row per step between consecutive samples: dx, dy, length and dt."""
    s = neighbours(chunk_by(mouse, "t", width_ms), ["session"], ["t", "pos"], lag={"t0": "t", "x0": "x", "y0": "y"})
    s = s.filter(F.col("t0").isNotNull())
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    return s.select("session", "t", "pos", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("length"), (F.col("t") - F.col("t0")).alias("dt"))


def pointer_features(mouse: DataFrame, width_ms: float = 60_000.0) -> DataFrame:
    ends = F.struct("t", "pos")
    a = mouse.groupBy("session").agg(
        F.count(L(1)).alias("mouse_points"), F.min_by(F.struct("x", "y"), ends).alias("f"), F.max_by(F.struct("x", "y"), ends).alias("l")
    )
    seg = pointer_segments(mouse, width_ms)
    dt = F.when(F.col("dt") > 0, F.col("dt"))
    b = seg.groupBy("session").agg(
        F.sum("length").alias("path"), F.count(F.when(F.col("length") > 1e-6, 1)).alias("moving"), F.count(dt).alias("dts"), F.avg(dt).alias("dm"), F.stddev_pop(dt).alias("ds")
    )
    # sixteen direction bins over (-pi, pi], the last one closed
    bin16 = F.least(F.floor((F.atan2("dy", "dx") + math.pi) / (2 * math.pi / 16)), L(15))
    bins = seg.filter(F.col("length") > 1e-6).groupBy("session", bin16.alias("bin")).agg(F.count(L(1)).alias("c"))
    entropy = bins.groupBy("session").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.ln("c")).alias("clc")).select(
        "session", ((F.ln("s") - F.col("clc") / F.col("s")) / math.log(16)).alias("entropy")
    )
    # speed pairs the i-th length with the i-th positive dt, so both get their own position
    one = {"i": L(1).cast("bigint")}
    order = [F.col("t"), F.col("pos")]
    lengths = running_sums(chunk_by(seg, "t", width_ms), ["session"], order, one).select("session", "i", "length", "t")
    steps = running_sums(chunk_by(seg.filter(F.col("dt") > 0), "t", width_ms), ["session"], order, one).select("session", "i", "dt")
    speed = lengths.join(steps, ["session", "i"]).select("session", "i", (F.col("length") / F.col("dt")).alias("v")).withColumn(CHUNK, F.floor(F.col("i") / 4096))
    d1 = neighbours(speed, ["session"], ["i"], lag={"v0": "v"}).select("session", "i", (F.col("v") - F.col("v0")).alias("d"), F.floor(F.col("i") / 4096).alias(CHUNK))
    d2 = neighbours(d1.filter(F.col("d").isNotNull()), ["session"], ["i"], lag={"d0": "d"}).select("session", F.abs(F.col("d") - F.col("d0")).alias("j"))
    jerk = d2.filter(F.col("j").isNotNull()).groupBy("session").agg(F.avg("j").alias("jm"), F.stddev_pop("j").alias("js"))
    j = a.join(b, "session", "left").join(entropy, "session", "left").join(jerk, "session", "left")
    enough = F.col("mouse_points") >= K.MIN_POINTER_POINTS
    disp = F.sqrt(F.pow(F.col("l.x") - F.col("f.x"), 2) + F.pow(F.col("l.y") - F.col("f.y"), 2))
    straight = F.when(F.col("path") > 1e-6, disp / F.col("path")).otherwise(1.0)
    show = lambda c, cond, name: F.when(enough & cond, F.coalesce(F.round(c, 4), L(0.0))).otherwise(0.0).alias(name)
    return j.select(
        "session", "mouse_points",
        show(straight, L(True), "mouse_straightness"), show(F.col("entropy") + 0.0, F.col("moving") >= 4, "mouse_path_entropy"),
        F.when(enough, F.coalesce("moving", L(0))).otherwise(0).alias("mouse_moving_segments"), F.when(enough, F.coalesce("dts", L(0))).otherwise(0).alias("mouse_dt_samples"),
        show(F.when(F.col("dm") > 1e-9, F.col("ds") / F.col("dm")), F.col("dts") >= 4, "mouse_dt_cv"),
        show(F.when(F.col("jm") > 1e-9, F.col("js") / F.col("jm")), F.col("dts") >= 4, "mouse_jerk_cv"),
    )


# --- WN3 and form features ------------------------------------------------------
def focus_summary(focus: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """Fields touched, revisits and whether the declared indexes only ever rise.

    Revisits need no ordering: every named visit beyond the first of its field is one.
    """
    named = F.coalesce("field", L("")) != ""
    visits = focus.filter(named).groupBy("session", "field").agg(F.count(L(1)).alias("n")).groupBy("session").agg(
        F.count(L(1)).alias("fields_touched"), F.sum(F.col("n") - 1).alias("field_revisits")
    )
    indexed = focus.filter(F.col("index").isNotNull()).withColumn(CHUNK, F.floor(F.col("pos") / chunk_rows))
    steps = neighbours(indexed, ["session"], ["pos"], lag={"i0": "index"}).groupBy("session").agg(F.count(F.when(F.col("index") < F.col("i0"), 1)).alias("drops"), F.count(L(1)).alias("n_idx"))
    hold = F.when(F.col("t_out") >= F.col("t_in"), F.col("t_out") - F.col("t_in"))
    holds = focus.groupBy("session").agg(F.avg(hold).alias("hm"), F.stddev_pop(hold).alias("hs"))
    j = holds.join(visits, "session", "left").join(steps, "session", "left")
    mono = (F.col("n_idx") > 0) & (F.col("drops") == 0) & (F.coalesce("field_revisits", L(0)) == 0)
    return j.select(
        "session", F.coalesce("fields_touched", L(0)).alias("fields_touched"), F.coalesce("field_revisits", L(0)).alias("field_revisits"),
        F.coalesce(mono.cast("double"), L(0.0)).alias("field_order_monotonic"), F.coalesce(F.round(F.when(F.col("hm") > 1e-9, F.col("hs") / F.col("hm")), 4), L(0.0)).alias("field_dwell_cv"),
    )


def paste_events(sessions: DataFrame) -> DataFrame:
    return sessions.select("session", F.explode("paste").alias("e")).select("session", F.col("e.field").alias("field"))


def form_features(sessions: DataFrame, focus: DataFrame, pastes: DataFrame) -> DataFrame:
    """Pastes, field order, hold spread and timing.

    sessions: session, form_loaded_at, submitted_at, span_s.  pastes: session, field.
    """
    sensitive = F.lower(F.coalesce("field", L(""))).isin(K.SENSITIVE_FIELDS)
    pasted = pastes.groupBy("session").agg(F.count(L(1)).alias("paste_count"), F.count(F.when(sensitive, 1)).alias("paste_into_sensitive"))
    shown = F.col("submitted_at") > F.col("form_loaded_at")
    total = F.when(shown, (F.col("submitted_at") - F.col("form_loaded_at")) / 1000.0).otherwise(F.coalesce("span_s", L(0.0)))
    sleeps = F.array(*[L(x) for x in K.ROUND_SLEEPS_S])
    near = F.coalesce(F.get(F.filter(sleeps, lambda r: F.abs(total - r) <= K.SLEEP_TOLERANCE_S), 0), L(0.0))
    base = sessions.select("session", F.round(total, 2).alias("total_time_s"), near.alias("near_round_sleep_s"))
    j = base.join(pasted, "session", "left").join(focus_summary(focus), "session", "left")
    return j.fillna(0, ["paste_count", "paste_into_sensitive", "fields_touched", "field_revisits"]).fillna(0.0, ["field_order_monotonic", "field_dwell_cv"])


# --- SC17, SC18 environment -------------------------------------------------------
def region_of(tag: Column) -> Column:
    """'en-IN' -> 'IN': the first two-letter part after the language."""
    parts = F.split(F.replace(tag, L("_"), L("-")), "-")
    return F.upper(F.get(F.filter(F.slice(parts, L(2), F.size(parts)), lambda p: p.rlike("^[A-Za-z]{2}$")), 0))


def locale_incoherent(languages: Column, country: Column, js_offset: Column) -> Column:
    """True when the clock is far from every advertised region that is known."""
    regions = F.array_compact(F.transform(F.coalesce(languages, F.array().cast("array<string>")), region_of))
    declared = F.substring(F.upper(F.coalesce(country, L(""))), 1, 2)
    regions = F.when(declared != "", F.array_append(regions, declared)).otherwise(regions)
    offsets = literal_map(K.REGION_UTC_MINUTES)
    gaps = F.array_compact(F.transform(regions, lambda r: F.abs(-js_offset - F.try_element_at(offsets, r))))
    return F.coalesce(F.array_min(gaps) > K.LOCALE_TOLERANCE_MIN, L(False))


def automation_flags(env: Column) -> Column:
    ua = F.lower(F.coalesce(env["user_agent"], L("")))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(env["webdriver"], L(False)), L("navigator.webdriver")),
            F.when((env["screen_w"] <= 0) | (env["screen_h"] <= 0), L("zero-size screen")),
            F.when(contains_any(ua, K.AUTOMATION_AGENTS), L("automation user-agent")),
            F.when(env["hardware_concurrency"].isin(0, 1) & ~F.contains(ua, L("mobi")), L("single-core desktop browser")),
        )
    )


# --- FE5 rules --------------------------------------------------------------------
def behavioral_hits(model_p: Column | None = None, extra_rules=()) -> Column:
    """Fired rules over the columns of one feature row."""
    c = lambda n: F.coalesce(F.col(n), L(0))
    keys, pts = c("keystroke_count"), c("mouse_points")
    typed = keys >= K.MIN_RHYTHM_KEYS
    flags = F.col("automation_flags")
    hard = F.arrays_overlap(flags, F.array(L("navigator.webdriver"), L("automation user-agent")))
    p = model_p if model_p is not None else L(None).cast("double")
    aimed = pts >= K.MIN_POINTER_POINTS
    return fired(
        rule("keystroke:model", p >= K.MODEL_ALERT, F.least(L(0.80), p), F.concat(L("Typing model puts this rhythm at "), pct(p), L(" likely generated"))),
        rule("keystroke:uniform_dwell", typed & (c("dwell_samples") >= K.MIN_RHYTHM_KEYS) & (c("dwell_cv") < K.DWELL_CV_FLOOR), 0.82, "Every key was held for nearly the same time"),
        rule("keystroke:uniform_flight", typed & (c("flight_samples") >= K.MIN_RHYTHM_KEYS) & (c("flight_cv") < K.FLIGHT_CV_FLOOR), 0.70, "Gaps between keys are metronomic"),
        rule("keystroke:implausible_speed", typed & (c("typing_speed_cps") > K.TYPING_CPS_LIMIT), 0.66, "Typed faster than a touch typist sustains"),
        rule("keystroke:no_corrections", typed & (c("backspace_rate") == 0.0) & (keys >= K.CONFIDENT_KEYS), 0.28, "Long entry without one correction"),
        rule("keystroke:below_human_floor", (keys >= 4) & (c("flight_min_ms") > 0) & (c("flight_min_ms") < K.FLIGHT_FLOOR_MS), 0.93, "Two keystrokes closer together than a hand can manage"),
        rule("pointer:never_moved", (pts == 0) & (keys > 0), 0.55, "The pointer never moved"),
        rule("pointer:straight_line", aimed & (c("mouse_straightness") > K.STRAIGHTNESS_LIMIT), 0.62, "The pointer travelled in a straight line"),
        rule("pointer:uniform_sampling", aimed & (c("mouse_dt_samples") >= 4) & (c("mouse_dt_cv") < K.POINTER_DT_CV_FLOOR), 0.58, "Pointer samples arrived on a fixed interval"),
        rule("pointer:no_tremor", aimed & (c("mouse_moving_segments") >= 4) & (c("mouse_path_entropy") < K.PATH_ENTROPY_FLOOR), 0.34, "The pointer path shows no tremor"),
        rule("form:pasted_identity", c("paste_into_sensitive") > 0, 0.58, "The identity number was pasted"),
        rule("form:robotic_order", (c("field_order_monotonic") >= 1.0) & (c("fields_touched") >= 4), 0.40, "Fields were filled strictly top to bottom"),
        rule("timing:too_fast", (c("total_time_s") > 0) & (c("total_time_s") < K.FORM_SECONDS_FLOOR), 0.64, "The form was completed too fast to be read"),
        rule("timing:hardcoded_sleep", c("near_round_sleep_s") > 0, 0.60, "Time on form matches a round sleep"),
        rule("environment:automation", F.size(flags) > 0, F.when(hard, 0.90).otherwise(0.35), F.concat(L("The browser identifies itself as automated: "), F.array_join(flags, ", "))),
        rule("environment:locale_mismatch", c("locale_incoherent") >= 1.0, 0.45, "Locale and clock disagree about the origin"),
        *extra_rules,
    )


def behavioral_rules(features: DataFrame, model_p: Column | None = None, extra_rules=()) -> DataFrame:
    """score, confidence, reasons and rule_hits of each feature row."""
    df = features.withColumn("rule_hits", behavioral_hits(model_p, extra_rules))
    keys, pts = F.coalesce("keystroke_count", L(0)), F.coalesce("mouse_points", L(0))
    seen = F.least(L(1.0), keys / K.CONFIDENT_KEYS) * 0.6 + F.least(L(1.0), pts / 60.0) * 0.25 + F.when(F.coalesce("fields_touched", L(0)) >= 3, 0.15).otherwise(0.0)
    hard = F.exists(weights_of(F.col("rule_hits")), lambda w: w >= K.HARD_WEIGHT)
    conf = clamp01(0.25 + 0.7 * seen)
    return df.select(
        "*",
        noisy_or(weights_of(F.col("rule_hits")), K.BEHAVIOUR_CAP).alias("score"),
        F.when(hard, F.greatest(conf, L(0.88))).otherwise(conf).alias("confidence"),
        reasons_by_weight(F.col("rule_hits"), "Typing, pointer and timing look like a person filling a form").alias("reasons"),
    )


def reference_bands(features: DataFrame) -> DataFrame:
    """Per session and feature: the human band and the measured value."""
    names = [n for n in K.HUMAN_BANDS if n in features.columns]
    long = features.select("session", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["session"], names, "feature", "measured")
    low, high = literal_map({k: v[0] for k, v in K.HUMAN_BANDS.items()}), literal_map({k: v[1] for k, v in K.HUMAN_BANDS.items()})
    return long.select("session", "feature", F.element_at(low, F.col("feature")).alias("low"), F.element_at(high, F.col("feature")).alias("high"), "measured")


def session_features(sessions: DataFrame) -> DataFrame:
    """Nested buffer -> one flat row per session with everything the rules read."""
    k = session_basics(keystroke_features(key_events(sessions)))
    m = pointer_features(mouse_events(sessions))
    spans = key_events(sessions).groupBy("session").agg(((F.max("down") - F.min("down")) / 1000.0).alias("span_s"))
    f = form_features(sessions.join(spans, "session", "left"), focus_events(sessions), paste_events(sessions))
    n = lambda c: F.greatest(F.coalesce(F.size(c), L(0)), L(0))
    env = F.col("env")
    base = sessions.select(
        "session", (n("keys") + n("mouse") + n("focus") + n("paste")).alias("event_count"), automation_flags(env).alias("automation_flags"),
        locale_incoherent(env["languages"], F.coalesce(F.col("declared_country"), env["country"]), env["timezone_offset_min"].cast("double")).cast("double").alias("locale_incoherent"),
    )
    out = base.join(f, "session", "left").join(k, "session", "left").join(m, "session", "left")
    skip = {"automation_flags", "session"}
    numeric = [c for c in out.columns if c not in skip]
    return out.fillna(0, numeric)
