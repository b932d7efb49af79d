"""Structured Streaming jobs over telemetry, submissions and verdicts."""
from __future__ import annotations

import json
import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..operators.durable import cut
from ..operators.ordered import row_numbers
from ..operators.views import alert_rows, scoreboard
from ..sources.readers import TELEMETRY_SCHEMA
from ..sources.writers import holds_files, is_keyed, latest_per_key, read_buckets, replace_by_key

log = logging.getLogger(__name__)
L = F.lit


def telemetry_ingest(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """ST1: a re-posted token replaces its row; the last one wins, within and across batches.

    The merge is keyed and idempotent, so a replayed batch changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        replace_by_key(batch, path, ["token"], ["posted_at"])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def telemetry_features(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """ST2 for whole buffers: features at write time, raw events not kept."""
    from ..operators.telemetry import behavioral_rules, session_features

    def fold(batch: DataFrame, _: int) -> None:
        latest = latest_per_key(batch, ["session"], ["posted_at"])
        rows = behavioral_rules(session_features(latest.drop("posted_at")))
        stamped = rows.join(latest.select(F.col("session"), "posted_at"), "session").withColumnRenamed("session", "token")
        replace_by_key(stamped, path, ["token"], ["posted_at"])

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def telemetry_sessions(events: DataFrame, gap: str = "5 hours", late: str = "10 minutes") -> DataFrame:
    """ST2 for single events: sessions closed by a gap, with basic features, append mode."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "token").agg(
        F.count(L(1)).alias("event_count"), F.avg("dwell").alias("dwell_mean_ms"), F.stddev_pop("dwell").alias("dwell_std"), F.sum((F.col("kind") == "paste").cast("int")).alias("paste_count")
    ).select("token", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_count", "dwell_mean_ms", F.coalesce(F.col("dwell_std") / F.when(F.col("dwell_mean_ms") > 1e-9, F.col("dwell_mean_ms")), L(0.0)).alias("dwell_cv"), "paste_count")


def stream_attach(subs: DataFrame, telemetry: DataFrame, late: str = "10 minutes", before: str = "30 minutes") -> DataFrame:
    """ST3: bind telemetry that preceded the packet by at most `before`; no match leaves it null.

    subs: token, submitted_at, ...  telemetry: token, posted_at, ...  The null rows appear once
    both watermarks have passed, i.e. `late` + `before` after the packet.
    """
    s = subs.withWatermark("submitted_at", late).alias("s")
    t = telemetry.withColumnRenamed("token", "t_token").withWatermark("posted_at", late).alias("t")
    near = F.expr(f"t_token = token AND posted_at <= submitted_at AND posted_at >= submitted_at - INTERVAL {before}")
    return s.join(t, near, "left_outer").drop("t_token")


def running_scoreboard(results: DataFrame) -> DataFrame:
    """ST4: the scoreboard after every batch (complete mode, one row of state)."""
    return scoreboard(results)


def attack_wave(verdicts: DataFrame, slide: str | None = "1 hour", late: str = "1 hour") -> DataFrame:
    """ST5: flagged counts by pattern in 24-hour windows, sliding or tumbling."""
    w = F.window("decided_at", "24 hours", slide) if slide else F.window("decided_at", "24 hours")
    flagged = verdicts.filter(F.col("verdict") != "PASS").withWatermark("decided_at", late)
    return flagged.groupBy(w.alias("w"), F.coalesce("attack_pattern", L("unclassified")).alias("pattern")).agg(F.count(L(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "pattern", "n"
    )


def alerts(verdicts: DataFrame, policies: DataFrame, deliver, checkpoint: str) -> DataStreamWriter:
    """ST6: notify per batch; a failing delivery is logged and never stops the verdict stream.

    `deliver(rows, batch_id)` can key its sink by the batch, so that a replay repeats nothing.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        try:
            deliver(alert_rows(batch, policies), batch_id)
        except Exception as exc:  # delivery must not affect scoring
            log.warning("alert delivery failed for batch %s: %s", batch_id, exc)

    return verdicts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def seed_history(hashes: DataFrame, path: str) -> None:
    """The two tables that ST7 keeps, from hashes known beforehand (submission_id, kind, content_hash, created_at)."""
    _remember(_arrivals(hashes), path, -1)


def _arrivals(batch: DataFrame) -> DataFrame:
    """One row per (submission, file), at its earliest time; files without bytes link nothing."""
    at = F.unix_micros(F.col("created_at").cast("timestamp")) if "created_at" in batch.columns else L(0).cast("bigint")
    return batch.filter(F.coalesce("content_hash", L("")) != "").groupBy("submission_id", "kind", "content_hash").agg(F.min(at).alias("at"))


FILE = ["content_hash", "kind"]
FILES = "content_hash string, kind string, n bigint, first {0}, second {0}, batch bigint, n_before bigint, first_before {0}, second_before {0}"


def _before(spark, path: str, new: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(files as they were before this batch, submissions seen before it), only the buckets of `new` are read."""
    idt = new.schema["submission_id"].dataType.simpleString()
    files, seen = read_buckets(spark, f"{path}/_files", new.select(*FILE)), read_buckets(spark, f"{path}/_seen", new.select("submission_id"))
    if files is None:
        return spark.createDataFrame([], FILES.format(idt)).select(*FILE, "n", "first", "second"), spark.createDataFrame([], f"submission_id {idt}, kind string, content_hash string")
    again = F.col("batch") == batch_id  # a replayed batch finds the state that it found first
    was = lambda c: F.when(again, F.col(f"{c}_before")).otherwise(F.col(c)).alias(c)
    return files.select(*FILE, was("n"), was("first"), was("second")), seen.filter(F.col("batch") != batch_id).select("submission_id", "kind", "content_hash")


def _remember(new: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Takes a batch into the history; returns its rows with n_earlier and first_submission."""
    spark = new.sparkSession
    new = cut(new)
    files, seen = (cut(x) for x in _before(spark, path, new, batch_id))
    key = ["submission_id", "kind", "content_hash"]
    fresh = new.join(seen, key, "left_anti")
    placed = cut(row_numbers(fresh, FILE, "at", ["submission_id"], "place"))  # in order of time within the batch, chunked for a file that is everywhere
    heads = placed.filter("place <= 2").groupBy(*FILE).agg(F.max(F.when(F.col("place") == 1, F.col("submission_id"))).alias("one"), F.max(F.when(F.col("place") == 2, F.col("submission_id"))).alias("two"))
    count = placed.groupBy(*FILE).agg(F.count(L(1)).alias("more"))
    state = files.join(heads.join(count, FILE), FILE, "full").withColumn("n", F.coalesce("n", L(0)))
    known = F.col("n") > 0
    first = F.when(known, F.col("first")).otherwise(F.col("one"))
    second = F.when(F.col("n") > 1, F.col("second")).when(known, F.col("one")).otherwise(F.col("two"))
    total = F.col("n") + F.coalesce("more", L(0))
    after = cut(state.select(*FILE, total.alias("n"), first.alias("first"), second.alias("second"), L(batch_id).cast("bigint").alias("batch"), F.col("n").alias("n_before"), F.when(known, F.col("first")).alias("first_before"), F.when(F.col("n") > 1, F.col("second")).alias("second_before")))
    # a fresh row meets the history and the earlier rows of its batch; a row sent again meets all others known before
    links = new.join(placed.select(*key, "place"), key, "left").join(after.select(*FILE, "n_before", "first", "second"), FILE)
    earlier = F.when(F.col("place").isNotNull(), F.col("n_before") + F.col("place") - 1).otherwise(F.col("n_before") - 1)
    other = F.when(F.col("first") == F.col("submission_id"), F.col("second")).otherwise(F.col("first"))
    out = cut(links.select("submission_id", "kind", earlier.alias("n_earlier"), other.alias("first_submission")).filter("n_earlier > 0"))
    replace_by_key(after, f"{path}/_files", FILE, ["n"])
    replace_by_key(fresh.select(*key, L(batch_id).cast("bigint").alias("batch")), f"{path}/_seen", key, ["batch"])
    return out


def stream_asset_links(new_hashes: DataFrame, history_path: str, sink, checkpoint: str) -> DataStreamWriter:
    """ST7: exact reuse of an earlier file.  The history is kept by the job itself.

    new_hashes: submission_id, kind, content_hash, created_at (without it all times are equal).  A
    plain table of hashes at `history_path` is taken in first.  Earlier means taken in by an
    earlier batch, or by the same batch with an earlier time (ties to the lower id).  The
    history has one row per file (how many submissions, the first two) and one per
    (submission, file), both in hash buckets, so a batch reads and rewrites its own buckets
    only.  A file row carries its state before its last batch, so a replayed batch gives
    the same rows.  A submission does not link to itself, however often it is sent.
    """

    def link(batch: DataFrame, batch_id: int) -> None:
        if not is_keyed(batch.sparkSession, f"{history_path}/_files") and holds_files(batch.sparkSession, history_path):
            seed_history(batch.sparkSession.read.parquet(history_path), history_path)
        sink(_remember(_arrivals(batch), history_path, batch_id), batch_id)

    return new_hashes.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint)


# --- ST2 for single events ------------------------------------------------------------------
EVENT = "token string, ts timestamp, kind string, pos bigint, key string, field string, a double, b double, c double, i int"
_TAIL = "kind string, pos bigint, key string, field string, a double, b double, c double, i int"
CLOSED = TELEMETRY_SCHEMA.replace("session string, ", "session string, token string, started timestamp, ended timestamp, ", 1)


TAIL_NAMES = [f.split(" ")[0] for f in _TAIL.split(", ")]
FRAME_ROWS = 256  # sessions of a token that leave the state in one frame
CLOSED_NAMES = ["session", "token", "started", "ended", "form_loaded_at", "submitted_at", "declared_country", "keys", "mouse", "focus", "paste", "env"]


class SessionBuffer(StatefulProcessor):
    """Holds the events of a token in appended pieces until the watermark is `gap` behind them.

    A timer stands at the end of the earliest session plus the gap.  When it fires, events are
    split where they lie further apart than the gap; sessions that ended are emitted whole, in
    the order of their positions, and the rest stays, with a timer for its earliest session.
    Nothing that is emitted can still grow, since rows behind the watermark are dropped before
    they come here.  Timers, reads of the state and frames are counted by token, not by session.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at bigint, " + _TAIL)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            columns = [[None if v is None or v != v else v for v in pdf[c].tolist()] for c in TAIL_NAMES]
            columns[-1] = [None if v is None else int(v) for v in columns[-1]]  # a null among them made them doubles
            self.events.appendList(list(zip(at.tolist(), *columns)))
            first = self.first_end(np.sort(np.append(at.to_numpy(), [] if first is None else first).astype("int64")))
        if first is not None:  # no session of these rows can end before; a session held already has its timer
            self.wake(first)
        return iter(())

    def first_end(self, at: np.ndarray) -> int:
        """The last of the sorted times that follow the first one without a gap."""
        breaks = np.flatnonzero(np.diff(at) > self.gap * 1000)
        return int(at[breaks[0] if len(breaks) else -1])

    def wake(self, end: int) -> None:
        self.handle.registerTimer(-(-end // 1000) + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        gone = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.events.get()), key=lambda r: (r[0], r[2]))
        runs, gap = [], self.gap * 1000
        for r in rows:
            if runs and r[0] - runs[-1][-1][0] <= gap:
                runs[-1].append(r)
            else:
                runs.append([r])
        done = [x for x in runs if x[-1][0] + gap <= gone]
        left = [x for x in runs if x[-1][0] + gap > gone]
        if done:
            if left:
                self.events.put([r for x in left for r in x])
            else:
                self.events.clear()
        if left:
            self.wake(left[0][-1][0])
        for at in range(0, len(done), FRAME_ROWS):
            yield pd.DataFrame([self.row(key[0], run) for run in done[at : at + FRAME_ROWS]], columns=CLOSED_NAMES)

    @staticmethod
    def row(token: str, run: list) -> dict:
        by = {}
        for at, kind, pos, key, field, a, b, c, i in sorted(run, key=lambda r: (r[2], r[0])):
            by.setdefault(kind, []).append((key, field, a, b, c, i))
        one = lambda kind, at: by[kind][-1][at] if kind in by else None
        start, end = run[0][0], run[-1][0]
        return {
            "session": f"{token}@{start}", "token": token, "started": pd.Timestamp(start, unit="us"), "ended": pd.Timestamp(end, unit="us"),
            "form_loaded_at": one("load", 2), "submitted_at": one("submit", 2), "declared_country": one("country", 0),
            "keys": [{"key": k, "down": a, "up": b, "field": f} for k, f, a, b, _, _ in by.get("key", [])],
            "mouse": [{"t": a, "x": b, "y": c} for _, _, a, b, c, _ in by.get("mouse", [])],
            "focus": [{"field": f, "index": i, "in": a, "out": b} for _, f, a, b, _, i in by.get("focus", [])],
            "paste": [{"field": f, "t": a, "length": i} for _, f, a, _, _, i in by.get("paste", [])],
            "env": json.loads(one("env", 0)) if "env" in by else None,
        }


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """ST2 for single events: (session, token, started, ended, keys, mouse, focus, paste, env, ...), one row per closed session.

    `events` as EVENT: kind 'key' (a down, b up), 'mouse' (a t, b x, c y), 'focus' (a in, b out, i
    index), 'paste' (a t, i length), 'load' and 'submit' (a), 'country' and 'env' (key; env as
    JSON).  A session closes when the watermark is `gap` behind its last event.  The state store must be
    RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    names = [f.split(" ")[0] for f in EVENT.split(", ")]
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)
    src = events.select(*names).withWatermark("ts", late)
    return src.groupBy("token").transformWithStateInPandas(SessionBuffer(wait), CLOSED, "Append", "EventTime")


def event_features(events: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataStreamWriter:
    """ST2: FE1-FE5 of every session when it closes, by the same expressions as in batch; raw events are not kept."""
    from ..operators.telemetry import behavioral_rules, session_features

    def fold(batch: DataFrame, _: int) -> None:
        closed = cut(batch)
        rows = behavioral_rules(session_features(closed.drop("token", "started", "ended")))
        replace_by_key(rows.join(closed.select("session", "token", "started", "ended"), "session"), path, ["session"], ["ended"])

    return closed_sessions(events, gap, late).writeStream.outputMode("append").foreachBatch(fold).option("checkpointLocation", checkpoint)
