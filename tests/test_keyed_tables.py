"""Keyed tables with growing buckets, the file history and single-event sessions."""
import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fraudloom.operators import sampling as S
from fraudloom.operators import telemetry as T
from fraudloom.operators.durable import fresh_path
from fraudloom.sources import readers, writers
from fraudloom.streaming import jobs

START = dt.datetime(2024, 1, 1)
at = lambda minutes: START + dt.timedelta(minutes=minutes)


def layout(path):
    with open(f"{path.removeprefix('file:')}/{writers.LAYOUT}") as f:
        return json.load(f)


def test_buckets_grow_and_a_small_batch_stays_small(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    r = random.Random(1)
    for batch in range(6):
        rows = [(f"k{r.randint(0, 3000)}", batch, f"{r.getrandbits(800):x}") for _ in range(1500)]
        want |= {k: v for k, v, _ in rows}
        df = spark.createDataFrame(rows, "k string, v int, pad string")
        writers.replace_by_key(df, path, ["k"], ["v"], bucket_bytes=20_000, first_buckets=2)
    n = layout(path)["n"]
    assert n > 16
    table = writers.read_keyed(spark, path)
    assert {x.k: x.v for x in table.collect()} == want and table.count() == len(want)
    # every row is where its key belongs
    placed = spark.read.parquet(path).withColumn("own", writers.bucket_of("k", n))
    assert placed.filter("part <> own").count() == 0
    before = set(spark.read.parquet(path).inputFiles())
    writers.replace_by_key(spark.createDataFrame([("k7", 99, "y")], "k string, v int, pad string"), path, ["k"], ["v"], bucket_bytes=20_000)
    after = set(spark.read.parquet(path).inputFiles())
    assert len(before - after) <= 2 and writers.read_keyed(spark, path).filter("k = 'k7'").first().v == 99


def test_linear_hashing_moves_rows_of_one_bucket(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    for n in (8, 11, 15, 16):
        moved = df.select(writers.bucket_of("k", n).alias("a"), writers.bucket_of("k", n + 1).alias("b")).filter("a <> b").distinct().collect()
        assert [(x.a, x.b) for x in moved] == [(writers._sources(n, n + 1)[0], n)]


def test_a_merge_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(str(i), 0) for i in range(300)], "k string, v int")
    writers.replace_by_key(df, path, ["k"], ["v"])
    real = writers._replace
    monkeypatch.setattr(writers, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        writers.replace_by_key(df.withColumn("v", F.lit(1)), path, ["k"], ["v"])
    monkeypatch.setattr(writers, "_replace", real)
    assert "pending" in layout(path)
    writers.replace_by_key(spark.createDataFrame([("7", 2)], "k string, v int"), path, ["k"], ["v"])
    got = {r.k: r.v for r in writers.read_keyed(spark, path).collect()}
    assert len(got) == 300 and got["7"] == 2 and set(got.values()) == {1, 2} and "pending" not in layout(path)


def test_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_by_key(spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, v int, x string"), path, ["k"], ["v"])
    writers.replace_by_key(spark.createDataFrame([("a", 2, 5.0)], "k string, v int, y double"), path, ["k"], ["v"])
    got = {r.k: (r.v, r.x, r.y) for r in writers.read_keyed(spark, path).collect()}
    assert got == {"a": (2, None, 5.0), "b": (1, "old", None)}
    writers.replace_by_key(spark.createDataFrame([], "k string, v int"), path, ["k"], ["v"])
    assert writers.read_keyed(spark, path).count() == 2
    with pytest.raises(ValueError):
        (spark.range(3).write.parquet(str(tmp_path / "plain")), writers.replace_by_key(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "plain"), ["k"], ["v"]))


HASHED = "submission_id bigint, kind string, content_hash string, created_at timestamp"


def test_history_meets_its_own_batches_in_time_order(spark):
    past = fresh_path(spark, "history")
    jobs.seed_history(spark.createDataFrame([(50, "id", "x", at(0))], HASHED), past)
    rows = [
        [(9, "id", "x", at(3)), (4, "id", "x", at(5)), (4, "id", "x", at(6)), (7, "id", "y", at(1)), (8, "selfie", "x", at(1)), (1, "id", "", at(1)), (2, "id", None, at(1))],
        [(3, "id", "y", at(9)), (9, "id", "x", at(20)), (2, "id", "x", at(21))],
    ]
    links = lambda b: sorted(tuple(r) for r in jobs._remember(jobs._arrivals(spark.createDataFrame(rows[b], HASHED)), past, b).collect())
    first = [(4, "id", 2, 50), (9, "id", 1, 50)]
    second = [(2, "id", 3, 50), (3, "id", 1, 7), (9, "id", 2, 50)]
    assert links(0) == first and links(0) == first  # a replay gives the same
    assert links(1) == second and links(1) == second
    files = {(r.content_hash, r.kind): (r.n, r["first"], r.second) for r in writers.read_keyed(spark, f"{past}/_files").collect()}
    assert files == {("x", "id"): (4, 50, 9), ("y", "id"): (2, 7, 3), ("x", "selfie"): (1, 8, None)}


def as_events(session, begin):
    """The nested buffer of a session as single events on the event clock."""
    out, pos = [], 0
    put = lambda ms, kind, **v: out.append({"token": session["session"], "ts": begin + dt.timedelta(milliseconds=ms), "kind": kind, "pos": len(out), "key": None, "field": None, "a": None, "b": None, "c": None, "i": None, **v})
    put(0, "load", a=session["form_loaded_at"])
    put(0, "env", key=json.dumps(session["env"]))
    put(0, "country", key=session["declared_country"])
    for k in session["keys"]:
        put(k["down"], "key", key=k["key"], field=k["field"], a=k["down"], b=k["up"])
    for m in session["mouse"]:
        put(m["t"], "mouse", a=m["t"], b=m["x"], c=m["y"])
    for f in session["focus"]:
        put(f["in"], "focus", field=f["field"], i=f["index"], a=f["in"], b=f["out"])
    for p in session["paste"]:
        put(p["t"], "paste", field=p["field"], a=p["t"], i=p["length"])
    put(session["submitted_at"], "submit", a=session["submitted_at"])
    return out


def test_single_events_give_the_features_of_the_batch(spark):
    from test_semantics import human, kit

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sessions = [human(1), human(2), kit()]
    schema = jobs.EVENT
    names = [f.split(" ")[0] for f in schema.split(", ")]
    rows = [e for s in sessions for e in as_events(s, START)]
    random.Random(2).shuffle(rows)
    again = as_events({**human(1), "keys": human(1)["keys"][:5], "mouse": [], "focus": []}, at(300))
    late = [{**rows[0], "token": "h1", "kind": "key", "key": "late", "a": 1.0, "b": 2.0, "ts": at(1), "pos": 9999}]
    path = fresh_path(spark, "events")
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], again + [{**again[0], "token": "other", "ts": at(310)}], [{**again[0], "token": "end", "ts": at(900)}], late, [{**again[0], "token": "end2", "ts": at(901)}]):
        spark.createDataFrame([tuple(e[n] for n in names) for e in part], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = fresh_path(spark, "features")
    jobs.event_features(stream, out, fresh_path(spark, "state"), "30 minutes").trigger(availableNow=True).start().awaitTermination()
    got = {(r.token, r.started): r.asDict() for r in writers.read_keyed(spark, out).collect()}
    batch = {r.session: r.asDict() for r in T.behavioral_rules(T.session_features(spark.createDataFrame(sessions, readers.TELEMETRY_SCHEMA))).collect()}
    for s in sessions:
        mine = got[(s["session"], START)]
        for c, v in batch[s["session"]].items():
            if c not in ("session", "event_count"):
                assert mine[c] == (pytest.approx(v) if isinstance(v, float) else v), (s["session"], c)
    second = got[("h1", at(300))]
    assert second["keystroke_count"] == 5 and ("other", at(310)) in got and len(got) == 5


@pytest.mark.parametrize("chunk_rows", [1, 2, 7, 64])
def test_sessions_that_restart_equal_a_walk(spark, chunk_rows):
    r = random.Random(chunk_rows)
    rows = [(f"p{p}", f"s{i:04d}", r.randint(0, 60)) for p, n in enumerate((1, 5, 90, 40)) for i in range(n)]
    want, open_, session = [], {}, {}
    held = []
    for p, s, n in sorted(rows):
        if (p not in open_):
            open_[p], session[p], held = 0, 0, []
        held.append((p, s, session[p]))
        open_[p] += n
        if open_[p] >= 110:
            want += held
            held, open_[p], session[p] = [], 0, session[p] + 1
    got = S.aalto_sessionise(spark.createDataFrame(rows, "subject string, section string, n_keys int"), 110, chunk_rows)
    assert sorted((x.subject, x.section, x.session) for x in got.collect()) == sorted(want)


def test_a_large_first_load_opens_enough_buckets(spark, tmp_path):
    path, r = str(tmp_path / "t"), random.Random(8)
    rows = [(f"k{i}", i, f"{r.getrandbits(1600):x}") for i in range(2000)]
    writers.replace_by_key(spark.createDataFrame(rows, "k string, v int, pad string"), path, ["k"], ["v"], bucket_bytes=30_000, first_buckets=2)
    assert layout(path)["n"] > 10 and writers.read_keyed(spark, path).count() == 2000
