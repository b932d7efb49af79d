"""Readers, sinks and streaming contracts."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fraudloom.operators.durable import fresh_path
from fraudloom.operators.sampling import cmu_sessionise
from fraudloom.sources import readers, writers
from fraudloom.streaming import jobs


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_pair_protocol(spark, tmp_path):
    p = tmp_path / "pairs.txt"
    p.write_text("2\t2\nA\t1\t2\nB\t1\t3\nA\t1\tB\t2\nC\t1\tD\t4\nE\t1\t2\nF\t1\t2\nE\t1\tF\t1\nG\t1\tH\t1\n")
    rows = readers.read_pair_protocol(spark, str(p)).orderBy("pair_id").collect()
    assert [r.label for r in rows] == [1, 1, 0, 0, 1, 1, 0, 0] and [r.fold for r in rows] == [0] * 4 + [1] * 4
    assert (rows[0].photo_a, rows[0].photo_b) == ("A_0001", "A_0002") and (rows[3].photo_a, rows[3].photo_b) == ("C_0001", "D_0004")


def test_cmu_wide(spark, tmp_path):
    p = tmp_path / "cmu.csv"
    head = "subject,sessionIndex,rep,H.a,DD.a.b,UD.a.b,H.b"
    p.write_text(head + "\n" + "\n".join(f"s1,1,{i},0.1,0.5,0.{i + 1},0.2" for i in range(7)) + "\n")
    df = readers.read_cmu_wide(spark, str(p))
    first = df.orderBy("rep").first()
    assert first.dwells == pytest.approx([100.0, 200.0]) and first.flights == pytest.approx([100.0]) and first.n_keys == 2
    out = cmu_sessionise(df, keys_per_row=2, keys=5).groupBy("session").count().orderBy("session").collect()
    assert [r["count"] for r in out] == [3, 3]  # the last partial session is dropped


def test_aalto_tsv(spark, tmp_path):
    head = "PARTICIPANT_ID\tTEST_SECTION_ID\tSENTENCE\tUSER_INPUT\tKEYSTROKE_ID\tPRESS_TIME\tRELEASE_TIME\tLETTER\tKEYCODE\n"
    (tmp_path / "17_keystrokes.txt").write_text(head + '17\t9\tit is "\tx\t1\t100\t180\ta\t65\n17\t9\tx\tx\t2\t200\tbad\tb\t66\n17\t10\tx\tx\t3\t300\t390\tb\t66\n')
    rows = readers.read_keystroke_tsv(spark, str(tmp_path)).orderBy("press").collect()
    assert [(r.subject, r.section, r.press) for r in rows] == [("aalto::17", "9", 100.0), ("aalto::17", "10", 300.0)]


def test_scores_array_file(spark, tmp_path):
    p = tmp_path / "scores.json"
    p.write_text('[{"id": "a", "y": 1, "detectors": {"face_match": {"score": 0.5, "status": "ok"}}},\n {"id": "b", "y": 0}]')
    rows = readers.read_scores(spark, str(p)).orderBy("id").collect()
    assert rows[0].detectors["face_match"].score == 0.5 and rows[1].detectors is None


def test_report_writes_nulls_for_non_finite(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [float("inf"), 2.0], {"k": float("nan")})], "i int, a double, b array<double>, m map<string,double>")
    writers.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"i":1,"a":null,"b":[null,2.0],"m":{"k":null}}'


def test_replace_by_key_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(str(i), 0, at(0)) for i in range(200)], "submission_id string, v int, decided_at timestamp")
    writers.write_verdicts(df, path)
    before = {f: None for f in spark.read.parquet(path).inputFiles()}
    writers.write_verdicts(spark.createDataFrame([("7", 1, at(5)), ("7", 2, at(4))], df.schema), path)
    after = spark.read.parquet(path)
    assert after.count() == 200 and after.filter("submission_id = '7'").first().v == 1
    assert len(set(after.inputFiles()) & set(before)) >= len(before) - 1


def stream_of(spark, rows, schema, tag):
    path = fresh_path(spark, tag)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_attach_leaves_missing_telemetry_null_after_the_watermark(spark):
    subs = stream_of(spark, [[("a", at(20), 1), ("b", at(20), 2), ("c", at(50), 3)], [("z", at(600), 9)], [("z", at(700), 10)]], "token string, submitted_at timestamp, sid int", "subs")
    tele = stream_of(spark, [[("a", at(5), 11), ("c", at(1), 12)], [("z", at(599), 13)], [("z", at(699), 14)]], "token string, posted_at timestamp, tid int", "tele")
    out = fresh_path(spark, "out")
    q = jobs.stream_attach(subs, tele).select("sid", "tid").writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.sid: r.tid for r in spark.read.parquet(out).collect()}
    assert got[1] == 11 and got[2] is None and got[3] is None and got[9] == 13  # 49 minutes is too long before


def test_reposted_token_replaces_its_row_across_batches(spark):
    s = stream_of(spark, [[("t", 1, at(1)), ("u", 5, at(1))], [("t", 2, at(2)), ("t", 3, at(3))]], "token string, v int, posted_at timestamp", "posts")
    out = fresh_path(spark, "tokens")
    jobs.telemetry_ingest(s, out, fresh_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r.token: r.v for r in spark.read.parquet(out).collect()} == {"t": 3, "u": 5}


def test_failing_delivery_does_not_stop_the_stream(spark):
    s = stream_of(spark, [[("a", "m", "REJECT", 0.95)], [("b", "m", "REJECT", 0.99)]], "submission_id string, merchant_id string, verdict string, final_score double", "v")
    seen = []

    def deliver(rows, batch_id):
        seen.append((batch_id, rows.count()))
        raise OSError("unreachable")

    pol = spark.createDataFrame([("m", 0.9)], "merchant_id string, webhook_min_score double")
    q = jobs.alerts(s, pol, deliver, fresh_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and seen == [(0, 1), (1, 1)]


def test_a_submission_does_not_link_to_itself(spark):
    schema = "submission_id bigint, kind string, content_hash string"
    past = fresh_path(spark, "history")
    spark.createDataFrame([(1, "id", "x"), (2, "id", "x"), (2, "id", "x"), (5, "id", "y"), (6, "id", "")], schema).write.parquet(past)
    s = stream_of(spark, [[(1, "id", "x"), (3, "id", "x"), (5, "id", "y"), (7, "id", ""), (8, "id", None)]], schema, "new")
    got = []
    jobs.stream_asset_links(s, past, lambda df, _: got.extend(df.collect()), fresh_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, got)) == [(1, "id", 1, 2), (3, "id", 2, 1)]


def test_buffers_become_features_in_the_stream(spark):
    from test_semantics import human, kit

    schema = readers.TELEMETRY_SCHEMA + ", posted_at timestamp"
    s = stream_of(spark, [[{**human(1), "posted_at": at(1)}, {**kit(), "posted_at": at(1)}]], schema, "buffers")
    out = fresh_path(spark, "features")
    jobs.telemetry_features(s, out, fresh_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.token: r.score for r in spark.read.parquet(out).collect()}
    assert got["h1"] == 0.0 and got["kit"] > 0.9
