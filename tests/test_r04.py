"""Findings of the fourth round: state by token, pairs of blocks, tables of hyperplanes."""
from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest

from fraudloom.operators import durable
from fraudloom.operators import similarity as V
from fraudloom.plans import link_queries
from fraudloom.streaming import jobs

MINUTE = 60_000_000


class Handle:
    """The state and the timers of one token, as the state store keeps them."""

    def __init__(self):
        self.rows, self.timers, self.asked, self.reads = [], set(), 0, 0

    def getListState(self, name, schema):
        return self

    def appendList(self, rows):
        assert all(type(v) in (int, float, str, type(None)) for r in rows for v in r)
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def registerTimer(self, at):
        self.timers.add(at)
        self.asked += 1

    def batch(self, buffer, frames, watermark):
        """One micro-batch: rows, then the timers that the watermark (ms) has passed."""
        if frames:
            list(buffer.handleInputRows(("p",), iter(frames), None))
        out = []
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: watermark})()
        for at in sorted(t for t in self.timers if t <= watermark):
            out += buffer.handleExpiredTimer(("p",), now, None)
            self.timers.discard(at)
        return out


def buffered(gap_ms):
    buffer, handle = jobs.SessionBuffer(gap_ms), Handle()
    buffer.init(handle)
    return buffer, handle


def typed(rows):
    """(microseconds, pos) as single keystrokes; every third has no release, and an index."""
    return pd.DataFrame(
        [{"token": "p", "ts": pd.Timestamp(at, unit="us"), "kind": "key", "pos": pos, "key": "a", "field": None, "a": float(at), "b": None if pos % 3 == 0 else at + 1.0, "c": None, "i": None if pos % 3 else 2**31 - 1} for at, pos in rows]
    )


def test_a_token_with_many_sessions_has_one_timer_and_one_frame():
    buffer, handle = buffered(5 * 60_000)
    rows = [(i * 60 * MINUTE + k, 2 * i + k) for i in range(200) for k in range(2)]
    frames = handle.batch(buffer, [typed(rows)], 10**9)
    assert handle.asked == 1 and handle.reads == 1 and len(frames) == 1 and not handle.rows
    got = frames[0]
    assert got["session"].tolist() == [f"p@{i * 60 * MINUTE}" for i in range(200)]
    assert [[k["down"] for k in x] for x in got["keys"]] == [[float(i * 60 * MINUTE), i * 60 * MINUTE + 1.0] for i in range(200)]
    assert got["keys"][0][0]["up"] is None and got["keys"][0][1]["up"] == 2.0


def test_sessions_over_many_batches_close_with_the_watermark():
    for seed in range(40):
        r = random.Random(seed)
        gap = 30 * MINUTE
        buffer, handle = buffered(30 * 60_000)
        end, seen, closed, mark = 0, [], set(), -(10**9)
        for step in range(12):
            new = [(r.randint(max(end - 5 * MINUTE, mark * 1000 + 1, 0), end + 300 * MINUTE), 100 * step + k) for k in range(r.choice([0, 1, 3, 9]))]
            seen += new
            halves = [x for x in (new[: len(new) // 2], new[len(new) // 2 :]) if x]
            end = max([end, *(at for at, _ in new)])
            mark = max(mark, end // 1000 - r.choice([5, 10, 60]) * 60_000)
            got = handle.batch(buffer, [typed(x) for x in halves], mark)
            runs = []
            for at, _ in sorted(seen):
                if runs and at - runs[-1][-1] <= gap:
                    runs[-1].append(at)
                else:
                    runs.append([at])
            due = {(x[0], x[-1], len(x)) for x in runs if x[-1] + gap <= mark * 1000}
            rows = [(row.started.value // 1000, row.ended.value // 1000, len(row.keys)) for f in got for row in f.itertuples()]
            assert len(rows) == len(set(rows)) and set(rows) == due - closed, (seed, step)
            closed |= set(rows)
            open_ends = [x[-1] for x in runs if x[-1] + gap > mark * 1000]
            assert not open_ends or any(t <= -(-min(open_ends) // 1000) + 30 * 60_000 for t in handle.timers)
        assert len(handle.rows) == len(seen) - sum(n for *_, n in closed)


# --- JN4: what the pairs of vectors leave on disk -------------------------------------------------
def vectors(spark, n, dims, seed=0, centres=0, kind="float"):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims))
    if centres:
        x = g.normal(size=(centres, dims))[np.arange(n) % centres] + 0.25 * x
    x = x.astype(np.float32).astype(np.float64)
    reps = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"rep bigint, vector array<{kind}>")
    return reps, np.round((x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2), 12)


def brute(sims, threshold):
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sims >= threshold, 1)))}


@pytest.mark.parametrize("centres,threshold,tile", [(0, 0.3, 1 << 22), (30, 0.9, 1 << 22), (0, 0.3, 10 * 16 * 3), (30, -1.0, 10 * 16 * 2)])
def test_tiles_of_blocks_find_every_pair_once(spark, monkeypatch, centres, threshold, tile):
    monkeypatch.setattr(V, "TILE_NUMBERS", tile, raising=False)
    reps, sims = vectors(spark, 700, 16, centres=centres)
    sent, sort = [], type(reps).sortWithinPartitions
    monkeypatch.setattr(type(reps), "sortWithinPartitions", lambda self, *c: sent.append(self) or sort(self, *c))
    got = [(r.a, r.b) for r in V.similar_pairs(reps, threshold, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(sims, threshold)
    blocks = V.pivot_blocks(reps, threshold, 10)[0].select("b").distinct().count()
    copies = sent[0].filter("rep IS NOT NULL").count() / 700
    assert blocks >= 60 and copies <= (blocks / 2 + 2 if tile < 1 << 22 else 14)  # one per pair of blocks before


def shuffled(spark):
    """Bytes of shuffle files that this process holds."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    size = 0
    while files.hasNext():
        f = files.next()
        size += f.length() if f.getName().startswith("shuffle_") else 0
    return size


def test_tables_of_hyperplanes_go_in_rounds_and_leave_their_pairs_only(spark, monkeypatch):
    reps, sims = vectors(spark, 1500, 32)
    reps = durable.cut(reps)
    tables, paired = [], V._paired
    monkeypatch.setattr(V, "_paired", lambda met, *a: tables.append({r.t for r in met.select("t").distinct().collect()} if "t" in met.columns else None) or paired(met, *a))
    before = shuffled(spark)
    one = [(r.a, r.b, r.similarity) for r in V.approx_pairs(reps, 0.5, bits=6).collect()]
    assert len({x[:2] for x in one}) == len(one) and {x[:2] for x in one} <= brute(sims, 0.5)
    assert len(one) >= 0.95 * len(brute(sims, 0.5)) > 300 and all(a < b and s == sims[a, b] for a, b, s in one)
    n = len(tables[0])
    assert len(tables) == 1 and n > 20
    until = time.time() + 20
    while shuffled(spark) - before > 2_000_000 and time.time() < until:  # n tables of 1,500 * 32 * 4 bytes were left before
        time.sleep(0.5)
    assert shuffled(spark) - before < 2_000_000
    monkeypatch.setattr(V, "ROUND_NUMBERS", 7 * 1500 * 32)
    again = [tuple(r) for r in V.approx_pairs(reps, 0.5, bits=6, scores=False).collect()]
    assert sorted(again) == sorted(x[:2] for x in one)
    assert len(tables) == 1 + -(-n // 7) and set().union(*tables[1:]) == set(range(n)) and all(len(x) <= 7 for x in tables[1:])


def test_a_row_has_the_same_buckets_in_every_batch():
    x = np.random.default_rng(3).normal(size=(300, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = V._codes(x, 9, range(150), 150, 7)
    assert whole.dtype == np.uint16 and (V._codes(x[40:41], 9, range(70, 150), 150, 7) == whole[40:41, 70:]).all()
    signs = (x @ V._planes(48, 9, 150, 7).T >= 0).reshape(300, 150, 9) @ (1 << np.arange(9))
    assert (signs != whole).mean() < 1e-3


def test_recall_is_counted_by_parts(spark, monkeypatch, tmp_path):
    reps, sims = vectors(spark, 600, 16, seed=5)
    reps.selectExpr("rep AS vec_id", "vector AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = len(brute(sims, link_queries.FACE_T))
    for part in (1 << 25, want // 3):
        monkeypatch.setattr(link_queries, "PART_PAIRS", part, raising=False)
        assert tuple(link_queries.approx_recall(link_queries.B.Tables(spark, str(tmp_path))).first()) == (want, 0, True)
    # what the approximate form loses or invents still shows
    approx = V.approx_pairs
    monkeypatch.setattr(V, "approx_pairs", lambda *a, **k: approx(*a, **k).select("a", "b").filter("a % 5 > 0").unionByName(spark.createDataFrame([(1, 10**6)], "a bigint, b bigint")))
    assert tuple(link_queries.approx_recall(link_queries.B.Tables(spark, str(tmp_path))).first()) == (want, 1, False)
    assert spark.conf.get(durable.CLEANED, None) is None
