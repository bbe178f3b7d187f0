"""Decisions chunk by chunk against one pass in time, over many chunk borders and in dense sessions."""

import random
import time

import pyarrow as pa
import pytest

from evtrace.operators import chunks

A, C = "session_id long, a_id long, a_t long, a_side string", "session_id long, c_id long, c_t long, c_conf double, c_side string"


def one_pass(a, c, window, prefer=False):
    used, out = set(), {}
    for s, i, t, side in sorted(a, key=lambda x: (x[0], x[2], x[1])):
        free = [(prefer and side != cs, abs(ct - t), -conf, ct, ci) for s2, ci, ct, conf, cs in c if s2 == s and ci not in used and abs(ct - t) <= window]
        if free:
            out[i] = min(free)[4]
            used.add(out[i])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_equals_one_pass(spark, seed):
    rng = random.Random(seed)
    times = lambda: rng.choice([rng.randrange(0, 400), rng.randrange(190, 210)])
    a = [(rng.randrange(3), i, times(), rng.choice("xy")) for i in range(90)]
    c = [(rng.randrange(3), i, times(), rng.choice([0.1, 0.5]), rng.choice(["x", "y", None])) for i in range(90)]
    left, right = spark.createDataFrame(a, A), spark.createDataFrame(c, C)
    for width in (24, 70, 1000):
        for prefer in (None, "side"):
            got = {r["a_id"]: r["c_id"] for r in chunks.greedy_match(left, right, 12, prefer, width=width).collect()}
            assert got == one_pass(a, c, 12, bool(prefer))


def test_throttle_equals_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(0, 500), i, "x") for i in range(400)]
    want, last = [], {}
    for s, t, i, _ in sorted(rows):
        if s not in last or t - last[s] >= 7:
            want.append(i)
            last[s] = t
    df = spark.createDataFrame(rows, "session_id long, t long, event_id long, note string")
    for width in (7, 20, 90, 10_000):
        out = chunks.throttle(df, ["session_id"], 7, width=width)
        assert out.columns == df.columns and sorted(r["event_id"] for r in out.collect()) == sorted(want)
    none = df.where("false")
    assert chunks.throttle(none, ["session_id"], 7).count() == 0


def test_a_dense_session_costs_in_proportion(spark):
    n = 100_000  # anchors and as many candidates, all within one window of the next
    left = spark.range(n).selectExpr("1L as session_id", "id as a_id", "id * 2 as a_t", "'x' as a_side")
    right = spark.range(n).selectExpr("1L as session_id", "id as c_id", "id * 2 + 1 as c_t", "0.5D as c_conf", "'x' as c_side")
    began = time.time()
    got = chunks.greedy_match(left, right, 1_000_000, width=40_000)
    assert got.count() == n and got.select("c_id").distinct().count() == n
    kept = chunks.throttle(spark.range(2 * n).selectExpr("1L as session_id", "id as t", "id as event_id"), ["session_id"], 3, width=40_000)
    assert kept.count() == -(-2 * n // 3) and time.time() - began < 120


def test_no_rows(spark):
    none = chunks.greedy_match(spark.createDataFrame([], A), spark.createDataFrame([], C), 10)
    assert none.count() == 0 and none.columns == ["session_id", "a_id", "c_id", "gap", "tier"]


def test_many_small_runs_are_decided_together():
    n = 60_000  # sessions of one anchor and two candidates; one call for each took about a millisecond
    rows = lambda kind, shift, conf, window: {"session_id": list(range(n)), "chunk": [0] * n, "kind": [kind] * n, "id": [4 * i + shift for i in range(n)], "t": [shift] * n, "conf": [conf] * n, "side": ["x" if kind == 3 or shift == 3 else None] * n, "window": [window] * n}
    schema = pa.schema([("session_id", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("conf", pa.float64()), ("side", pa.string()), ("window", pa.int64())])
    table = pa.concat_tables(pa.table(x, schema) for x in (rows(3, 0, None, 10), rows(1, 1, 0.5, None), rows(1, 3, 0.5, None))).sort_by("session_id")
    at, calls = ["session_id", "chunk"], []
    decide = chunks._greedy(["session_id"])
    counted = lambda *x: calls.append(1) or decide(*x)
    began = time.time()
    got = pa.Table.from_batches(chunks.many_runs(counted, at, [*at, "a_id", "c_id", "gap", "tier", "c_t"])(table.to_batches(max_chunksize=10_000)))
    assert sorted(got.column("session_id").to_pylist()) == list(range(n)) and set(got.column("gap").to_pylist()) == {3} and set(got.column("tier").to_pylist()) == {0}
    assert all(c == a + 3 for a, c in zip(got.column("a_id").to_pylist(), got.column("c_id").to_pylist()))
    assert len(calls) <= 19 and time.time() - began < 20
