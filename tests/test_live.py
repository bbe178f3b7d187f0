"""Streams over small files, one file a batch, against what the rows say by hand and against batch operators."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evtrace.operators import spatial, timeline
from evtrace.streaming import live

BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches of (session, event, seconds, type, value) as one file each and gives the stream."""

    def make(*batches, late="1 hour"):
        for n, rows in enumerate(batches):
            data = pd.DataFrame([(e, BEGIN + dt.timedelta(seconds=s), u, k, float(v), "{}") for u, e, s, k, v in rows], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
            data["ts"] = data["ts"].astype("datetime64[us]")
            (tmp_path / "in").mkdir(exist_ok=True)
            data.to_parquet(tmp_path / "in" / f"{n:03d}.parquet")
            import os

            os.utime(tmp_path / "in" / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
        return live.stream_events(spark, str(tmp_path / "in"), late)

    return make


def run(spark, stream, tmp_path, mode="append"):
    live.to_table(stream, str(tmp_path / "out"), str(tmp_path / "check"), mode)
    return spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))


def test_late_rows_are_dropped(spark, feed, tmp_path):
    stream = feed([(1, 1, 0, "a", 1), (1, 2, 10, "a", 1)], [(1, 3, 50_000, "a", 1)], [(1, 5, 50_010, "a", 1)], [(1, 4, 20, "a", 9)], [(2, 6, 200_000, "a", 1)], [(2, 7, 200_001, "a", 1)])
    got = run(spark, live.near_duplicates(stream, "60 seconds"), tmp_path).collect()
    assert sorted((r["session_id"], r["members"], r["value"]) for r in got) == [(1, 2, 1.0), (1, 2, 1.0)]  # event 4 came over an hour late


def test_rate_limit_keeps_the_first_of_each_tick(spark, feed, tmp_path):
    stream = feed([(1, 1, 0, "a", 1), (1, 2, 3, "a", 1), (1, 3, 12, "a", 1), (2, 4, 5, "a", 1)], [(1, 5, 100_000, "a", 1)], [(1, 6, 100_001, "a", 1)])
    assert {r["event_id"] for r in run(spark, live.rate_limit(stream, "10 seconds"), tmp_path).collect()} == {1, 3, 4}


def test_matches_come_in_pairs_and_alone(spark, feed, tmp_path):
    stream = feed([(1, 1, 0, "a", 1), (1, 2, 5, "b", 1), (1, 3, 900, "a", 1)], [(2, 4, 900_000, "b", 1), (2, 5, 900_000, "a", 1)], [(2, 6, 1_900_000, "a", 1), (2, 7, 1_900_000, "b", 1)])
    got = run(spark, live.matches(stream.where("event_type = 'a'"), stream.where("event_type = 'b'"), "10 seconds"), tmp_path)
    assert {(1, 2), (3, None)} <= {(r["a_id"], r["c_id"]) for r in got.collect()}


def test_live_counters(spark, feed, tmp_path):
    stream = feed([(1, 1, 0, "view", 1), (1, 2, 1, "click", 1), (2, 3, 0, "error", 1), (2, 4, 1, "error", 1)], [(1, 5, 2, "click", 1), (1, 6, 3, "click", 1), (2, 7, 2, "error", 1), (2, 8, 3, "view", 1)], [(1, 9, 4, "click", 1)])
    got = run(spark, live.live_counters(stream, "click", "error", 2, 3), tmp_path).collect()
    assert {(1, 2, 1, 0, "running"), (1, 4, 3, 0, "done"), (2, 2, 0, 2, "running"), (2, 3, 0, 3, "error")} == {tuple(r) for r in got}


def test_sessions_end_after_their_time(spark, feed, tmp_path):
    stream = feed([(1, 1, 0, "a", 1), (1, 2, 20, "a", 1), (1, 3, 70, "a", 1)], [(2, 4, 100_000, "a", 1)], [(2, 5, 100_001, "a", 1)])
    got = {(r["session_id"], r["generation"], r["stop"] - r["start"], r["events"]) for r in run(spark, live.session_timeouts(stream, 60.0), tmp_path).collect()}
    assert {(1, 0, 60.0, 2), (1, 1, 60.0, 1)} <= got and not any(g > 1 for _, g, _, _ in got)


def test_notices_of_a_full_queue_are_dropped(spark, feed, tmp_path):
    stream = feed([(1, i, i, "a", i) for i in range(5)] + [(2, 9, 0, "b", 1)], [(1, 7, 100, "a", 1)])
    live.notify(stream, str(tmp_path / "n"), str(tmp_path / "c"), 3)
    sent = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "n" / "payloads"))
    lost = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "n" / "dropped"))
    assert sorted(r["e"] for r in sent.select(F.get_json_object("payload", "$.event_id").cast("int").alias("e")).collect()) == [0, 1, 2, 7, 9] and [tuple(r) for r in lost.collect()] == [(1, 2)]


def test_repeats_within_the_watermark_count_once(spark, feed, tmp_path):
    rows = [(1, 1, 0, "a", 1), (1, 2, 10, "a", 5), (1, 3, 30, "a", 2), (2, 1, 5, "a", 1), (1, 9, 500, "a", 3)]
    stream = feed(rows[:3], [rows[1], rows[0], rows[3]], [rows[4], rows[2], rows[1]], [(3, 7, 900_000, "a", 1)], [(3, 8, 900_001, "a", 1)])
    got = run(spark, live.near_duplicates(stream, "60 seconds"), tmp_path).collect()
    batch = spark.createDataFrame([(u, e, s * 1_000_000, k, float(v)) for u, e, s, k, v in rows + rows], "session_id long, event_id long, t long, event_type string, confidence double").dropDuplicates()
    twin = batch.withColumns({"end": F.lit(None).cast("long"), "status_rank": F.lit(0)})
    want = timeline.merge_near_duplicates(twin, ["session_id", "event_type"], 59_999_999).collect()
    assert sorted((r["session_id"], r["members"], r["value"]) for r in got if r["session_id"] != 3) == sorted((r["session_id"], r["members"], r["confidence"]) for r in want)


def test_nearest_matches_equal_batch(spark, feed, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(400), rng.choice("ab"), rng.randrange(5)) for i in range(90)]
    cut = [rows[:30], rows[30:60], rows[60:]]  # each batch within the watermark's hour of the others
    stream = feed(*cut, [(9, 900, 900_000, "a", 1), (9, 901, 900_000, "b", 1)], [(9, 902, 1_900_000, "a", 1), (9, 903, 1_900_000, "b", 1)], [(9, 904, 2_900_000, "a", 1), (9, 905, 2_900_000, "b", 1)])
    got = run(spark, live.nearest_matches(stream.where("event_type = 'a'"), stream.where("event_type = 'b'"), "10 seconds"), tmp_path).where("session_id < 9").collect()
    at = lambda k: [(u, e, s * 1_000_000, float(v)) for u, e, s, kind, v in rows if kind == k]
    anchors = spark.createDataFrame([(u, e, t) for u, e, t, _ in at("a")], "session_id long, a_id long, a_t long")
    want = timeline.nearest_match(anchors, spark.createDataFrame(at("b"), "session_id long, c_id long, c_t long, c_conf double"), 10_000_000).collect()
    assert sorted((r["a_id"], r["c_id"], r["gap"]) for r in got) == sorted((r["a_id"], r["c_id"], r["gap"]) for r in want)


END = [[(2, 99, 900_000, "p", 0)], [(2, 100, 900_001, "p", 0)], [(2, 101, 900_002, "p", 0)]]


def places(feed, *batches, late="1 hour"):
    return feed(*batches, *END, late=late).withColumns({"x": F.col("value"), "y": F.lit(0.0)})


def test_stream_recoveries_equal_batch(spark, feed, tmp_path):
    track = [0, 100, 400, 20, 21, 22, 23, 500, 900, 10, 300, 5, 400, 6, 390, 7, 380, 8, 370, 9, 10, 10, 10, 10]
    rows = [(1, i, i, "p", x) for i, x in enumerate(track)]
    limits = live.Run(calm_rows=3)
    got = run(spark, live.recoveries(places(feed, rows[:5], rows[5:8], rows[8:15], rows[15:]), limits), tmp_path).where("session_id = 1").collect()
    batch = spark.createDataFrame([(1, i, i * 1_000_000, float(x), 0.0) for i, x in enumerate(track)], "session_id long, id long, t long, x double, y double")
    path = spatial.trajectory(batch)
    found = spatial.teleports(path, 200.0, 80.0, most=5)
    want = [r["id"] for r in found.orderBy("t").collect()]
    assert [r["event_id"] for r in sorted(got, key=lambda r: r["at"]) if r["what"] == "recovered"] == want == [3, 9, 11, 13, 15]
    assert [r["event_id"] for r in got if r["what"] == "aborted"] == [17]  # the sixth
    after = {r["id"]: (r["settled"], r["settled_t"] / 1e6) for r in spatial.settle_after(found, path, 5.0, 3, 8_000_000).collect()}
    begin = BEGIN.replace(tzinfo=dt.timezone.utc).timestamp()
    assert {r["event_id"]: (r["what"] == "settled", r["at"] - begin) for r in got if r["what"] in ("settled", "timed_out")} == after


def test_rows_behind_decided_ones_are_left_out(spark, feed, tmp_path):
    rows = [(1, 1, 0, "p", 0), (1, 2, 10, "p", 300), (1, 3, 20, "p", 310)]
    got = run(spark, live.recoveries(places(feed, rows, [(1, 4, 15, "p", 1)], [(1, 5, 30, "p", 2)])), tmp_path).where("session_id = 1").collect()
    assert {(r["event_id"], r["what"]) for r in got} == {(5, "recovered"), (5, "timed_out")}


def test_waypoints_with_their_timers(spark, feed, tmp_path):
    limits = live.Run(waypoints=((200.0, 0.0), (400.0, 0.0), (600.0, 0.0)), reach=10.0, tries=2)
    rows = [(1, 1, 0, "p", 0), (1, 2, 5, "p", 195), (1, 3, 10, "p", 300), (1, 4, 50, "p", 405), (1, 5, 60, "p", 0), (1, 6, 61, "p", 200), (1, 7, 200, "p", 600)]
    begin = BEGIN.replace(tzinfo=dt.timezone.utc).timestamp()
    got = run(spark, live.recoveries(places(feed, rows[:3], rows[3:6], rows[6:]), limits), tmp_path).where("session_id = 1").collect()
    told = sorted((r["at"] - begin, r["event_id"], r["what"]) for r in got)
    assert told == [
        (5, 0, "reached"), (35, 1, "waypoint_tried_again"), (50, 1, "reached"), (60, 5, "recovered"), (61, 0, "reached"), (68, 5, "timed_out"),
        (91, 1, "waypoint_tried_again"), (121, 1, "waypoint_left_out"), (151, 2, "waypoint_tried_again"), (181, 2, "completed"), (181, 2, "waypoint_left_out"),
    ]


def test_idle_sessions_are_forgotten(spark, feed, tmp_path):
    limits = live.Run(idle=1000.0)
    late = [(1, 8, 950_000, "p", 500), (1, 9, 950_010, "p", 100)]  # a new first position: no recovery
    stream = feed([(1, 1, 0, "p", 0), (1, 2, 10, "p", 300)], [(2, 5, 900_000, "p", 0)], [(2, 6, 900_001, "p", 0)], late, [(2, 7, 990_000, "p", 0)]).withColumns({"x": F.col("value"), "y": F.lit(0.0)})
    assert run(spark, live.recoveries(stream, limits), tmp_path).where("session_id = 1").count() == 0
