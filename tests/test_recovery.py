"""Hand-made sessions: what the search for an up segment notes and where it stops."""

from evtrace.operators.recovery import Recovery, recovery_events, recovery_summary

S = 1_000_000
SEGMENTS = "session_id long, id long, state string, start_t long, end_t long, confidence double, readings int"
SIGNALS = "session_id long, id long, t long, confidence double"
TOLD = SIGNALS + ", kind string"


def seg(i, state, a, b, conf=0.9, n=3, session=1):
    return (session, i, state, int(a * S), int(b * S), conf, n)


def search(spark, segments, signals=(), told=(), rules=Recovery()):
    make = spark.createDataFrame
    events, records = recovery_events(make(list(segments), SEGMENTS), make([(1, i, int(t * S), c) for i, t, c in signals], SIGNALS), make([(1, i, int(t * S), c, k) for i, t, c, k in told], TOLD), rules)
    return {r["down_id"]: r for r in events.collect()}, {r["id"]: r for r in records.collect()}


def test_the_first_of_two_claims_the_up_segment(spark):
    got, told = search(spark, [seg(1, "down", 0, 2), seg(2, "panel", 3, 4, 0.5), seg(3, "up", 5, 9)])
    assert set(got) == {1} and (got[1]["up_id"], got[1]["status"], got[1]["result"], got[1]["delay"]) == (3, "CONFIRMED", "DETECTED", 3 * S)
    # 0.35 (0.55 0.9 + 0.45) + 0.35 (0.55 0.9 + 0.30 + 0.15) + 0.15 (1 - 3 / 8 / 2)
    assert abs(got[1]["confidence"] - (0.35 * 0.945 + 0.35 * 0.945 + 0.15 * 0.8125)) < 1e-8
    assert {i: r["status"] for i, r in told.items()} == {1: "INFERRED", 2: "INFERRED"}


def test_notes_in_order_of_the_walk(spark):
    got, _ = search(spark, [seg(1, "down", 0, 1), seg(2, "unknown", 3.5, 3.6), seg(3, "overlay", 5, 5.2), seg(4, "up", 7, 7.1, 0.1, 1)])
    assert got[1]["notes"] == ["large_gap_before_candidate:1.400>1.200", "intermediate_state:overlay@5.000", "large_gap_before_candidate:1.800>1.200"]
    assert got[1]["result"] == "DETECTED_LOW_CONFIDENCE" and got[1]["sources"] == ["state_segments", "up_returned"]


def test_a_search_that_meets_the_end_is_not_a_miss(spark):
    got, _ = search(spark, [seg(1, "down", 0, 1, 0.0), seg(2, "overlay", 2, 3)])
    assert (got[1]["status"], got[1]["result"]) == ("UNCERTAIN", "UNOBSERVED_END") and got[1]["notes"] == ["intermediate_state:overlay@2.000", "no_later_segment"]


def test_a_late_segment_ends_the_search(spark):
    got, _ = search(spark, [seg(1, "down", 0, 1, 0.0), seg(2, "overlay", 9, 9.5), seg(3, "up", 9.0005, 20), seg(4, "down", 50, 51, 1.0), seg(5, "overlay", 70, 71), seg(6, "up", 72, 80)], [(9, 50, 1.0)])
    assert (got[1]["status"], got[1]["result"], got[1]["recovery_t"]) == ("MISSING", "MISSING", None)
    assert got[1]["notes"] == ["large_gap_before_candidate:8.000>1.200", "intermediate_state:overlay@9.000", "max_delay_exceeded:8.001>8.000"]
    assert (got[4]["status"], got[4]["result"]) == ("UNCERTAIN", "MISSING_OR_UNOBSERVED") and got[4]["notes"] == ["max_delay_exceeded:19.000>8.000"]


def test_short_segments_need_a_signal(spark):
    got, told = search(spark, [seg(1, "panel", 0, 0.2), seg(2, "panel", 10, 10.2), seg(3, "up", 11, 20)], [(7, 9.5, 0.2), (8, 10.9, 1.0), (9, 11.3, 1.0)])
    assert set(got) == {2} and got[2]["signal_id"] == 7  # 0.5 s less 0.02 is under 0.9 s less 0.1
    assert got[2]["notes"] == ["short_down_segment:0.200<0.500"] and "signal_crosscheck" in got[2]["sources"]
    assert (told[1]["status"], told[1]["notes"]) == ("FILTERED_SHORT_SEGMENT", ["short_down_segment:0.200<0.500", "not_promoted"])
    assert told[2]["status"] == "CONFIRMED" and told[2]["sources"] == ["state_segment", "signal_crosscheck"]


def test_state_events_lift_the_step(spark):
    segments = [seg(1, "down", 0, 1), seg(2, "up", 8, 9)]
    plain, _ = search(spark, segments)
    got, _ = search(spark, segments, told=[(5, 0.5, 0.9, "down"), (6, 8.4, 0.95, "up"), (7, 8.5, 1.0, "up")])
    assert got[1]["state_event_id"] == 6 and abs(got[1]["confidence"] - plain[1]["confidence"] - 0.15 * (0.95 - (1 - 7 / 8 / 2))) < 1e-8
    assert search(spark, segments, told=[(5, 0.5, 0.9, "down")])[0][1]["state_event_id"] == 5


def test_sessions_apart_ties_and_empty_tables(spark):
    rows = [seg(1, "down", 0, 1), seg(2, "up", 1, 2), seg(3, "up", 1, 2), seg(4, "down", 0, 1, None, session=2), seg(5, "up", 30 * 86400, 30 * 86400 + 5)]
    got, told = search(spark, rows)
    assert got[1]["up_id"] == 2 and got[4]["result"] == "UNOBSERVED_END" and told[4]["confidence"] == 0.0
    make = spark.createDataFrame
    events, records = recovery_events(make(rows, SEGMENTS), make([], SIGNALS), make([], TOLD))
    summed = {r["session_id"]: tuple(r)[1:] for r in recovery_summary(make([(1,), (2,), (3,)], "session_id long"), events, records).collect()}
    assert summed == {1: (1, 1, 0, 0, 0, 0, S), 2: (1, 0, 0, 0, 1, 0, None), 3: (0, 0, 0, 0, 0, None, None)}
    assert search(spark, []) == ({}, {})
