"""Scores, names, focus times, votes and groups by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from evtrace.functions import evidence, scalars as S
from evtrace.operators import lookups, order, rollups, series

S1 = 1_000_000


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ladders_hold_their_limits(spark):
    full = {c: F.lit(1.0) for c in ("edge_density", "contrast", "bright_ratio", "saturation_ratio", "text_like_density", "dark_ratio")}
    assert {n: value(spark, evidence.ladder(n, full)) for n in evidence.LADDERS} == pytest.approx({n: x[2] for n, x in evidence.LADDERS.items()})
    assert value(spark, evidence.ladder("panel", {"dark_ratio": F.lit(0.9)})) == 0.0  # darkness without detail is no panel
    assert value(spark, evidence.ladder("panel", {"dark_ratio": F.lit(0.9), "bright_ratio": F.lit(0.02)})) == pytest.approx(0.35 * 0.9 + 0.8 * 0.02)
    assert value(spark, evidence.ladder("aim", {"edge_density": F.lit(0.04), "contrast": F.lit(None).cast("double")})) == pytest.approx(0.225)
    x = F.lit(0.03)
    assert value(spark, evidence.panel_structure(x, x, F.lit(0.9), F.lit(60))) == pytest.approx(0.45 + 0.15 + 0.075 + 0.135)
    assert value(spark, evidence.panel_structure(x, x, F.lit(0.9), F.lit(70))) is None


def test_names_and_focus(spark):
    assert value(spark, S.normalize_name(F.lit("  bl--base gr "), ("BL", "GR"))) == "BL Base Gr"  # a code at the very end is no code
    long = lambda x: F.lit(x).cast("long")
    focus = lambda t, lo, hi, d, n: value(spark, S.focus_time(long(t), long(lo), long(hi), F.lit(d).cast("double"), long(n)))
    assert focus(7, 1, 9, 5, 1) == 7 and focus(None, 2, 9, None, None) == 5.5 and focus(None, None, 9, None, 3) == 9
    assert focus(None, None, None, 100 * S1, 6) == 34 * S1 and focus(None, None, None, S1 / 2, 6) == S1 and focus(None, None, None, None, 2) == 8 * S1


def test_unlike_names_have_no_entry(spark):
    q = spark.createDataFrame([(1, "zzz", 0.9), (2, "alpha", None)], "q_id long, name string, confidence double")
    got = {r["q_id"]: (r["entry"], r["score"], r["confidence"], r["status"]) for r in lookups.fuzzy_match(q, spark.createDataFrame([("alpha",)], "entry string")).collect()}
    assert got == {1: (None, 0.0, 0.0, "low_match"), 2: ("alpha", 1.0, 0.0, "low_reading")}


HITS = "session_id long, kind string, id long, t long, confidence double, side string, side_conf double"


def test_votes_of_a_group(spark):
    hits = [(1, "feed", 1, 0, 0.5, "left", 0.4), (1, "feed", 2, S1, 0.6, "right", 0.4), (1, "feed", 3, S1, 0.4, None, 0.9), (1, "feed", 4, 100 * S1, 0.7, "left", 0.1), (1, "other", 5, 0, 0.3, "left", 1.0), (1, "feed", 6, 200 * S1, 0.8, None, None)]
    changes = spark.createDataFrame([(1, 50, 100 * S1, None)], "session_id long, c_id long, c_t long, c_conf double")
    got = {r["id"]: r for r in series.primary_events(spark.createDataFrame(hits, HITS), changes, ["feed"], 2 * S1, 0.2, S1).collect()}
    assert set(got) == {2, 4, 5, 6}
    assert (got[2]["side"], got[2]["side_votes"], got[2]["side_id"], got[2]["frames"]) == ("left", 1, 1, 3)  # equal sums: the first seen
    assert got[2]["status"] == "UNCERTAIN" and got[2]["t"] == round((S1 * 0.6 + S1 * 0.4) / 1.5)
    assert (got[4]["c_id"], got[4]["confidence"], got[4]["status"], got[4]["sources"]) == (50, pytest.approx(0.7), "CONFIRMED", ["feed", "change_crosscheck"])
    assert got[5]["supporting"] and got[5]["side"] is None and got[5]["status"] == "UNCERTAIN" and got[6]["status"] == "INFERRED"


def test_peaks_pass_all_thresholds(spark):
    rows = [(1, 1, 0, 0.9, 5), (1, 2, S1, 0.9, 6), (1, 3, 2 * S1, 0.95, 9), (1, 4, 3 * S1, 0.5, 1), (1, 5, 50 * S1, 0.8, 1), (1, 6, 51 * S1, None, 1)]
    df = spark.createDataFrame(rows, "session_id long, id long, t long, score double, display int")
    got = sorted(tuple(r) for r in series.peak_groups(df, ["session_id"], 2 * S1, "score", {"score": 0.6}, {"display": 7}).collect())
    assert got == [(1, 1, 0, 0.9, 5, 0, S1, 2), (1, 5, 50 * S1, 0.8, 1, 50 * S1, 50 * S1, 1)]


def test_numbers_over_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.col("id"))
    got = order.numbered(df.repartition(7), F.desc("x"), "id").collect()
    assert [r["number"] for r in sorted(got, key=lambda r: (-r["x"], r["id"]))] == list(range(1, 5001))
    assert order.numbered(df.limit(0), "x").count() == 0


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "session_id long, status string, result string, verdict string, event_type string")
    assert rollups.location_summary(none, none).count() == rollups.evidence_summary(none, none).count() == rollups.status_counts(none, "event_type").count() == 0
    assert tuple(rollups.run_summary(none, none).first()) == (0,) * 8
