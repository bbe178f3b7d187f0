"""Reports, recordings, listings, lineage and what is written, over small files."""

import json

from pyspark.sql import functions as F, types as T

from evtrace.operators import actions, rollups
from evtrace.plans import settle, views
from evtrace.sources import reports

SCHEMA = T.StructType([T.StructField("rows", T.ArrayType(T.StructType([T.StructField("event_id", T.LongType()), T.StructField("time", T.DoubleType()), T.StructField("result", T.StringType())])))])


def test_reports_keep_empty_ones(spark, tmp_path):
    for name, rows in (("s1", [{"event_id": 1, "time": 0.5, "result": "pass"}, {"event_id": 2}]), ("s2", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(json.dumps({"rows": rows}))
    got = reports.read_reports(spark, str(tmp_path), SCHEMA, "rows")
    assert sorted((r["session_id"], r["event_id"]) for r in got.where("event_id is not null").collect()) == [("s1", 1), ("s1", 2)]
    assert got.where("session_id = 's2' and event_id is null").count() == 1
    told = {r["event_id"]: r for r in reports.normalize_events(got.where("event_id is not null")).collect()}
    assert (told[1]["t"], told[1]["status"], told[2]["t"], told[2]["status"], told[2]["confidence"]) == (500_000, "PASS", None, "UNKNOWN", 0.0)


def test_names_of_time_and_confidence_in_their_order(spark):
    raw = spark.createDataFrame([("s", 1, None, 2.0, 3.0, "0.4", "nan"), ("s", 2, 1.0, 2.0, None, None, "7")], "session_id string, event_id long, time double, start_time double, respawn_time double, final_spawn_score string, top_confidence string")
    got = {r["event_id"]: (r["t"], r["end_t"], r["confidence"]) for r in reports.normalize_events(raw).collect()}
    assert got == {1: (2_000_000, 3_000_000, 0.4), 2: (1_000_000, None, 1.0)}


def test_listing_lineage_and_markdown(spark, tmp_path):
    for n in ("b one.mp4", "a.mp4", "c.txt"):
        (tmp_path / n).write_text(n)
    got = reports.list_sessions(spark, str(tmp_path), "mp4").orderBy("path").collect()
    assert [r["session_id"] for r in got] == ["session_0001_a", "session_0002_b_one"]
    a = spark.createDataFrame([("x", b"1"), ("y", b"2")], "path string, content binary")
    one, two = reports.lineage(a).first()[0], reports.lineage(a.orderBy(F.desc("path"))).first()[0]
    assert one == two and len(one) == 64 and one != reports.lineage(a.withColumn("content", F.lit(b"3"))).first()[0]
    rows = spark.createDataFrame([("s", 2, "a|b"), ("s", 1, None), ("t", 5, "z")], "session_id string, n int, note string")
    lines = reports.markdown(rows, "Checks", ["n", "note"], ["n"]).orderBy("session_id", "line_no").collect()
    assert [r["line"] for r in lines if r["session_id"] == "s"] == ["# Checks: 2", "| n | note |", "|-|-|", "| 1 |  |", "| 2 | a\\|b |"]
    reports.write_markdown(reports.markdown(rows, "Checks", ["n", "note"], ["n"]), str(tmp_path / "md"))
    text = "".join(f.read_text() for f in (tmp_path / "md" / "session_id=s").glob("*.txt"))
    assert text.startswith("# Checks: 2\n| n | note |")
    reports.write_tables({"checks": rows}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "checks")).count() == 3


def test_legacy_rows_start_behind_the_last_known_time(spark):
    rows = [("s", 0, None, None, 7, None), ("s", 1, 5.0, None, None, "key_down"), ("s", 2, None, None, 10, None), ("s", 3, None, None, 5, None), ("s", 250_000, None, None, 1, None), ("s", 250_001, None, 9.0, 3, None), ("s", 250_002, None, None, None, None), ("t", 0, None, None, None, None)]
    raw = spark.createDataFrame([(*r, "keyboard", "up", 1) for r in rows], "session_id string, seq long, t double, time double, delay_ms long, type string, kind string, action string, code int")
    got = [(r["session_id"], r["t_ms"]) for r in actions.normalize_actions(raw).orderBy("session_id", "seq").collect()]
    assert got == [("s", 7), ("s", 5000), ("s", 5010), ("s", 5015), ("s", 5016), ("s", 9000), ("s", 9000), ("t", 0)]


def test_actions_across_chunks(spark):
    raw = spark.createDataFrame([("s", i * 60_000, None, None, 10, None, "keyboard", "down", i) for i in range(5)], "session_id string, seq long, t double, time double, delay_ms long, type string, kind string, action string, code int")
    assert [r["t_ms"] for r in actions.normalize_actions(raw).orderBy("seq").collect()] == [10, 20, 30, 40, 50]
    log = spark.createDataFrame([("s", t, "key_down", 1) for t in (0, 700_000, 5_000_000)], "session_id string, t_ms long, kind string, code int")
    assert [(r["run"], r["t_ms"], r["index"]) for r in actions.repeat_scenario(log, 2).orderBy("index").collect()] == [(0, 0, 1), (0, 700_000, 2), (0, 5_000_000, 3), (1, 0, 4), (1, 700_000, 5), (1, 5_000_000, 6)]
    assert actions.repeat_scenario(log, 0).count() == 3


def test_verdicts_without_subjects(spark):
    none = spark.createDataFrame([], "session_id long, rule string, result string, confidence double, findings long")
    row = rollups.dataset_verdict(rollups.session_verdicts(none, ["session_id"])).first()
    assert (row["verdict"], row["subjects"], row["fail"]) == ("UNKNOWN", 0, 0)


def test_views_for_sql_and_settled_tables(spark):
    assert "t_session_events" in views.register(spark, "/root/testdata/sf0.001", "t_")
    n = spark.sql("select count(*) from t_session_events e join t_customer c on e.session_id = c.c_custkey").first()[0]
    assert n > 0
    table = settle.settle(spark.range(5).toDF("x"))
    assert table.count() == 5
    settle.discard(table)
