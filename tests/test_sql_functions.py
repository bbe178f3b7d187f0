"""Functions called by name in SQL."""

from evtrace.plans.sql_functions import register_functions


def test_functions_by_name(spark):
    assert set(register_functions(spark)) >= {"clamp01", "angle_delta", "hash_distance", "stable_vote", "expand_action"}
    one = lambda sql: tuple(spark.sql(sql).first())
    assert one("SELECT clamp01(double('nan')), clamp01(2), clamp01(NULL), clamp01(0.25)") == (0.0, 1.0, 0.0, 0.25)
    assert one("SELECT angle_delta(350, 10), angle_delta(10, 350), hash_distance(5, 6), hash_distance(NULL, 1)") == (20.0, -20.0, 2, 999)
    rows = "VALUES (1, 7, 0.5D, 30L, 1L), (1, 9, 1D, 10L, 2L), (1, 9, 0D, 40L, 3L), (1, 7, 0.5D, 20L, 4L), (2, NULL, 1D, 1L, 5L) t(g, v, c, t, i)"
    got = {r["g"]: r["s"] for r in spark.sql(f"SELECT g, stable_vote(v, c, t, i) AS s FROM {rows} GROUP BY g").collect()}
    assert got == {1: "9:0.500000000000:2", 2: None}  # two votes each, 9 was seen first
    kinds = "VALUES ('key_press', 5L, NULL), ('mouse_click', 9L, 100L), ('mouse_move', 1L, NULL), (NULL, 3L, NULL) a(k, t, d)"
    told = spark.sql(f"SELECT e.* FROM {kinds}, LATERAL expand_action(k, t, CAST(d AS BIGINT)) e").collect()
    assert sorted(map(tuple, told)) == [(1, "mouse_move"), (5, "key_down"), (9, "mouse_down"), (35, "key_up"), (109, "mouse_up")]
