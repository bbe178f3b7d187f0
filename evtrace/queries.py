"""Registered queries of the timeline operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .functions import evidence, scalars as S
from .operators.order import numbered
from .operators import actions as A, checks as C, incidents as I, lookups as L, recovery, rollups as R, rules, series, spatial, timeline as T
from .plans import views as V
from .plans.settle import settle
from .plans.sql_functions import register_functions
from .plans.views import HOUR
from .sources import reports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _sides(ev, a: str, b: str):
    """Anchors and candidates of two event types."""
    left = ev.where(F.col("event_type") == a).select("session_id", F.col("event_id").alias("a_id"), F.col("t").alias("a_t"), F.col("side").alias("a_side"))
    right = ev.where(F.col("event_type") == b).select("session_id", F.col("event_id").alias("c_id"), F.col("t").alias("c_t"), F.col("confidence").alias("c_conf"), F.col("side").alias("c_side"))
    return left, right


#: Rounding half up of num / (den * 10^9), whole numbers both: the same in every engine.
_PPM = "((2 * ({num}) + ({den}) * 1000) // (2000 * ({den}))) / 1e6"
_NANO = "round(({c}) * 1e9)::HUGEINT"


def _mean_sql(c: str) -> str:
    """Mean of c over a group, rounded to six places."""
    return _PPM.format(num=f"sum({_NANO.format(c=c)})::HUGEINT", den="count(*)::HUGEINT")


def _half_even_sql(num: str, den: str) -> str:
    """Whole num / den, den above 0, rounded half to even."""
    size = f"abs({num})"
    up = f"2 * ({size} % {den}) > {den} OR 2 * ({size} % {den}) = {den} AND ({size} // {den}) % 2 = 1"
    return f"(sign({num}) * ({size} // {den} + CASE WHEN {up} THEN 1 ELSE 0 END))::BIGINT"


def _sec(micros: str) -> str:
    """Microseconds as text in seconds."""
    return f"printf('%d.%03d', (({micros}) + 500) // 1000 // 1000, (({micros}) + 500) // 1000 % 1000)"


def _joined(df, *lists):
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


_STATUS = "CASE WHEN event_type = 'purchase' THEN 5 WHEN event_type = 'click' THEN 3 WHEN event_type = 'error' THEN 1 ELSE 0 END"


def _with_status(ev):
    return ev.withColumn("status", F.when(F.col("event_type") == "purchase", "CONFIRMED").when(F.col("event_type") == "click", "OBSERVED").when(F.col("event_type") == "error", "FAIL").otherwise("UNKNOWN"))


@query("WITH" + V.SQL_EVENTS + """
SELECT event_id, session_id, t, round(confidence, 6) AS confidence, CASE WHEN event_type = 'error' THEN 'down' WHEN event_type = 'purchase' AND value > 200 THEN 'primary' WHEN event_type IN ('view', 'click') THEN 'signal' ELSE 'other' END AS event_class
FROM ev""")
def classified_events(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    kind = S.classify(F.col("event_type"), [(F.col("event_type") == "error", "down"), ((F.col("event_type") == "purchase") & (F.col("value") > 200), "primary"), (F.col("event_type").isin("view", "click"), "signal")])
    return ev.select("event_id", "session_id", "t", F.round(S.clamp01(F.col("confidence")), 6).alias("confidence"), kind.alias("event_class"))


@query("WITH" + V.SQL_EVENTS + " SELECT event_id, k, round(k / 10.0, 6) AS ts_sec FROM ev WHERE k % 3 = 0")
def sampled_rows(spark, sf_dir):
    step = max(1, round(30 / 10))
    return V.events(spark, sf_dir).where(F.col("k") % step == 0).select("event_id", "k", F.round(F.col("k") / 10.0, 6).alias("ts_sec"))


_CHAINS = V.SQL_EVENTS + f""",
s AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY session_id, event_type ORDER BY t, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, event_type ORDER BY t, event_id) AS grp FROM s),
f AS (SELECT *, min(t) OVER (PARTITION BY session_id, event_type, grp) AS t0, {_STATUS} AS status_rank FROM g)"""


@query("WITH" + _CHAINS + """
SELECT session_id, event_type, min(t0) + floor(avg(t - t0))::BIGINT AS mean_t, max(t) AS end_t, round(max(confidence), 6) AS confidence, max(status_rank)::INTEGER AS status_rank,
  first(event_id ORDER BY confidence DESC, t - t0, event_id) AS best_id, count(*) AS members
FROM f GROUP BY session_id, event_type, grp""")
def near_duplicates(spark, sf_dir):
    ev = _with_status(V.events(spark, sf_dir)).withColumns({"end": F.lit(None).cast("long"), "status_rank": S.status_rank(F.col("status"))})
    out = T.merge_near_duplicates(ev, ["session_id", "event_type"], 6 * HOUR)
    return out.select("session_id", "event_type", "mean_t", "end_t", F.round("confidence", 6).alias("confidence"), "status_rank", "best_id", "members")


@query("WITH" + V.SQL_EVENTS + f""",
s AS (SELECT *, [source, 'feed'] AS sources, list_filter([CASE WHEN k % 5 = 0 THEN 'fifth' END, CASE WHEN k > 70 THEN 'high' END, 'a_' || side], lambda x: x IS NOT NULL) AS notes, CASE WHEN t - lag(t) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY session_id, source, event_type ORDER BY t, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, source, event_type ORDER BY t, event_id) AS grp FROM s),
m AS (SELECT session_id, source, event_type, min(t) AS start_t, count(*) AS members, any_value(sources) AS one_s, any_value(notes) AS one_n, list_sort(list_distinct(flatten(list(sources)))) AS all_s, list_sort(list_distinct(flatten(list(notes)))) AS all_n FROM g GROUP BY session_id, source, event_type, grp)
SELECT session_id, source, event_type, start_t, members, array_to_string(CASE WHEN members = 1 THEN one_s ELSE all_s END, ',') AS sources, array_to_string(CASE WHEN members = 1 THEN one_n ELSE list_append(all_n, 'deduplicated:' || members) END, ',') AS notes FROM m""")
def merged_events(spark, sf_dir):
    """Chains of events of one source and type with the sources and notes of all their members."""
    k = F.col("k")
    notes = F.array_compact(F.array(F.when(k % 5 == 0, "fifth"), F.when(k > 70, "high"), F.concat(F.lit("a_"), "side")))
    ev = V.events(spark, sf_dir).withColumns({"end": F.lit(None).cast("long"), "status_rank": F.lit(0), "sources": F.array("source", F.lit("feed")), "notes": notes})
    out = T.merge_near_duplicates(ev, ["session_id", "source", "event_type"], 6 * HOUR)
    return _joined(out.select("session_id", "source", "event_type", F.col("island.t").alias("start_t"), "members", "sources", "notes"), "sources", "notes")


@query("WITH" + V.SQL_EVENTS + """
SELECT c.c_custkey AS session_id, count(event_id) AS events, count(DISTINCT event_type) AS types, min(t) AS first_t, max(t) AS last_t, coalesce(""" + _PPM.format(num="sum(" + _NANO.format(c="confidence") + ")", den="nullif(count(confidence), 0)::HUGEINT") + """, 0) AS mean_confidence
FROM customer c LEFT JOIN ev ON ev.session_id = c.c_custkey GROUP BY c.c_custkey""")
def timeline_counts(spark, sf_dir):
    sessions = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("session_id"))
    return R.timeline_summary(sessions, V.events(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


def _pairs_sql(a: str, b: str, hours: int) -> str:
    return V.SQL_EVENTS + f""",
p AS (
  SELECT a.session_id, a.event_id AS a_id, a.t AS a_t, a.side AS a_side, c.event_id AS c_id, c.t AS c_t, c.confidence AS c_conf, c.side AS c_side, abs(c.t - a.t) AS gap
  FROM ev a JOIN ev c ON a.session_id = c.session_id AND a.event_type = '{a}' AND c.event_type = '{b}' AND c.t BETWEEN a.t - {hours * HOUR} AND a.t + {hours * HOUR})"""


@query("WITH" + _pairs_sql("click", "purchase", 6) + """,
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY gap, c_conf DESC, c_t, c_id) = 1)
SELECT ev.session_id, ev.event_id AS a_id, m.c_id, m.gap FROM ev LEFT JOIN m ON m.a_id = ev.event_id WHERE event_type = 'click'""")
def nearest_pairs(spark, sf_dir):
    return T.nearest_match(*_sides(V.events(spark, sf_dir), "click", "purchase"), 6 * HOUR).select("session_id", "a_id", "c_id", "gap")


@query("WITH" + _pairs_sql("click", "purchase", 6) + " SELECT ev.event_id AS c_id, ev.session_id FROM ev WHERE event_type = 'purchase' AND event_id NOT IN (SELECT c_id FROM p)")
def unmatched_signals(spark, sf_dir):
    left, right = _sides(V.events(spark, sf_dir), "click", "purchase")
    used = T.range_pairs(left, right, ["session_id"], 6 * HOUR, 6 * HOUR, "a_t", "c_t").select("c_id").distinct()
    return right.join(used.hint("shuffle_merge"), "c_id", "left_anti").select("c_id", "session_id")


def _greedy_sql(tier: str) -> str:
    return "WITH RECURSIVE" + _pairs_sql("click", "purchase", 6) + f""",
q AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY a_t, a_id) AS n, {tier} AS tier FROM p),
w AS (SELECT session_id, n, any_value(a_id) AS a_id, list({{'c_id': c_id, 'gap': gap, 'tier': tier}} ORDER BY tier, gap, c_conf DESC, c_t, c_id) AS wants FROM q GROUP BY session_id, n),
r AS (
  SELECT session_id, 0 AS n, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS a_id, NULL::BIGINT AS c_id, NULL::BIGINT AS gap, NULL::INTEGER AS tier FROM (SELECT DISTINCT session_id FROM w)
  UNION ALL
  SELECT w.session_id, w.n::INTEGER, CASE WHEN f IS NULL THEN r.used ELSE list_append(r.used, f.c_id) END, w.a_id, f.c_id, f.gap, f.tier
  FROM r JOIN w ON w.session_id = r.session_id AND w.n = r.n + 1, LATERAL (SELECT list_filter(w.wants, lambda x: NOT list_contains(r.used, x.c_id))[1] AS f))
SELECT session_id, a_id, c_id, gap{", tier" if tier != "0" else ""} FROM r WHERE c_id IS NOT NULL"""


@query(_greedy_sql("0"))
def greedy_pairs(spark, sf_dir):
    return T.greedy_match(*_sides(V.events(spark, sf_dir), "click", "purchase"), 6 * HOUR).select("session_id", "a_id", "c_id", "gap")


@query(_greedy_sql("CASE WHEN a_side = c_side THEN 0 ELSE 1 END"))
def greedy_pairs_by_side(spark, sf_dir):
    return T.greedy_match(*_sides(V.events(spark, sf_dir), "click", "purchase"), 6 * HOUR, prefer="side").select("session_id", "a_id", "c_id", "gap", "tier")


@query("WITH" + _pairs_sql("error", "view", 12) + """
SELECT a_id, c_id, n FROM (SELECT a_id, c_id, row_number() OVER (PARTITION BY a_id ORDER BY c_t, c_id) AS n FROM p) WHERE n <= 3""")
def mined_windows(spark, sf_dir):
    left, right = _sides(V.events(spark, sf_dir), "error", "view")
    pairs = T.range_pairs(left, right, ["session_id"], 12 * HOUR, 12 * HOUR, "a_t", "c_t")
    return R.top_per_group(pairs, ["a_id"], ["c_t", "c_id"], 3).select("a_id", "c_id", F.col("rank").cast("long").alias("n"))


@query("WITH" + V.SQL_EVENTS + f""",
p AS (SELECT a.session_id, a.event_id AS a_id, c.event_id AS c_id, c.t AS c_t, a.t AS a_t, floor(c.value / 25)::BIGINT AS v FROM ev a JOIN ev c ON a.session_id = c.session_id AND a.event_type = 'error' AND c.event_type = 'view' AND c.t BETWEEN a.t - {24 * HOUR} AND a.t + {24 * HOUR})
SELECT session_id, a_id, arg_max(v, (c_t, c_id)) FILTER (c_t <= a_t) AS before, arg_min(v, (c_t, c_id)) FILTER (c_t >= a_t) AS after
FROM p GROUP BY session_id, a_id HAVING before IS NOT NULL AND after IS NOT NULL AND after > before""")
def before_after(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    moments, _ = _sides(ev, "error", "view")
    points = ev.where("event_type = 'view'").select("session_id", F.col("event_id").alias("c_id"), F.col("t").alias("c_t"), F.floor(F.col("value") / 25).alias("c_value"))
    return T.before_after(points, moments, 24 * HOUR).where("after > before").select("session_id", "a_id", "before", "after")


@query("WITH" + V.SQL_EVENTS + f""",
p AS (SELECT a.event_id AS a_id, a.t AS a_t, c.event_id AS c_id, c.t AS c_t FROM ev a JOIN ev c ON a.session_id = c.session_id AND a.event_type = 'error' AND c.event_type = 'view' AND c.t > a.t AND c.t <= a.t + {72 * HOUR}),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY c_t, c_id) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY a_t, a_id) = 1 AS claims FROM b)
SELECT ev.session_id, ev.event_id AS a_id, f.c_id, f.c_t - ev.t AS delay, coalesce(claims, false) AS claims FROM ev LEFT JOIN f ON f.a_id = ev.event_id WHERE event_type = 'error'""")
def recoveries(spark, sf_dir):
    left, right = _sides(V.events(spark, sf_dir), "error", "view")
    out = T.first_later_match(left, right.drop("c_conf", "c_side"), 72 * HOUR)
    return out.select("session_id", "a_id", "c_id", (F.col("c_t") - F.col("a_t")).alias("delay"), "claims")


@query("WITH" + V.SQL_READINGS + f""",
m AS (SELECT event_id AS a_id, session_id, side, t, confidence FROM ev WHERE event_type = 'click'),
p AS (SELECT m.a_id, m.session_id, m.side, m.t AS a_t, m.confidence AS a_conf, rd.t, rd.id, rd.value, rd.confidence FROM m JOIN rd ON rd.session_id = m.session_id AND rd.channel = m.side AND rd.confidence >= 0.3 AND rd.t BETWEEN m.t - {24 * HOUR} AND m.t + {24 * HOUR}),
b AS (SELECT * FROM p WHERE t <= a_t QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY t DESC, confidence DESC, id) = 1),
f AS (SELECT * FROM p WHERE t >= a_t QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY t, confidence DESC, id) = 1),
x AS (
  SELECT b.session_id, b.side, b.a_id, b.a_t, f.t, b.t AS bt, b.value AS from_value, f.value AS to_value, least(1.0, 0.45 * b.confidence + 0.45 * f.confidence + 0.10 * CASE WHEN coalesce(b.a_conf, 0) = 0 THEN 0.7 ELSE b.a_conf END) AS confidence
  FROM b JOIN f USING (a_id) WHERE f.value > b.value QUALIFY row_number() OVER (PARTITION BY b.session_id, b.side, round_even(f.t / 10000, 0) ORDER BY b.a_t, b.a_id) = 1)
SELECT session_id, side, a_id, t, from_value, to_value, round(confidence, 9) AS confidence, CASE WHEN to_value - from_value <= 1 THEN 'CONFIRMED' ELSE 'NEED_REVIEW' END AS status,
  concat_ws(',', 'expected_side:' || side, 'anchored_before:' || {_sec("bt")}, 'anchored_after:' || {_sec("t")}, CASE WHEN to_value - from_value > 1 THEN 'abnormal_jump:' || (to_value - from_value) END) AS notes FROM x""")
def anchored_changes(spark, sf_dir):
    points = V.readings(spark, sf_dir).where("confidence >= 0.3").withColumnRenamed("channel", "side")
    moments = V.events(spark, sf_dir).where("event_type = 'click'").select("session_id", F.col("event_id").alias("id"), "t", "side", "confidence")
    out = series.anchored_changes(points, moments, 24 * HOUR, 1)
    return _joined(out.withColumn("confidence", F.round("confidence", 9)), "notes")


@query("WITH" + V.SQL_READINGS + f""",
g AS (SELECT a.session_id, a.id, a.t, c.channel FROM rd a JOIN (SELECT DISTINCT session_id, channel FROM rd) c USING (session_id)),
p AS (SELECT a.id, a.channel, c.value, c.confidence, c.t, c.id AS c_id FROM g a JOIN rd c ON a.session_id = c.session_id AND a.channel = c.channel AND c.t BETWEEN a.t - {12 * HOUR} AND a.t + {12 * HOUR} AND c.confidence >= 0.3),
v AS (SELECT id, channel, value, count(*) AS votes, avg(confidence) AS m, min((t, c_id)) AS seen FROM p GROUP BY ALL),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id, channel ORDER BY votes DESC, seen) = 1)
SELECT g.session_id, g.channel, g.id, g.t, b.value, coalesce(votes, 0) AS votes, round(coalesce(m * least(1.0, votes / 2.0), 0), 6) AS confidence, CASE WHEN b.id IS NULL THEN 'no_valid_reading' WHEN votes < 2 THEN 'weak_votes' ELSE 'stable' END AS status
FROM g LEFT JOIN b USING (id, channel)""")
def stable_series(spark, sf_dir):
    return series.stable_series(V.readings(spark, sf_dir), 24 * HOUR, 0.3, 2).withColumn("confidence", F.round("confidence", 6))


@query("WITH" + V.SQL_STATES + f""",
p AS (SELECT a.id, c.state, sum(c.score) AS s FROM st a JOIN st c ON a.session_id = c.session_id AND c.t BETWEEN a.t - {12 * HOUR} AND a.t + {12 * HOUR} AND c.score >= 0.7 * 0.8 GROUP BY 1, 2),
b AS (SELECT *, sum(s) OVER (PARTITION BY id) AS total FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, CASE state WHEN 'down' THEN 2 WHEN 'up' THEN 1 ELSE 0 END DESC, state DESC) = 1)
SELECT st.session_id, st.id, st.t, coalesce(b.state, 'unknown') AS state, round(coalesce(s / total, 0), 6) AS confidence FROM st LEFT JOIN b USING (id)""")
def smoothed_states(spark, sf_dir):
    out = series.smooth_states(V.states(spark, sf_dir), 24 * HOUR, 0.8, {"down": 2, "up": 1, "overlay": 0})
    return out.withColumn("confidence", F.round("confidence", 6))


_SEGMENTS = V.SQL_STATES + """,
s1 AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY session_id ORDER BY t, id) THEN 0 ELSE 1 END AS fresh FROM st),
s2 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY t, id) AS g FROM s1),
seg AS (SELECT session_id, first(id ORDER BY t, id) AS id, any_value(state) AS state, min(t) AS start_t, max(t) AS end_t, count(*) AS readings, avg(score) AS confidence, sum(round(score * 1e9)::HUGEINT)::HUGEINT AS s9 FROM s2 GROUP BY session_id, g HAVING max(t) - min(t) >= 200000)"""


def _segments(spark, sf_dir):
    return series.state_segments(V.states(spark, sf_dir).withColumnRenamed("score", "confidence"), 200_000)


@query("WITH" + _SEGMENTS + " SELECT session_id, id, state, start_t, end_t, readings, " + _PPM.format(num="s9", den="readings::HUGEINT") + " AS confidence FROM seg")
def state_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("session_id", "id", "state", "start_t", "end_t", "readings", F.round("confidence", 6).alias("confidence"))


@query("WITH" + _SEGMENTS + """,
x AS (SELECT session_id, start_t AS t, state, confidence, readings AS n, s9, lag(state) OVER w AS p, lag(readings) OVER w AS pn, lag(s9) OVER w AS ps9 FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY start_t, id))
SELECT session_id, t, p || '_to_' || state AS event, """ + _PPM.format(num="s9 * pn + ps9 * n", den="2 * n::HUGEINT * pn") + """ AS confidence FROM x WHERE p <> state""")
def transitions(spark, sf_dir):
    return series.transitions(_segments(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("WITH RECURSIVE" + V.SQL_EVENTS + f""",
o AS (SELECT session_id, event_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS n FROM ev),
r AS (
  SELECT session_id, event_id, t, n, t AS kept, true AS keep FROM o WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.event_id, o.t, o.n, CASE WHEN o.t - r.kept >= {12 * HOUR} THEN o.t ELSE r.kept END, o.t - r.kept >= {12 * HOUR} FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1)
SELECT session_id, t, event_id FROM r WHERE keep""")
def throttled_rows(spark, sf_dir):
    return T.throttle(V.events(spark, sf_dir).select("session_id", "t", "event_id"), ["session_id"], 12 * HOUR)


_CHANGES = "WITH RECURSIVE" + V.SQL_READINGS + f""",
m AS (SELECT *, lag(value) OVER (PARTITION BY session_id, channel ORDER BY t, id) AS p FROM rd WHERE confidence >= 0.25),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel ORDER BY t, id) AS n FROM m WHERE p IS NOT NULL AND p <> value),
r AS (
  SELECT session_id, channel, id, t, p, value, confidence, n, t AS kept, true AS keep FROM o WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.channel, o.id, o.t, o.p, o.value, o.confidence, o.n, CASE WHEN o.t - r.kept >= {12 * HOUR} THEN o.t ELSE r.kept END, o.t - r.kept >= {12 * HOUR} FROM r JOIN o ON o.session_id = r.session_id AND o.channel = r.channel AND o.n = r.n + 1),
ce AS (SELECT session_id, channel, id, t, p AS from_value, value AS to_value, confidence, CASE WHEN value <= p OR value - p > 1 THEN 'NEED_REVIEW' ELSE 'CONFIRMED' END AS status FROM r WHERE keep)"""


@query(_CHANGES + " SELECT session_id, channel, id, t, from_value, to_value, status FROM ce")
def change_events(spark, sf_dir):
    return series.change_events(V.readings(spark, sf_dir), 1, 12 * HOUR, 0.25).drop("confidence")


@query(_CHANGES + f""",
x AS (SELECT ce.id, s.event_id AS signal_id FROM ce JOIN ev s ON s.session_id = ce.session_id AND s.event_type = 'click' AND abs(s.t - ce.t) <= {6 * HOUR} AND (s.k % 10 = 0 OR s.side = ce.channel) QUALIFY row_number() OVER (PARTITION BY ce.id ORDER BY abs(s.t - ce.t), s.t, s.event_id) = 1)
SELECT session_id, channel, id, t, from_value, to_value, signal_id, round(CASE WHEN signal_id IS NULL THEN confidence ELSE least(1, confidence * 0.85 + 0.15) END, 6) AS confidence, CASE WHEN signal_id IS NULL AND status = 'CONFIRMED' THEN 'UNCERTAIN' ELSE status END AS status FROM ce LEFT JOIN x USING (id)""")
def checked_changes(spark, sf_dir):
    signals = V.events(spark, sf_dir).where("event_type = 'click'").select("session_id", F.col("event_id").alias("id"), "t", F.when(F.col("k") % 10 != 0, F.col("side")).alias("side"))
    return series.cross_checked(series.change_events(V.readings(spark, sf_dir), 1, 12 * HOUR, 0.25), signals, 6 * HOUR).withColumn("confidence", F.round("confidence", 6))


@query("WITH" + V.SQL_EVENTS + f""",
s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id, event_type ORDER BY t, event_id) <= {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM ev WHERE confidence >= 0.2),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, event_type ORDER BY t, event_id) AS grp FROM s)
SELECT session_id, event_type, min(t) AS start_t, max(t) AS end_t, count(*) AS hits, round(avg(confidence), 6) AS mean_conf, round(max(confidence), 6) AS best_conf, first(event_id ORDER BY confidence DESC, t, event_id) AS peak_id,
  CASE WHEN count(*) >= 2 THEN 'CONFIRMED' WHEN max(confidence) >= 0.75 THEN 'INFERRED' ELSE 'UNCERTAIN' END AS status
FROM g GROUP BY session_id, event_type, grp""")
def hit_groups(spark, sf_dir):
    hits = V.events(spark, sf_dir).withColumnRenamed("event_id", "id")
    out = series.hit_groups(hits, ["session_id", "event_type"], 12 * HOUR, 0.2)
    return out.select("session_id", "event_type", "start_t", "end_t", "hits", F.round("mean_conf", 6).alias("mean_conf"), F.round("best_conf", 6).alias("best_conf"), "peak_id", "status")


def _conf_sql(*parts: tuple[int, str]) -> str:
    """Weighted sum of confidences, weights in hundredths, rounded to six places."""
    return _PPM.format(num=" + ".join(f"{w} * coalesce({_NANO.format(c=c)}, 0)" for w, c in parts), den="100::HUGEINT")


_OWN = _conf_sql((100, "confidence"))
_SUPPORT = "greatest(coalesce(recovery_conf, 0), coalesce(state_conf, 0), confidence)"
_BACK = "coalesce(recovery_conf, confidence)"
_SCORE = "coalesce(location_score, 0)"
_TYPED = V.SQL_EVENTS + """,
inc AS (
  SELECT session_id, event_id AS incident_id, t, confidence, CASE event_type WHEN 'purchase' THEN 'primary' WHEN 'click' THEN 'candidate' WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'recovery' WHEN 1 THEN 'recovery_missing' ELSE 'down_only' END ELSE 'other' END AS incident_type,
    CASE WHEN k % 4 <> 0 THEN k / 100.0 END::DOUBLE AS signal_conf, CASE WHEN k % 5 <> 0 THEN confidence END AS change_conf, CASE WHEN k % 7 <> 0 THEN (k - 50)::BIGINT * 100000 END AS delay,
    CASE WHEN k % 3 = 0 THEN (99 - k) / 100.0 END::DOUBLE AS recovery_conf, CASE WHEN k % 2 = 0 THEN k / 100.0 END::DOUBLE AS state_conf,
    CASE k % 5 WHEN 1 THEN 'PASS' WHEN 2 THEN 'fail' WHEN 3 THEN 'UNCERTAIN' WHEN 4 THEN 'ODD' END AS location_result, confidence AS location_score
  FROM ev)"""
_RULES = _TYPED + f""",
cust AS (SELECT c_custkey AS session_id FROM customer),
counted AS (SELECT *, coalesce(signal_conf, 0) >= 0.45 AS has_signal, coalesce(change_conf, 0) >= 0.45 AS has_change FROM inc WHERE incident_type IN ('primary', 'candidate')),
down AS (SELECT *, coalesce(signal_conf, 0) >= 0.45 AS has_signal, upper(location_result) AS verdict FROM inc WHERE incident_type IN ('recovery', 'recovery_missing', 'down_only')),
every AS (
  SELECT session_id, incident_id, 'count' AS rule, CASE WHEN has_signal AND has_change THEN CASE WHEN delay IS NULL OR delay <= 2000000 THEN 'PASS' ELSE 'FAIL' END WHEN has_signal THEN 'FAIL' WHEN has_change THEN 'NEED_REVIEW' ELSE 'UNCERTAIN' END AS result,
    CASE WHEN has_signal AND has_change THEN {_conf_sql((50, "change_conf"), (30, "signal_conf"), (20, "confidence"))} WHEN has_signal THEN {_conf_sql((65, "signal_conf"), (35, "confidence"))} WHEN has_change THEN {_conf_sql((70, "change_conf"), (30, "confidence"))} ELSE {_OWN} END AS confidence,
    CASE WHEN has_signal AND has_change THEN CASE WHEN delay > 2000000 THEN 'change_delay_exceeded' ELSE '' END WHEN has_signal THEN 'missing_change' WHEN has_change THEN 'change_without_signal' ELSE 'weak_evidence' END AS note FROM counted
  UNION ALL SELECT session_id, incident_id, 'signal', CASE WHEN has_signal OR has_change THEN 'PASS' ELSE 'UNCERTAIN' END, CASE WHEN has_signal THEN {_conf_sql((65, "signal_conf"), (35, "confidence"))} WHEN has_change THEN {_conf_sql((65, "change_conf"), (35, "confidence"))} ELSE {_OWN} END,
    CASE WHEN has_signal THEN '' WHEN has_change THEN 'change_only_ignored' ELSE 'weak_signal' END FROM counted
  UNION ALL SELECT session_id, incident_id, 'signal', CASE WHEN has_signal OR {_SUPPORT} >= 0.45 THEN 'PASS' ELSE 'UNCERTAIN' END, CASE WHEN has_signal THEN {_conf_sql((65, "signal_conf"), (35, "confidence"))} ELSE {_conf_sql((100, _SUPPORT))} END,
    CASE WHEN has_signal THEN '' WHEN {_SUPPORT} >= 0.45 THEN 'missing_optional_signal' ELSE 'weak_signal' END FROM down
  UNION ALL SELECT session_id, incident_id, 'recovery', CASE WHEN incident_type = 'recovery_missing' THEN 'FAIL' WHEN incident_type = 'down_only' OR verdict IS NULL THEN 'UNCERTAIN' WHEN verdict = 'PASS' AND {_SCORE} >= 0.75 THEN 'PASS' WHEN verdict = 'FAIL' OR {_SCORE} <= 0.45 THEN 'FAIL' WHEN verdict IN ('UNCERTAIN', 'OBSERVED', 'UNKNOWN') THEN 'UNCERTAIN' ELSE 'NEED_REVIEW' END,
    CASE WHEN incident_type = 'recovery_missing' THEN {_conf_sql((100, f"greatest(confidence, {_BACK})"))} WHEN incident_type = 'down_only' OR verdict IS NULL THEN {_OWN} WHEN verdict = 'PASS' AND {_SCORE} >= 0.75 THEN {_conf_sql((75, _SCORE), (25, _BACK))}
      WHEN verdict = 'FAIL' OR {_SCORE} <= 0.45 THEN {_conf_sql((100, f"greatest({_SCORE}, confidence)"))} WHEN verdict IN ('UNCERTAIN', 'OBSERVED', 'UNKNOWN') THEN greatest({_conf_sql((100, _SCORE))}, {_conf_sql((50, "confidence"))}) ELSE {_conf_sql((100, f"greatest({_SCORE}, confidence)"))} END,
    CASE WHEN incident_type = 'recovery_missing' THEN 'missing_recovery' WHEN incident_type = 'down_only' THEN 'down_without_recovery' WHEN verdict IS NULL THEN 'missing_location_check' WHEN verdict = 'PASS' AND {_SCORE} >= 0.75 THEN '' WHEN verdict = 'FAIL' OR {_SCORE} <= 0.45 THEN 'location_mismatch_or_low_score' WHEN verdict IN ('UNCERTAIN', 'OBSERVED', 'UNKNOWN') THEN 'location_uncertain' ELSE 'unexpected_location_status' END FROM down
  UNION ALL SELECT session_id, NULL, 'count', 'UNCERTAIN', 0.0, 'no_incidents' FROM cust WHERE session_id NOT IN (SELECT session_id FROM counted)
  UNION ALL SELECT session_id, NULL, 'signal', 'UNCERTAIN', 0.0, 'no_incidents' FROM cust WHERE session_id NOT IN (SELECT session_id FROM counted UNION ALL SELECT session_id FROM down)
  UNION ALL SELECT session_id, NULL, 'recovery', 'PASS', 1.0, 'no_recovery_required' FROM cust WHERE session_id NOT IN (SELECT session_id FROM down)),
fi AS (SELECT * FROM every),
obs AS (
  SELECT session_id, rule, bool_or(result = 'FAIL') AS any_fail, bool_or(result = 'NEED_REVIEW') AS any_review, bool_or(result = 'UNCERTAIN') AS any_uncertain,
    max(confidence) FILTER (result = 'FAIL') AS f, max(confidence) FILTER (result = 'NEED_REVIEW') AS n, min(confidence) FILTER (result = 'PASS') AS p, count(*) AS findings,
    {_PPM.format(num="sum(round(confidence * 1e6)::HUGEINT * 1000) FILTER (result = 'UNCERTAIN')", den="nullif(count(*) FILTER (result = 'UNCERTAIN'), 0)::HUGEINT")} AS u
  FROM every WHERE session_id IN (SELECT session_id FROM cust) GROUP BY session_id, rule),
obj AS (SELECT session_id, rule, findings, CASE WHEN any_fail THEN 'FAIL' WHEN any_review THEN 'NEED_REVIEW' WHEN any_uncertain THEN 'UNCERTAIN' ELSE 'PASS' END AS result, CASE WHEN any_fail THEN f WHEN any_review THEN n WHEN any_uncertain THEN u ELSE p END AS confidence FROM obs)"""


def _incidents(spark, sf_dir):
    ev, kind, k, conf = V.events(spark, sf_dir), F.col("event_type"), F.col("k"), F.col("confidence")
    typed = F.when(kind == "purchase", "primary").when(kind == "click", "candidate").when(kind == "error", F.element_at(F.array(*map(F.lit, rules.DOWN)), k % 3 + 1)).otherwise("other")
    return ev.select(
        "session_id", F.col("event_id").alias("incident_id"), "t", "confidence", typed.alias("incident_type"), F.when(k % 4 != 0, k / 100).alias("signal_conf"), F.when(k % 5 != 0, conf).alias("change_conf"), F.when(k % 7 != 0, (k - 50).cast("long") * 100_000).alias("delay"),
        F.when(k % 3 == 0, (99 - k) / 100).alias("recovery_conf"), F.when(k % 2 == 0, k / 100).alias("state_conf"), F.when(k % 5 == 1, "PASS").when(k % 5 == 2, "fail").when(k % 5 == 3, "UNCERTAIN").when(k % 5 == 4, "ODD").alias("location_result"), conf.alias("location_score"),
    )


def _every_finding(spark, sf_dir):
    sessions = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("session_id"))
    return sessions, rules.findings(_incidents(spark, sf_dir), sessions).withColumn("confidence", F.round("confidence", 6))


def _findings(spark, sf_dir):
    sessions, found = _every_finding(spark, sf_dir)
    return sessions, found.drop("notes")


_SHOWN = " SELECT session_id, incident_id, result, confidence, note FROM every WHERE rule = '{}'"


def _by_rule(spark, sf_dir, rule):
    return _every_finding(spark, sf_dir)[1].where(F.col("rule") == rule).select("session_id", "incident_id", "result", "confidence", F.array_join("notes", ",").alias("note"))


@query("WITH" + _RULES + _SHOWN.format("count"))
def rule_count(spark, sf_dir):
    return _by_rule(spark, sf_dir, "count")


@query("WITH" + _RULES + _SHOWN.format("signal"))
def rule_signal(spark, sf_dir):
    return _by_rule(spark, sf_dir, "signal")


@query("WITH" + _RULES + _SHOWN.format("recovery"))
def rule_recovery(spark, sf_dir):
    return _by_rule(spark, sf_dir, "recovery")


def _three_objectives(spark, sf_dir):
    sessions, found = _every_finding(spark, sf_dir)
    subjects = sessions.select("session_id", F.explode(F.array(*map(F.lit, rules.RULES))).alias("rule"))
    return R.objective_rollup(subjects, found, ["session_id", "rule"]).withColumn("confidence", F.round("confidence", 6))


_VERDICTS = """,
ve AS (
  SELECT session_id, count(*) FILTER (result = 'FAIL') AS fail, count(*) FILTER (result = 'NEED_REVIEW') AS need_review, count(*) FILTER (result = 'UNCERTAIN') AS uncertain, count(*) FILTER (result = 'PASS') AS pass, sum(findings)::BIGINT AS findings,
    max(confidence) FILTER (result = 'FAIL') AS f, max(confidence) FILTER (result = 'NEED_REVIEW') AS n, min(confidence) AS p, """ + _PPM.format(num="sum(round(confidence * 1e6)::HUGEINT * 1000) FILTER (result = 'UNCERTAIN')", den="nullif(count(*) FILTER (result = 'UNCERTAIN'), 0)::HUGEINT") + """ AS u
  FROM obj GROUP BY session_id),
vd AS (SELECT session_id, fail, need_review, uncertain, pass, findings, CASE WHEN fail > 0 THEN 'FAIL' WHEN need_review > 0 THEN 'NEED_REVIEW' WHEN uncertain > 0 THEN 'UNCERTAIN' ELSE 'PASS' END AS verdict, CASE WHEN fail > 0 THEN f WHEN need_review > 0 THEN n WHEN uncertain > 0 THEN u ELSE p END AS confidence FROM ve)"""


@query("WITH" + _RULES + _VERDICTS + " SELECT * FROM vd")
def session_verdicts(spark, sf_dir):
    return R.session_verdicts(_three_objectives(spark, sf_dir), ["session_id"]).withColumn("confidence", F.round("confidence", 6))


@query("WITH" + _RULES + _VERDICTS + " SELECT CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'NEED_REVIEW') THEN 'NEED_REVIEW' WHEN bool_or(verdict = 'UNCERTAIN') THEN 'UNCERTAIN' ELSE 'PASS' END AS verdict, count(*) AS subjects, count(*) FILTER (verdict = 'FAIL') AS fail, count(*) FILTER (verdict = 'NEED_REVIEW') AS need_review, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (verdict = 'PASS') AS pass FROM vd")
def dataset_verdict(spark, sf_dir):
    return R.dataset_verdict(R.session_verdicts(_three_objectives(spark, sf_dir), ["session_id"]))


@query("WITH" + _RULES + " SELECT rule, note, count(*) AS findings FROM every WHERE result <> 'PASS' AND note <> '' GROUP BY rule, note")
def uncertainty_causes(spark, sf_dir):
    return R.uncertainty_causes(_every_finding(spark, sf_dir)[1], ["rule"])


@query("WITH" + _RULES + """,
tr AS (
  SELECT e.session_id, e.incident_id, e.rule, coalesce(change_conf, 0) AS cc, coalesce(signal_conf, 0) AS sc, coalesce(recovery_conf, i.confidence) AS rc, incident_type, e.result = 'PASS' AS passed FROM every e JOIN inc i USING (incident_id))
SELECT session_id, incident_id, rule, 'change_detected' AS condition, true AS expected, cc >= 0.45 AS observed, cc AS confidence, CASE WHEN cc >= 0.45 THEN 'satisfied' ELSE 'not_satisfied' END AS outcome, '' AS note FROM tr WHERE rule = 'count'
UNION ALL SELECT session_id, incident_id, rule, 'signal_detected', true, sc >= 0.45, sc, CASE WHEN sc >= 0.45 THEN 'satisfied' ELSE 'not_satisfied' END, '' FROM tr WHERE rule = 'count' OR rule = 'signal' AND incident_type = 'primary'
UNION ALL SELECT session_id, incident_id, rule, 'down_signal_detected', true, sc >= 0.45, sc, CASE WHEN sc >= 0.45 THEN 'satisfied' ELSE 'not_required' END, CASE WHEN sc >= 0.45 THEN '' ELSE 'optional' END FROM tr WHERE rule = 'signal' AND incident_type NOT IN ('primary', 'candidate')
UNION ALL SELECT session_id, incident_id, rule, 'recovery_detected', true, passed, rc, CASE WHEN passed THEN 'satisfied' ELSE 'not_satisfied' END, '' FROM tr WHERE rule = 'recovery'""")
def decision_traces(spark, sf_dir):
    facts = _incidents(spark, sf_dir).select("incident_id", "incident_type", "signal_conf", "change_conf", "recovery_conf", F.col("confidence").alias("own"))
    found = _every_finding(spark, sf_dir)[1].drop("confidence").join(facts.hint("shuffle_merge"), "incident_id").withColumnRenamed("own", "confidence")
    return rules.decision_trace(found).select("session_id", "incident_id", "rule", F.explode("trace").alias("x")).select("session_id", "incident_id", "rule", "x.condition", "x.expected", "x.observed", F.round("x.confidence", 6).alias("confidence"), F.col("x.result").alias("outcome"), "x.note")


@query("WITH" + _RULES + " SELECT session_id, rule, result, confidence, findings FROM obj")
def objectives(spark, sf_dir):
    return _three_objectives(spark, sf_dir)


@query("WITH" + _RULES + """
SELECT rule, c_mktsegment AS segment, count(*) AS checks, count(*) FILTER (result = 'FAIL') AS fail, count(*) FILTER (result = 'NEED_REVIEW') AS need_review, count(*) FILTER (result = 'UNCERTAIN') AS uncertain, count(*) FILTER (result = 'PASS') AS pass
FROM obj JOIN customer ON c_custkey = session_id GROUP BY GROUPING SETS ((rule), (c_mktsegment), ())""")
def dataset_summary(spark, sf_dir):
    segment = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("session_id"), F.col("c_mktsegment").alias("segment"))
    return R.result_matrix(_three_objectives(spark, sf_dir).join(segment.hint("shuffle_merge"), "session_id"), "rule", "segment")


_SEARCH = recovery.Recovery(least_down=HOUR // 2, least_up=HOUR // 2, most=72 * HOUR, gap=12 * HOUR, window=2 * HOUR)


#: Events as segments of several states, signals and state events; the search that the recoveries rest on, pair by pair.
_RECOVERY = V.SQL_EVENTS + f""",
sg AS (
  SELECT *, row_number() OVER w AS o, lag(e) OVER w AS pe FROM (
    SELECT session_id, event_id AS id, t AS s, t + k::BIGINT * 60000000 AS e, confidence, 1 + k % 3 AS readings,
      CASE event_type WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 'panel' ELSE 'down' END WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'recovered' ELSE 'up' END WHEN 'purchase' THEN 'overlay' ELSE 'unknown' END AS state
    FROM ev WHERE event_type <> 'click') WINDOW w AS (PARTITION BY session_id ORDER BY s, e, id)),
noted AS (
  SELECT *, list_filter([
    CASE WHEN state <> 'unknown' AND greatest(0, s - pe) > {12 * HOUR} THEN 'large_gap_before_candidate:' || {_sec("greatest(0, s - pe)")} || '>' || {_sec(str(12 * HOUR))} END,
    CASE WHEN state = 'overlay' THEN 'intermediate_state:' || state || '@' || {_sec("s")} END], lambda x: x IS NOT NULL) AS told FROM sg),
near AS (
  SELECT d.id, n.event_id AS s_id, n.confidence AS s_conf FROM sg d JOIN ev n ON n.session_id = d.session_id AND n.event_type = 'click' AND n.k % 2 = 0 AND n.t BETWEEN d.s - {2 * HOUR} AND d.e + {2 * HOUR}
  WHERE d.state IN ('panel', 'down') QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY abs(n.t - d.s) / 1e6 - 0.1 * n.confidence, n.t, n.event_id) = 1),
dn AS (SELECT sg.*, s_id, s_conf, s_id IS NULL AND e - s < {HOUR // 2} AS filtered FROM sg LEFT JOIN near USING (id) WHERE state IN ('panel', 'down')),
fu AS (
  SELECT d.id, u.id AS u_id, u.o AS uo, u.s AS us, u.e AS ue, u.confidence AS uc, u.readings AS un FROM dn d JOIN sg u ON u.session_id = d.session_id AND u.o > d.o AND u.state IN ('up', 'recovered')
  WHERE NOT filtered QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY u.o) = 1),
wk AS (SELECT d.*, fu.* EXCLUDE (id) FROM dn d LEFT JOIN fu ON fu.id = d.id AND us <= d.e + {72 * HOUR} WHERE NOT filtered),
se AS (
  SELECT w.id, list(struct_pack(o := x.o, told := x.told) ORDER BY x.o) AS between FROM wk w JOIN noted x ON x.session_id = w.session_id AND x.o > w.o AND len(x.told) > 0 AND CASE WHEN u_id IS NULL THEN x.s <= w.e + {72 * HOUR} ELSE x.o <= uo END
  GROUP BY w.id),
la AS (SELECT w.id, min(x.s) - any_value(w.e) AS late FROM wk w JOIN sg x ON x.session_id = w.session_id AND x.o > w.o AND x.s > w.e + {72 * HOUR} WHERE u_id IS NULL GROUP BY w.id),
ow AS (SELECT * FROM wk QUALIFY u_id IS NULL OR row_number() OVER (PARTITION BY u_id ORDER BY o) = 1),
su AS (
  SELECT w.id, n.event_id AS up_event, n.confidence AS up_conf FROM ow w JOIN ev n ON n.session_id = w.session_id AND n.event_type = 'click' AND n.k % 4 = 1 AND n.t BETWEEN us - {2 * HOUR} AND ue + {2 * HOUR}
  QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY abs(n.t - us), n.t, n.event_id) = 1),
sd AS (
  SELECT w.id, n.event_id AS down_event FROM ow w JOIN ev n ON n.session_id = w.session_id AND n.event_type = 'click' AND n.k % 4 = 3 AND n.t BETWEEN w.s - {2 * HOUR} AND w.e + {2 * HOUR}
  QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY abs(n.t - w.s), n.t, n.event_id) = 1),
sc AS (
  SELECT ow.*, between, late, up_event, up_conf, down_event, round(greatest(0, least(1,
      0.35 * greatest(0, least(1, 0.55 * confidence + 0.45 * greatest(0, least(1, (e - s) / {HOUR / 2}))))
    + 0.35 * CASE WHEN u_id IS NULL THEN 0 ELSE greatest(0, least(1, 0.55 * uc + 0.30 * greatest(0, least(1, (ue - us) / {HOUR / 2})) + 0.15 * CASE WHEN un >= 2 THEN 1.0 ELSE 0.65 END)) END
    + 0.15 * CASE WHEN u_id IS NULL THEN 0 ELSE greatest(greatest(0, least(1, 1 - greatest(0, us - e) / {72.0 * HOUR} * 0.5)), coalesce(up_conf, 0)) END
    + 0.15 * coalesce(s_conf, 0))), 9) AS c
  FROM ow LEFT JOIN se USING (id) LEFT JOIN la USING (id) LEFT JOIN su USING (id) LEFT JOIN sd USING (id)),
rec AS (
  SELECT session_id, id AS down_id, u_id AS up_id, s AS down_t, us AS recovery_t, CASE WHEN u_id IS NOT NULL THEN greatest(0, us - e) END AS delay, s_id AS signal_id, coalesce(up_event, down_event) AS state_event_id, c AS confidence,
    CASE WHEN u_id IS NULL THEN CASE WHEN late IS NULL OR c >= 0.45 THEN 'UNCERTAIN' ELSE 'MISSING' END WHEN c >= 0.7 THEN 'CONFIRMED' WHEN c >= 0.45 THEN 'INFERRED' ELSE 'UNCERTAIN' END AS status,
    CASE WHEN u_id IS NULL THEN CASE WHEN late IS NULL THEN 'UNOBSERVED_END' WHEN c >= 0.45 THEN 'MISSING_OR_UNOBSERVED' ELSE 'MISSING' END
      WHEN c >= 0.7 THEN 'DETECTED' WHEN c >= 0.45 THEN 'DETECTED_LOW_CONFIDENCE' ELSE 'DETECTED_UNCERTAIN' END AS result,
    concat_ws(',', 'state_segments', CASE WHEN s_id IS NOT NULL THEN 'signal_crosscheck' END, CASE WHEN up_event IS NOT NULL THEN 'state_event_crosscheck' END, CASE WHEN u_id IS NOT NULL THEN 'up_returned' END) AS sources,
    array_to_string(list_filter(list_concat([CASE WHEN e - s < {HOUR // 2} THEN 'short_down_segment:' || {_sec("e - s")} || '<' || {_sec(str(HOUR // 2))} END], flatten(list_transform(coalesce(between, []), lambda x: x.told)), [
      CASE WHEN u_id IS NOT NULL THEN NULL WHEN late IS NULL THEN 'no_later_segment' ELSE 'max_delay_exceeded:' || {_sec("late")} || '>' || {_sec(str(72 * HOUR))} END,
      CASE WHEN u_id IS NOT NULL AND c < 0.45 THEN 'confidence_below_inferred:' || {_sec("floor(c * 1e6)::BIGINT")} || '<0.450' END]), lambda x: x IS NOT NULL), ',') AS notes
  FROM sc),
recs AS (
  SELECT session_id, id, state, s AS start_t, e AS end_t, confidence, s_id AS signal_id,
    CASE WHEN filtered THEN 'FILTERED_SHORT_SEGMENT' WHEN s_id IS NOT NULL OR (state = 'panel' AND confidence >= 0.6) THEN 'CONFIRMED' ELSE 'INFERRED' END AS status,
    concat_ws(',', 'state_segment', CASE WHEN s_id IS NOT NULL THEN 'signal_crosscheck' END) AS sources,
    concat_ws(',', CASE WHEN e - s < {HOUR // 2} THEN 'short_down_segment:' || {_sec("e - s")} || '<' || {_sec(str(HOUR // 2))} END, CASE WHEN filtered THEN 'not_promoted' END) AS notes
  FROM dn)"""


def _recovery(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("id", F.col("event_id"))
    kind, k = F.col("event_type"), F.col("k")
    state = F.when(kind == "error", F.when(k % 4 == 0, "panel").otherwise("down")).when(kind == "view", F.when(k % 3 == 0, "recovered").otherwise("up")).when(kind == "purchase", "overlay").otherwise("unknown")
    segments = ev.where("event_type <> 'click'").select("session_id", "id", state.alias("state"), F.col("t").alias("start_t"), (F.col("t") + k.cast("long") * 60_000_000).alias("end_t"), "confidence", (k % 3 + 1).alias("readings"))
    clicks = ev.where("event_type = 'click'")
    told = clicks.where("k % 2 = 1").withColumn("kind", F.when(k % 4 == 1, "up").otherwise("down"))
    return recovery.recovery_events(segments, clicks.where("k % 2 = 0"), told, _SEARCH)


@query("WITH" + _RECOVERY + " SELECT * FROM rec")
def recovery_events(spark, sf_dir):
    return _joined(_recovery(spark, sf_dir)[0], "sources", "notes")


@query("WITH" + _RECOVERY + " SELECT * FROM recs")
def down_records(spark, sf_dir):
    return _joined(_recovery(spark, sf_dir)[1], "sources", "notes")


@query("WITH" + _RECOVERY + """,
a AS (SELECT session_id, count(*) AS down_segments, min(start_t) AS first_down_t FROM recs GROUP BY 1),
b AS (SELECT session_id, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'INFERRED') AS inferred, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'UNCERTAIN') AS uncertain, first(recovery_t ORDER BY down_t, recovery_t) FILTER (recovery_t IS NOT NULL) AS first_recovery_t FROM rec GROUP BY 1)
SELECT c_custkey AS session_id, coalesce(down_segments, 0) AS down_segments, coalesce(confirmed, 0) AS confirmed, coalesce(inferred, 0) AS inferred, coalesce(missing, 0) AS missing, coalesce(uncertain, 0) AS uncertain, first_down_t, first_recovery_t
FROM customer LEFT JOIN a ON a.session_id = c_custkey LEFT JOIN b ON b.session_id = c_custkey""")
def recovery_summaries(spark, sf_dir):
    sessions = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return recovery.recovery_summary(sessions, *_recovery(spark, sf_dir))


#: Checks that did not pass, and whether a down segment near them was followed by nothing.
_REVIEW = _RULES + "," + _RECOVERY.removeprefix(V.SQL_EVENTS).lstrip(",") + f""",
tail AS (
  SELECT fi.session_id, fi.incident_id, fi.rule, fi.result, fi.note, fi.rule = 'recovery' AND fi.result = 'FAIL' AND fi.note = 'missing_recovery' AND EXISTS (
    FROM rec WHERE rec.session_id = fi.session_id AND rec.down_t BETWEEN ev.t - {2 * HOUR} AND ev.t + {3 * HOUR} AND list_contains(string_split(rec.notes, ','), 'no_later_segment')) AS unobservable
  FROM fi JOIN ev ON fi.incident_id = ev.event_id WHERE fi.result <> 'PASS')"""


def _review(spark, sf_dir):
    at = V.events(spark, sf_dir).select(F.col("event_id").alias("incident_id"), "t")
    found = _every_finding(spark, sf_dir)[1].where("incident_id is not null").join(at.hint("shuffle_merge"), "incident_id").withColumn("check_id", F.concat_ws(":", "rule", "incident_id"))
    return R.review_package(found, _recovery(spark, sf_dir)[0], 2 * HOUR, 3 * HOUR)


@query("WITH" + _REVIEW + " SELECT session_id, incident_id, rule, result, note FROM tail WHERE NOT unobservable")
def review_queue(spark, sf_dir):
    kept = _review(spark, sf_dir).where("exclusion is null")
    return kept.select("session_id", "incident_id", "rule", "result", F.array_join("notes", ",").alias("note"))


@query("WITH" + _REVIEW + " SELECT session_id, incident_id, rule, result, note, 'missing_recovery_at_end_no_later_segment' AS exclusion FROM tail WHERE unobservable")
def excluded_checks(spark, sf_dir):
    out = _review(spark, sf_dir).where("exclusion is not null")
    return out.select("session_id", "incident_id", "rule", "result", F.array_join("notes", ",").alias("note"), "exclusion")


@query("WITH" + _RULES + " SELECT session_id, rule, incident_id, confidence, rank FROM (SELECT session_id, rule, incident_id, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY session_id, rule ORDER BY round(confidence, 6) DESC, incident_id) AS rank FROM fi WHERE result = 'PASS') WHERE rank <= 2")
def pass_examples(spark, sf_dir):
    passed = _findings(spark, sf_dir)[1].where("result = 'PASS'").select("session_id", "rule", "incident_id", F.round("confidence", 6).alias("confidence"))
    return R.top_per_group(passed, ["session_id", "rule"], [F.desc("confidence"), F.asc_nulls_last("incident_id")], 2).withColumn("rank", F.col("rank").cast("long"))


@query(r"""
WITH t AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
n AS (SELECT doc_id, any_value(lang) AS lang, list(('0x' || substr(md5(w), 1, 4))::INTEGER % 65) AS bs, count(*) AS n FROM t GROUP BY doc_id HAVING count(*) >= 20),
d AS (SELECT doc_id, lang, list_transform(range(0, 65), lambda i: len(list_filter(bs, lambda x: x = i))) AS c FROM n),
h AS (SELECT lang, min(doc_id) AS id, list_transform(range(1, 65), lambda i: (c[i + 1] > c[i])::INTEGER) AS b FROM d GROUP BY lang, b)
SELECT x.lang AS grp, x.id AS a, y.id AS b, list_sum(list_transform(range(1, 65), lambda i: (x.b[i] <> y.b[i])::INTEGER))::INTEGER AS distance
FROM h x JOIN h y ON x.lang = y.lang AND x.id < y.id WHERE list_sum(list_transform(range(1, 65), lambda i: (x.b[i] <> y.b[i])::INTEGER)) <= 8""")
def hash_neighbours(spark, sf_dir):
    return L.hash_pairs(V.document_hashes(spark, sf_dir), 8)


@query("SELECT sha256(text) AS key, min(doc_id) AS first, count(*) AS rows FROM documents GROUP BY text")
def exact_duplicates(spark, sf_dir):
    return L.exact_duplicates(V.table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


@query("""
WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 25 = 0), q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 25 <> 0),
s AS (SELECT q.vec_id AS q_id, r.vec_id AS r_id, round(list_dot_product(q.v, r.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v))), 6) AS score FROM q JOIN r ON q.label = r.label)
SELECT q_id, r_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, r_id) AS rank FROM s) WHERE rank <= 5""")
def nearest_reference(spark, sf_dir):
    v = V.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("q_id"), F.col("label").alias("class"), F.col("embedding").alias("q_v"))
    r = v.where("vec_id % 25 = 0").select(F.col("vec_id").alias("r_id"), F.col("label").alias("class"), F.col("embedding").alias("r_v"))
    return L.nearest_reference(q, r)


@query(r"""
WITH e AS (SELECT DISTINCT p_brand AS entry, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS e FROM part),
q AS (SELECT p_partkey AS q_id, regexp_replace(lower(CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN substr(p_brand, 2) || 'x' WHEN 2 THEN 'of ' || p_brand ELSE 'z' || (p_partkey % 89) END), '[^a-z0-9]', '', 'g') AS q, (p_partkey % 101) / 100.0::DOUBLE AS c FROM part),
s AS (SELECT q_id, c, entry, round(CASE WHEN contains(q, e) OR contains(e, q) THEN 1.0 ELSE 1 - levenshtein(q, e) / greatest(length(q), length(e)) END, 9) AS score FROM q, e),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, entry) = 1)
SELECT q_id, CASE WHEN score > 0 THEN entry END AS entry, round(score, 6) AS score, round(CASE WHEN c >= 0.25 AND score >= 0.55 THEN 0.55 * c + 0.45 * score ELSE c * score END, 5) AS confidence, CASE WHEN c < 0.25 THEN 'low_reading' WHEN score < 0.55 THEN 'low_match' ELSE 'ok' END AS status FROM b""")
def fuzzy_match(spark, sf_dir):
    part, key, brand = V.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_brand")
    name = F.when(key % 4 == 0, brand).when(key % 4 == 1, F.concat(F.substring(brand, 2, 100), F.lit("x"))).when(key % 4 == 2, F.concat(F.lit("of "), brand)).otherwise(F.concat(F.lit("z"), key % 89))
    out = L.fuzzy_match(part.select(key.alias("q_id"), name.alias("name"), (key % 101 / 100).alias("confidence")), part.select(brand.alias("entry")))
    return out.withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 5)})


@query("""
WITH l AS (SELECT o_orderkey AS frame, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 7 + 1)::VARCHAR ELSE CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END END AS key, 'no. ' || o_custkey AS value FROM orders),
d AS (SELECT frame, key, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM l)
SELECT l_orderkey AS frame, l_linenumber::VARCHAR AS slot, l_returnflag AS side, coalesce(a.digits, b.digits) AS label FROM lineitem LEFT JOIN d a ON a.frame = l_orderkey AND a.key = l_linenumber::VARCHAR LEFT JOIN d b ON b.frame = l_orderkey AND b.key = l_returnflag""")
def labelled_frames(spark, sf_dir):
    frames = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("string").alias("slot"), F.col("l_returnflag").alias("side"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    side = F.when(cust % 3 == 0, "A").when(cust % 3 == 1, "N").otherwise("R")
    labels = V.table(spark, sf_dir, "orders").select(key.alias("frame"), F.when(key % 2 == 0, (cust % 7 + 1).cast("string")).otherwise(side).alias("key"), F.concat(F.lit("no. "), cust).alias("value"), F.lit(0).alias("seq"))
    return L.apply_labels(frames, labels)


_PATH = V.SQL_POSITIONS + """,
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, first(x) OVER w AS hx, first(y) OVER w AS hy FROM po WINDOW w AS (PARTITION BY session_id ORDER BY t, id)),
tr AS (SELECT session_id, id, t, x, y, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0) AS step, sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) AS from_home FROM l)"""


@query("WITH" + _PATH + " SELECT session_id, id, round(step, 4) AS step, round(from_home, 4) AS from_home FROM tr")
def trajectory(spark, sf_dir):
    return spatial.trajectory(V.positions(spark, sf_dir)).select("session_id", "id", F.round("step", 4).alias("step"), F.round("from_home", 4).alias("from_home"))


_JUMPS = "WITH RECURSIVE" + _PATH + """,
o AS (SELECT *, step > 150 AND from_home < 120 AS back, row_number() OVER (PARTITION BY session_id ORDER BY t, id) AS n FROM tr),
f AS (
  SELECT session_id, id, t, n, from_home AS far, CASE WHEN back AND from_home > 150 THEN 1 ELSE 0 END AS hits, back AND from_home > 150 AS hit, from_home AS since, back FROM o WHERE n = 1
  UNION ALL
  SELECT o.session_id, o.id, o.t, o.n, CASE WHEN o.back AND greatest(CASE WHEN f.hit THEN 0 ELSE f.far END, o.from_home) > 150 AND f.hits < 5 THEN o.from_home ELSE greatest(CASE WHEN f.hit THEN 0 ELSE f.far END, o.from_home) END,
    f.hits + CASE WHEN o.back AND greatest(CASE WHEN f.hit THEN 0 ELSE f.far END, o.from_home) > 150 AND f.hits < 5 THEN 1 ELSE 0 END, o.back AND greatest(CASE WHEN f.hit THEN 0 ELSE f.far END, o.from_home) > 150 AND f.hits < 5,
    greatest(CASE WHEN f.back THEN 0 ELSE f.since END, o.from_home), o.back
  FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)"""


@query(_JUMPS + " SELECT session_id, id, t, hits::INTEGER AS n FROM f WHERE hit")
def teleports(spark, sf_dir):
    return spatial.teleports(spatial.trajectory(V.positions(spark, sf_dir)), 150.0, 120.0)


@query(_JUMPS + " SELECT session_id, id, round(since, 4) AS farthest FROM f")
def farthest_points(spark, sf_dir):
    return spatial.farthest_since(spatial.trajectory(V.positions(spark, sf_dir)), 150.0, 120.0).select("session_id", "id", F.round("farthest", 4).alias("farthest"))


@query(_JUMPS + f""",
w AS (SELECT h.id AS r_id, p.t, p.id, p.step < 400 AS calm FROM f h JOIN tr p ON h.hit AND p.session_id = h.session_id AND p.t > h.t AND p.t <= h.t + {72 * HOUR}),
g AS (SELECT *, sum(CASE WHEN calm THEN 0 ELSE 1 END) OVER (PARTITION BY r_id ORDER BY t, id) AS run FROM w),
n AS (SELECT r_id, t, row_number() OVER (PARTITION BY r_id, run ORDER BY t, id) AS n FROM g WHERE calm),
z AS (SELECT r_id, min(t) AS s FROM n WHERE n = 2 GROUP BY r_id)
SELECT session_id, f.id, coalesce(s, f.t + {72 * HOUR}) AS settled_t, s IS NOT NULL AS settled FROM f LEFT JOIN z ON z.r_id = f.id WHERE hit""")
def settled_recoveries(spark, sf_dir):
    path = settle(spatial.trajectory(V.positions(spark, sf_dir)))
    return spatial.settle_after(spatial.teleports(path, 150.0, 120.0), path, 400.0, 2, 72 * HOUR)


@query("WITH" + _PATH + """,
c AS (SELECT *, step < 300 AS calm, row_number() OVER (PARTITION BY session_id ORDER BY t, id) - row_number() OVER (PARTITION BY session_id, step < 300 ORDER BY t, id) AS g FROM tr),
n AS (SELECT session_id, t, row_number() OVER (PARTITION BY session_id, g ORDER BY t, id) AS n FROM c WHERE calm)
SELECT session_id, min(t) AS t FROM n WHERE n = 3 GROUP BY session_id""")
def settles(spark, sf_dir):
    return spatial.settled_at(spatial.trajectory(V.positions(spark, sf_dir)), 300.0, 3)


@query("WITH" + V.SQL_POSITIONS + """,
a AS (SELECT *, lead(x) OVER w - x AS nx, lead(y) OVER w - y AS ny FROM po WINDOW w AS (PARTITION BY session_id ORDER BY t, id)),
b AS (SELECT *, coalesce(CASE WHEN round(x / 19.8) % 9 = 0 THEN round(x / 19.8) * 3 END, CASE WHEN nx <> 0 OR ny <> 0 THEN (degrees(atan2(nx, -ny)) + 360) % 360 END) AS own FROM a)
SELECT session_id, id, round(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 90), 4) AS heading FROM b""")
def headings(spark, sf_dir):
    k = F.round(F.col("x") / 19.8)
    points = V.positions(spark, sf_dir).withColumn("heading", F.when(k % 9 == 0, k * 3))  # some are given
    return spatial.headings(points).select("session_id", "id", F.round("heading", 4).alias("heading"))


FLOORS, OBSTACLES, CORRIDORS = [[(60, 60), (1920, 60), (1920, 600), (60, 600)]], [[(600, 200), (900, 200), (900, 420), (600, 420)]], [[(0, 300), (60, 300), (60, 360), (0, 360)]]


#: Floors of any shape, one inside another's hole being an obstacle; a corridor across it.
SHAPES = {
    "obstacles": [[(500, 150), (1100, 120), (820, 520)], [(1300, 300), (1500, 200), (1700, 330), (1480, 520)]],
    "corridors": [[(0, 280), (420, 180), (420, 240), (0, 340)], [(1400, 100), (1460, 100), (1560, 640), (1500, 640)]],
    "floors": [[(60, 60), (900, 20), (1900, 140), (1820, 600), (1000, 480), (300, 640)]],
}


def _rings_sql(rings: list) -> str:
    """Whether (x, y) lies in one of the rings: an odd number of their edges to the right of it."""

    def inside(ring):
        edges = [(p, q) for p, q in zip(ring, ring[1:] + ring[:1]) if p[1] != q[1]]
        hits = [f"(({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y) AND x < {x2 - x1}::DOUBLE * (y - {y1}::DOUBLE) / {y2 - y1}::DOUBLE + {x1}::DOUBLE)::INTEGER" for (x1, y1), (x2, y2) in edges]
        return f"({' + '.join(hits)}) % 2 = 1"

    return " OR ".join(map(inside, rings))


@query("WITH" + V.SQL_POSITIONS + f"""
SELECT session_id, id, CASE WHEN {_rings_sql(SHAPES["obstacles"])} THEN false WHEN {_rings_sql(SHAPES["corridors"])} THEN true ELSE {_rings_sql(SHAPES["floors"])} END AS walkable FROM po""")
def zones(spark, sf_dir):
    return V.positions(spark, sf_dir).select("session_id", "id", spatial.walkable(F.col("x"), F.col("y"), **SHAPES).alias("walkable"))


def _free_sql(x: str, y: str) -> str:
    return f"CASE WHEN {x} >= 600 AND {x} < 900 AND {y} >= 200 AND {y} < 420 THEN false WHEN {x} >= 0 AND {x} < 60 AND {y} >= 300 AND {y} < 360 THEN true ELSE {x} >= 60 AND {x} < 1920 AND {y} >= 60 AND {y} < 600 END"


@query("WITH" + V.SQL_POSITIONS + f""",
g AS (SELECT gx, gy FROM range(80) a(gx), range(28) b(gy) WHERE {_free_sql("(gx + 0.5) * 25", "(gy + 0.5) * 25")}),
c AS (SELECT DISTINCT floor(x / 25)::BIGINT AS cx, floor(y / 25)::BIGINT AS cy FROM po),
m AS (SELECT cx, cy, gx, gy FROM c JOIN g ON greatest(abs(gx - cx), abs(gy - cy)) <= 59 QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY greatest(abs(gx - cx), abs(gy - cy)), gx - cx, gy - cy) = 1)
SELECT id, round_even(gx * 25 + 12.5, 0)::BIGINT AS sx, round_even(gy * 25 + 12.5, 0)::BIGINT AS sy FROM po JOIN m ON cx = floor(x / 25) AND cy = floor(y / 25)""")
def snapped_points(spark, sf_dir):
    points = V.positions(spark, sf_dir).select("id", "x", "y")
    return spatial.snap_to_walkable(points, OBSTACLES, CORRIDORS, FLOORS, 25.0, 80, 28).select("id", "sx", "sy")


@query("WITH" + V.SQL_POSITIONS + f""",
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM po WINDOW w AS (PARTITION BY session_id ORDER BY t, id)),
s AS (SELECT id, floor(x / 30) AS ax, floor(y / 30) AS ay, floor(nx / 30) AS bx, floor(ny / 30) AS dy FROM n WHERE nx IS NOT NULL),
p AS (SELECT *, unnest(range(0, greatest(abs(bx - ax), abs(dy - ay), 1)::BIGINT + 1)) AS i, greatest(abs(bx - ax), abs(dy - ay), 1) AS steps FROM s),
c AS (SELECT id, (round(ax + (bx - ax) * i / steps) + 0.5) * 30 AS x, (round(ay + (dy - ay) * i / steps) + 0.5) * 30 AS y FROM p)
SELECT id, bool_and({_free_sql("x", "y")}) AS clear FROM c GROUP BY id""")
def lines_of_sight(spark, sf_dir):
    turned = V.positions(spark, sf_dir).withColumns({"_t": -F.col("t"), "_i": -F.col("id")})
    ahead = T.with_previous(turned, ["session_id"], "_t", "_i", ["x", "y"], "n").where("n is not null")
    return spatial.line_of_sight(ahead.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n.x").alias("x2"), F.col("n.y").alias("y2")), OBSTACLES, CORRIDORS, FLOORS, 30.0)


@query("WITH" + V.SQL_ACTIONS + """,
e AS (SELECT session_id, t_ms, CASE kind WHEN 'mouse_click' THEN 'mouse_down' ELSE kind END AS kind, code FROM ac UNION ALL SELECT session_id, t_ms + 30, 'mouse_up', code FROM ac WHERE kind = 'mouse_click')
SELECT session_id, t_ms, kind, code FROM e""")
def expanded_actions(spark, sf_dir):
    return A.expand_actions(V.actions(spark, sf_dir))


@query("WITH" + V.SQL_ACTIONS + """,
e AS (SELECT session_id, t_ms, CASE kind WHEN 'mouse_click' THEN 'mouse_down' ELSE kind END AS kind, code FROM ac UNION ALL SELECT session_id, t_ms + 30, 'mouse_up', code FROM ac WHERE kind = 'mouse_click')
SELECT session_id, code, max(t_ms) AS t_ms FROM e GROUP BY session_id, code HAVING arg_max(kind, (t_ms, kind)) LIKE '%down'""")
def held_inputs(spark, sf_dir):
    return A.held_inputs(A.expand_actions(V.actions(spark, sf_dir)))


@query("WITH" + V.SQL_ACTIONS + " SELECT session_id, t_ms, kind, code, run::INTEGER AS run, row_number() OVER (PARTITION BY session_id ORDER BY run, t_ms, kind, code)::INTEGER AS index FROM ac, range(3) r(run)")
def repeated_scenario(spark, sf_dir):
    return A.repeat_scenario(V.actions(spark, sf_dir).drop("duration_ms"), 3)


@query("WITH" + V.SQL_ACTIONS + " SELECT session_id, count(*) AS actions, count(DISTINCT code) AS codes, round(max(t_ms) / 1000, 4) AS duration, count(*) FILTER (kind LIKE '%down') AS downs FROM ac GROUP BY session_id")
def recording_summary(spark, sf_dir):
    return A.recording_summary(V.actions(spark, sf_dir))


@query("""
WITH a AS (SELECT l_orderkey AS frame, l_partkey % 41 - 20 AS dx, l_suppkey % 31 - 15 AS dy, """ + _NANO.format(c="l_quantity::DOUBLE / 50") + """ AS s FROM lineitem WHERE l_quantity::DOUBLE / 50 >= 0.3),
g AS (SELECT frame, sum(dx * s)::HUGEINT AS x, sum(dy * s)::HUGEINT AS y, sum(s)::HUGEINT AS d, """ + _PPM.format(num="sum(s)::HUGEINT", den="count(*)::HUGEINT") + """ AS score, count(*) AS anchors FROM a GROUP BY frame)
SELECT frame, """ + _half_even_sql("x", "d") + " AS dx, " + _half_even_sql("y", "d") + """ AS dy, score, anchors FROM g""")
def weighted_offsets(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 41 - 20).alias("dx"), (F.col("l_suppkey") % 31 - 15).alias("dy"), (F.col("l_quantity").cast("double") / 50).alias("score"))
    return R.weighted_offsets(li, ["frame"], 0.3).withColumn("score", F.round("score", 6))


@query("WITH" + V.SQL_EVENTS + """,
w AS (SELECT event_id, t, k, CASE WHEN k % 3 > 0 THEN t + (k - 40)::BIGINT * 1000000 END AS e FROM ev WHERE event_type = 'error')
SELECT event_id, greatest(0, t - 2000000) AS lo, greatest(greatest(0, t - 2000000) + 200000, CASE WHEN e >= t THEN e ELSE t END + 3000000) AS hi FROM w""")
def evidence_windows(spark, sf_dir):
    end = F.when(F.col("k") % 3 > 0, F.col("t") + (F.col("k") - 40).cast("long") * 1_000_000)
    w = S.evidence_window(F.col("t"), end, 2_000_000, 3_000_000, 200_000)
    return V.events(spark, sf_dir).where("event_type = 'error'").select("event_id", w.alias("w")).select("event_id", "w.lo", "w.hi")


@query("WITH" + V.SQL_EVENTS + """,
c AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN t END AS t, CASE WHEN k % 4 = 1 THEN t - 7000000 END AS lo, CASE WHEN k % 4 = 1 AND k % 3 > 0 THEN t END AS hi, CASE WHEN k % 4 = 2 THEN k::DOUBLE * 100000 END AS duration FROM ev)
SELECT event_id, coalesce(t::DOUBLE, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo::DOUBLE + hi::DOUBLE) / 2 ELSE coalesce(lo, hi)::DOUBLE END,
  CASE WHEN duration > 0 THEN least(greatest(1000000, duration * [0.18, 0.34, 0.5, 0.66, 0.82][event_id % 5 + 1]::DOUBLE), greatest(1000000, duration - 1000000)) END, 8000000) AS focus FROM c""")
def focus_times(spark, sf_dir):
    t, k = F.col("t"), F.col("k")
    told = S.focus_time(F.when(k % 4 == 0, t), F.when(k % 4 == 1, t - 7_000_000), F.when((k % 4 == 1) & (k % 3 > 0), t), F.when(k % 4 == 2, k.cast("double") * 100_000), F.col("event_id"))
    return V.events(spark, sf_dir).select("event_id", told.alias("focus"))


@query("WITH" + V.SQL_EVENTS + """,
b AS (SELECT event_id, (k * 20)::INTEGER AS x, (k * 7)::INTEGER AS y FROM ev), c AS (SELECT event_id, greatest(0, least(x, 1919)) AS x1, greatest(0, least(y, 599)) AS y1 FROM b)
SELECT event_id, x1 AS x, y1 AS y, greatest(1, least(120, 1920 - x1)) AS w, greatest(1, least(80, 600 - y1)) AS h FROM c""")
def region_boxes(spark, sf_dir):
    box = S.clip_box((F.col("k") * 20).cast("int"), (F.col("k") * 7).cast("int"), F.lit(120), F.lit(80), 1920, 600)
    return V.events(spark, sf_dir).select("event_id", box.alias("b")).select("event_id", "b.*")


@query(r"""
WITH n AS (SELECT p_partkey, p_name, p_brand, p_name || CASE p_partkey % 3 WHEN 0 THEN ' bl east!' WHEN 1 THEN ' Gr--west' ELSE ' bl' END AS raw FROM part),
w AS (SELECT *, list_transform(string_split(regexp_replace(regexp_replace(trim(raw), '[^A-Za-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda x: upper(x[1]) || lower(x[2:])) AS w FROM n)
SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe, regexp_replace(p_brand, '[^0-9]', '', 'g')::BIGINT AS digits,
  trim(replace(replace(array_to_string(w, ' '), 'Bl ', 'BL '), 'Gr ', 'GR ')) AS name FROM w""")
def names(spark, sf_dir):
    key = F.col("p_partkey")
    raw = F.concat("p_name", F.when(key % 3 == 0, " bl east!").when(key % 3 == 1, " Gr--west").otherwise(" bl"))
    return V.table(spark, sf_dir, "part").select("p_partkey", S.safe_name(F.col("p_name")).alias("safe"), S.digits_only(F.col("p_brand")).alias("digits"), S.normalize_name(raw, ("BL", "GR")).alias("name"))


_ROLES = V.SQL_EVENTS + f""",
raw AS (
  SELECT session_id, event_id, t, confidence, side, CASE event_type WHEN 'purchase' THEN 'signal' WHEN 'click' THEN 'change' WHEN 'view' THEN 'state' WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'down_signal' ELSE 'down_state' END ELSE CASE WHEN k % 3 = 0 THEN 'location' ELSE 'recovery' END END AS role,
    CASE WHEN event_type = 'signup' AND k % 3 <> 0 AND k >= 10 THEN t + {3 * HOUR} END AS end_t, k < 30 AS heuristic, CASE WHEN k >= 80 THEN k / 100.0 END::DOUBLE AS matched, k < 10 AS missing,
    CASE WHEN confidence >= 0.75 THEN 'PASS' WHEN confidence < 0.2 THEN 'FAIL' WHEN k % 2 = 0 THEN 'OBSERVED' ELSE 'UNCERTAIN' END AS result, 'UNKNOWN' AS status
  FROM ev)"""


def _roles(spark, sf_dir):
    ev, kind, k, conf = V.events(spark, sf_dir), F.col("event_type"), F.col("k"), F.col("confidence")
    role = F.when(kind == "purchase", "signal").when(kind == "click", "change").when(kind == "view", "state").when(kind == "error", F.when(k % 2 == 0, "down_signal").otherwise("down_state")).when(k % 3 == 0, "location").otherwise("recovery")
    return ev.select(
        "session_id", "event_id", "t", "confidence", "side", role.alias("role"), F.when((kind == "signup") & (k % 3 != 0) & (k >= 10), F.col("t") + 3 * HOUR).alias("end_t"), (k < 30).alias("heuristic"), F.when(k >= 80, k / 100).alias("matched"), (k < 10).alias("missing"),
        F.when(conf >= 0.75, "PASS").when(conf < 0.2, "FAIL").when(k % 2 == 0, "OBSERVED").otherwise("UNCERTAIN").alias("result"), F.lit("UNKNOWN").alias("status"),
    )


def _exclusive_sql(name: str, anchors: str, candidates: str, hours: int, at: str = "t", tier: str = "0") -> str:
    """Tables for the exclusive match of two tables: the last, `name`, holds a_id and c_id."""
    return f""",
{name}_p AS (SELECT a.session_id, a.event_id AS a_id, a.{at} AS a_t, c.event_id AS c_id, c.t AS c_t, c.confidence AS c_conf, abs(c.t - a.{at}) AS gap, {tier} AS tier FROM {anchors} a JOIN {candidates} c ON a.session_id = c.session_id AND c.t BETWEEN a.{at} - {hours * HOUR} AND a.{at} + {hours * HOUR}),
{name}_q AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY a_t, a_id) AS n FROM {name}_p),
{name}_w AS (SELECT session_id, n, any_value(a_id) AS a_id, list(c_id ORDER BY tier, gap, c_conf DESC, c_t, c_id) AS wants FROM {name}_q GROUP BY session_id, n),
{name}_r AS (
  SELECT session_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS a_id, NULL::BIGINT AS c_id FROM (SELECT DISTINCT session_id FROM {name}_w)
  UNION ALL
  SELECT w.session_id, w.n, CASE WHEN f IS NULL THEN r.used ELSE list_append(r.used, f) END, w.a_id, f FROM {name}_r r JOIN {name}_w w ON w.session_id = r.session_id AND w.n = r.n + 1, LATERAL (SELECT list_filter(w.wants, lambda x: NOT list_contains(r.used, x))[1] AS f)),
{name} AS MATERIALIZED (SELECT a_id, c_id FROM {name}_r WHERE c_id IS NOT NULL)"""


def _role_sql(name: str, role: str, without: str | None = None) -> str:
    return f",\n{name} AS (SELECT * FROM raw WHERE role = '{role}'" + (f" AND event_id NOT IN (SELECT c_id FROM {without})" if without else "") + ")"


def _weighted_sql(*parts: tuple[int, str]) -> str:
    """num and den of the weighted mean over the parts that are there; weights in hundredths."""
    num = " + ".join(f"coalesce({w} * {_NANO.format(c=c)}, 0)" for w, c in parts)
    den = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for w, c in parts)
    return f"({num})::HUGEINT AS num, ({den})::HUGEINT AS den"


_LADDER = "CASE WHEN {c} >= 0.75 AND {n} >= 2 THEN 'CONFIRMED' WHEN {c} >= 0.5 THEN 'INFERRED' ELSE 'UNCERTAIN' END"
_FLOOR = "CASE WHEN c >= 0.5 THEN 'INFERRED' ELSE 'UNCERTAIN' END"
_TIMELINE = (
    "WITH RECURSIVE" + _ROLES + _role_sql("sg", "signal") + _role_sql("cg", "change") + _exclusive_sql("m1", "sg", "cg", 6, tier="CASE WHEN a.side = c.side THEN 0 ELSE 1 END")
    + ",\nkept AS (SELECT * FROM sg WHERE event_id IN (SELECT a_id FROM m1) OR NOT heuristic)" + _role_sql("sa", "state") + _exclusive_sql("m2", "kept", "sa", 2)
    + ",\ncl AS (SELECT * FROM cg WHERE event_id NOT IN (SELECT c_id FROM m1))" + _role_sql("sb", "state", "m2") + _exclusive_sql("m3", "cl", "sb", 2)
    + _role_sql("rc", "recovery") + _role_sql("ds", "down_signal") + _role_sql("dt", "down_state") + _role_sql("lo", "location")
    + _exclusive_sql("m4", "rc", "ds", 8) + _exclusive_sql("m5", "rc", "dt", 8) + ",\nrt AS (SELECT * FROM rc WHERE end_t IS NOT NULL)" + _exclusive_sql("m6", "rt", "lo", 8, at="end_t")
    + _role_sql("dl", "down_signal", "m4") + _role_sql("dv", "down_state", "m5") + _exclusive_sql("m7", "dl", "dv", 8)
    + f""",
i1 AS (SELECT a.session_id, 'primary' AS incident_type, least(a.t, c.t, s.t) AS t, NULL::BIGINT AS end_t, {_weighted_sql((45, "a.confidence"), (35, "c.confidence"), (20, "s.confidence"))}, a.event_id AS anchor_id, [a.event_id, c.event_id, s.event_id] AS parts,
  [CASE WHEN c.t IS NULL THEN 'signal_without_change' END, CASE WHEN c.side <> a.side THEN 'change_of_other_side' END] AS notes
  FROM kept a LEFT JOIN m1 ON m1.a_id = a.event_id LEFT JOIN raw c ON c.event_id = m1.c_id LEFT JOIN m2 ON m2.a_id = a.event_id LEFT JOIN raw s ON s.event_id = m2.c_id),
i2 AS (SELECT a.session_id, CASE WHEN a.matched IS NOT NULL THEN 'primary' ELSE 'candidate' END AS incident_type, a.t, NULL::BIGINT AS end_t, {_weighted_sql((45, "a.matched"), (35, "a.confidence"), (20, "s.confidence"))}, a.event_id AS anchor_id, [a.event_id, s.event_id] AS parts,
  [CASE WHEN a.matched IS NOT NULL THEN 'signal_crosscheck' ELSE 'change_without_signal' END] AS notes, a.matched
  FROM cl a LEFT JOIN m3 ON m3.a_id = a.event_id LEFT JOIN raw s ON s.event_id = m3.c_id),
l3 AS (SELECT a.*, d.confidence AS d_conf, s.confidence AS s_conf, l.result AS l_result, CASE WHEN l.result = 'FAIL' THEN 0.0 WHEN l.result IN ('UNCERTAIN', 'OBSERVED') THEN l.confidence * 0.5 ELSE l.confidence END AS l_conf, [a.event_id, d.event_id, s.event_id, l.event_id] AS parts
  FROM rc a LEFT JOIN m4 ON m4.a_id = a.event_id LEFT JOIN raw d ON d.event_id = m4.c_id LEFT JOIN m5 ON m5.a_id = a.event_id LEFT JOIN raw s ON s.event_id = m5.c_id LEFT JOIN m6 ON m6.a_id = a.event_id LEFT JOIN raw l ON l.event_id = m6.c_id),
i3 AS (SELECT session_id, CASE WHEN missing THEN 'recovery_missing' ELSE 'recovery' END AS incident_type, t, end_t, {_weighted_sql((45, "confidence"), (20, "d_conf"), (15, "s_conf"), (20, "l_conf"))}, event_id AS anchor_id, parts,
  [CASE WHEN missing THEN 'down_without_recovery' WHEN l_result IS NULL THEN 'recovery_without_location' WHEN l_result = 'FAIL' THEN 'location_failed' WHEN l_result = 'UNCERTAIN' THEN 'location_uncertain' END] AS notes, missing, l_result FROM l3),
i4 AS (SELECT a.session_id, a.t, {_weighted_sql((60, "a.confidence"), (40, "s.confidence"))}, a.event_id AS anchor_id, [a.event_id, s.event_id] AS parts FROM dl a LEFT JOIN m7 ON m7.a_id = a.event_id LEFT JOIN raw s ON s.event_id = m7.c_id),
al AS (
  SELECT session_id, incident_type, t, end_t, num, den, num::DOUBLE / (den * 1e9)::DOUBLE AS c, {_LADDER.format(c="c", n="len(list_filter(parts, lambda x: x IS NOT NULL))")} AS status, anchor_id, parts, notes, 1 AS stage FROM i1
  UNION ALL SELECT session_id, incident_type, t, end_t, num, den, num::DOUBLE / (den * 1e9)::DOUBLE AS c, CASE WHEN matched IS NULL THEN {_FLOOR} ELSE {_LADDER.format(c="c", n="2")} END, anchor_id, parts, notes, 2 FROM i2
  UNION ALL SELECT session_id, incident_type, t, end_t, num, den, num::DOUBLE / (den * 1e9)::DOUBLE AS c, CASE WHEN missing THEN 'MISSING' WHEN l_result = 'FAIL' THEN 'NEED_REVIEW' ELSE {_LADDER.format(c="c", n="len(list_filter(parts, lambda x: x IS NOT NULL))")} END, anchor_id, parts, notes, 3 FROM i3
  UNION ALL SELECT session_id, 'down_only', t, NULL, num, den, num::DOUBLE / (den * 1e9)::DOUBLE AS c, {_FLOOR}, anchor_id, parts, ['down_without_recovery_match'], 4 FROM i4
  UNION ALL SELECT session_id, CASE WHEN result = 'OBSERVED' THEN 'location_observed' ELSE 'location_check' END, t, NULL, {_NANO.format(c='confidence')}, 1, confidence, status, event_id, [event_id], ['standalone_location'], 5 FROM lo WHERE event_id NOT IN (SELECT c_id FROM m6)
  UNION ALL SELECT session_id, 'supporting_' || role, t, end_t, {_NANO.format(c='confidence')}, 1, confidence, status, event_id, [event_id], ['supporting_not_linked'], 6 FROM raw
    WHERE confidence >= 0.35 AND (role = 'state' AND event_id NOT IN (SELECT c_id FROM m2 UNION ALL SELECT c_id FROM m3) OR role = 'down_state' AND event_id NOT IN (SELECT c_id FROM m5 UNION ALL SELECT c_id FROM m7))),
tl AS (SELECT session_id, incident_type, t, end_t, {_PPM.format(num='num', den='den')} AS confidence, status, anchor_id, list_filter(parts, lambda x: x IS NOT NULL) AS linked, list_filter(notes, lambda x: x IS NOT NULL) AS notes, printf('evt_%05d', row_number() OVER (PARTITION BY session_id ORDER BY t, stage, anchor_id)) AS incident_id FROM al)"""
)


def _timeline(spark, sf_dir):
    return I.build_timeline(_roles(spark, sf_dir), I.Linking(change_window=6 * HOUR, state_window=2 * HOUR, down_window=8 * HOUR, location_window=8 * HOUR))


@query(_TIMELINE + " SELECT session_id, incident_id, incident_type, t, end_t, confidence, status, anchor_id, array_to_string(list_sort(linked), ',') AS linked, array_to_string(notes, ',') AS notes FROM tl")
def incident_timeline(spark, sf_dir):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _timeline(spark, sf_dir)[0].withColumn("linked", F.sort_array("linked")).select("session_id", "incident_id", "incident_type", "t", "end_t", F.round("confidence", 6).alias("confidence"), "status", "anchor_id", text("linked"), text("notes"))


@query(_TIMELINE + ", us AS (SELECT DISTINCT unnest(linked) AS e FROM tl) SELECT event_id, role FROM raw WHERE event_id NOT IN (SELECT e FROM us)")
def unused_events(spark, sf_dir):
    return _timeline(spark, sf_dir)[1].select("event_id", "role")


@query(_TIMELINE + """,
x AS (SELECT session_id, incident_id, unnest(linked) AS event_id FROM tl WHERE status IN ('NEED_REVIEW', 'CONFIRMED'))
SELECT x.session_id, incident_id AS check_id, min(t) AS lo, max(t) AS hi, string_agg(event_id, ',' ORDER BY t, event_id) AS events, string_agg(role, ',' ORDER BY t, event_id) AS roles FROM x JOIN raw USING (event_id) GROUP BY x.session_id, incident_id""")
def check_links(spark, sf_dir):
    incidents = _timeline(spark, sf_dir)[0]
    checks = incidents.where(F.col("status").isin("NEED_REVIEW", "CONFIRMED")).select("session_id", "incident_id", F.col("incident_id").alias("check_id"))
    return I.resolve_links(checks, incidents, _roles(spark, sf_dir)).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("events", "roles")})


@query("WITH" + V.SQL_EVENTS + f""",
f AS (SELECT * FROM ev WHERE event_type = 'view'), h AS (SELECT * FROM ev WHERE event_type = 'click'), w AS (SELECT session_id, event_id, t AS lo, t + k::BIGINT * 60000000 AS hi FROM ev WHERE event_type = 'purchase'),
a AS (SELECT f.event_id, h.event_id AS h1 FROM f JOIN h ON f.session_id = h.session_id AND f.k = h.k QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY h.confidence DESC, h.event_id) = 1),
b AS (SELECT f.event_id, w.event_id AS h2 FROM f JOIN w ON f.session_id = w.session_id AND f.t BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY lo, w.event_id) = 1),
c AS (SELECT f.event_id, h.event_id AS h3 FROM f JOIN h ON f.session_id = h.session_id AND abs(h.t - f.t) <= {2 * HOUR} QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY abs(h.t - f.t), h.confidence DESC, h.event_id) = 1)
SELECT session_id, event_id AS id, coalesce(h1, h2, h3) AS hint, CASE WHEN h1 IS NOT NULL THEN 1 WHEN h2 IS NOT NULL THEN 2 WHEN h3 IS NOT NULL THEN 3 END AS tier FROM f LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id) LEFT JOIN c USING (event_id)""")
def hinted_frames(spark, sf_dir):
    ev = V.events(spark, sf_dir).select("session_id", F.col("event_id").alias("id"), "t", F.col("k").alias("index"), "confidence", "event_type")
    windows = ev.where("event_type = 'purchase'").select("session_id", "id", F.col("t").alias("lo"), (F.col("t") + F.col("index").cast("long") * 60_000_000).alias("hi"))
    return I.hint_join(ev.where("event_type = 'view'").select("session_id", "id", "t", "index"), ev.where("event_type = 'click'"), windows, 2 * HOUR)


@query("WITH RECURSIVE" + V.SQL_EVENTS + f""",
tg AS (SELECT session_id, event_id * 3 + n AS event_id, t + (n - 1) * {HOUR} AS t FROM ev, range(3) r(n) WHERE event_type = 'signup'), rd AS (SELECT session_id, event_id, t, confidence FROM ev WHERE event_type = 'view')"""
+ _exclusive_sql("mm", "tg", "rd", 6) + " SELECT session_id, a_id // 3 AS event_id, a_id % 3 AS n, c_id AS reading, gap FROM mm JOIN mm_p USING (a_id, c_id)")
def offset_readings(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    readings = ev.where("event_type = 'view'").select("session_id", F.col("event_id").alias("id"), "t", "confidence")
    return I.offset_readings(ev.where("event_type = 'signup'"), [-HOUR, 0, HOUR], readings, 6 * HOUR)


@query("WITH" + V.SQL_EVENTS + """,
s AS (SELECT session_id, event_type, side, sum(""" + _NANO.format(c="confidence") + ") AS s, " + _mean_sql("confidence") + """ AS m, count(*) AS votes, first(event_id ORDER BY confidence DESC, event_id) AS best_id FROM ev GROUP BY session_id, event_type, side)
SELECT session_id, event_type, side, m AS confidence, votes, best_id FROM s QUALIFY row_number() OVER (PARTITION BY session_id, event_type ORDER BY s DESC, side) = 1""")
def side_votes(spark, sf_dir):
    return I.vote_side(V.events(spark, sf_dir).withColumn("id", F.col("event_id")), ["session_id", "event_type"]).withColumn("confidence", F.round("confidence", 6))


@query("""
SELECT o_orderkey AS finding, path FROM orders JOIN (SELECT 'r' || (p_partkey % 500) AS rule, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 END AS target, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, p_name AS path FROM part) a
ON a.rule = 'r' || (o_custkey % 500) AND status = 'ok' AND path IS NOT NULL AND (target IS NULL OR o_orderkey % 5 = 0 OR target = o_orderkey % 7)""")
def artifact_lookup(spark, sf_dir):
    key, part = F.col("o_orderkey"), F.col("p_partkey")
    findings = V.table(spark, sf_dir, "orders").select(key.alias("finding"), F.concat(F.lit("r"), F.col("o_custkey") % 500).alias("rule"), F.when(key % 5 != 0, key % 7).alias("target"))
    artifacts = V.table(spark, sf_dir, "part").select(F.concat(F.lit("r"), part % 500).alias("rule"), F.when(part % 3 == 0, part % 7).alias("target"), F.when(F.col("p_size") % 2 == 0, "ok").otherwise("failed").alias("status"), F.col("p_name").alias("path"))
    return I.artifact_lookup(findings, artifacts).select("finding", "path")


@query("WITH" + _ROLES + """,
c AS (SELECT * FROM (VALUES ('control', 'unchanged'), ('change_hidden', 'signal_without_change'), ('signal_hidden', 'change_without_signal'), ('dimmed', 'low_confidence')) v("case", expected))
SELECT session_id, event_id, "case", expected, round(CASE WHEN "case" = 'dimmed' THEN confidence * 0.35 ELSE confidence END, 6) AS confidence FROM raw, c WHERE NOT ("case" = 'change_hidden' AND role = 'change') AND NOT ("case" = 'signal_hidden' AND role = 'signal')""")
def injected_faults(spark, sf_dir):
    return I.inject_faults(_roles(spark, sf_dir), {"change": "change", "signal": "signal"}).select("session_id", "event_id", "case", "expected", F.round("confidence", 6).alias("confidence"))


@query("WITH" + V.SQL_EVENTS + """
SELECT session_id, side, t FROM ev WHERE event_type = 'click'
UNION ALL SELECT session_id, side, t FROM ev b WHERE event_type = 'view' AND NOT EXISTS (FROM ev a WHERE a.event_type = 'click' AND a.session_id = b.session_id AND a.side = b.side AND round(a.t / 10000) = round(b.t / 10000))""")
def change_union(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    of = lambda kind: ev.where(F.col("event_type") == kind).select("session_id", "side", "t")
    return I.change_union(of("click"), of("view"))


_GROUPS = V.SQL_EVENTS + f""",
hits AS (SELECT *, CASE WHEN k % 4 <> 3 THEN side END AS vote FROM ev WHERE confidence >= 0.2 AND event_type IN ('purchase', 'signup')),
s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id, event_type ORDER BY t, event_id) <= {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM hits),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, event_type ORDER BY t, event_id) AS grp FROM s),
g0 AS (SELECT *, min(t) OVER (PARTITION BY session_id, event_type, grp) AS t0 FROM g),
h AS (
  SELECT session_id, event_type AS kind, grp, round(any_value(t0) + sum((t - t0) * confidence) / sum(confidence))::BIGINT AS time, min(t) AS start_t, max(t) AS end_t, count(*) AS frames, avg(confidence) AS mean_conf, first(event_id ORDER BY confidence DESC, t, event_id) AS id,
    CASE WHEN count(*) >= 2 THEN 'CONFIRMED' WHEN max(confidence) >= 0.75 THEN 'INFERRED' ELSE 'UNCERTAIN' END AS status FROM g0 GROUP BY session_id, event_type, grp),
vs AS (SELECT session_id, grp, vote, sum({_NANO.format(c="k / 100")}) AS s, {_mean_sql("k / 100")} AS mean, count(*) AS n, min((t, event_id)) AS seen, first(event_id ORDER BY k DESC, t, event_id) AS best FROM g0 WHERE event_type = 'purchase' AND vote IS NOT NULL GROUP BY session_id, grp, vote),
vo AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY session_id, grp ORDER BY s DESC, seen) = 1)"""


@query("WITH" + _GROUPS + f""",
m AS (SELECT h.id, c.event_id AS c_id, c.confidence AS c_conf FROM h JOIN ev c ON h.kind = 'purchase' AND c.session_id = h.session_id AND c.event_type = 'click' AND c.t BETWEEN h.time - {6 * HOUR} AND h.time + {6 * HOUR} QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY abs(c.t - h.time), c.confidence DESC, c.t, c.event_id) = 1),
x AS (SELECT h.*, c_id, CASE WHEN c_id IS NULL THEN mean_conf ELSE (mean_conf + c_conf) / 2 END AS c FROM h LEFT JOIN m USING (id))
SELECT x.session_id, kind, id, time AS t, start_t, end_t, frames, c_id, round(c, 6) AS confidence, CASE WHEN kind = 'purchase' AND c < 0.58 THEN 'UNCERTAIN' WHEN c_id IS NOT NULL THEN 'CONFIRMED' ELSE status END AS status,
  concat_ws(',', kind, CASE WHEN c_id IS NOT NULL THEN 'change_crosscheck' END) AS sources, vote AS side, mean AS side_conf, n AS side_votes, best AS side_id, kind <> 'purchase' AS supporting
FROM x LEFT JOIN vo ON kind = 'purchase' AND vo.session_id = x.session_id AND vo.grp = x.grp""")
def primary_events(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    hits = ev.where("event_type in ('purchase', 'signup')").select("session_id", F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "t", "confidence", F.when(F.col("k") % 4 != 3, F.col("side")).alias("side"), (F.col("k") / 100).alias("side_conf"))
    out = series.primary_events(hits, _sides(ev, "purchase", "click")[1].drop("c_side"), ["purchase"], 12 * HOUR, 0.2, 6 * HOUR)
    return _joined(out.withColumns({c: F.round(c, 6) for c in ("confidence", "side_conf")}), "sources")


@query("WITH" + V.SQL_EVENTS + f""",
h AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {24 * HOUR} THEN 0 ELSE 1 END AS fresh FROM ev WHERE confidence >= 0.1 AND k >= 20 AND k % 10 <= 7 WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY t, event_id) AS grp FROM h)
SELECT session_id, first(event_id ORDER BY k DESC, t, event_id) AS id, first(t ORDER BY k DESC, t, event_id) AS t, max(k) AS cue, first(confidence ORDER BY k DESC, t, event_id) AS panel, first(k % 10 ORDER BY k DESC, t, event_id) AS display, min(t) AS start_t, max(t) AS end_t, count(*) AS rows FROM g GROUP BY session_id, grp""")
def peak_groups(spark, sf_dir):
    rows = V.events(spark, sf_dir).select("session_id", F.col("event_id").alias("id"), "t", F.col("k").alias("cue"), F.col("confidence").alias("panel"), (F.col("k") % 10).alias("display"))
    return series.peak_groups(rows, ["session_id"], 24 * HOUR, "cue", {"panel": 0.1, "cue": 20}, {"display": 7})


@query("""
WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'Zone ' || (o_orderkey % 3) END AS expected, (o_orderkey % 101) * 10000000 AS own FROM orders),
e AS (SELECT l_orderkey AS id, l_linenumber % 2 AS frame, CASE l_linenumber % 3 WHEN 0 THEN 45 WHEN 1 THEN 20 ELSE 20 END AS weight, CASE WHEN l_partkey % 5 <> 0 THEN 'Zone ' || (l_suppkey % 3) END AS detected, """ + _NANO.format(c="l_quantity::DOUBLE / 50") + """ AS score FROM lineitem),
x AS (SELECT e.*, r.expected, r.own, detected IS NOT NULL AND expected IS NOT NULL AND detected <> expected AS wrong, CASE WHEN detected IS NULL THEN 0 ELSE weight END AS w FROM e JOIN r USING (id)),
y AS (SELECT *, CASE WHEN detected IS NULL OR wrong THEN 0 ELSE score END AS s FROM x),
f AS (SELECT id, frame, sum(w * s)::HUGEINT AS ws, sum(w)::HUGEINT AS sw, max(own) AS own, bool_or(wrong AND score >= 200000000) AS strong FROM y GROUP BY id, frame),
f1 AS (SELECT id, strong, CASE WHEN own > 0 THEN ws + 15 * own ELSE ws END AS num, CASE WHEN own > 0 THEN sw + 15 ELSE sw END AS den FROM f),
f2 AS (SELECT id, strong, CASE WHEN den > 0 THEN (2 * num + den) // (2 * den) ELSE 0 END AS fs FROM f1),
m AS (SELECT id, least(1000000000, (2 * sum(fs)::HUGEINT + count(*)) // (2 * count(*))) AS score, max(fs) AS top, bool_or(strong) AS strong, count(*) AS frames FROM f2 GROUP BY id),
v AS (SELECT id, detected FROM y WHERE detected IS NOT NULL GROUP BY id, detected QUALIFY row_number() OVER (PARTITION BY id ORDER BY sum(score) DESC, detected) = 1),
z AS (SELECT r.id, r.expected, v.detected, m.score, m.top, m.frames, coalesce(m.strong AND v.detected <> r.expected, false) AS conflict FROM r LEFT JOIN m USING (id) LEFT JOIN v USING (id)),
q AS (SELECT *, CASE WHEN frames IS NULL THEN 'NO_EVIDENCE' WHEN expected IS NULL THEN 'NO_EXPECTED' WHEN score >= 750000000 AND NOT conflict THEN 'CONFIRMED' WHEN score <= 450000000 AND conflict THEN 'CONFLICT' WHEN score <= 450000000 AND detected IS NULL THEN 'INSUFFICIENT' WHEN score <= 450000000 THEN 'LOW_MATCH' ELSE 'AMBIGUOUS' END AS status FROM z)
SELECT id AS recovery_id, expected, detected, coalesce(score, 0) / 1e9 AS score, status, CASE status WHEN 'NO_EVIDENCE' THEN 'UNCERTAIN' WHEN 'NO_EXPECTED' THEN 'OBSERVED' WHEN 'CONFIRMED' THEN 'PASS' WHEN 'CONFLICT' THEN 'FAIL' WHEN 'LOW_MATCH' THEN 'FAIL' ELSE 'UNCERTAIN' END AS result,
  CASE status WHEN 'NO_EVIDENCE' THEN 0 WHEN 'NO_EXPECTED' THEN least(1000000000, greatest(score, top)) WHEN 'CONFIRMED' THEN score WHEN 'CONFLICT' THEN greatest(1000000000 - score, 500000000) WHEN 'AMBIGUOUS' THEN greatest(score, 1000000000 - abs(score - 500000000)) ELSE 1000000000 - score END / 1e9 AS confidence, coalesce(frames, 0) AS frames FROM q""")
def location_verdicts(spark, sf_dir):
    key, li = F.col("o_orderkey"), V.table(spark, sf_dir, "lineitem")
    recoveries = V.table(spark, sf_dir, "orders").select(key.alias("recovery_id"), F.when(key % 7 != 0, F.concat(F.lit("Zone "), key % 3)).alias("expected"), (key % 101 / 100).alias("confidence"))
    part = F.element_at(F.array(F.lit("text"), F.lit("map"), F.lit("view")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    evidence = li.select(F.col("l_orderkey").alias("recovery_id"), (F.col("l_linenumber") % 2).alias("frame"), part.alias("component"), F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("Zone "), F.col("l_suppkey") % 3)).alias("detected"), (F.col("l_quantity").cast("double") / 50).alias("score"))
    return C.location_verdicts(recoveries, evidence, {"text": 0.45, "map": 0.2, "view": 0.2}, 0.15).withColumns({c: F.round(c, 9) for c in ("score", "confidence")})


_CHECKS = _RULES + """,
ck AS (
  SELECT session_id, concat_ws(':', session_id, rule, coalesce(incident_id::VARCHAR, 'session')) AS check_id, CASE rule WHEN 'count' THEN 'count_after_signal' WHEN 'signal' THEN 'signal_for_state' ELSE 'recovery_after_down' END AS check_type,
    CASE rule WHEN 'recovery' THEN 'critical' ELSE 'major' END AS severity, result, fi.confidence, result IN ('UNCERTAIN', 'NEED_REVIEW') AS uncertain,
    CASE WHEN result IN ('UNCERTAIN', 'NEED_REVIEW') THEN CASE WHEN incident_id IS NULL THEN 'no_incident' WHEN fi.confidence < 0.5 THEN 'low_confidence' ELSE 'conflicting_evidence' END END AS reason,
    greatest(0, t - 2000000) AS lo, t + 3000000 AS hi, rule FROM fi LEFT JOIN (SELECT event_id AS incident_id, t FROM ev) USING (incident_id))"""


def _checks(spark, sf_dir):
    at = V.events(spark, sf_dir).select(F.col("event_id").alias("incident_id"), "t")
    found = _findings(spark, sf_dir)[1].join(at.hint("shuffle_merge"), "incident_id", "left")
    kinds = {"count": "count_after_signal", "signal": "signal_for_state", "recovery": "recovery_after_down"}
    out = C.build_checks(found, kinds, ["recovery"], 2_000_000, 3_000_000)
    return out.withColumns({"lo": F.when(F.col("hi").isNotNull(), F.col("lo")).otherwise(F.lit(0).cast("long"))})


@query("WITH" + _CHECKS + " SELECT * EXCLUDE (rule) FROM ck")
def built_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query("WITH" + _CHECKS + " SELECT printf('check_%04d', row_number() OVER (ORDER BY session_id, check_type, hi NULLS FIRST, check_id)) AS number, check_id, result FROM ck")
def numbered_checks(spark, sf_dir):
    """Checks numbered over the whole dataset, session by session, by type, time and id."""
    placed = numbered(_checks(spark, sf_dir), "session_id", "check_type", F.asc_nulls_first("hi"), "check_id")
    return placed.select(F.format_string("check_%04d", "number").alias("number"), "check_id", "result")


@query("WITH" + V.SQL_EVENTS + " SELECT event_id, printf('raw_%05d_', row_number() OVER (PARTITION BY session_id ORDER BY source DESC, t, event_id)) || event_type AS raw_id FROM ev")
def raw_ids(spark, sf_dir):
    """Raw events numbered in each session in the order in which its sources are read."""
    return I.raw_ids(V.events(spark, sf_dir), ["b", "a"]).select("event_id", "raw_id")


@query("WITH" + _RULES + """
SELECT session_id, incident_id, unnest(CASE WHEN session_id % 3 = 0 THEN ['list', 'count'] WHEN session_id % 3 = 1 THEN ['map'] ELSE ['whole'] END) AS region FROM fi WHERE result <> 'PASS' AND incident_id IS NOT NULL""")
def selected_evidence(spark, sf_dir):
    found = _findings(spark, sf_dir)[1].where("incident_id is not null")
    rows = found.select(F.struct("session_id", "incident_id").alias("finding"), F.when(F.col("session_id") % 3 == 0, "count").otherwise("none").alias("rule"), F.when(F.col("session_id") % 3 == 1, "recovery").alias("event_type"), "result")
    return C.select_evidence(rows, {"PASS": False}, {"count": ["list", "count"], "same_place": ["map"]}, {"recovery": "same_place"}, ["whole"]).select("finding.*", "region")


_HASHES = r"""
tk AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
nn AS (SELECT doc_id, any_value(lang) AS lang, list(('0x' || substr(md5(w), 1, 4))::INTEGER % 65) AS bs, count(*) AS n FROM tk GROUP BY doc_id HAVING count(*) >= 20),
dd AS (SELECT doc_id, lang, list_transform(range(0, 65), lambda i: len(list_filter(bs, lambda x: x = i))) AS c FROM nn),
hh AS MATERIALIZED (SELECT lang, doc_id AS id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN c[i + 1] > c[i] THEN 2::HUGEINT ** (i - 1) ELSE 0 END))::HUGEINT AS h FROM dd)"""
_HASHES = _HASHES.replace("2::HUGEINT ** (i - 1)", "(1::HUGEINT << (i - 1)::HUGEINT)")


def _representatives_sql(rows: str) -> str:
    """Tables that end in rp: id and the representative it repeats, of the rows (lang, id, h) in `rows`."""
    return f""",
ho AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS n FROM {rows}),
rr AS (
  SELECT lang, 0::BIGINT AS n, CAST([] AS STRUCT(id BIGINT, h HUGEINT)[]) AS reps, NULL::BIGINT AS id, NULL::BIGINT AS rep FROM (SELECT DISTINCT lang FROM ho)
  UNION ALL
  SELECT ho.lang, ho.n, CASE WHEN f IS NULL THEN list_append(rr.reps, {{'id': ho.id, 'h': ho.h}}) ELSE rr.reps END, ho.id, coalesce(f.id, ho.id)
  FROM rr JOIN ho ON ho.lang = rr.lang AND ho.n = rr.n + 1, LATERAL (SELECT list_filter(rr.reps, lambda x: bit_count(xor(x.h, ho.h)) <= 8)[1] AS f)),
rp AS (SELECT lang, id, rep FROM rr WHERE id IS NOT NULL)"""


@query("WITH RECURSIVE" + _HASHES + _representatives_sql("hh") + " SELECT lang AS grp, id, rep AS representative FROM rp")
def representatives(spark, sf_dir):
    return C.representatives(settle(V.document_hashes(spark, sf_dir)))


@query("WITH RECURSIVE" + _HASHES + """,
cd AS (SELECT hh.lang, hh.id, hh.id // 10 AS event, hh.id % 3 AS kind, (hh.id * 37 % 101) / 100.0::DOUBLE AS confidence, (hh.id * 13 % 97) / 100.0::DOUBLE AS quality, h FROM hh),
cr AS (SELECT *, [CASE WHEN quality < 0.1 THEN 'poor_quality' END, CASE WHEN kind = 2 THEN 'unknown_kind' END, CASE WHEN kind = 0 AND confidence < 0.3 OR kind = 1 AND confidence < 0.5 THEN 'low_confidence' END, CASE WHEN row_number() OVER (PARTITION BY event ORDER BY confidence DESC, id) > 6 THEN 'not_selected' END] AS why FROM cd),
ck AS (SELECT lang, id, h FROM cr WHERE len(list_filter(why, lambda x: x IS NOT NULL)) = 0)""" + _representatives_sql("ck") + """
SELECT cr.id, CASE WHEN rep IS NULL THEN 'review' WHEN rep <> cr.id THEN 'duplicate' ELSE 'promoted' END AS decision, CASE WHEN rep <> cr.id THEN rep END AS duplicate_of, array_to_string(list_filter(why, lambda x: x IS NOT NULL), ',') AS reasons FROM cr LEFT JOIN rp ON rp.id = cr.id""")
def promotions(spark, sf_dir):
    i = F.col("id")
    rows = settle(V.document_hashes(spark, sf_dir)).withColumns({"event": F.floor(i / 10), "kind": F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (i % 3 + 1).cast("int")), "confidence": i * 37 % 101 / 100, "quality": i * 13 % 97 / 100})
    return C.promotions(rows, {"a": 0.3, "b": 0.5}, 0.1, 6).withColumn("reasons", F.array_join("reasons", ","))


@query("WITH RECURSIVE" + _HASHES + """,
lg AS (SELECT *, bit_count(xor(h, lag(h) OVER (PARTITION BY lang ORDER BY id)))::INTEGER AS distance FROM hh),
mv AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS n FROM lg WHERE distance >= 24),
th AS (
  SELECT lang, id, distance, n, id AS kept, true AS keep FROM mv WHERE n = 1
  UNION ALL SELECT mv.lang, mv.id, mv.distance, mv.n, CASE WHEN mv.id - th.kept >= 20 THEN mv.id ELSE th.kept END, mv.id - th.kept >= 20 FROM th JOIN mv ON mv.lang = th.lang AND mv.n = th.n + 1)
SELECT lang AS grp, id, id AS t, distance FROM th WHERE keep""")
def hash_changes(spark, sf_dir):
    return C.hash_changes(settle(V.document_hashes(spark, sf_dir)).withColumn("t", F.col("id")), ["grp"], 24, 20, width=100_000)


WAYPOINTS = [(990.0, 327.0), (300.0, 150.0), (1500.0, 500.0), (990.0, 100.0)]


def _waypoint_sql() -> str:
    steps = []
    for i, (x, y) in enumerate(WAYPOINTS):
        after = f"JOIN w{i - 1} l ON l.session_id = p.session_id AND (p.t, p.id) > (l.t, l.id) " if i else ""
        steps.append(f",\nw{i} AS (SELECT p.session_id, min(p.t) AS t, arg_min(p.id, (p.t, p.id)) AS id FROM po p {after}WHERE sqrt((p.x - {x}) ** 2 + (p.y - {y}) ** 2) <= 100 GROUP BY p.session_id)")
    return "WITH" + V.SQL_POSITIONS + "".join(steps) + " UNION ALL ".join(f"\nSELECT session_id, {i} AS waypoint, t, id FROM w{i}" for i in range(len(WAYPOINTS)))


@query(_waypoint_sql())
def waypoint_progress(spark, sf_dir):
    return C.waypoint_progress(V.positions(spark, sf_dir), WAYPOINTS, 100.0)


@query("""
WITH f AS (SELECT l_orderkey AS frame, l_linenumber AS region, l_discount::DOUBLE * 10 AS bright, l_tax::DOUBLE * 12.5 AS edge, l_quantity::DOUBLE / 50 AS sat FROM lineitem),
s AS (SELECT *, least(1, greatest(0, 0.6 * least(1, greatest(0, (bright - 0.2) / 0.6)) + 0.4 * least(1, greatest(0, edge / 0.8)))) AS up, least(1, greatest(0, 0.7 * least(1, greatest(0, (sat - 0.5) / 0.5)) + 0.3 * least(1, greatest(0, (0.6 - bright) / 0.6)))) AS down FROM f)
SELECT frame, region, round(up, 6) AS up, round(down, 6) AS down, CASE WHEN greatest(round(up, 9), round(down, 9)) < 0.4 THEN 'unknown' WHEN round(down, 9) >= round(up, 9) THEN 'down' ELSE 'up' END AS state FROM s""")
def evidence_scores(spark, sf_dir):
    f = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("region"), (F.col("l_discount").cast("double") * 10).alias("bright"), (F.col("l_tax").cast("double") * 12.5).alias("edge"), (F.col("l_quantity").cast("double") / 50).alias("sat"))
    up, down = S.capped_score([(0.6, F.col("bright"), 0.2, 0.8), (0.4, F.col("edge"), 0.0, 0.8)]), S.capped_score([(0.7, F.col("sat"), 0.5, 1.0), (0.3, F.col("bright"), 0.6, 0.0)])
    scored = f.select("frame", "region", up.alias("up"), down.alias("down"))
    return scored.select("frame", "region", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"), S.argmax_with_priority([("down", F.round("down", 9)), ("up", F.round("up", 9))], 0.4)["state"].alias("state"))


@query("""
WITH f AS (SELECT l_orderkey AS frame, l_linenumber AS region, l_discount::DOUBLE * 10 AS a, (l_linenumber / 10.0)::DOUBLE AS b, (l_partkey % 11 / 10.0)::DOUBLE AS c, (l_suppkey % 11 / 10.0)::DOUBLE AS d, l_quantity::DOUBLE / 50 AS q FROM lineitem),
g AS (SELECT *, 0.30 * a + 0.35 * b + 0.20 * c + 0.10 * d + 0.05 * a AS display, greatest(CASE WHEN q > 0.9 THEN c ELSE 0 END, d * 0.5 * 0.85, CASE WHEN q < 0.2 THEN d ELSE 0 END) AS panel FROM f),
h AS (SELECT *, greatest(d * 0.5, panel * 0.92, (1 - b) * 0.30 + (1 - c) * 0.25 + CASE WHEN q < 0.2 THEN d ELSE 0 END * 0.45) AS down, display * (1 - least(0.85, panel)) AS up, CASE WHEN q > 0.5 AND q < 0.6 THEN a ELSE 0 END AS rec FROM g)
SELECT frame, region, round(up, 8) AS up, round(down, 8) AS down, round(panel, 8) AS panel, round(greatest(rec, CASE WHEN rec > 0 THEN up * 0.7 ELSE 0 END), 8) AS recovered,
  round(CASE WHEN greatest(a, b, d) < 0.12 THEN (1 - a) * 0.25 + (1 - b) * 0.25 + (1 - d) * 0.25 + (1 - a) * 0.25 ELSE 0 END, 8) AS menu FROM h""")
def state_scores(spark, sf_dir):
    col = lambda c: F.col(c).cast("double")
    a, b, c, d, q = col("l_discount") * 10, F.col("l_linenumber") / 10, F.col("l_partkey") % 11 / 10, F.col("l_suppkey") % 11 / 10, col("l_quantity") / 50
    made = S.state_scores({"health": a, "tool": b, "aim": c, "map": d, "bar": a}, {"down": d * 0.5, "panel": F.when(q > 0.9, c).otherwise(0.0)}, {"panel": F.when(q < 0.2, d).otherwise(0.0), "recovered": F.when((q > 0.5) & (q < 0.6), a).otherwise(0.0)})
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("region"), *[F.round(made[k], 8).alias(k) for k in ("up", "down", "panel", "recovered", "menu")])


@query("SELECT l_orderkey AS frame, l_linenumber AS region FROM lineitem WHERE l_quantity * 2 >= 45 AND l_discount >= 0.08 AND l_tax >= 0.04 AND (l_partkey % 10 / 100.0 >= 0.04 OR l_suppkey % 10 / 100.0 >= 0.04)")
def gated_frames(spark, sf_dir):
    f = V.table(spark, sf_dir, "lineitem")
    shown = S.display_gate(F.col("l_quantity").cast("double") * 2, F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_partkey") % 10 / 100, F.col("l_suppkey") % 10 / 100)
    return f.where(shown).select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("region"))


@query("""
WITH f AS (SELECT l_orderkey AS frame, l_linenumber AS region, l_discount::DOUBLE / 5 AS a1, l_tax::DOUBLE / 4 AS b1, l_tax::DOUBLE / 5 AS a2, l_quantity::DOUBLE / 2500 AS b2 FROM lineitem),
s AS (SELECT frame, region, CASE WHEN a1 + b1 >= 0.003 THEN CASE WHEN a1 > b1 THEN 'x' ELSE 'y' END END AS p, CASE WHEN a1 + b1 >= 0.003 THEN abs(a1 - b1) / (a1 + b1) * least(1, (a1 + b1) * 80) ELSE 0 END AS pc, CASE WHEN a2 + b2 >= 0.003 THEN CASE WHEN a2 > b2 THEN 'x' ELSE 'y' END END AS q, CASE WHEN a2 + b2 >= 0.003 THEN abs(a2 - b2) / (a2 + b2) * least(1, (a2 + b2) * 80) ELSE 0 END AS qc FROM f),
c AS (SELECT *, CASE WHEN p = q AND pc >= 0.55 AND qc >= 0.55 THEN 'same_side_rejected' WHEN p IS NOT NULL AND pc >= 0.55 AND (q IS NULL OR p = q) THEN 'second_inferred' WHEN q IS NOT NULL AND qc >= 0.55 AND (p IS NULL OR p = q) THEN 'first_inferred' END AS note FROM s),
d AS (SELECT frame, region, note, CASE note WHEN 'same_side_rejected' THEN NULL WHEN 'first_inferred' THEN CASE q WHEN 'x' THEN 'y' ELSE 'x' END ELSE p END AS "first", CASE note WHEN 'same_side_rejected' THEN NULL WHEN 'second_inferred' THEN CASE p WHEN 'x' THEN 'y' ELSE 'x' END ELSE q END AS "second",
  CASE WHEN note = 'first_inferred' THEN greatest(pc, qc * 0.8) ELSE pc END AS pc, CASE WHEN note = 'second_inferred' THEN greatest(qc, pc * 0.8) ELSE qc END AS qc FROM c),
e AS (SELECT *, CASE WHEN pc > 0 AND qc > 0 THEN (pc + qc) / 2 ELSE pc + qc END AS conf FROM d)
SELECT frame, region, "first", "second", round(conf, 6) AS confidence, CASE WHEN "first" <> "second" AND conf >= 0.25 THEN 'ok' ELSE 'low_confidence' END AS status, note FROM e""")
def relations(spark, sf_dir):
    of = lambda c, n: F.col(c).cast("double") / n
    r = S.relation(of("l_discount", 5), of("l_tax", 4), of("l_tax", 5), of("l_quantity", 2500), "x", "y")
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("region"), r.alias("r")).select("frame", "region", "r.*").withColumn("confidence", F.round("confidence", 6))


@query(r"""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS a, CASE WHEN p_partkey % 3 <> 0 THEN upper(p_brand) ELSE 'Brand#99' END AS b, CASE WHEN p_partkey % 5 <> 0 THEN 'place_conflict:' || p_brand || '!=' || ' Zone ' || (p_size % 4) || '@0.' || (p_partkey % 90 + 10) ELSE 'seen' END AS note FROM part),
x AS (SELECT *, regexp_replace(lower(coalesce(a, '')), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(coalesce(b, '')), '[^a-z0-9]', '', 'g') AS y FROM n)
SELECT p_partkey, CASE WHEN x = '' AND y = '' THEN 'unresolved' WHEN x = 'brand23' THEN 'own' WHEN y = 'brand23' THEN 'own_down' ELSE 'other' END AS scope, nullif(trim(regexp_extract(note, 'conflict:([^!=@]+)!=([^@]+)@([0-9.]+)', 1)), '') AS observed, nullif(trim(regexp_extract(note, 'conflict:([^!=@]+)!=([^@]+)@([0-9.]+)', 2)), '') AS expected,
  try_cast(nullif(regexp_extract(note, 'conflict:([^!=@]+)!=([^@]+)@([0-9.]+)', 3), '') AS DOUBLE) AS confidence, p_partkey + 0.5::DOUBLE AS at, note = 'seen' AS tagged FROM x""")
def parsed_notes(spark, sf_dir):
    key, brand = F.col("p_partkey"), F.col("p_brand")
    note = F.when(key % 5 != 0, F.concat(F.lit("place_conflict:"), brand, F.lit("!= Zone "), F.col("p_size") % 4, F.lit("@0."), key % 90 + 10)).otherwise("seen")
    n = V.table(spark, sf_dir, "part").select("p_partkey", F.when(key % 4 != 0, brand).alias("a"), F.when(key % 3 != 0, F.upper(brand)).otherwise("Brand#99").alias("b"), note.alias("note"), F.concat(F.lit("crop_t"), key, F.lit(".5_x")).alias("name"))
    return n.select("p_partkey", S.actor_scope(F.col("a"), F.col("b"), F.lit("brand 23")).alias("scope"), S.parse_conflict(F.col("note")).alias("c"), S.time_in_name(F.col("name")).alias("at"), S.notes_contain("seen", F.array("note"), F.lit(None).cast("array<string>")).alias("tagged")).select("p_partkey", "scope", "c.*", "at", "tagged")


@query("""
SELECT user_id AS session_id, event_id, 'feed' AS source, event_type, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + 2000000 END AS end_t, greatest(0, least(1, value / 100)) AS confidence, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE 'UNKNOWN' END AS status FROM events""")
def normalized_events(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (at / 1_000_000).cast("decimal(20,6)")
    raw = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.lit("feed").alias("source_module"), "event_type", F.lit(None).cast("double").alias("time"), seconds.cast("double").alias("timestamp_sec"), F.when(F.col("event_id") % 3 == 0, (at / 1_000_000 + 2).cast("double")).alias("end_time"), (F.col("value") / 100).cast("string").alias("confidence"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("status"))
    return reports.normalize_events(raw)


@query("""
WITH r AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN turn % 2 = 0 THEN turn * 0.5 END AS t, length(text) % 500 AS d, CASE WHEN turn % 3 = 0 THEN 'key_press' END AS type, role FROM conversations)
SELECT session_id, seq, (coalesce(max(round(t * 1000)) OVER g, 0) + sum(CASE WHEN t IS NULL THEN coalesce(d, 0) ELSE 0 END) OVER (g ORDER BY seq))::BIGINT AS t_ms, coalesce(type, 'key_' || role) AS kind, seq % 3 AS code
FROM (SELECT *, count(t) OVER (PARTITION BY session_id ORDER BY seq) AS known FROM r) WINDOW g AS (PARTITION BY session_id, known)""")
def normalized_actions(spark, sf_dir):
    turn = F.col("turn")
    raw = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), turn.alias("seq"), F.when(turn % 2 == 0, turn * 0.5).alias("t"), F.lit(None).cast("double").alias("time"), (F.length("text") % 500).alias("delay_ms"), F.when(turn % 3 == 0, "key_press").alias("type"), F.lit("keyboard").alias("kind"), F.col("role").alias("action"), (turn % 3).alias("code"))
    return A.normalize_actions(raw)


@query("""
WITH a AS (SELECT l_partkey % 700 AS path, l_orderkey AS event_id, CASE WHEN l_linenumber > 2 THEN l_suppkey END AS check_id, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
SELECT path, 'event' AS kind, event_id AS id, min(seq) AS seq FROM a GROUP BY ALL UNION ALL SELECT path, 'check', check_id, min(seq) FROM a WHERE check_id IS NOT NULL GROUP BY ALL""")
def evidence_index(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 700).alias("path"), F.col("l_orderkey").alias("event_id"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("check_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return R.evidence_index(li)


@query("""
SELECT p_partkey, CASE replace(trim(lower(p_type)), ' ', '_') WHEN 'standard_brass' THEN 'brass' WHEN 'economy_tin' THEN 'tin' ELSE replace(trim(lower(p_type)), ' ', '_') END AS class,
  CASE WHEN p_size % 3 = 0 THEN greatest(0.5, p_size / 50.0) WHEN p_size % 3 = 1 THEN greatest(0.5, least(0.9, p_size / 50.0)) ELSE 0.7 END::DOUBLE AS confidence,
  (p_size // 7) * 7 + 3.5::DOUBLE AS centre, 60 - p_size AS rx, p_partkey % 40 AS ry, greatest(5.0, least(20.0, p_size))::DOUBLE AS held, p_partkey % 40 - 3 AS bx, p_size + 6 AS bw, round_even(p_size * 1.5, 0)::BIGINT AS scaled FROM part""")
def frame_values(spark, sf_dir):
    size, x = F.col("p_size").cast("double"), F.col("p_partkey") % 40
    kind = S.normalize_class(F.col("p_type"), {"standard_brass": "brass", "economy_tin": "tin"})
    share = size / 50
    conf = S.region_confidence(F.when(F.col("p_size") % 3 == 0, share), F.when(F.col("p_size") % 3 == 1, share))
    turned, grown = S.rotated(x, F.col("p_size"), 60), S.expand_box(x, F.col("p_size"), F.col("p_size"), F.col("p_size"), 3)
    return V.table(spark, sf_dir, "part").select("p_partkey", kind.alias("class"), conf.cast("double").alias("confidence"), S.cell_centre(size, 7.0).alias("centre"), turned["x"].cast("int").alias("rx"), turned["y"].alias("ry"), S.clamped(size, 5.0, 20.0).alias("held"), grown["x"].alias("bx"), grown["w"].alias("bw"), S.rescale(size, 1.5).alias("scaled"))


@query("WITH" + V.SQL_READINGS + f""",
d AS (SELECT session_id, channel, t // {28 * 24 * HOUR} AS month, value, count(*) AS n, avg(confidence) AS c, min((t, id)) AS seen FROM rd WHERE value IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY session_id, channel, month ORDER BY n DESC, seen) = 1)
SELECT session_id, channel, month, value::VARCHAR AS value, round(c, 9) AS confidence, n::VARCHAR AS votes FROM b""")
def sql_votes(spark, sf_dir):
    """The registered aggregate, called by name over a view: the most read value of each channel's four weeks."""
    V.register(spark, sf_dir, "sf_")
    register_functions(spark)
    told = spark.sql(f"SELECT session_id, channel, t DIV {28 * 24 * HOUR} AS month, split(stable_vote(value, confidence, t, id), ':') AS v FROM sf_readings GROUP BY ALL")
    return told.select("session_id", "channel", "month", F.col("v")[0].alias("value"), F.round(F.col("v")[1].cast("double"), 9).alias("confidence"), F.col("v")[2].alias("votes"))


@query("WITH" + V.SQL_ACTIONS + """
SELECT session_id, code, unnest(CASE WHEN kind = 'mouse_click' THEN [t_ms, t_ms + 30] ELSE [t_ms] END) AS at_ms, unnest(CASE WHEN kind = 'mouse_click' THEN ['mouse_down', 'mouse_up'] ELSE [kind] END) AS action FROM ac""")
def sql_actions(spark, sf_dir):
    """The registered table function, called by name for every row of a view."""
    V.register(spark, sf_dir, "sf_")
    register_functions(spark)
    return spark.sql("SELECT a.session_id, a.code, e.at_ms, e.action FROM sf_actions a, LATERAL expand_action(a.kind, a.t_ms, a.duration_ms) e")


def _ladder_sql(name: str, of: dict[str, str], most: float | None = None) -> str:
    terms, factor, own = evidence.LADDERS[name]
    detail = " OR ".join(f"{of[c]} > {x}::DOUBLE" for c, x in evidence.DETAIL.items())
    value = lambda c: f"CASE WHEN {detail} THEN {of['dark_ratio']} ELSE 0 END" if c == "dark_detail" else of[c]
    total = " + ".join(["0::DOUBLE"] + [f"{w}::DOUBLE * " + (f"({value(c)})" if full is None else f"least(1, ({value(c)}) / {full}::DOUBLE)") for c, w, full in terms])
    return f"round(greatest(0, least({own if most is None else most}::DOUBLE, ({total}) * {factor}::DOUBLE)), 9)"


_FEATURES = {"edge_density": "e", "contrast": "c", "bright_ratio": "b", "saturation_ratio": "s", "text_like_density": "x", "dark_ratio": "d"}
_FEATURE_ROWS = """
WITH f AS (SELECT l_orderkey AS frame, l_linenumber AS region, l_discount::DOUBLE AS b, l_tax::DOUBLE AS e, l_quantity::DOUBLE / 200 AS s, (l_partkey % 97)::DOUBLE / 80 AS c, (l_suppkey % 31)::DOUBLE / 400 AS x, (l_partkey % 21)::DOUBLE / 20 AS d FROM lineitem)"""


@query(_FEATURE_ROWS + " SELECT frame, region, " + ", ".join(f"{_ladder_sql(n, _FEATURES)} AS {'returned' if n == 'return' else n}_score" for n in evidence.LADDERS) + """,
  CASE WHEN b >= 0.02 AND e >= 0.03 AND d >= 0.85 AND c * 100 <= 65 THEN round(least(0.82, 0.45 + 5.0::DOUBLE * b + 2.5::DOUBLE * e + 0.15::DOUBLE * d), 9) END AS structure FROM f""")
def evidence_ladders(spark, sf_dir):
    """Every score of functions.evidence over rows of features."""
    f = _feature_rows(spark, sf_dir)
    scores = [F.round(evidence.ladder(n, _feature_columns()), 9).alias(("returned" if n == "return" else n) + "_score") for n in evidence.LADDERS]
    structure = F.round(evidence.panel_structure(F.col("b"), F.col("e"), F.col("d"), F.col("c") * 100), 9)
    return f.select("frame", "region", *scores, structure.alias("structure"))


def _feature_rows(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return V.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("region"), F.col("l_discount").cast("double").alias("b"), F.col("l_tax").cast("double").alias("e"), (F.col("l_quantity").cast("double") / 200).alias("s"),
        ((part % 97).cast("double") / 80).alias("c"), ((supp % 31).cast("double") / 400).alias("x"), ((part % 21).cast("double") / 20).alias("d"),
    )


def _feature_columns(shift: float = 0.0):
    return {name: F.col(c) + shift for name, c in _FEATURES.items()}


@query(_FEATURE_ROWS + ", p AS (SELECT frame, region, " + _ladder_sql("panel", _FEATURES, 1.0).replace("round(", "(").replace(", 9)", ")") + " AS panel, " + _ladder_sql("cue", _FEATURES).replace("round(", "(").replace(", 9)", ")") + " AS cue, "
+ _ladder_sql("bar", _FEATURES).replace("round(", "(").replace(", 9)", ")") + " AS bar, " + _ladder_sql("bar", {k: f"({v} + 0.1::DOUBLE)" for k, v in _FEATURES.items()}).replace("round(", "(").replace(", 9)", ")") + """ AS other FROM f)
SELECT frame, region, round(least(1, 0.3::DOUBLE * panel + 0.5::DOUBLE * cue + 0.2::DOUBLE * (1 - (bar + other) / 2)), 9) AS score, round(cue, 9) AS cue, round((bar + other) / 2, 9) AS display FROM p""")
def down_scores(spark, sf_dir):
    told = evidence.down_score(_feature_columns(), _feature_columns(), _feature_columns(), _feature_columns(0.1))
    return _feature_rows(spark, sf_dir).select("frame", "region", told.alias("d")).select("frame", "region", *(F.round(f"d.{c}", 9).alias(c) for c in ("score", "cue", "display")))


@query("""
WITH r AS (SELECT o_custkey AS session_id, o_orderkey AS id FROM orders),
v AS (SELECT session_id, CASE id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'UNCERTAIN' WHEN 3 THEN 'OBSERVED' END AS result FROM r WHERE id % 5 < 4),
a AS (SELECT session_id, count(*) AS recoveries FROM r GROUP BY 1),
b AS (SELECT session_id, count(*) AS checks, count(*) FILTER (result = 'PASS') AS pass, count(*) FILTER (result = 'FAIL') AS fail, count(*) FILTER (result = 'UNCERTAIN') AS uncertain, count(*) FILTER (result = 'OBSERVED') AS observed FROM v GROUP BY 1)
SELECT session_id, recoveries, coalesce(checks, 0) AS checks, coalesce(pass, 0) AS pass, coalesce(fail, 0) AS fail, coalesce(uncertain, 0) AS uncertain, coalesce(observed, 0) AS observed, greatest(0, recoveries - 10) AS skipped FROM a LEFT JOIN b USING (session_id)""")
def location_summaries(spark, sf_dir):
    r = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"))
    verdicts = r.where("id % 5 < 4").select("session_id", F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "UNCERTAIN", "OBSERVED"))), (F.col("id") % 5 + 1).cast("int")).alias("result"))
    return R.location_summary(r, verdicts, 10)


@query("WITH" + _RULES + """,
i AS (SELECT session_id, count(*) AS items, count(*) FILTER (result = 'FAIL') AS fail, count(*) FILTER (result = 'NEED_REVIEW') AS need_review, count(*) FILTER (result = 'UNCERTAIN') AS uncertain, count(*) FILTER (result = 'PASS') AS pass FROM fi WHERE incident_id IS NOT NULL GROUP BY 1),
a AS (SELECT session_id, count(*) FILTER (k % 5 > 1) AS artifacts_ok, count(*) FILTER (k % 5 = 0) AS artifacts_missing, count(*) FILTER (k % 5 = 1) AS artifacts_disabled FROM ev WHERE k % 2 = 0 GROUP BY 1)
SELECT i.*, coalesce(artifacts_ok, 0) AS artifacts_ok, coalesce(artifacts_missing, 0) AS artifacts_missing, coalesce(artifacts_disabled, 0) AS artifacts_disabled FROM i LEFT JOIN a USING (session_id)""")
def evidence_summaries(spark, sf_dir):
    k = F.col("k")
    artifacts = V.events(spark, sf_dir).where("k % 2 = 0").select("session_id", F.when(k % 5 > 1, "ok").when(k % 5 == 0, "missing").otherwise("disabled").alias("status"))
    return R.evidence_summary(_findings(spark, sf_dir)[1].where("incident_id is not null"), artifacts)


@query("WITH" + _RULES + _VERDICTS + """,
r AS (SELECT c_custkey AS session_id, CASE WHEN c_custkey % 11 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM customer)
SELECT count(*) AS runs, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status <> 'COMPLETED') AS failed, count(*) FILTER (status = 'COMPLETED' AND verdict = 'FAIL') AS fail, count(*) FILTER (status = 'COMPLETED' AND verdict = 'NEED_REVIEW') AS need_review,
  count(*) FILTER (status = 'COMPLETED' AND verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (status = 'COMPLETED' AND verdict = 'PASS') AS pass, count(*) FILTER (status = 'COMPLETED' AND verdict IS NULL) AS unknown FROM r LEFT JOIN vd USING (session_id)""")
def run_counts(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    runs = V.table(spark, sf_dir, "customer").select(key.alias("session_id"), F.when(key % 11 == 0, "FAILED").otherwise("COMPLETED").alias("status"))
    return R.run_summary(runs, R.session_verdicts(_three_objectives(spark, sf_dir), ["session_id"]))


@query("WITH" + V.SQL_EVENTS + f", s AS (SELECT event_type, CASE {_STATUS.removeprefix('CASE')} AS r FROM ev), n AS (SELECT event_type, CASE r WHEN 5 THEN 'CONFIRMED' WHEN 3 THEN 'OBSERVED' WHEN 1 THEN 'FAIL' ELSE 'UNKNOWN' END AS status FROM s) SELECT event_type, status, count(*) AS events FROM n GROUP BY GROUPING SETS ((event_type, status), (status))")
def event_statuses(spark, sf_dir):
    return R.status_counts(_with_status(V.events(spark, sf_dir)), "event_type")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
