"""Input logs: normalising, expanding, repeating and summarising actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .incidents import numbered
from .timeline import running_last


def expand_actions(actions: DataFrame, default_ms: int = 30) -> DataFrame:
    """Presses and clicks become a down and, duration_ms later, an up (session_id, t_ms, kind, code, duration_ms)."""
    until = F.col("t_ms") + F.coalesce("duration_ms", F.lit(default_ms))
    row = lambda t, k: F.struct(t.cast("long").alias("t_ms"), k.alias("kind"))
    device = F.split(F.col("kind"), "_")[0]
    both = F.array(row(F.col("t_ms"), F.concat(device, F.lit("_down"))), row(until, F.concat(device, F.lit("_up"))))
    out = actions.withColumn("e", F.explode(F.when(F.col("kind").isin("key_press", "mouse_click"), both).otherwise(F.array(row(F.col("t_ms"), F.col("kind"))))))
    return out.select("session_id", "e.t_ms", "e.kind", "code")


def repeat_scenario(actions: DataFrame, times: int, width: int = 600_000) -> DataFrame:
    """The ordered log n times over, at least once, with a running index per session; places are counted in chunks of width milliseconds."""
    placed = numbered(actions, ["session_id"], "t_ms", ["kind", "code"], "_place", width)
    size = actions.groupBy("session_id").agg(F.count("*").alias("_size"))
    again = placed.join(size.hint("shuffle_merge"), "session_id").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(max(1, times) - 1))))
    return again.withColumn("index", (F.col("run") * F.col("_size") + F.col("_place")).cast("int")).drop("_place", "_size")


def held_inputs(actions: DataFrame) -> DataFrame:
    """Codes whose last down or up of a session is a down."""
    last = actions.where(F.col("kind").endswith("_down") | F.col("kind").endswith("_up")).groupBy("session_id", "code").agg(F.max_by(F.struct("kind", "t_ms"), F.struct("t_ms", "kind")).alias("last"))
    return last.where(F.col("last.kind").endswith("_down")).select("session_id", "code", F.col("last.t_ms").alias("t_ms"))


def recording_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("session_id").agg(F.count("*").alias("actions"), F.count_distinct("code").alias("codes"), F.round(F.max("t_ms") / 1000, 4).alias("duration"), F.count_if(F.col("kind").endswith("_down")).alias("downs"))


def normalize_actions(raw: DataFrame) -> DataFrame:
    """Current rows (type) and legacy ones (kind, action, delay_ms) as session_id, seq, t_ms, kind, code, in order of seq.

    A row with a time (t, else time, in seconds) sets the clock. One without starts its delay after the row before it, so
    its time is the last known one plus the delays since, from 0 where none is known yet.
    """
    known = F.round(F.coalesce("t", "time") * 1000).cast("long")
    rows = raw.withColumns({"_known": known, "_wait": F.when(known.isNull(), F.coalesce("delay_ms", F.lit(0))).otherwise(0).cast("long"), "_c": F.floor(F.col("seq") / 100_000)})
    inside = F.sum("_wait").over(W.partitionBy("session_id", "_c").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    per = rows.groupBy("session_id", "_c").agg(F.sum("_wait").alias("_d"))
    before = per.select("session_id", "_c", (F.sum("_d").over(W.partitionBy("session_id").orderBy("_c")) - F.col("_d")).alias("_before"))
    waited = rows.withColumn("_in", inside).join(before.hint("shuffle_merge"), ["session_id", "_c"]).withColumn("_waited", F.col("_in") + F.col("_before"))
    # the clock less what was waited until it was set, carried on
    held = running_last(waited.drop("_c"), ["session_id"], "seq", "seq", F.col("_known") - F.col("_waited"), "_clock", 100_000)
    kind = F.coalesce("type", F.concat_ws("_", F.when(F.col("kind") == "keyboard", "key").otherwise(F.col("kind")), F.col("action")))
    return held.select("session_id", "seq", (F.coalesce("_clock", F.lit(0)) + F.col("_waited")).cast("long").alias("t_ms"), kind.alias("kind"), "code")
