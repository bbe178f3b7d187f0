"""Order within a key, in time, without one task per key.

A key's rows are cut into chunks of time; windows run inside chunks, and what a chunk needs from earlier ones
comes from a summary of one row per chunk. So a session that holds a third of all rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .chunks import DAY, greedy_match, throttle

__all__ = ["greedy_match", "throttle"]


def _chunk(t: str, width: int) -> Column:
    return F.floor(F.col(t) / width).alias("_c")


def with_previous(df: DataFrame, keys: list[str], t: str, tie: str, columns: list[str], name: str = "prev", width: int = 7 * DAY) -> DataFrame:
    """df with `name`, a struct of the columns of the row before in (t, tie) order; null for a key's first row."""
    row = F.struct(*columns)
    chunked = df.withColumn("_c", _chunk(t, width))
    near = chunked.withColumn("_near", F.lag(row).over(W.partitionBy(*keys, "_c").orderBy(t, tie)))
    last = chunked.groupBy(*keys, "_c").agg(F.max_by(row, F.struct(t, tie)).alias("_last"))
    carried = last.select(*keys, "_c", F.lag("_last").over(W.partitionBy(*keys).orderBy("_c")).alias("_far"))
    joined = near.join(carried.hint("shuffle_merge"), [*keys, "_c"], "left")
    return joined.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_c")


def running_last(df: DataFrame, keys: list[str], t: str, tie: str, value: Column, name: str, width: int = 7 * DAY) -> DataFrame:
    """df with the last non-null `value` at or before each row in (t, tie) order."""
    chunked = df.withColumns({"_v": value, "_c": _chunk(t, width)})
    near = chunked.withColumn("_near", F.last("_v", True).over(W.partitionBy(*keys, "_c").orderBy(t, tie).rowsBetween(W.unboundedPreceding, 0)))
    last = chunked.where("_v is not null").groupBy(*keys, "_c").agg(F.max_by("_v", F.struct(t, tie)).alias("_last"))
    every = chunked.select(*keys, "_c").distinct().join(last.hint("shuffle_merge"), [*keys, "_c"], "left")
    carried = every.select(*keys, "_c", F.last("_last", True).over(W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)).alias("_far"))
    joined = near.join(carried.hint("shuffle_merge"), [*keys, "_c"], "left")
    return joined.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_c", "_v")


def running_next(df: DataFrame, keys: list[str], t: str, tie: str, value: Column, name: str, width: int = 7 * DAY) -> DataFrame:
    """df with the first non-null `value` behind each row, itself left out, in (t, tie) order."""
    chunked = df.withColumns({"_v": value, "_c": _chunk(t, width)})
    backwards = W.partitionBy(*keys, "_c").orderBy(F.desc(t), F.desc(tie)).rowsBetween(W.unboundedPreceding, -1)
    near = chunked.withColumn("_near", F.last("_v", True).over(backwards))
    first = chunked.where("_v is not null").groupBy(*keys, "_c").agg(F.min_by("_v", F.struct(t, tie)).alias("_first"))
    every = chunked.select(*keys, "_c").distinct().join(first.hint("shuffle_merge"), [*keys, "_c"], "left")
    carried = every.select(*keys, "_c", F.last("_first", True).over(W.partitionBy(*keys).orderBy(F.desc("_c")).rowsBetween(W.unboundedPreceding, -1)).alias("_far"))
    joined = near.join(carried.hint("shuffle_merge"), [*keys, "_c"], "left")
    return joined.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_c", "_v")


def islands(df: DataFrame, keys: list[str], t: str, tie: str, gap: int | None = None, changes: list[str] = (), name: str = "island") -> DataFrame:
    """df with `name`: the (t, tie) of the first row of its run.

    A run ends where the step in t exceeds gap, or where one of the `changes` columns differs from the row before.
    """
    seen = with_previous(df, keys, t, tie, [t, *changes], "_prev")
    starts = F.col("_prev").isNull()
    if gap is not None:
        starts = starts | (F.col(t) - F.col("_prev")[t] > gap)
    for c in changes:
        starts = starts | ~F.col(c).eqNullSafe(F.col("_prev")[c])
    return running_last(seen, keys, t, tie, F.when(F.coalesce(starts, F.lit(True)), F.struct(F.col(t).alias("t"), F.col(tie).alias("id"))), name).drop("_prev")


def merge_near_duplicates(events: DataFrame, keys: list[str], window: int, t: str = "t", tie: str = "event_id") -> DataFrame:
    """One row per chain of events whose steps are at most window: mean time, last end, best member, counts.

    events: keys, t, tie, confidence, end (nullable), status_rank. The best member has the highest confidence,
    of equals the one nearest the chain's first time, then the smaller id. Where events have them, `sources` and `notes`
    (arrays of strings) come along: an event alone keeps its own, a chain has all of its members', sorted and once each,
    and the note deduplicated:<members>.
    """
    runs = islands(events, keys, t, tie, gap=window)
    nearest = F.struct("confidence", (-(F.abs(F.col(t) - F.col("island.t")))).alias("near"), (-F.col(tie)).alias("id"))
    lists = [c for c in ("sources", "notes") if c in events.columns]
    own = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    out = runs.groupBy(*keys, "island").agg(
        F.floor(F.avg(F.col(t) - F.col("island.t"))).cast("long").alias("_mean"),
        F.max(F.coalesce("end", t)).alias("end_t"),
        F.max("confidence").alias("confidence"),
        F.max("status_rank").alias("status_rank"),
        F.max_by(tie, nearest).alias("best_id"),
        F.count("*").alias("members"),
        *(F.collect_set(own(c)).alias(f"_{c}") for c in lists),  # members with equal lists come once
    ).withColumn("mean_t", F.col("_mean") + F.col("island.t")).drop("_mean")
    for c in lists:
        merged = F.array_sort(F.array_distinct(F.flatten(f"_{c}")))
        if c == "notes":
            merged = F.array_append(merged, F.format_string("deduplicated:%d", "members"))
        out = out.withColumn(c, F.when(F.col("members") == 1, F.col(f"_{c}")[0]).otherwise(merged)).drop(f"_{c}")
    return out


def range_pairs(left: DataFrame, right: DataFrame, keys: list[str], before: int, after: int, lt: str, rt: str) -> DataFrame:
    """Pairs with rt in [lt - before, lt + after], joined on key and time bucket: never a key-wide product.

    left's rows go to every bucket that their range covers; right's rows keep one, so each pair shows once.
    """
    width = max(1, before + after)
    lo, hi = F.floor((F.col(lt) - before) / width), F.floor((F.col(lt) + after) / width)
    a = left.withColumn("_b", F.explode(F.sequence(lo, hi)))
    b = right.withColumn("_b", F.floor(F.col(rt) / width))
    return a.join(b.hint("shuffle_merge"), [*keys, "_b"]).where((F.col(rt) >= F.col(lt) - before) & (F.col(rt) <= F.col(lt) + after)).drop("_b")


def nearest_match(anchors: DataFrame, candidates: DataFrame, window: int, keys: list[str] = ["session_id"]) -> DataFrame:
    """Each anchor (a_id, a_t) with its nearest candidate (c_id, c_t, c_conf), unmatched ones with nulls.

    Ties: higher confidence, then earlier time, then smaller id. Candidates may serve several anchors.
    """
    pairs = range_pairs(anchors, candidates, keys, window, window, "a_t", "c_t")
    order = F.struct(F.abs(F.col("c_t") - F.col("a_t")).alias("gap"), (-F.col("c_conf")).alias("conf"), "c_t", "c_id")
    best = pairs.groupBy("a_id").agg(F.min(order).alias("m")).select("a_id", "m.c_id", "m.c_t", "m.gap")
    return anchors.join(best.hint("shuffle_merge"), "a_id", "left")


def first_later_match(anchors: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Each anchor (a_id, a_t) with the first target (c_id, c_t) after it within `most`, nulls if none; later claims of a taken target are marked."""
    pairs = range_pairs(anchors, targets, ["session_id"], -1, most, "a_t", "c_t")
    best = pairs.groupBy("a_id").agg(F.min(F.struct("c_t", "c_id")).alias("m")).select("a_id", "m.c_t", "m.c_id")
    joined = anchors.join(best.hint("shuffle_merge"), "a_id", "left")
    first = best.join(anchors.select("a_id", "a_t").hint("shuffle_merge"), "a_id").groupBy("c_id").agg(F.min(F.struct("a_t", "a_id")).alias("f")).select("c_id", F.col("f.a_id").alias("_first"))
    return joined.join(first.hint("shuffle_merge"), "c_id", "left").withColumn("claims", F.col("c_id").isNotNull() & (F.col("a_id") == F.col("_first"))).drop("_first")


def before_after(points: DataFrame, moments: DataFrame, window: int) -> DataFrame:
    """Each moment (a_id, a_t) with the last point value at or before it and the first at or after it, both within window."""
    pairs = range_pairs(moments, points, ["session_id"], window, window, "a_t", "c_t")
    return pairs.groupBy("session_id", "a_id", "a_t").agg(
        F.max_by("c_value", F.when(F.col("c_t") <= F.col("a_t"), F.struct("c_t", "c_id"))).alias("before"),
        F.min_by("c_value", F.when(F.col("c_t") >= F.col("a_t"), F.struct("c_t", "c_id"))).alias("after"),
    ).where("before is not null and after is not null")
