"""Stable series, states and their segments, change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import exact, exact_mean, seconds
from ..plans.settle import settle
from .chunks import throttle
from .timeline import islands, nearest_match, range_pairs, running_last, with_previous


def stable_series(readings: DataFrame, window: int, least_conf: float, least_votes: int) -> DataFrame:
    """Centred vote per frame and channel: the value most often read within half a window on both sides.

    readings: session_id, channel, id, t, value, confidence; id and t name the frame, which may have a reading of each
    channel or of some. Every channel of a session has a row at every frame of it: one without a usable reading near is
    no_valid_reading. Frames meet the readings once, whatever their channel, and carry the session's channels along for
    the rows that nothing voted for. Ties go to the value seen first in time.
    """
    half = window // 2
    frames = readings.select("session_id", F.col("id").alias("a_id"), F.col("t").alias("a_t")).distinct()
    usable = readings.where((F.col("confidence") >= least_conf) & F.col("value").isNotNull()).select("session_id", "channel", F.col("id").alias("c_id"), F.col("t").alias("c_t"), "value", "confidence")
    pairs = range_pairs(frames, usable, ["session_id"], half, half, "a_t", "c_t")
    counted = pairs.groupBy("a_id", "channel", "value").agg(F.count("*").alias("votes"), F.avg("confidence").alias("mean"), F.min(F.struct("c_t", "c_id")).alias("seen"))
    best = counted.groupBy("a_id", "channel").agg(F.min(F.struct((-F.col("votes")).alias("v"), "seen", "value", "mean")).alias("b"))
    channels = readings.groupBy("session_id").agg(F.collect_set("channel").alias("_all"))
    grid = frames.join(channels.hint("shuffle_merge"), "session_id").withColumn("channel", F.explode("_all")).drop("_all")
    n = -F.col("b.v")
    out = grid.join(best.hint("shuffle_merge"), ["a_id", "channel"], "left")
    return out.select(
        "session_id", "channel", F.col("a_id").alias("id"), F.col("a_t").alias("t"), F.col("b.value").alias("value"), F.coalesce(n, F.lit(0)).cast("long").alias("votes"),
        F.coalesce(F.col("b.mean") * F.least(F.lit(1.0), n / float(least_votes)), F.lit(0.0)).alias("confidence"),
        F.when(F.col("b").isNull(), "no_valid_reading").when(n < least_votes, "weak_votes").otherwise("stable").alias("status"),
    )


def anchored_changes(points: DataFrame, moments: DataFrame, window: int, most: int) -> DataFrame:
    """Rises of a side's value from the last point at or before a moment to the first at or after it, both within window.

    points: session_id, side, id, t, value, confidence. moments: session_id, id, t, side, confidence. Of points at one
    time the most confident counts, then the smaller id. A rise by more than `most` needs review. Of rises of a side
    that end in the same hundredth of a second the first moment's stays. A moment without side has none; one without
    confidence, or with 0, counts as 0.7.
    """
    a = moments.select("session_id", "side", F.col("id").alias("a_id"), F.col("t").alias("a_t"), F.col("confidence").alias("a_conf"))
    c = points.select("session_id", "side", F.col("id").alias("c_id"), F.col("t").alias("c_t"), F.col("value").alias("v"), F.col("confidence").alias("c"))
    pairs = range_pairs(a, c, ["session_id", "side"], window, window, "a_t", "c_t")
    point, less = F.struct(F.col("c_t").alias("t"), "v", "c"), (-F.col("c_id")).alias("i")
    found = pairs.groupBy("session_id", "side", "a_id", "a_t").agg(
        F.max_by(point, F.when(F.col("c_t") <= F.col("a_t"), F.struct("c_t", "c", less))).alias("b"),
        F.min_by(point, F.when(F.col("c_t") >= F.col("a_t"), F.struct("c_t", (-F.col("c")).alias("n"), "c_id"))).alias("f"), F.max("a_conf").alias("a_conf"),
    )
    risen = found.where("b is not null and f is not null and f.v > b.v").withColumn("_cent", F.bround(F.col("f.t") / 10_000).cast("long"))
    first = risen.groupBy("session_id", "side", "_cent").agg(F.min(F.struct("a_t", "a_id", "b", "f", "a_conf")).alias("m")).select("session_id", "side", "m.*")
    own = F.when(F.coalesce("a_conf", F.lit(0.0)) == 0, 0.7).otherwise(F.col("a_conf"))
    rise = F.col("f.v") - F.col("b.v")
    notes = [
        F.concat(F.lit("expected_side:"), "side"), F.concat(F.lit("anchored_before:"), seconds(F.col("b.t"))), F.concat(F.lit("anchored_after:"), seconds(F.col("f.t"))),
        F.when(rise > most, F.concat(F.lit("abnormal_jump:"), rise.cast("string"))),
    ]
    return first.select(
        "session_id", "side", "a_id", F.col("f.t").alias("t"), F.col("b.v").alias("from_value"), F.col("f.v").alias("to_value"),
        F.least(F.lit(1.0), 0.45 * F.col("b.c") + 0.45 * F.col("f.c") + 0.10 * own).alias("confidence"), F.when(rise <= most, "CONFIRMED").otherwise("NEED_REVIEW").alias("status"), F.array_compact(F.array(*notes)).alias("notes"),
    )


def smooth_states(scores: DataFrame, window: int, threshold: float, priority: dict[str, int]) -> DataFrame:
    """Centred sum of state scores (session_id, id, t, state, score); best by sum, then priority; confidence is its share."""
    half = window // 2
    points = scores.select("session_id", F.col("id").alias("a_id"), F.col("t").alias("a_t")).distinct()
    usable = scores.where((F.col("score") >= 0.7 * threshold) & (F.col("state") != "unknown")).select("session_id", F.col("t").alias("c_t"), "state", "score")
    sums = range_pairs(points, usable, ["session_id"], half, half, "a_t", "c_t").groupBy("a_id", "state").agg(F.sum("score").alias("s"))
    rank = F.element_at(F.create_map(*[F.lit(x) for p in priority.items() for x in p]), F.col("state"))
    best = sums.groupBy("a_id").agg(F.max(F.struct(F.round("s", 9).alias("s"), F.coalesce(rank, F.lit(-1)).alias("p"), "state")).alias("b"), F.sum("s").alias("all"))
    out = points.join(best.hint("shuffle_merge"), "a_id", "left")
    return out.select("session_id", F.col("a_id").alias("id"), F.col("a_t").alias("t"), F.coalesce("b.state", F.lit("unknown")).alias("state"), F.coalesce(F.col("b.s") / F.col("all"), F.lit(0.0)).alias("confidence"))


def state_segments(states: DataFrame, least: int) -> DataFrame:
    """Runs of equal state (session_id, id, t, state, confidence); runs shorter than least vanish."""
    runs = islands(states, ["session_id"], "t", "id", changes=["state"])
    segments = runs.groupBy("session_id", "island").agg(F.first("state").alias("state"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("readings"), exact_mean(F.col("confidence")).alias("confidence"))
    return segments.where((F.col("end_t") - F.col("start_t")) >= least).withColumn("id", F.col("island.id")).drop("island")


def transitions(segments: DataFrame) -> DataFrame:
    """Steps between a session's consecutive segments of different state."""
    seen = with_previous(segments, ["session_id"], "start_t", "id", ["state", "confidence"])
    both = seen.where(F.col("prev").isNotNull() & (F.col("prev.state") != F.col("state")))
    return both.select("session_id", F.col("start_t").alias("t"), F.concat_ws("_to_", "prev.state", "state").alias("event"), F.least(F.lit(1.0), ((exact(F.col("prev.confidence")) + exact(F.col("confidence"))) / 2).cast("double")).alias("confidence"))


def change_events(series: DataFrame, most: int, least_gap: int, least_conf: float = 0.0) -> DataFrame:
    """Changes of each channel's value (session_id, channel, id, t, value, confidence; readings under least_conf do not count).

    Against the value before: a fall, or a rise by over `most`, needs review; a change within least_gap of the
    last emitted one changes the value silently.
    """
    known = series.where(F.col("value").isNotNull() & (F.col("confidence") >= least_conf))
    seen = with_previous(known, ["session_id", "channel"], "t", "id", ["value"])
    moved = seen.where(F.col("prev").isNotNull() & (F.col("prev.value") != F.col("value"))).withColumn("from_value", F.col("prev.value")).drop("prev")
    done = throttle(moved.select("session_id", "channel", "t", "id", "from_value", "value", "confidence"), ["session_id", "channel"], least_gap, "t", "id")
    rise = F.col("value") - F.col("from_value")
    return done.select("session_id", "channel", "id", "t", F.col("from_value").cast("long").alias("from_value"), F.col("value").cast("long").alias("to_value"), F.col("confidence").cast("double").alias("confidence"), F.when((rise <= 0) | (rise > most), "NEED_REVIEW").otherwise("CONFIRMED").alias("status"))


def cross_checked(changes: DataFrame, signals: DataFrame, window: int) -> DataFrame:
    """changes (what change_events gives) with the nearest signal (session_id, id, t, side; no side fits any channel) within window.

    A match lifts the confidence to 0.85 of it and 0.15; without one a confirmed change is UNCERTAIN. Adds signal_id.
    """
    a = changes.select("session_id", F.col("id").alias("a_id"), F.col("t").alias("a_t"), "channel")
    s = signals.select("session_id", F.col("id").alias("c_id"), F.col("t").alias("c_t"), "side")
    pairs = range_pairs(a, s, ["session_id"], window, window, "a_t", "c_t").where(F.col("side").isNull() | (F.col("side") == F.col("channel")))
    best = pairs.groupBy("a_id").agg(F.min(F.struct(F.abs(F.col("c_t") - F.col("a_t")).alias("gap"), "c_t", "c_id")).alias("m")).select(F.col("a_id").alias("id"), F.col("m.c_id").alias("signal_id"))
    out, met = changes.join(best.hint("shuffle_merge"), "id", "left"), F.col("signal_id").isNotNull()
    lifted = F.least(F.lit(1.0), F.col("confidence") * 0.85 + 0.15)
    return out.withColumns({"confidence": F.when(met, lifted).otherwise(F.col("confidence")), "status": F.when(~met & (F.col("status") == "CONFIRMED"), "UNCERTAIN").otherwise(F.col("status"))})


def hit_groups(hits: DataFrame, keys: list[str], gap: int, threshold: float, votes: int = 2) -> DataFrame:
    """Runs of hits (keys, id, t, confidence) over the threshold: weighted time, mean and best confidence, rows.

    A run of `votes` hits and more is CONFIRMED, a shorter one INFERRED from a best confidence of 0.75, else UNCERTAIN.
    """
    return _groups(islands(hits.where(F.col("confidence") >= threshold), keys, "t", "id", gap=gap), keys, votes).drop("island")


def _groups(runs: DataFrame, keys: list[str], votes: int, *more) -> DataFrame:
    out = runs.groupBy(*keys, "island").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count_distinct("id").alias("hits"), F.avg("confidence").alias("mean_conf"), F.max("confidence").alias("best_conf"),
        (F.sum((F.col("t") - F.col("island.t")) * F.col("confidence")) / F.sum("confidence")).alias("_w"), F.max_by("id", F.struct("confidence", (-F.col("t")).alias("t"), (-F.col("id")).alias("i"))).alias("peak_id"), *more,
    )
    status = F.when(F.col("hits") >= votes, "CONFIRMED").when(F.col("best_conf") >= 0.75, "INFERRED").otherwise("UNCERTAIN")
    return out.withColumns({"time": F.round(F.col("island.t") + F.coalesce("_w", F.lit(0.0))).cast("long"), "status": status}).drop("_w")


def primary_events(hits: DataFrame, changes: DataFrame, primary: list[str], gap: int, threshold: float, window: int, votes: int = 2, least: float = 0.58) -> DataFrame:
    """Runs of hits (session_id, kind, id, t, confidence, side, side_conf) as events, with the side that their hits vote for.

    A run of a primary kind takes the nearest change (session_id, c_id, c_t, c_conf) within window of its time; a null
    confidence of that counts as 0.7. Its confidence is the mean of its own and the change's, it is CONFIRMED with a
    change, and UNCERTAIN under `least` in any case. The side has the largest sum of side_conf over the hits that name
    one (of equals the first seen); with it come its mean, its votes and its best hit. Runs of other kinds stay as
    supporting evidence, with their own confidence and status and no side.
    Gives session_id, kind, id (the peak hit), t, start_t, end_t, frames, c_id, confidence, status, sources, side, side_conf,
    side_votes, side_id, supporting.
    """
    keys = ["session_id", "kind"]
    runs = settle(islands(hits.where(F.col("confidence") >= threshold), keys, "t", "id", gap=gap))
    groups = _groups(runs, keys, votes).withColumn("main", F.col("kind").isin(*primary))
    sided = runs.where(F.col("side").isNotNull() & F.col("kind").isin(*primary)).withColumn("v", F.coalesce(exact(F.col("side_conf")), F.lit(0).cast("decimal(12,9)")))
    by_side = sided.groupBy(*keys, "island", "side").agg(F.sum("v").alias("s"), F.avg("v").cast("double").alias("mean"), F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("seen"), F.min(F.struct((-F.col("v")).alias("v"), "t", "id")).alias("b"))
    voted = by_side.groupBy(*keys, "island").agg(F.min(F.struct((-F.col("s")).alias("s"), "seen", "side", "mean", "n", "b")).alias("vote"))
    groups = groups.join(voted.hint("shuffle_merge"), [*keys, "island"], "left").drop("island")
    anchors = groups.where("main").select("session_id", F.col("peak_id").alias("a_id"), F.col("time").alias("a_t"))
    near = nearest_match(anchors, changes, window).select(F.col("a_id").alias("peak_id"), "c_id").where("c_id is not null")
    near = near.join(changes.select("c_id", F.coalesce("c_conf", F.lit(0.7)).alias("c_conf")).hint("shuffle_merge"), "c_id")
    out = groups.join(near.hint("shuffle_merge"), "peak_id", "left")
    met = F.col("c_id").isNotNull()
    conf = F.when(met, (F.col("mean_conf") + F.col("c_conf")) / 2).otherwise(F.col("mean_conf"))
    status = F.when(F.col("main") & (conf < least), "UNCERTAIN").when(met, "CONFIRMED").otherwise(F.col("status"))
    return out.select(
        *keys, F.col("peak_id").alias("id"), F.col("time").alias("t"), "start_t", "end_t", F.col("hits").alias("frames"), "c_id", conf.alias("confidence"), status.alias("status"),
        F.array_compact(F.array(F.col("kind"), F.when(met, "change_crosscheck"))).alias("sources"), "vote.side", F.col("vote.mean").alias("side_conf"), F.col("vote.n").alias("side_votes"), F.col("vote.b.id").alias("side_id"),
        (~F.col("main")).alias("supporting"),
    )


def peak_groups(rows: DataFrame, keys: list[str], gap: int, score: str, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Runs of rows (keys, id, t and scores) that reach every score in `least` and exceed none in `most`, each by its peak.

    The peak has the highest `score`, of equals the first in time; with it come all named scores of the peak, the run's
    span and its rows. A null score reaches nothing.
    """
    passing = F.lit(True)
    for c, x in least.items():
        passing = passing & (F.col(c) >= x)
    for c, x in most.items():
        passing = passing & (F.col(c) <= x)
    runs = islands(rows.where(passing), keys, "t", "id", gap=gap)
    named = list(dict.fromkeys([score, *least, *most]))
    first = F.struct((-F.col(score)).alias("s"), "t", "id", *(F.col(c).alias(f"_{c}") for c in named))
    out = runs.groupBy(*keys, "island").agg(F.min(first).alias("p"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("rows"))
    return out.select(*keys, "p.id", "p.t", *(F.col(f"p._{c}").alias(c) for c in named), "start_t", "end_t", "rows")


__all__ = ["stable_series", "smooth_states", "state_segments", "transitions", "change_events", "hit_groups", "primary_events", "peak_groups", "running_last"]
