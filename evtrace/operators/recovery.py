"""What became of each down segment: the search for the up segment that ends it, with notes on what lay between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clamp01, seconds
from ..plans.settle import settle
from .timeline import running_next, with_previous

SECOND = 1_000_000


@dataclass(frozen=True)
class Recovery:
    """States and thresholds of the search; times in microseconds."""

    down: tuple[str, ...] = ("panel", "down")
    up: tuple[str, ...] = ("up", "recovered")
    ignored: tuple[str, ...] = ("unknown", "loading")
    sure: tuple[str, ...] = ("panel",)  # down states that need no signal to be confirmed
    least_down: int = SECOND // 2
    least_up: int = SECOND // 2
    most: int = 8 * SECOND  # longest delay
    gap: int = 1_200_000  # longest step without a segment that goes unnoted
    window: int = SECOND  # of signals and state events round a segment
    confirmed: float = 0.70
    inferred: float = 0.45
    sure_from: float = 0.60


def best_in_span(spans: DataFrame, points: DataFrame, window: int, bonus: float, width: int) -> DataFrame:
    """id, point, point_conf: the point (session_id, p_id, p_t, p_conf) within window of each span (session_id, id, start_t,
    end_t) whose distance to the span's start in seconds, less bonus times its confidence, is smallest; then by time and id.

    Spans meet points in buckets of width; a long span costs as many rows as it covers buckets.
    """
    bucket = lambda c: F.floor(c / width)
    wide = spans.select("session_id", "id", "start_t", "end_t", F.explode(F.sequence(bucket(F.col("start_t") - window), bucket(F.col("end_t") + window))).alias("_b"))
    pairs = wide.join(points.withColumn("_b", bucket(F.col("p_t"))).hint("shuffle_merge"), ["session_id", "_b"])
    pairs = pairs.where((F.col("p_t") >= F.col("start_t") - window) & (F.col("p_t") <= F.col("end_t") + window))
    cost = F.abs(F.col("p_t") - F.col("start_t")) / 1e6 - bonus * F.col("p_conf")
    best = pairs.groupBy("id").agg(F.min(F.struct(cost.alias("cost"), "p_t", "p_id", "p_conf")).alias("m"))
    return best.select("id", F.col("m.p_id").alias("point"), F.col("m.p_conf").alias("point_conf"))


def _search(segments: DataFrame, downs: DataFrame, rules: Recovery) -> DataFrame:
    """id of each of downs, with the up segment (u, a struct) that ends it or null, and the notes of the search.

    A walk over a session's segments in order carries the end of the segment before, so what it notes of a segment (a
    gap before it, a state that is neither down, up nor ignored) does not depend on where the walk began: notes are
    worked out once a segment, and a down segment takes those up to where its own walk stops.
    """
    order = F.struct("end_t", "id")
    placed = segments.withColumn("_o", order)
    seen = with_previous(placed, ["session_id"], "start_t", "_o", ["end_t"])
    up = F.col("state").isin(*rules.up)
    about = F.struct("start_t", "end_t", "id", "state", "confidence", "readings")
    ahead = running_next(seen, ["session_id"], "start_t", "_o", F.when(up, about), "u")
    step = F.greatest(F.lit(0), F.col("start_t") - F.col("prev.end_t"))
    apart = ~F.col("state").isin(*rules.ignored) & (step > rules.gap)
    between = ~F.col("state").isin(*rules.down, *rules.up, *rules.ignored)
    told = F.array_compact(F.array(
        F.when(apart, F.concat(F.lit("large_gap_before_candidate:"), seconds(step), F.lit(">"), seconds(F.lit(rules.gap)))),
        F.when(between, F.concat(F.lit("intermediate_state:"), F.col("state"), F.lit("@"), seconds(F.col("start_t")))),
    ))
    walked = settle(ahead.withColumn("_told", told).select("session_id", "id", "start_t", "end_t", "_o", "u", "_told"))

    latest = F.col("end_t") + rules.most
    mine = walked.join(downs.select("id").hint("shuffle_hash"), "id", "left_semi").select("session_id", "id", "start_t", "end_t", "_o", F.when(F.col("u.start_t") <= latest, F.col("u")).alias("u"))
    # the first segment that starts too late, for walks that found none
    marks = mine.where("u is null").select("session_id", "id", latest.alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start"))
    starts = walked.select("session_id", "id", F.col("start_t").alias("t"), F.lit(0).alias("kind"), F.col("start_t").alias("start"))
    tied = marks.unionByName(starts).withColumn("_k", F.struct("kind", "id"))
    late = running_next(tied, ["session_id"], "t", "_k", F.col("start"), "late").where("kind = 1").select("id", "late")
    # notes of the segments from the one after the down segment to the last that its walk looked at
    until = F.coalesce("u.start_t", latest)
    bucket = lambda c: F.floor(c / rules.most)
    spans = mine.select("session_id", F.col("id").alias("d_id"), F.struct("start_t", "_o").alias("d"), until.alias("until"), F.when(F.col("u").isNotNull(), F.struct("u.start_t", F.struct("u.end_t", "u.id").alias("_o"))).alias("last"), F.explode(F.sequence(bucket(F.col("start_t")), bucket(until))).alias("_b"))
    noted = walked.where(F.size("_told") > 0).select("session_id", F.struct("start_t", "_o").alias("s"), "_told", bucket(F.col("start_t")).alias("_b"))
    pairs = spans.join(noted.hint("shuffle_merge"), ["session_id", "_b"]).where("s > d and s.start_t <= until and (last is null or s <= last)")
    lists = pairs.groupBy("d_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "_told"))), lambda x: x["_told"])).alias("between")).withColumnRenamed("d_id", "id")
    out = mine.join(late.hint("shuffle_hash"), "id", "left").join(lists.hint("shuffle_hash"), "id", "left")
    delay = F.col("late") - F.col("end_t")
    stop = F.when(F.col("u").isNotNull(), F.lit(None)).when(F.col("late").isNull(), "no_later_segment").otherwise(F.concat(F.lit("max_delay_exceeded:"), seconds(delay), F.lit(">"), seconds(F.lit(rules.most))))
    return out.select("id", "u", F.array_compact(F.concat(F.coalesce("between", F.array().cast("array<string>")), F.array(stop))).alias("search"))


def recovery_events(segments: DataFrame, signals: DataFrame, state_events: DataFrame, rules: Recovery = Recovery()) -> tuple[DataFrame, DataFrame]:
    """Recoveries, one row per down segment that has one of its own or none at all, and a record of every down segment.

    segments: session_id, id, state, start_t, end_t, confidence, readings, in order of (start_t, end_t, id).
    signals: session_id, id, t, confidence; the best within window of a down segment, a near start weighing most, backs it.
    state_events: session_id, id, t, kind (down, up), confidence; the nearest to a segment's start backs its step.

    A down segment shorter than least_down without a signal is recorded as FILTERED_SHORT_SEGMENT and has no event. The
    walk over later segments stops at the first up segment, or where one starts later than `most` after the down
    segment's end. If the segments run out first, nothing is known: UNCERTAIN, UNOBSERVED_END. Of several down segments
    that reach the same up segment the first has the event; the others are recorded alone. A session without down
    segments gives no rows. Null confidences count as 0.

    Events: session_id, down_id, up_id, down_t, recovery_t, delay, signal_id, state_event_id, confidence, status, result,
    sources, notes. Records: session_id, id, state, start_t, end_t, confidence, signal_id, status, sources, notes.
    """
    clean = segments.withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
    downs = clean.where(F.col("state").isin(*rules.down))
    points = signals.select("session_id", F.col("id").alias("p_id"), F.col("t").alias("p_t"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("p_conf"))
    width = max(4 * rules.window, rules.most)
    signal = best_in_span(downs, points, rules.window, 0.1, width).select("id", F.col("point").alias("signal_id"), F.col("point_conf").alias("s_conf"))
    lasts = F.col("end_t") - F.col("start_t")
    seen = downs.join(signal.hint("shuffle_merge"), "id", "left").withColumn("short", lasts < rules.least_down)
    seen = settle(seen)
    short_note = F.when(F.col("short"), F.concat(F.lit("short_down_segment:"), seconds(lasts), F.lit("<"), seconds(F.lit(rules.least_down))))
    filtered = F.col("short") & F.col("signal_id").isNull()
    sure = F.col("signal_id").isNotNull() | (F.col("state").isin(*rules.sure) & (F.col("confidence") >= rules.sure_from))
    crossed = F.when(F.col("signal_id").isNotNull(), "signal_crosscheck")
    records = seen.select(
        "session_id", "id", "state", "start_t", "end_t", "confidence", "signal_id",
        F.when(filtered, "FILTERED_SHORT_SEGMENT").when(sure, "CONFIRMED").otherwise("INFERRED").alias("status"),
        F.array_compact(F.array(F.lit("state_segment"), crossed)).alias("sources"),
        F.array_compact(F.array(short_note, F.when(filtered, "not_promoted"))).alias("notes"),
    )

    lasting = seen.where(~filtered)
    found = lasting.join(_search(clean, lasting, rules).hint("shuffle_hash"), "id")
    first = found.where("u is not null").groupBy(F.col("u.id").alias("u_id")).agg(F.min(F.struct("start_t", "end_t", "id")).alias("f")).select("u_id", F.col("f.id").alias("_first"))
    found = found.withColumn("u_id", F.col("u.id")).join(first.hint("shuffle_merge"), "u_id", "left").where(F.col("u").isNull() | (F.col("_first") == F.col("id")))
    found = settle(found)
    told = state_events.select("session_id", F.col("id").alias("p_id"), F.col("t").alias("p_t"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("p_conf"), "kind")
    of_up = best_in_span(found.where("u is not null").select("session_id", F.col("u.id").alias("id"), "u.start_t", "u.end_t"), told.where("kind = 'up'"), rules.window, 0.0, width)
    of_down = best_in_span(found, told.where("kind = 'down'"), rules.window, 0.0, width)
    found = found.join(of_up.select(F.col("id").alias("u_id"), F.col("point").alias("up_event"), F.col("point_conf").alias("up_conf")).hint("shuffle_merge"), "u_id", "left")
    found = found.join(of_down.select("id", F.col("point").alias("down_event")).hint("shuffle_merge"), "id", "left")

    lasted = lambda span, least: F.greatest(F.lit(0.0), F.least(F.lit(1.0), span / float(least))) if least > 0 else F.lit(1.0)
    has = F.col("u").isNotNull()
    delay = F.when(has, F.greatest(F.lit(0), F.col("u.start_t") - F.col("end_t")).cast("long"))
    down = clamp01(0.55 * F.col("confidence") + 0.45 * lasted(lasts, rules.least_down))
    many = F.when(F.col("u.readings") >= 2, 1.0).otherwise(0.65)
    up = F.when(has, clamp01(0.55 * F.col("u.confidence") + 0.30 * lasted(F.col("u.end_t") - F.col("u.start_t"), rules.least_up) + 0.15 * many)).otherwise(0.0)
    step = F.when(has, F.greatest(clamp01(1.0 - delay / float(rules.most) * 0.5), F.coalesce("up_conf", F.lit(0.0)))).otherwise(0.0)
    conf = F.round(clamp01(0.35 * down + 0.35 * up + 0.15 * step + 0.15 * F.coalesce("s_conf", F.lit(0.0))), 9)
    scored = found.withColumn("c", conf)
    c, ended = F.col("c"), F.array_contains("search", "no_later_segment")
    status = F.when(~has, F.when(ended | (c >= rules.inferred), "UNCERTAIN").otherwise("MISSING")).when(c >= rules.confirmed, "CONFIRMED").when(c >= rules.inferred, "INFERRED").otherwise("UNCERTAIN")
    result = (
        F.when(~has, F.when(ended, "UNOBSERVED_END").when(c >= rules.inferred, "MISSING_OR_UNOBSERVED").otherwise("MISSING"))
        .when(c >= rules.confirmed, "DETECTED").when(c >= rules.inferred, "DETECTED_LOW_CONFIDENCE").otherwise("DETECTED_UNCERTAIN")
    )
    weak = F.when(has & (c < rules.inferred), F.concat(F.lit("confidence_below_inferred:"), seconds(F.floor(c * 1e6)), F.lit("<"), seconds(F.lit(round(rules.inferred * SECOND)))))
    events = scored.select(
        "session_id", F.col("id").alias("down_id"), F.col("u_id").alias("up_id"), F.col("start_t").alias("down_t"), F.col("u.start_t").alias("recovery_t"), delay.alias("delay"), "signal_id",
        F.coalesce("up_event", "down_event").alias("state_event_id"), c.alias("confidence"), status.alias("status"), result.alias("result"),
        F.array_compact(F.array(F.lit("state_segments"), crossed, F.when(F.col("up_event").isNotNull(), "state_event_crosscheck"), F.when(has, "up_returned"))).alias("sources"),
        F.array_compact(F.concat(F.array(short_note), "search", F.array(weak))).alias("notes"),
    )
    return events, records


def recovery_summary(sessions: DataFrame, events: DataFrame, records: DataFrame) -> DataFrame:
    """Counts per session (session_id), its first down time and first recovery time; 0 and null for sessions without any."""
    downs = records.groupBy("session_id").agg(F.count("*").alias("down_segments"), F.min("start_t").alias("first_down_t"))
    number = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    first = F.min(F.when(F.col("recovery_t").isNotNull(), F.struct("down_t", "recovery_t")))
    told = events.groupBy("session_id").agg(*map(number, ("CONFIRMED", "INFERRED", "MISSING", "UNCERTAIN")), first.alias("f"))
    out = sessions.join(downs.hint("shuffle_hash"), "session_id", "left").join(told.hint("shuffle_hash"), "session_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("down_segments", "confirmed", "inferred", "missing", "uncertain")]
    return out.select("session_id", *counts, "first_down_t", F.col("f.recovery_t").alias("first_recovery_t"))
