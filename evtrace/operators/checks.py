"""Composed reports: primary events, location verdicts, checks, evidence, promotions, duplicates, waypoints."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import clamp01, exact, hamming, normalize_name
from ..plans.settle import settle
from .lookups import first_near, hash_pairs
from .chunks import WIDTH, each_run, throttle
from .timeline import with_previous


def location_verdicts(recoveries: DataFrame, evidence: DataFrame, weights: dict[str, float], own: float, good: float = 0.75, bad: float = 0.45, margin: float = 0.2) -> DataFrame:
    """Verdict on the place of each recovery (recovery_id, expected, confidence).

    evidence: recovery_id, frame, component (a key of weights), detected, score, one row per component and frame. A
    component that saw nothing takes no part in its frame's weighted mean; one that saw another place counts 0. `own`
    weighs the recovery's confidence. Frames average to the score, places are voted by summed scores (ties to the first
    name). Without evidence: UNCERTAIN; without expected place: OBSERVED. Weights and scores count to nine places; sums
    are exact, a frame's mean and their average are rounded half up to nine places before anything is compared, so no
    verdict depends on the order of rows.
    """
    wanted, seen = normalize_name(F.col("expected")), normalize_name(F.col("detected"))
    zero, nano = F.lit(Decimal(0)), lambda x: F.lit(Decimal(str(x))).cast("decimal(12,9)")
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), nano(v))])[F.col("component")]
    wrong = F.col("detected").isNotNull() & F.col("expected").isNotNull() & (wanted != seen)
    rows = evidence.join(recoveries.select("recovery_id", "expected", exact(F.col("confidence")).alias("own")).hint("shuffle_merge"), "recovery_id").withColumns({
        "w": F.when(F.col("detected").isNotNull(), weight).otherwise(zero), "s": F.when(F.col("detected").isNull() | wrong, zero).otherwise(exact(F.col("score"))), "strong": wrong & (F.col("score") >= margin),
    })
    sums = rows.groupBy("recovery_id", "frame").agg(F.sum(F.col("w") * F.col("s")).alias("ws"), F.sum("w").alias("sw"), F.max("own").alias("own"), F.bool_or("strong").alias("strong"))
    ours = F.when(F.col("own") > 0, nano(own)).otherwise(zero)
    total = F.col("sw") + ours
    frames = sums.withColumn("frame_score", F.when(total > 0, _rounded_ratio(F.col("ws") + ours * F.coalesce("own", zero), total)).otherwise(zero))
    means = frames.groupBy("recovery_id").agg(_rounded_ratio(F.sum("frame_score"), F.count("frame_score")).alias("mean"), F.max("frame_score").alias("top"), F.bool_or("strong").alias("strong"), F.count("*").alias("frames"))
    votes = rows.where("detected is not null").groupBy("recovery_id", "detected").agg(F.sum(exact(F.col("score"))).alias("v"))
    voted = votes.groupBy("recovery_id").agg(F.min_by("detected", F.struct((-F.col("v")).alias("v"), "detected")).alias("place"))
    out = recoveries.join(means.hint("shuffle_merge"), "recovery_id", "left").join(voted.hint("shuffle_merge"), "recovery_id", "left")
    score, none, place = F.when(F.col("mean").isNotNull(), F.greatest(zero, F.least(nano(1), "mean"))), F.col("frames").isNull(), F.col("place")
    conflict = F.col("strong") & place.isNotNull() & (normalize_name(place) != wanted)
    say = lambda result, status, conf: F.struct(F.lit(result).alias("result"), F.lit(status).alias("status"), conf.cast("double").alias("c"))
    low, high, rest = score <= nano(bad), score >= nano(good), nano(1) - score
    verdict = (
        F.when(none, say("UNCERTAIN", "NO_EVIDENCE", F.lit(0.0))).when(F.col("expected").isNull(), say("OBSERVED", "NO_EXPECTED", F.greatest(score, "top")))
        .when(high & ~conflict, say("PASS", "CONFIRMED", score)).when(low & conflict, say("FAIL", "CONFLICT", F.greatest(rest, nano(0.5))))
        .when(low & place.isNull(), say("UNCERTAIN", "INSUFFICIENT", rest)).when(low, say("FAIL", "LOW_MATCH", rest))
        .otherwise(say("UNCERTAIN", "AMBIGUOUS", F.greatest(score, nano(1) - F.abs(score - nano(0.5)))))
    )
    return out.withColumn("v", verdict).select("recovery_id", "expected", F.col("place").alias("detected"), F.coalesce(score.cast("double"), F.lit(0.0)).alias("score"), "v.result", "v.status", clamp01(F.col("v.c")).alias("confidence"), F.coalesce("frames", F.lit(0)).cast("long").alias("frames"))


def _rounded_ratio(num: Column, den: Column) -> Column:
    """num / den of decimals that are not negative, den of nine places or a count, rounded half up to nine places.

    Whole billionths by integer division, as a decimal quotient would be rounded twice.
    """
    n, d = (num * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,9)"), den.cast("decimal(22,9)")
    return (F.call_function("div", n + n + d, d + d).cast("decimal(20,0)") * F.lit(Decimal("1e-9")).cast("decimal(9,9)")).cast("decimal(21,9)")


def build_checks(found: DataFrame, kinds: dict[str, str], critical: list[str], before: int, after: int) -> DataFrame:
    """Findings (session_id, incident_id, rule, result, confidence, t) as checks: type, severity, uncertainty, time range."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("rule")], F.col("rule"))
    open_ = F.col("result").isin("UNCERTAIN", "NEED_REVIEW")
    why = F.when(open_ & F.col("incident_id").isNull(), "no_incident").when(open_ & (F.col("confidence") < 0.5), "low_confidence").when(open_, "conflicting_evidence")
    return found.select(
        "session_id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("rule"), F.coalesce(F.col("incident_id").cast("string"), F.lit("session"))).alias("check_id"), kind.alias("check_type"),
        F.when(F.col("rule").isin(*critical), "critical").otherwise("major").alias("severity"), "result", "confidence", open_.alias("uncertain"), why.alias("reason"),
        F.greatest(F.lit(0).cast("long"), F.col("t") - before).alias("lo"), (F.col("t") + after).alias("hi"),
    )


def select_evidence(found: DataFrame, include: dict[str, bool], by_rule: dict[str, list[str]], by_type: dict[str, str], default: list[str]) -> DataFrame:
    """One row per finding and region to show: regions of its rule, else of the rule that stands for its event type, else default.

    Results that `include` sets to False give no rows; unnamed ones do. found: finding, rule, event_type, result.
    """
    shown = F.lit(True)
    for result, keep in include.items():
        shown = F.when(F.upper("result") == result, F.lit(keep)).otherwise(shown)
    lists = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    regions = lists(default)
    for kind, rule in by_type.items():
        regions = F.when(F.col("event_type") == kind, lists(by_rule[rule])).otherwise(regions)
    for rule, names in by_rule.items():
        regions = F.when(F.col("rule") == rule, lists(names)).otherwise(regions)
    return found.where(shown).select("finding", F.explode(regions).alias("region"))


def hash_changes(hashes: DataFrame, keys: list[str], most: int, least_gap: int, width: int = WIDTH) -> DataFrame:
    """Rows (keys, t, id, h) whose hash is `most` bits or more from the row before, at least least_gap after the last such row kept; width is what one task looks at of a key, in units of t."""
    seen = with_previous(hashes, keys, "t", "id", ["h"])
    moved = seen.where(F.col("prev").isNotNull()).withColumn("distance", hamming(F.col("h"), F.col("prev.h"))).where(F.col("distance") >= most)
    return throttle(moved.select(*keys, "id", "t", "distance"), keys, least_gap, "t", "id", width)


def _repeats(pairs: DataFrame) -> DataFrame:
    """Of near pairs (a, b), a before b, every b that repeats an earlier representative, with the smallest: id, rep.

    Every round settles the rows without undecided earlier neighbours, and theirs: two joins over the pairs left.
    """
    left, gone = pairs, None
    while not left.isEmpty():
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct().hint("shuffle_merge"), "a", "left_anti")
        dropped = settle(left.join(first.hint("shuffle_merge"), "a", "left_semi").select("b").distinct())
        gone = dropped if gone is None else gone.union(dropped)
        out = dropped.select(F.col("b").alias("a")).hint("shuffle_merge")
        left = settle(left.join(first.hint("shuffle_merge"), "a", "left_anti").join(out, "a", "left_anti").join(dropped.hint("shuffle_merge"), "b", "left_anti").select("a", "b"))
    if gone is None:
        return pairs.select(F.col("b").alias("id"), F.col("a").alias("rep"))
    return pairs.join(gone.select(F.col("b").alias("a")).hint("shuffle_merge"), "a", "left_anti").join(gone.hint("shuffle_merge"), "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("rep"))


def representatives(hashes: DataFrame, most: int = 8, batch: int = 8192) -> DataFrame:
    """Each row (grp, id, h) with the representative it repeats, itself where it is one.

    By id within a group, a row repeats the smallest earlier representative at most `most` bits away. Distinct hashes go
    by id in a few batches, the first of about `batch` and each later one four times all before it: what lies near a
    representative of earlier batches repeats it, and only what is left over is paired with its like. So near pairs are
    listed among rows that no earlier batch explains, not among all.
    """
    once = settle(hashes.groupBy("grp", "h").agg(F.min("id").alias("id")))
    n, shares = once.count(), []
    while n * 5.0 ** -(len(shares) + 1) >= batch:
        shares.insert(0, 5.0 ** -(len(shares) + 1))
    cuts = [None, *sorted(set(once.approxQuantile("id", shares, 0.0005))), None] if shares else [None, None]
    reps = told = None
    for lo, hi in zip(cuts, cuts[1:]):
        rows = once.where((F.lit(True) if lo is None else F.col("id") > lo) & (F.lit(True) if hi is None else F.col("id") <= hi))
        made = None
        if reps is not None:
            made = settle(first_near(rows, reps, most))
            rows = settle(rows.join(made.select("id").hint("shuffle_merge"), "id", "left_anti"))
        repeats = settle(_repeats(settle(hash_pairs(rows, most).select("a", "b"))))
        for x in (made, repeats):
            told = x if told is None else told if x is None else told.unionByName(x)
        new = rows.join(repeats.select("id").hint("shuffle_merge"), "id", "left_anti").select("grp", "id", "h")
        reps = settle(new if reps is None else reps.unionByName(new))
    once = once.withColumnRenamed("id", "own").join(told.withColumnRenamed("id", "own").hint("shuffle_merge"), "own", "left")
    return hashes.join(once.hint("shuffle_merge"), ["grp", "h"]).select("grp", "id", F.coalesce("rep", "own").alias("representative"))


def promotions(candidates: DataFrame, thresholds: dict[str, float], least_quality: float, per_event: int, most: int = 8) -> DataFrame:
    """Candidates (id, grp, event, kind, confidence, quality, h) as promoted, duplicate or review, with reasons for review.

    Rows of poor quality, of an unknown kind, under their kind's threshold or behind the best per_event of their event
    go to review; of the others, those near an earlier one of their group are duplicates of it.
    """
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("kind")]
    best = candidates.select("event", "id", F.row_number().over(W.partitionBy("event").orderBy(F.desc("confidence"), "id")).alias("n")).where(F.col("n") <= per_event).select("id", F.lit(True).alias("best"))
    why = F.array_compact(F.array(F.when(F.col("quality") < least_quality, "poor_quality"), F.when(limit.isNull(), "unknown_kind"), F.when(F.col("confidence") < limit, "low_confidence"), F.when(F.col("best").isNull(), "not_selected")))
    told = settle(candidates.join(best.hint("shuffle_merge"), "id", "left").withColumn("reasons", why).drop("best"))
    kept = representatives(told.where(F.size("reasons") == 0).select("grp", "id", "h"), most).select("id", "representative")
    out = told.join(kept.hint("shuffle_merge"), "id", "left")
    decision = F.when(F.size("reasons") > 0, "review").when(F.col("representative") != F.col("id"), "duplicate").otherwise("promoted")
    return out.select("id", decision.alias("decision"), F.when(decision == "duplicate", F.col("representative")).alias("duplicate_of"), "reasons")


def _ways(n: int):
    """Of a chunk's hits in order: where each of the n + 1 states it may begin in leads."""

    def run(table):
        import pyarrow as pa

        state = np.arange(n + 1)
        for w in table.column("waypoint").to_pylist():
            state[state == w] += 1
        return pa.table([table.column("session_id")[:1], table.column("chunk")[:1], pa.array([state.tolist()], pa.list_(pa.int32()))], ["session_id", "chunk", "leads"])

    return run


def _reached(table):
    """Of a chunk's hits in order, from the state that it begins in: those that reach the waypoint ahead."""
    ahead, keep = table.column("begin")[0].as_py(), []
    for i, w in enumerate(table.column("waypoint").to_pylist()):
        if w == ahead:
            keep.append(i)
            ahead += 1
    return table.take(np.array(keep, np.int64))


def waypoint_progress(positions: DataFrame, waypoints: list[tuple[float, float]], reach: float, width: int = WIDTH) -> DataFrame:
    """Time at which each session reaches each waypoint in turn, one a tick: session_id, waypoint (from 0), t, id.

    Only positions within reach of some waypoint go on. They are cut into chunks of time: a chunk says at once where each
    number of waypoints done before it leads, these are put one after another per session (a row a chunk), and then every
    chunk knows where it begins and tells what it reaches. So it is two passes, however many waypoints there are, and no
    session is one task's work. A position near several waypoints reaches one of them, the one ahead.
    """
    n, at = len(waypoints), ["session_id", "chunk"]
    near = [F.when(F.hypot(F.col("x") - x, F.col("y") - y) <= reach, F.lit(i)) for i, (x, y) in enumerate(waypoints)]
    hits = positions.select("session_id", F.floor(F.col("t") / width).alias("chunk"), "t", "id", F.explode(F.array_compact(F.array(*near))).alias("waypoint"))
    # of one position the later waypoint first: it cannot be ahead because of the earlier one
    order = [*at, "t", "id", F.desc("waypoint")]
    hits = settle(hits)
    sorted_ = lambda df: df.repartition(*at).sortWithinPartitions(*order)
    kinds = dict(hits.dtypes)
    leads = sorted_(hits.select(*at, "t", "id", "waypoint")).mapInArrow(each_run(_ways(n), at, ["session_id", "chunk", "leads"]), f"session_id {kinds['session_id']}, chunk long, leads array<int>")
    chain = leads.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "leads"))).alias("c"))
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<chunk:bigint,begin:int>>").alias("begins"))
    step = lambda s, x: F.struct(F.get(x["leads"], s["now"]).alias("now"), F.array_append(s["begins"], F.struct(x["chunk"].alias("chunk"), s["now"].alias("begin"))).alias("begins"))
    begins = chain.select("session_id", F.explode(F.aggregate("c", start, step)["begins"]).alias("b")).select("session_id", "b.chunk", "b.begin")
    placed = sorted_(hits.join(begins.hint("shuffle_merge"), at)).select(*at, "begin", "waypoint", "t", "id")
    shape = f"session_id {kinds['session_id']}, waypoint int, t {kinds['t']}, id {kinds['id']}"
    return placed.mapInArrow(each_run(_reached, at, ["session_id", "waypoint", "t", "id"]), shape)


def next_action(dx: Column, dy: Column, heading: Column, tolerance: float) -> Column:
    """What to do next for a waypoint at (dx, dy): rotate by the signed angle, or advance once within tolerance."""
    from ..functions.scalars import angle_delta, bearing

    turn = angle_delta(heading, bearing(dx, dy))
    return F.when(dx.isNull(), F.struct(F.lit("none").alias("action"), F.lit(None).cast("double").alias("turn"))).when(F.abs(turn) > tolerance, F.struct(F.lit("rotate").alias("action"), turn.alias("turn"))).otherwise(F.struct(F.lit("advance").alias("action"), F.lit(0.0).alias("turn")))
