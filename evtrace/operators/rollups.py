"""Results of rules: worst-wins roll-ups, summaries, matrices, indexes, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import exact, exact_mean
from .timeline import range_pairs

RESULTS = ("FAIL", "NEED_REVIEW", "UNCERTAIN", "PASS")  # the worst first


def worst(result: Column) -> Column:
    """Aggregate: the worst result of a group; UNCERTAIN for an empty one."""
    place = F.min(F.array_position(F.array(*map(F.lit, RESULTS)), result))
    return F.coalesce(F.element_at(F.array(*map(F.lit, RESULTS)), place.cast("int")), F.lit("UNCERTAIN"))


def objective_rollup(subjects: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per subject: worst result of its findings (keys, result, confidence), with a confidence by its kind.

    The highest of the failing or to be reviewed, the mean of the uncertain, the lowest of the passing; subjects
    without findings are UNCERTAIN at 0.
    """
    of = lambda r: F.when(F.col("result") == r, F.col("confidence"))
    found = findings.groupBy(*keys).agg(worst(F.col("result")).alias("result"), F.count("*").alias("findings"), F.max(of("FAIL")).alias("f"), F.max(of("NEED_REVIEW")).alias("n"), exact_mean(of("UNCERTAIN")).alias("u"), F.min(of("PASS")).alias("p"))
    out = subjects.join(found.hint("shuffle_merge"), keys, "left")
    conf = F.when(F.col("result") == "FAIL", F.col("f")).when(F.col("result") == "NEED_REVIEW", F.col("n")).when(F.col("result") == "UNCERTAIN", F.col("u")).otherwise(F.col("p"))
    return out.select(*keys, F.coalesce("result", F.lit("UNCERTAIN")).alias("result"), F.coalesce(conf, F.lit(0.0)).alias("confidence"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def session_verdicts(objectives: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict per subject over its objectives (keys, result, confidence, findings): the worst result, with a
    confidence by its kind as in objective_rollup, the number of each result and of all findings."""
    of = lambda r: F.when(F.col("result") == r, F.col("confidence"))
    counts = [F.count_if(F.col("result") == r).alias(r.lower()) for r in RESULTS]
    told = objectives.groupBy(*keys).agg(worst(F.col("result")).alias("verdict"), F.max(of("FAIL")).alias("_f"), F.max(of("NEED_REVIEW")).alias("_n"), exact_mean(of("UNCERTAIN")).alias("_u"), F.min(of("PASS")).alias("_p"), *counts, F.sum("findings").alias("findings"))
    conf = F.when(F.col("verdict") == "FAIL", F.col("_f")).when(F.col("verdict") == "NEED_REVIEW", F.col("_n")).when(F.col("verdict") == "UNCERTAIN", F.col("_u")).otherwise(F.col("_p"))
    return told.withColumn("confidence", F.coalesce(conf, F.lit(0.0))).drop("_f", "_n", "_u", "_p")


def dataset_verdict(verdicts: DataFrame) -> DataFrame:
    """One row: the worst verdict of all subjects, UNKNOWN without any, and how many have each."""
    counts = [F.count_if(F.col("verdict") == r).alias(r.lower()) for r in RESULTS]
    told = verdicts.agg(F.count("*").alias("subjects"), *counts)
    overall = F.when(F.col("subjects") == 0, "UNKNOWN")
    for r in RESULTS:
        overall = overall.when(F.col(r.lower()) > 0, r)
    return told.withColumn("verdict", overall.otherwise("UNKNOWN"))


def uncertainty_causes(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how often each note stands on a finding that did not pass (keys, note, findings)."""
    return found.where(F.col("result") != "PASS").select(*keys, F.explode("notes").alias("note")).groupBy(*keys, "note").agg(F.count("*").alias("findings"))


def timeline_summary(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Counts, first and last time and mean confidence per session; 0 and nulls for sessions without events."""
    found = events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("types"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), exact_mean(F.col("confidence")).alias("c"))
    out = sessions.join(found.hint("shuffle_merge"), "session_id", "left")
    return out.select("session_id", F.coalesce("n", F.lit(0)).cast("long").alias("events"), F.coalesce("types", F.lit(0)).cast("long").alias("types"), "first_t", "last_t", F.coalesce("c", F.lit(0.0)).alias("mean_confidence"))


def location_summary(recoveries: DataFrame, verdicts: DataFrame, most: int | None = None) -> DataFrame:
    """Per session its recoveries (session_id), how many location checks (session_id, result) each result has, and how many
    recoveries a limit of `most` checks leaves without one; 0 for sessions without checks."""
    results = ("PASS", "FAIL", "UNCERTAIN", "OBSERVED")
    every = recoveries.groupBy("session_id").agg(F.count("*").alias("recoveries"))
    told = verdicts.groupBy("session_id").agg(F.count("*").alias("checks"), *[F.count_if(F.col("result") == r).alias(r.lower()) for r in results])
    out = every.join(told.hint("shuffle_merge"), "session_id", "left").na.fill(0, ["checks", *map(str.lower, results)])
    skipped = F.lit(0) if most is None else F.greatest(F.lit(0), F.col("recoveries") - most)
    return out.withColumn("skipped", skipped.cast("long"))


def evidence_summary(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per session its evidence items (session_id, result), of each result, and its artifacts (session_id, status) that are
    ok, missing or disabled; sessions without items have no row."""
    of = items.groupBy("session_id").agg(F.count("*").alias("items"), *[F.count_if(F.col("result") == r).alias(r.lower()) for r in RESULTS])
    kept = artifacts.groupBy("session_id").agg(*[F.count_if(F.col("status") == k).alias("artifacts_" + k) for k in ("ok", "missing", "disabled")])
    return of.join(kept.hint("shuffle_merge"), "session_id", "left").na.fill(0, ["artifacts_ok", "artifacts_missing", "artifacts_disabled"])


def run_summary(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row over a dataset's runs (session_id, status): how many, completed, failed, and how many completed ones have
    each verdict (session_id, verdict); one without a verdict is unknown."""
    done = F.col("status") == "COMPLETED"
    told = runs.select("session_id", "status").join(verdicts.select("session_id", "verdict").hint("shuffle_merge"), "session_id", "left")
    known = [F.count_if(done & (F.col("verdict") == r)).alias(r.lower()) for r in RESULTS]
    return told.agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("failed"), *known, F.count_if(done & F.col("verdict").isNull()).alias("unknown"))


def status_counts(events: DataFrame, by: str) -> DataFrame:
    """How many events have each status, for each value of `by` and over all (null), in one pass; a null status is UNKNOWN."""
    named = events.withColumn("status", F.coalesce(F.upper("status"), F.lit("UNKNOWN")))
    return named.groupingSets([(F.col(by), F.col("status")), (F.col("status"),)], by, "status").agg(F.count("*").alias("events"))


def result_matrix(checks: DataFrame, *by: str, results=RESULTS) -> DataFrame:
    """In one pass one row per value of each column of `by` (the others null) and one for all, with a count per result; zeros where there are none."""
    counts = [F.count_if(F.col("result") == r).alias(r.lower()) for r in results]
    return checks.groupingSets([*((F.col(c),) for c in by), ()], *by).agg(F.count("*").alias("checks"), *counts)


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; partial top-k runs before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def weighted_offsets(anchors: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Weighted mean of dx and dy over anchors scoring over the threshold, rounded half to even, and their mean score.

    Offsets count to six places and scores to nine; sums are exact, so a mean halfway between two whole numbers is seen as
    one in whatever order rows come.
    """
    used = anchors.where(F.col("score") >= threshold).withColumn("_s", exact(F.col("score")))
    sums = used.groupBy(*keys).agg(*[F.sum(F.col(c).cast("decimal(20,6)") * F.col("_s")).alias(c) for c in ("dx", "dy")], F.sum("_s").alias("_d"), exact_mean(F.col("score")).alias("score"), F.count("*").alias("anchors"))

    def mean(c: str) -> Column:
        size, den = F.abs(c), F.col("_d")
        whole, twice = F.call_function("div", size, den), size % den + size % den
        up = (twice > den) | ((twice == den) & (whole % 2 == 1))
        return (F.signum(F.col(c)).cast("long") * (whole + up.cast("long"))).alias(c)

    return sums.select(*keys, F.when(F.col("_d") != 0, mean("dx")).alias("dx"), F.when(F.col("_d") != 0, mean("dy")).alias("dy"), "score", "anchors")


def review_package(checks: DataFrame, recoveries: DataFrame, before: int, after: int, rule: str = "recovery") -> DataFrame:
    """Checks that did not pass (session_id, check_id, rule, result, notes, t), with `exclusion`, null where one is to be reviewed.

    A failed check of `rule` for a missing recovery shows nothing wrong where a recovery (session_id, down_t, notes) from
    before its time until after it was searched to the session's end: it is excluded, with the reason.
    """
    open_ = checks.where(F.col("result") != "PASS")
    missed = open_.where((F.col("rule") == rule) & (F.col("result") == "FAIL") & F.array_contains("notes", "missing_recovery"))
    ended = recoveries.where(F.array_contains(F.split("notes", ",") if dict(recoveries.dtypes)["notes"] == "string" else F.col("notes"), "no_later_segment")).select("session_id", "down_t")
    near = range_pairs(missed.select("session_id", "check_id", "t"), ended, ["session_id"], before, after, "t", "down_t").select("session_id", "check_id").distinct()
    out = open_.join(near.withColumn("_out", F.lit(True)).hint("shuffle_merge"), ["session_id", "check_id"], "left")
    return out.withColumn("exclusion", F.when(F.col("_out"), "missing_recovery_at_end_no_later_segment")).drop("_out")


def evidence_index(artifacts: DataFrame) -> DataFrame:
    """Per artifact path its events and checks, each once and a row each: path, kind (event or check), id, seq of first sight.

    artifacts: path, event_id, check_id, seq; null ids name nothing.
    """
    named = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("id"))
    each = artifacts.select("path", "seq", F.explode(F.array(named("event", "event_id"), named("check", "check_id"))).alias("x")).where("x.id is not null")
    return each.groupBy("path", "x.kind", "x.id").agg(F.min("seq").alias("seq"))
