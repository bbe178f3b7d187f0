"""Declarative rules over incidents, each a ladder of conditions in order, and what a reader needs to follow them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import weighted

COUNTED = ("primary", "candidate")  # incidents that the count rule judges
DOWN = ("recovery", "recovery_missing", "down_only")  # incidents that the recovery rule judges
RULES = ("count", "signal", "recovery")


@dataclass(frozen=True)
class Policy:
    """Thresholds of the rules, times in microseconds, and what is required."""

    signal_min: float = 0.45
    max_delay: int = 2_000_000
    location_pass: float = 0.75
    location_fail: float = 0.45
    recovered_min: float = 0.50
    change_required: bool = True  # after a signal
    signal_required: bool = True  # for a change, by the count rule
    signal_required_alone: bool = False  # for a change, by the signal rule
    down_signal_required: bool = True
    down_signal_optional: bool = True  # its absence is no failure
    recovery_required: bool = True
    location_required: bool = True
    fail_missing: bool = True
    fail_down_only: bool = False


def _finding(result: Column | str, confidence: Column, *notes: str) -> Column:
    result = F.lit(result) if isinstance(result, str) else result
    return F.struct(result.alias("result"), confidence.cast("double").alias("confidence"), F.array(*map(F.lit, notes)).cast("array<string>").alias("notes"))


def _ladder(*steps: tuple[Column, Column], otherwise: Column) -> Column:
    out = None
    for when, then in steps:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def count_rule(p: Policy) -> Column:
    """Whether a signal and a change go together: struct<result, confidence, notes> of a COUNTED incident."""
    own, signal, change = F.col("confidence"), F.coalesce("signal_conf", F.lit(0.0)), F.coalesce("change_conf", F.lit(0.0))
    has_signal, has_change = signal >= p.signal_min, change >= p.signal_min
    both = weighted((0.5, change), (0.3, signal), (0.2, own))
    in_time = F.col("delay").isNull() | (F.col("delay") <= p.max_delay)
    return _ladder(
        (has_signal & has_change & in_time, _finding("PASS", both)),
        (has_signal & has_change, _finding("FAIL", both, "change_delay_exceeded")),
        (has_signal, _finding("FAIL" if p.change_required else "UNCERTAIN", weighted((0.65, signal), (0.35, own)), "missing_change")),
        (has_change, _finding("NEED_REVIEW" if p.signal_required else "PASS", weighted((0.7, change), (0.3, own)), "change_without_signal")),
        otherwise=_finding("UNCERTAIN", own, "weak_evidence"),
    )


def signal_rule(p: Policy) -> Column:
    """Whether signals show where they should: of a COUNTED or DOWN incident."""
    own, signal, change = F.col("confidence"), F.coalesce("signal_conf", F.lit(0.0)), F.coalesce("change_conf", F.lit(0.0))
    seen = _finding("PASS", weighted((0.65, signal), (0.35, own)))
    only_change = _finding("FAIL" if p.signal_required_alone else "PASS", weighted((0.65, change), (0.35, own)), "missing_signal" if p.signal_required_alone else "change_only_ignored")
    counted = _ladder((signal >= p.signal_min, seen), (change >= p.signal_min, only_change), otherwise=_finding("UNCERTAIN", own, "weak_signal"))
    support = F.greatest(F.coalesce("recovery_conf", F.lit(0.0)), F.coalesce("state_conf", F.lit(0.0)), own)
    absent = _finding("PASS", support, "missing_optional_signal") if p.down_signal_optional else _finding("FAIL", support, "missing_signal")
    needed = (support >= p.signal_min) & F.lit(p.down_signal_required)
    down = _ladder((signal >= p.signal_min, seen), (needed, absent), otherwise=_finding("UNCERTAIN", support, "weak_signal"))
    return F.when(F.col("incident_type").isin(*COUNTED), counted).otherwise(down)


def recovery_rule(p: Policy) -> Column:
    """Whether what went down came back, and where: of a DOWN incident."""
    own, kind = F.col("confidence"), F.col("incident_type")
    back, verdict, score = F.coalesce("recovery_conf", "confidence"), F.upper("location_result"), F.coalesce("location_score", F.lit(0.0))
    placed = _ladder(
        ((verdict == "PASS") & (score >= p.location_pass), _finding("PASS", weighted((0.75, score), (0.25, back)))),
        ((verdict == "FAIL") | (score <= p.location_fail), _finding("FAIL", F.greatest(score, own), "location_mismatch_or_low_score")),
        (verdict.isin("UNCERTAIN", "OBSERVED", "UNKNOWN"), _finding("UNCERTAIN", F.greatest(score, weighted((0.5, own))), "location_uncertain")),
        otherwise=_finding("NEED_REVIEW", F.greatest(score, own), "unexpected_location_status"),
    )
    recovered = F.when(back >= p.recovered_min, "PASS").otherwise("UNCERTAIN")
    found = F.when(verdict.isNull(), _finding("UNCERTAIN", own, "missing_location_check")).otherwise(placed) if p.location_required else _finding(recovered, F.greatest(back, own), "location_check_disabled")
    return _ladder(
        (kind == "recovery_missing", _finding("FAIL" if p.fail_missing else "UNCERTAIN", F.greatest(own, back), "missing_recovery")),
        (kind == "down_only", _finding("FAIL" if p.fail_down_only else "UNCERTAIN", own, "down_without_recovery")),
        otherwise=found,
    )


def findings(incidents: DataFrame, sessions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """session_id, incident_id, rule, result, confidence, notes: a finding per incident and rule that judges it.

    incidents: session_id, incident_id, incident_type, confidence, and, null where absent, signal_conf, change_conf,
    delay, recovery_conf, state_conf, location_result, location_score. A rule without incidents in a session gives one
    finding without incident: UNCERTAIN at 0, but PASS at 1 for recoveries, as none was needed. A rule that the policy
    switches off gives PASS at 1 for every session.
    """
    kind = F.col("incident_type")
    counts_off, recovery_off = not policy.change_required and not policy.signal_required, not policy.recovery_required
    at = {"count": kind.isin(*COUNTED), "signal": kind.isin(*COUNTED, *DOWN), "recovery": kind.isin(*DOWN)}
    off = {"count": counts_off, "signal": False, "recovery": recovery_off}
    judged = {"count": count_rule(policy), "signal": signal_rule(policy), "recovery": recovery_rule(policy)}
    own = [F.when(at[r], F.struct(F.lit(r).alias("rule"), judged[r].alias("f"))) for r in RULES if not off[r]]
    found = incidents.select("session_id", "incident_id", F.explode(F.array_compact(F.array(*own))).alias("x")).select("session_id", "incident_id", "x.rule", "x.f.*")
    have = incidents.groupBy("session_id").agg(*[F.bool_or(at[r]).alias(r) for r in RULES])
    bare = sessions.select("session_id").join(have.hint("shuffle_merge"), "session_id", "left")

    def empty(rule: str) -> Column:
        if off[rule]:
            return F.struct(F.lit(rule).alias("rule"), _finding("PASS", F.lit(1.0), "rule_disabled").alias("f"))
        said = _finding("PASS", F.lit(1.0), "no_recovery_required") if rule == "recovery" else _finding("UNCERTAIN", F.lit(0.0), "no_incidents")
        return F.when(~F.coalesce(F.col(rule), F.lit(False)), F.struct(F.lit(rule).alias("rule"), said.alias("f")))

    none = bare.select("session_id", F.explode(F.array_compact(F.array(*map(empty, RULES)))).alias("x")).select("session_id", F.lit(None).cast(incidents.schema["incident_id"].dataType).alias("incident_id"), "x.rule", "x.f.*")
    return found.unionByName(none)


def decision_trace(found: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """findings with `trace`: per rule the conditions it rests on.

    found: what findings() gives, with incident_type, signal_conf, change_conf and recovery_conf of the incident. A
    condition is a struct of condition, expected, observed, confidence, result (satisfied, conflict, not_satisfied or
    not_required) and note.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(0.0))

    def condition(name, expected, observed, confidence, result, note=None):
        return F.struct(F.lit(name).alias("condition"), F.lit(expected).alias("expected"), observed.alias("observed"), confidence.cast("double").alias("confidence"), result.alias("result"), (F.lit("") if note is None else note).alias("note"))

    seen = lambda name: c(name) >= policy.signal_min
    told = lambda name, needed: F.when(seen(name), "satisfied").otherwise("not_satisfied" if needed else "not_required")
    count = F.array(
        condition("change_detected", policy.change_required, seen("change_conf"), c("change_conf"), told("change_conf", policy.change_required)),
        condition("signal_detected", policy.signal_required, seen("signal_conf"), c("signal_conf"), told("signal_conf", policy.signal_required)),
    )
    optional = policy.down_signal_optional
    signal = F.when(
        F.col("incident_type") == "primary", F.array(condition("signal_detected", True, seen("signal_conf"), c("signal_conf"), told("signal_conf", True)))
    ).when(
        F.col("incident_type").isin(*DOWN),
        F.array(condition("down_signal_detected", True, seen("signal_conf"), c("signal_conf"), told("signal_conf", not optional), F.when(~seen("signal_conf") & F.lit(optional), "optional").otherwise(""))),
    ).otherwise(F.array().cast(count_type()))
    passed = F.col("result") == "PASS"
    recovery = F.array(condition("recovery_detected", True, passed, F.coalesce("recovery_conf", "confidence"), F.when(passed, "satisfied").otherwise("not_satisfied"), F.lit("" if policy.location_required else "location check disabled")))
    return found.withColumn("trace", F.when(F.col("rule") == "count", count).when(F.col("rule") == "signal", signal).otherwise(recovery))


def count_type() -> str:
    """Type of a trace."""
    return "array<struct<condition:string,expected:boolean,observed:boolean,confidence:double,result:string,note:string>>"
