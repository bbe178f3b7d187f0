"""Hand-made cases of composed checks: representatives, verdicts, waypoints, relations, missing values."""

import random

from pyspark.sql import functions as F

from evtrace.functions import scalars as S
from evtrace.operators import checks, lookups

HASHES = "grp string, id long, h long"


def _near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def _hashes(n):
    """Chains of near hashes with the top bit in use, and repeated ones."""
    rng, out = random.Random(3), []
    for i in range(n):
        h = rng.getrandbits(64) - 2**63 if not out or rng.random() < 0.2 else rng.choice(out)
        for _ in range(rng.randrange(7)):
            h ^= 1 << rng.randrange(63)
        out.append(h)
    return [("xy"[i % 2], i, h) for i, h in enumerate(out)]


def test_hash_pairs_against_all_pairs(spark):
    rows = _hashes(120)
    once = {}
    for g, i, h in rows:
        once.setdefault((g, h), i)
    known = [(g, i, h) for (g, h), i in once.items()]
    for most in (0, 3, 8, 12):
        want = {(min(a, b), max(a, b), _near(x, y)) for g, a, x in known for k, b, y in known if g == k and a < b and _near(x, y) <= most}
        got = [tuple(r)[1:] for r in lookups.hash_pairs(spark.createDataFrame(rows, HASHES), most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_representatives_against_a_plain_loop(spark):
    rows, reps, want = _hashes(150), [], {}
    for g, i, h in rows:
        hit = [j for k, j, x in reps if k == g and _near(x, h) <= 8]
        want[i] = hit[0] if hit else i
        if not hit:
            reps.append((g, i, h))
    got = {r["id"]: r["representative"] for r in checks.representatives(spark.createDataFrame(rows, HASHES)).collect()}
    assert got == want
    assert checks.representatives(spark.createDataFrame([], HASHES)).count() == 0


def test_promotions_give_all_reasons(spark):
    rows = [(1, "g", 1, "a", 0.9, 0.9, 5), (2, "g", 1, "a", 0.8, 0.9, 5), (3, "g", 1, "a", 0.1, 0.0, 5), (4, "g", 2, "z", 0.9, 0.9, 5), (5, "g", 2, "a", None, 0.9, 7)]
    df = spark.createDataFrame(rows, "id long, grp string, event long, kind string, confidence double, quality double, h long")
    got = {r["id"]: (r["decision"], r["duplicate_of"], r["reasons"]) for r in checks.promotions(df, {"a": 0.5}, 0.2, 2).collect()}
    assert got[1][0] == "promoted" and got[2][:2] == ("duplicate", 1)
    assert got[3] == ("review", None, ["poor_quality", "low_confidence", "not_selected"]) and got[4][2] == ["unknown_kind"]


def test_location_verdict_ladder(spark):
    rec = spark.createDataFrame([(i, None if i == 2 else "Bay 1", 0.8) for i in range(6)], "recovery_id long, expected string, confidence double")
    ev = [(0, 0, "text", "bay  1!", 0.9), (1, 0, "text", "Dock", 0.9), (2, 0, "text", "Dock", 0.5), (4, 0, "text", None, None), (5, 0, "text", "Bay 1", 0.9), (5, 0, "map", "Dock", 0.4)]
    df = spark.createDataFrame(ev, "recovery_id long, frame int, component string, detected string, score double")
    got = {r["recovery_id"]: (r["result"], r["status"]) for r in checks.location_verdicts(rec, df, {"text": 0.5, "map": 0.3}, 0.2).collect()}
    assert got == {0: ("PASS", "CONFIRMED"), 1: ("FAIL", "CONFLICT"), 2: ("OBSERVED", "NO_EXPECTED"), 3: ("UNCERTAIN", "NO_EVIDENCE"), 4: ("PASS", "CONFIRMED"), 5: ("UNCERTAIN", "AMBIGUOUS")}


def test_waypoints_go_one_a_tick(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (1, 1, 1, 0.0, 0.0), (1, 2, 2, 90.0, 0.0), (2, 0, 3, 90.0, 0.0), (2, 1, 4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "session_id long, t long, id long, x double, y double")
    got = {(r["session_id"], r["waypoint"], r["id"]) for r in checks.waypoint_progress(df, [(0.0, 0.0), (0.0, 10.0), (90.0, 0.0)], 50.0).collect()}
    assert got == {(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 4)}
    act = spark.sql("select 10d dx, 0d dy, 80d h union all select 10d, 0d, 0d union all select null, null, 0d").select(checks.next_action(F.col("dx"), F.col("dy"), F.col("h"), 15.0).alias("a")).collect()
    assert [(r["a"]["action"], r["a"]["turn"]) for r in act] == [("advance", 0.0), ("rotate", 90.0), ("none", None)]


def test_notes_names_and_scores_without_values(spark):
    row = spark.sql("select cast(null as string) s, cast(null as double) d, cast(null as array<string>) l").select(
        S.parse_conflict(F.col("s")).alias("c"), S.time_in_name(F.lit("a_t12.5_b")).alias("t"), S.notes_contain("x", F.col("l")).alias("n"), S.notes_contain("x", F.col("l"), F.array(F.lit("x"))).alias("y"),
        S.actor_scope(F.col("s"), F.lit("Ann-1"), F.lit("ann1")).alias("a"), S.actor_scope(F.lit("b"), F.col("s"), F.col("s")).alias("u"), S.capped_score([(0.5, F.col("d"), 0, 1), (0.9, F.lit(3.0), 0, 1)]).alias("k"),
    ).first()
    assert tuple(row["c"] or (None,) * 3) == (None, None, None)
    assert (row["t"], row["n"], row["y"], row["a"], row["u"], row["k"]) == (12.5, False, True, "own_down", "unresolved", 0.9)


def test_waypoints_across_chunks(spark):
    import random

    rng = random.Random(4)
    places = [(0.0, 0.0), (10.0, 0.0), (11.0, 0.0), (30.0, 0.0), (10.0, 0.0)]
    rows = [(s, i, rng.randrange(400), float(rng.choice([0, 10, 11, 12, 30, 70])), 0.0) for s in range(6) for i in range(s * 100, s * 100 + rng.randrange(1, 80))]
    want = set()
    for s in range(6):
        ahead = 0
        for _, i, t, x, y in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            if ahead < len(places) and abs(x - places[ahead][0]) <= 1.5:
                want.add((s, ahead, t, i))
                ahead += 1
    df = spark.createDataFrame(rows, "session_id long, id long, t long, x double, y double").repartition(5)
    for width in (7, 50, 10_000):
        assert {tuple(r) for r in checks.waypoint_progress(df, places, 1.5, width).collect()} == want
    assert checks.waypoint_progress(df.limit(0), places, 1.5).count() == 0


def test_artifacts_by_rule_and_target(spark):
    from evtrace.operators import incidents

    found = [(1, "a", "x"), (2, "a", None), (3, "b", "y"), (4, None, "x"), (5, "a", "q")]
    kept = [("a", "x", "ok", "p1"), ("a", None, "ok", "p2"), ("a", "z", "ok", "p3"), ("a", "x", "missing", "p4"), ("b", "x", "ok", "p5"), (None, "x", "ok", "p6"), ("a", "x", "ok", None)]
    got = incidents.artifact_lookup(spark.createDataFrame(found, "finding long, rule string, target string"), spark.createDataFrame(kept, "rule string, target string, status string, path string"))
    assert sorted((r["finding"], r["path"]) for r in got.collect()) == [(1, "p1"), (1, "p2"), (2, "p1"), (2, "p2"), (2, "p3"), (5, "p2")]


def test_location_verdicts_at_a_limit_in_any_order(spark):
    """Frames of 0.3 and 0.6 average to 0.45 and count as low, ten scores of 0.1 tie with one of 1: sums of doubles miss both."""
    rec = spark.createDataFrame([(1, "Dock", 0.0), (2, None, 0.0)], "recovery_id long, expected string, confidence double")
    low = [(1, 0, c, "Dock", s) for c, s in (("text", 0.1), ("map", 0.3), ("view", 0.5))] + [(1, 1, c, "Dock", s) for c, s in (("text", 0.4), ("map", 0.6), ("view", 0.8))]
    tie = [(2, f, "text", "B", 0.1) for f in range(10)] + [(2, 10, "text", "A", 1.0)]
    for rows in (low + tie, (low + tie)[::-1]):
        df = spark.createDataFrame(rows, "recovery_id long, frame int, component string, detected string, score double").coalesce(1)
        got = {r["recovery_id"]: r for r in checks.location_verdicts(rec, df, {"text": 0.2, "map": 0.2, "view": 0.2}, 0.15).collect()}
        assert (got[1]["status"], got[1]["score"], got[1]["confidence"]) == ("LOW_MATCH", 0.45, 0.55)
        assert got[2]["detected"] == "A" and got[2]["frames"] == 11


def test_representatives_in_batches_and_tiles(spark, monkeypatch):
    """Batches and blocks far smaller than a group, and 400 hashes of which nearly all are near each other."""
    monkeypatch.setattr(lookups, "TILE", 40)
    rng = random.Random(5)
    rows = _hashes(300) + [("z", 1000 + i, (1 << rng.randrange(63)) | (1 << rng.randrange(63)) | -(2**63)) for i in range(400)]
    want, reps = {}, []
    for g, i, h in sorted(rows, key=lambda r: r[1]):
        hit = [j for k, j, x in reps if k == g and _near(x, h) <= 8]
        want[i] = hit[0] if hit else i
        if not hit:
            reps.append((g, i, h))
    df = spark.createDataFrame(rows, HASHES)
    assert {r["id"]: r["representative"] for r in checks.representatives(df, 8, batch=20).collect()} == want
    once = {}
    for g, i, h in rows:
        once.setdefault((g, h), i)
    known = [(g, i, h) for (g, h), i in once.items()]
    pairs = [(min(a, b), max(a, b), _near(x, y)) for g, a, x in known for k, b, y in known if g == k and a < b and _near(x, y) <= 8]
    assert sorted(tuple(r)[1:] for r in lookups.hash_pairs(df, 8).collect()) == sorted(pairs)


def test_artifacts_that_agree_come_back_each(spark):
    from evtrace.operators import incidents

    found = [(i, "r", "x" if i % 2 else None) for i in range(6)]
    kept = [("r", "x", "ok", "p")] * 7 + [("r", None, "ok", "p")] * 5 + [("r", "y", "ok", "q")] * 3
    df = lambda: (spark.createDataFrame(found, "finding long, rule string, target string"), spark.createDataFrame(kept, "rule string, target string, status string, path string"))
    for limit in (0, 100):
        got = incidents.artifact_lookup(*df(), limit=limit, most=4)
        assert sorted((r["finding"], r["path"]) for r in got.collect()) == sorted((i, p) for i in range(6) for p in ["p"] * 12 + ["q"] * (0 if i % 2 else 3))


def test_artifacts_meet_findings_read_once(spark):
    """Any mix of missing rules and targets, against a plain loop; no finding is computed a second time."""
    from evtrace.operators import incidents

    rng, seen = random.Random(8), spark.sparkContext.accumulator(0)
    found = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 2, None])) for i in range(200)]
    kept = [(rng.choice(["a", "b", "d", None]), rng.choice([0, 1, 3, None]), rng.choice(["ok", "ok", "failed"]), rng.choice(["p", "q", None])) for _ in range(150)]
    want = sorted((i, p) for i, r, t in found for s, u, state, p in kept if r is not None and r == s and state == "ok" and p is not None and (t is None or u is None or t == u))

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    artifacts = spark.createDataFrame(kept, "rule string, target long, status string, path string")
    for limit in (0, 10_000):
        seen.value = 0
        findings = spark.createDataFrame(found, "finding long, rule string, target int").mapInArrow(told, "finding long, rule string, target int")
        got = incidents.artifact_lookup(findings, artifacts, limit=limit, most=3)
        assert got.columns == ["finding", "rule", "target", "path"]
        assert sorted((r["finding"], r["path"]) for r in got.collect()) == want and seen.value == len(found)


def test_nearest_reference_over_blocks_and_ties(spark):
    """Small blocks, copies that tie, and vectors without a direction, against a plain loop."""
    rng = random.Random(6)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]
    q, r = [(i, i % 2, vec()) for i in range(60)] + [(60, 0, None), (61, None, [1.0] * 3)], [(i, i % 2, vec()) for i in range(90)]

    def score(x, y):
        n = sum(a * a for a in x or []) ** 0.5 * sum(b * b for b in y) ** 0.5
        return round(sum(a * b for a, b in zip(x, y)) / n, 6) if n else -9

    want = {(i, n + 1, j) for i, c, x in q for n, (_, j) in enumerate(sorted((-score(x, y), j) for j, k, y in r if k == c)[:5])}
    got = lookups.nearest_reference(spark.createDataFrame(q, "q_id long, class int, q_v array<double>"), spark.createDataFrame(r, "r_id long, class int, r_v array<double>"), 5, block=7)
    assert {(x["q_id"], x["rank"], x["r_id"]) for x in got.collect()} == want
