"""Scalar column functions: confidences, states, names, angles, boxes, hashes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

#: Rank of event statuses, best first.
STATUS_RANK = {"CONFIRMED": 5, "PASS": 5, "INFERRED": 4, "OBSERVED": 3, "UNCERTAIN": 2, "NEED_REVIEW": 2, "CONFLICT": 1, "FAIL": 1, "MISSING": 1, "UNKNOWN": 0}


def safe_double(c: Column, default: float = 0.0) -> Column:
    """c as a finite double; anything else is the default."""
    x = c.cast("string").try_cast("double") if hasattr(Column, "try_cast") else c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe_double(c)))


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def status_from_confidence(confidence: Column, parts: Column, conflict: Column | None = None) -> Column:
    out = F.when((confidence >= 0.75) & (parts >= 2), "CONFIRMED").when(confidence >= 0.5, "INFERRED").otherwise("UNCERTAIN")
    return out if conflict is None else F.when(conflict, "NEED_REVIEW").otherwise(out)


def seconds(micros: Column) -> Column:
    """Microseconds as text in seconds, three places, half up."""
    ms = F.floor((micros + 500) / 1000).cast("long")
    return F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)


def exact(c: Column) -> Column:
    """A confidence as a decimal of nine places: sums of these do not depend on the order of rows."""
    return c.cast("decimal(12,9)")


def exact_mean(c: Column) -> Column:
    """Aggregate: the mean of exact values, as a double."""
    return F.avg(exact(c)).cast("double")


def weighted(*parts: tuple[float, Column]) -> Column:
    """Weighted sum, worked out in decimals, held to 0..1; missing values add 0."""
    total = sum((F.coalesce(exact(c), F.lit(Decimal(0))) * F.lit(Decimal(str(w))) for w, c in parts), F.lit(Decimal(0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total.cast("double")))


def renormalized_confidence(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are present, worked out in decimals; 0 if none is."""
    weigh = lambda w: F.lit(Decimal(str(w)))
    none = F.lit(Decimal(0))
    weight = sum((F.when(c.isNotNull(), weigh(w)).otherwise(none) for w, c in parts if w > 0), none)
    value = sum((F.coalesce(exact(c) * weigh(w), none) for w, c in parts if w > 0), none)
    return F.when(weight > 0, (value / weight).cast("double")).otherwise(0.0)


def classify(c: Column, rules: list[tuple[Column, str]], default: str = "other") -> Column:
    """First rule that holds, in the given order."""
    out = None
    for when, name in rules:
        out = F.when(when, name) if out is None else out.when(when, name)
    return F.lit(default) if out is None else out.otherwise(default)


def normalize_class(c: Column, synonyms: dict[str, str]) -> Column:
    key = F.regexp_replace(F.trim(F.lower(c)), r"[\s-]+", "_")
    if not synonyms:
        return key
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in synonyms.items() for x in p]), key), key)


def argmax_with_priority(scores: list[tuple[str, Column]], threshold: float) -> Column:
    """struct<state, confidence>: the best state, the earlier of equals; under the threshold unknown and 0."""
    best = F.array_max(F.array(*[F.struct(F.coalesce(c, F.lit(0.0)).alias("s"), F.lit(-i).alias("p"), F.lit(n).alias("n")) for i, (n, c) in enumerate(scores)]))
    ok = best["s"] >= threshold
    return F.struct(F.when(ok, best["n"]).otherwise("unknown").alias("state"), F.when(ok, best["s"]).otherwise(0.0).alias("confidence"))


def normalize_name(c: Column, codes: tuple[str, ...] = ()) -> Column:
    """Letters and digits, single spaces, initial capitals; codes before another word or a mark keep their capitals."""
    out = F.initcap(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9 ]+", " "), r"\s+", " "))
    for code in codes:
        out = F.replace(out, F.lit(code.capitalize() + " "), F.lit(code + " "))
    return F.trim(out)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "_"), r"^_+|_+$", "")


def digits_only(c: Column) -> Column:
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(d != "", d.cast("long"))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, where y grows downwards."""
    return F.pmod(F.degrees(F.atan2(dx, -dy)) + 360.0, F.lit(360.0))


def angle_delta(a: Column, b: Column) -> Column:
    """Signed shortest turn from a to b, in (-180, 180]."""
    d = F.pmod(b - a, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def grid_cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def cell_centre(v: Column, size: float) -> Column:
    """Centre of the grid cell that v lies in."""
    return (F.floor(v / size) + 0.5) * size


def rotated(x: Column, y: Column, height: float) -> Column:
    """struct<x, y> of a point turned a quarter clockwise in a frame of that height."""
    return F.struct((F.lit(height) - y).alias("x"), x.alias("y"))


def clamped(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def expand_box(x: Column, y: Column, w: Column, h: Column, by: int) -> Column:
    """struct<x, y, w, h> grown by `by` on every side."""
    return F.struct((x - by).alias("x"), (y - by).alias("y"), (w + 2 * by).alias("w"), (h + 2 * by).alias("h"))


def shift_box(x: Column, y: Column, w: Column, h: Column, dx: Column, dy: Column) -> Column:
    return F.struct((x + dx).alias("x"), (y + dy).alias("y"), w.alias("w"), h.alias("h"))


def clip_box(x, y, w, h, width, height) -> Column:
    """Box within width x height, at least one pixel each way."""
    x1, y1 = F.greatest(F.lit(0), F.least(x, F.lit(width - 1))), F.greatest(F.lit(0), F.least(y, F.lit(height - 1)))
    return F.struct(x1.alias("x"), y1.alias("y"), F.greatest(F.lit(1), F.least(w, F.lit(width) - x1)).alias("w"), F.greatest(F.lit(1), F.least(h, F.lit(height) - y1)).alias("h"))


def rescale(v: Column, factor: float) -> Column:
    """v times factor, rounded half to even."""
    return F.bround(v * factor).cast("long")


def region_confidence(template: Column, anchor: Column) -> Column:
    return F.when(template.isNotNull(), F.greatest(F.lit(0.5), template)).when(anchor.isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(0.9), anchor))).otherwise(0.70)


def diff_hash(values: Column) -> Column:
    """Bit i is set where element i + 1 exceeds element i: at most 64 bits, as a signed long."""
    n = F.least(F.size(values) - 1, F.lit(64))
    bits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get(values, i + 1) > F.get(values, i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(n >= 1, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 999 if a hash is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def evidence_window(t: Column, end: Column, before: int, after: int, least: int) -> Column:
    """struct<lo, hi> around an event in microseconds, never under `least` long nor before 0."""
    lo = F.greatest(F.lit(0).cast("long"), t - before)
    hi = F.when(end >= t, end).otherwise(t) + after
    return F.struct(lo.alias("lo"), F.greatest(lo + least, hi).alias("hi"))


#: Fixed values of `focus_time`: shares of a session at which checks without a time look, and the time where nothing is known.
FOCUS, NO_FOCUS = (0.18, 0.34, 0.50, 0.66, 0.82), 8_000_000


def focus_time(t: Column, lo: Column, hi: Column, duration: Column, number: Column) -> Column:
    """Where to look for a check, in microseconds: its time, else the middle of its range, else a share of its session by
    its number, a second off both ends; 8 s where the duration is not known either."""
    ends = F.array_compact(F.array(lo.cast("double"), hi.cast("double")))
    middle = F.when(F.size(ends) > 0, F.aggregate(ends, F.lit(0.0), lambda a, x: a + x) / F.size(ends))
    share = F.get(F.array(*map(F.lit, FOCUS)), F.pmod(F.coalesce(number, F.lit(0)), F.lit(len(FOCUS))).cast("int"))
    second = F.lit(1_000_000.0)
    placed = F.least(F.greatest(second, duration * share), F.greatest(second, duration - second))
    return F.coalesce(t.cast("double"), middle, F.when(duration > 0, placed), F.lit(float(NO_FOCUS)))


def capped_score(terms: list[tuple[float, Column, float, float]]) -> Column:
    """Sum of weight times (value - low) / (high - low), each held to 0..1, and so is the sum; missing values add 0."""
    total = F.lit(0.0)
    for weight, value, low, high in terms:
        total = total + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce((value - low) / (high - low), F.lit(0.0))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


#: Fixed values of `relation`: least share of coloured points, share at which a side is sure, what an inferred side keeps.
LEAST_SHARE, FULL_SHARE, SURE, INFERRED, ENOUGH = 0.003, 1 / 80, 0.55, 0.80, 0.25


def relation(first_a: Column, first_b: Column, second_a: Column, second_b: Column, a: str, b: str) -> Column:
    """struct<first, second, confidence, status, note> of two actors from the shares of side a's and b's colour by each.

    Both sure of one side: neither counts. One sure, the other missing or of the same side: it gets the other side.
    """
    share = lambda x, y: F.when(x + y >= LEAST_SHARE, F.struct(F.when(x > y, a).otherwise(b).alias("side"), (F.abs(x - y) / (x + y) * F.least(F.lit(1.0), (x + y) / FULL_SHARE)).alias("c"))).otherwise(F.struct(F.lit(None).cast("string").alias("side"), F.lit(0.0).alias("c")))
    other = lambda s: F.when(s == a, b).when(s == b, a)
    p, q = share(first_a, first_b), share(second_a, second_b)
    clash = F.coalesce(p["side"] == q["side"], F.lit(False))
    known = lambda x: x["side"].isNotNull() & (x["c"] >= SURE)
    case = F.when(clash & known(p) & known(q), "same_side_rejected").when(known(p) & (q["side"].isNull() | clash), "second_inferred").when(known(q) & (p["side"].isNull() | clash), "first_inferred")
    none = F.lit(None).cast("string")
    first = F.when(case == "same_side_rejected", none).when(case == "first_inferred", other(q["side"])).otherwise(p["side"])
    second = F.when(case == "same_side_rejected", none).when(case == "second_inferred", other(p["side"])).otherwise(q["side"])
    pc = F.when(case == "first_inferred", F.greatest(p["c"], q["c"] * INFERRED)).otherwise(p["c"])
    qc = F.when(case == "second_inferred", F.greatest(q["c"], p["c"] * INFERRED)).otherwise(q["c"])
    conf = F.when((pc > 0) & (qc > 0), (pc + qc) / 2).otherwise(pc + qc)
    ok = first.isNotNull() & second.isNotNull() & (first != second) & (conf >= ENOUGH)
    return F.struct(first.alias("first"), second.alias("second"), conf.alias("confidence"), F.when(ok, "ok").otherwise("low_confidence").alias("status"), case.alias("note"))


def actor_scope(first: Column, second: Column, own: Column) -> Column:
    """Whose event it is, by names without case and marks: own, own_down, other or unresolved."""
    plain = lambda c: F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))
    x, y, me = plain(first), plain(second), plain(own)
    return F.when((me == "") | ((x == "") & (y == "")), "unresolved").when(x == me, "own").when(y == me, "own_down").otherwise("other")


def parse_conflict(note: Column) -> Column:
    """struct<observed, expected, confidence> of a note `...conflict:<observed>!=<expected>@<number>`; nulls if it is none."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(note, r"conflict:([^!=@]+)!=([^@]+)@([0-9.]+)", i)), F.lit(""))
    return F.struct(part(1).alias("observed"), part(2).alias("expected"), part(3).try_cast("double").alias("confidence"))


def time_in_name(name: Column) -> Column:
    """Seconds after `_t` in a name, or null."""
    return F.regexp_extract(name, r"_t([0-9]+(\.[0-9]+)?)", 1).try_cast("double")


def notes_contain(tag: str, *notes: Column) -> Column:
    """Whether any of several lists of notes holds the tag; missing lists hold nothing."""
    held = F.lit(False)
    for n in notes:
        held = held | F.coalesce(F.array_contains(n, tag), F.lit(False))
    return held


#: States that state_scores() scores, in the order in which the first of equals counts.
STATES = ("up", "engaged", "overlay", "down", "panel", "recovered", "menu", "unknown")
LOW_PRESENCE = 0.12  # every presence below it: nothing of the display is there


def state_scores(presence: dict[str, Column], template: dict[str, Column], hint: dict[str, Column]) -> dict[str, Column]:
    """Score of each of STATES from what of the display is present, template matches and hints, all 0..1.

    presence: health, tool, aim, map, bar. template: up, overlay, down, panel, menu. hint: overlay, panel, recovered.
    """
    of = lambda d, k: clamp01(d[k]) if k in d else F.lit(0.0)
    has = {k: of(presence, k) for k in ("health", "tool", "aim", "map", "bar")}
    display = clamp01(0.30 * has["health"] + 0.35 * has["tool"] + 0.20 * has["aim"] + 0.10 * has["map"] + 0.05 * has["bar"])
    panel = F.greatest(of(template, "panel"), of(template, "down") * 0.85, of(hint, "panel"))
    down = F.greatest(of(template, "down"), panel * 0.92, clamp01((1 - has["tool"]) * 0.30 + (1 - has["aim"]) * 0.25 + of(hint, "panel") * 0.45))
    up = F.greatest(of(template, "up"), display * (1 - F.least(F.lit(0.85), panel)))
    recovered = F.greatest(of(hint, "recovered"), F.when(of(hint, "recovered") > 0, up * 0.70).otherwise(0.0))
    bare = clamp01((1 - has["health"]) * 0.25 + (1 - has["tool"]) * 0.25 + (1 - has["map"]) * 0.25 + (1 - has["bar"]) * 0.25)
    menu = F.greatest(of(template, "menu"), F.when(F.greatest(has["health"], has["tool"], has["map"], has["bar"]) < LOW_PRESENCE, bare).otherwise(0.0))
    scores = (up, F.lit(0.0), F.greatest(of(template, "overlay"), of(hint, "overlay")), down, panel, recovered, menu, F.lit(0.0))
    return {k: clamp01(v) for k, v in zip(STATES, scores)}


def display_gate(luma: Column, bright: Column, white: Column, *colours: Column) -> Column:
    """Whether a frame shows the display: bright enough, with white marks and at least one team colour in some half."""
    any_colour = F.lit(False)
    for c in colours:
        any_colour = any_colour | (c >= 0.04)
    return F.coalesce((luma >= 45.0) & (bright >= 0.08) & (white >= 0.04) & any_colour, F.lit(False))
