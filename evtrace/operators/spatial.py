"""Positions: steps, recoveries, headings, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import bearing
from .chunks import DAY
from .timeline import range_pairs, running_last, with_previous

Ring = list[tuple[float, float]]


def trajectory(positions: DataFrame) -> DataFrame:
    """Step length and distance from the session's first position (session_id, id, t, x, y)."""
    first = positions.groupBy("session_id").agg(F.min_by(F.struct("x", "y"), F.struct("t", "id")).alias("home"))
    seen = with_previous(positions, ["session_id"], "t", "id", ["x", "y"]).join(first.hint("shuffle_merge"), "session_id")
    out = seen.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")), F.lit(0.0))).withColumn("from_home", F.hypot(F.col("x") - F.col("home.x"), F.col("y") - F.col("home.y")))
    return out.drop("prev", "home")


def _stretches(path: DataFrame, jump: float, near: float) -> DataFrame:
    """path with `back` (a jump over `jump` that lands within `near` of home) and `stretch`, the last such row before each row."""
    marked = path.withColumn("back", (F.col("step") > jump) & (F.col("from_home") < near))
    seen = with_previous(marked, ["session_id"], "t", "id", ["t", "id", "back"], "_p")
    return running_last(seen, ["session_id"], "t", "id", F.when(F.col("_p.back"), F.struct("_p.t", "_p.id")), "stretch").drop("_p")


def teleports(path: DataFrame, jump: float, near: float, moved: float = 150.0, most: int = 5) -> DataFrame:
    """Recoveries by teleport: rows of a trajectory that jump over `jump` and land within `near` of home, once the
    session has been over `moved` away from home since the last one; at most `most` per session (session_id, id, t, n).

    The farthest point between two jumps is a grouped maximum; only the jumps, rare rows, are folded in their order.
    """
    far = _stretches(path, jump, near).groupBy("session_id", "stretch").agg(F.max("from_home").alias("far"), F.max(F.when(F.col("back"), F.struct("t", "id"))).alias("at"))
    jumps = far.where("at is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "far"))).alias("jumps"))
    start = F.struct(F.lit(0.0).alias("far"), F.array().cast("array<struct<t:bigint,id:bigint>>").alias("found"))

    def step(s, x):
        far = F.greatest(s["far"], x["far"])
        hit = (far > moved) & (F.size(s["found"]) < most)
        taken = F.array(F.struct(x["at"]["t"].cast("bigint").alias("t"), x["at"]["id"].cast("bigint").alias("id")))
        return F.struct(F.when(hit, F.lit(0.0)).otherwise(far).alias("far"), F.when(hit, F.concat(s["found"], taken)).otherwise(s["found"]).alias("found"))

    found = jumps.select("session_id", F.aggregate("jumps", start, step)["found"].alias("found"))
    return found.select("session_id", F.posexplode("found").alias("n", "f")).select("session_id", "f.id", "f.t", (F.col("n") + 1).alias("n"))


def farthest_since(path: DataFrame, jump: float, near: float) -> DataFrame:
    """path with `farthest`: the greatest distance from home since the last jump home, the row's own included."""
    rows = _stretches(path, jump, near).withColumn("_c", F.floor(F.col("t") / (7 * DAY)))
    own = W.partitionBy("session_id", "stretch", "_c").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    near_max = rows.withColumn("_near", F.max("from_home").over(own))
    per = rows.groupBy("session_id", "stretch", "_c").agg(F.max("from_home").alias("_m"))
    before = per.withColumn("_far", F.max("_m").over(W.partitionBy("session_id", "stretch").orderBy("_c").rowsBetween(W.unboundedPreceding, -1))).drop("_m")
    same = F.col("a.session_id").eqNullSafe(F.col("b.session_id")) & F.col("a.stretch").eqNullSafe(F.col("b.stretch")) & (F.col("a._c") == F.col("b._c"))
    out = near_max.alias("a").join(before.alias("b").hint("shuffle_hash"), same, "left")
    return out.select(*[F.col(f"a.{c}") for c in path.columns], F.greatest("a._near", F.coalesce("b._far", F.lit(0.0))).alias("farthest"))


def settle_after(recoveries: DataFrame, path: DataFrame, step: float, rows: int, most: int) -> DataFrame:
    """Per recovery (session_id, id, t) when the session has made `rows` steps in a row under `step`; after `most` it counts
    as over without that (session_id, id, settled_t, settled)."""
    a = recoveries.select("session_id", F.col("id").alias("r_id"), F.col("t").alias("r_t"))
    pairs = range_pairs(a, path.select("session_id", F.col("id").alias("p_id"), F.col("t").alias("p_t"), "step"), ["session_id"], -1, most, "r_t", "p_t")
    w = W.partitionBy("r_id").orderBy("p_t", "p_id")  # at most what `most` holds
    runs = pairs.withColumn("calm", F.col("step") < step).withColumn("run", F.sum(F.when(F.col("calm"), 0).otherwise(1)).over(w))
    ranked = runs.where("calm").withColumn("n", F.row_number().over(W.partitionBy("r_id", "run").orderBy("p_t", "p_id")))
    first = ranked.where(F.col("n") == rows).groupBy("r_id").agg(F.min("p_t").alias("s"))
    out = a.join(first.hint("shuffle_merge"), "r_id", "left")
    return out.select("session_id", F.col("r_id").alias("id"), F.coalesce("s", F.col("r_t") + most).alias("settled_t"), F.col("s").isNotNull().alias("settled"))


def snap_to_walkable(points: DataFrame, obstacles: list[Ring], corridors: list[Ring], floors: list[Ring], cell: float, width: int, height: int, reach: int = 59, limit: int = 1_000_000) -> DataFrame:
    """points (id, x, y) moved to the centre of the nearest walkable cell of a grid of width x height cells.

    Nearest is by square ring, then by the smaller step in x, then in y, at most `reach` rings away; without any the
    point only gets whole coordinates. Cells are searched once each, not once per point.
    """
    if width * height > limit:
        raise ValueError(f"a grid of {width * height} cells; at most {limit} are sent along")
    spark = points.sparkSession
    grid = spark.range(width * height).select((F.col("id") % width).alias("gx"), F.floor(F.col("id") / width).alias("gy"))
    centre = lambda c: (F.col(c) + 0.5) * cell
    free = grid.where(walkable(centre("gx"), centre("gy"), obstacles, corridors, floors))
    at = points.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    used = at.select("gx", "gy").distinct()
    blocks = lambda c: F.floor(F.col(c) / (reach + 1))  # noqa: E731  a cell's neighbours lie in its block of cells or the next ones
    sought = used.withColumn("bx", F.explode(F.sequence(blocks("gx") - 1, blocks("gx") + 1))).withColumn("by", F.explode(F.sequence(blocks("gy") - 1, blocks("gy") + 1)))
    near = sought.join(F.broadcast(free.select(F.col("gx").alias("fx"), F.col("gy").alias("fy"), blocks("gx").alias("bx"), blocks("gy").alias("by"))), ["bx", "by"])
    dx, dy = F.col("fx") - F.col("gx"), F.col("fy") - F.col("gy")
    ring = F.greatest(F.abs(dx), F.abs(dy))
    best = near.where(ring <= reach).groupBy("gx", "gy").agg(F.min(F.struct(ring.alias("r"), dx.alias("dx"), dy.alias("dy"))).alias("m"))
    out = at.join(best.hint("shuffle_hash"), ["gx", "gy"], "left")
    moved = lambda g, d, own: F.when(F.col("m").isNull(), F.bround(own)).otherwise(F.bround((F.col(g) + F.col(d)) * cell + cell / 2)).cast("long")
    return out.select(*points.columns, moved("gx", "m.dx", "x").alias("sx"), moved("gy", "m.dy", "y").alias("sy"))


def headings(points: DataFrame) -> DataFrame:
    """Heading per waypoint: its own, else the bearing to the next point, else the last known, at first 90."""
    turned = points.withColumns({"_t": -F.col("t"), "_i": -F.col("id")})  # the next row is the one before, backwards in time
    ahead = with_previous(turned, ["session_id"], "_t", "_i", ["x", "y"], "_n").withColumns({"nx": F.col("_n.x") - F.col("x"), "ny": F.col("_n.y") - F.col("y")})
    own = F.coalesce("heading", F.when((F.col("nx") != 0) | (F.col("ny") != 0), bearing(F.col("nx"), F.col("ny"))))
    return running_last(ahead, ["session_id"], "t", "id", own, "_h").withColumn("heading", F.coalesce("_h", F.lit(90.0))).select(*points.columns)


def in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Ray cast: whether (x, y) lies inside a ring of corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        hit = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < F.lit(float(x2 - x1)) * (y - float(y1)) / float(y2 - y1) + float(x1))
        crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def walkable(x: Column, y: Column, obstacles: list[Ring], corridors: list[Ring], floors: list[Ring]) -> Column:
    """Obstacles beat corridors, corridors beat floors; nothing else is walkable."""
    any_of = lambda rings: F.lit(False) if not rings else _any([in_ring(x, y, r) for r in rings])
    return F.when(any_of(obstacles), False).when(any_of(corridors), True).otherwise(any_of(floors))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def line_of_sight(pairs: DataFrame, obstacles: list[Ring], corridors: list[Ring], floors: list[Ring], cell: float) -> DataFrame:
    """Whether every cell between two points (id, x1, y1, x2, y2) is walkable, sampled at grid steps."""
    g = lambda c: F.floor(F.col(c) / cell)
    steps = F.greatest(F.abs(g("x2") - g("x1")), F.abs(g("y2") - g("y1")), F.lit(1))
    at = pairs.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    mid = lambda a, b: (F.round(g(a) + (g(b) - g(a)) * F.col("i") / F.col("steps")) + 0.5) * cell
    return at.groupBy("id").agg(F.bool_and(walkable(mid("x1", "x2"), mid("y1", "y2"), obstacles, corridors, floors)).alias("clear"))


def settled_at(path: DataFrame, step: float, rows: int) -> DataFrame:
    """First time at which a session has made `rows` consecutive steps under `step`."""
    from .timeline import islands

    runs = islands(path.withColumn("calm", F.col("step") < step), ["session_id"], "t", "id", changes=["calm"]).where("calm")
    ranked = runs.withColumn("n", F.row_number().over(W.partitionBy("session_id", "island").orderBy("t", "id")))
    return ranked.where(F.col("n") == rows).groupBy("session_id").agg(F.min("t").alias("t"))
