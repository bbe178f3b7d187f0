"""Decisions that depend on earlier ones, chunk of time by chunk of time.

A key's rows are dealt to chunks of time and every chunk is decided on its own, all at once, as if nothing came before
it. What a chunk decides near its end is carried to the next one; chunks that get something else than what they were
decided with are decided again, until nothing changes. The first chunk of a key is right after the first round and
each later one at the latest a round after its predecessor, so the result is that of one pass in time, while no task
holds more than a chunk and rounds touch only what changed. Where chunks are far longer than what they carry over,
two or three rounds are usual.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.settle import discard, settle

DAY = 86_400_000_000
WIDTH = 56 * DAY


def _same(x, i: int, y, j: int, at: list[str]) -> bool:
    """Whether row i of table x and row j of table y are of one run."""
    return all(x.column(c)[i].as_py() == y.column(c)[j].as_py() for c in at)


def _whole_runs(batches, at: list[str]):
    """Tables of whole runs of rows with equal columns `at`, each with the places where its runs begin, and its end."""
    import pyarrow as pa

    waiting = []  # batches of the run that may still go on
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting and _same(waiting[-1], waiting[-1].num_rows - 1, table, table.num_rows - 1, at):
            waiting.append(table)  # rows are sorted: all of the batch belongs to the run
            continue
        table = pa.concat_tables([*waiting, table]).combine_chunks()
        step = np.zeros(table.num_rows - 1, bool)
        for c in at:
            values = table.column(c).to_numpy(zero_copy_only=False)
            step |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(step) + 1).tolist()]
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), cuts
        waiting = [table.slice(cuts[-1])]
    if waiting:
        table = pa.concat_tables(waiting).combine_chunks()
        yield table, [0, table.num_rows]


def each_run(decide: Callable, at: list[str], names: list[str]):
    """decide for each run of rows with equal columns `at`, many small ones to a batch; it gives a table or a generator of some."""

    def run(batches):
        import pyarrow as pa

        out, size = [], 0
        for table, cuts in _whole_runs(batches, at):
            for i, j in zip(cuts, cuts[1:]):
                made = decide(table.slice(i, j - i))
                for some in [made] if isinstance(made, pa.Table) else made:
                    out.append(some)
                    size += some.num_rows
                    if size > 10_000 or len(out) >= 1000:  # tables without rows take memory too
                        yield from pa.concat_tables(out).combine_chunks().select(names).to_batches()
                        out, size = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().select(names).to_batches()

    return run


def many_runs(decide: Callable, at: list[str], names: list[str]):
    """decide for tables of many whole runs, which are given with the places where their runs begin; it gives one table."""

    def run(batches):
        for table, cuts in _whole_runs(batches, at):
            yield from decide(table, cuts).select(names).to_batches(max_chunksize=10_000)

    return run


def by_chunks(rows: DataFrame, keys: list[str], decide: Callable, shape: str, carry: Callable[[DataFrame], DataFrame], runs: Callable = each_run) -> DataFrame:
    """What `decide` says of every chunk, an Arrow table of rows of one (keys, chunk), given what the one before carries over.

    With many_runs as `runs`, decide gets many chunks at once.

    rows: keys, chunk, carried (false) and more columns. decide returns a table of `shape`, which begins with keys and
    chunk, also of a chunk that has carried rows only. carry takes such a table and gives rows for later chunks, with
    the columns of rows and carried true.
    """
    at = [*keys, "chunk"]
    names = [c.split()[0].strip("`") for c in shape.split(", ")]
    decided = lambda df: df.repartition(*at).sortWithinPartitions(*at).mapInArrow(runs(decide, at, names), shape)
    done = settle(decided(rows))
    given, told = carry(done).select(*rows.columns), None
    if given.isEmpty():  # nothing lies near an end of a chunk
        return done
    rows = settle(rows)
    payload = [c for c in rows.columns if c not in at]
    mark = lambda df: df.groupBy(*at).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*payload) % 1_000_000_007).alias("h"))
    while True:
        given = settle(carry(done).select(*rows.columns))
        if told is None:
            changed = settle(given.select(*at).distinct())
        else:
            before = mark(told).withColumnsRenamed({"n": "n0", "h": "h0"})
            both = mark(given).join(before.hint("shuffle_merge"), at, "full")
            changed = settle(both.where(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("h").eqNullSafe(F.col("h0")))).select(*at))
            discard(told)
        if changed.isEmpty():
            return done
        mine = lambda df: df.join(changed.hint("shuffle_hash"), at, "left_semi")
        following = settle(done.join(changed.hint("shuffle_hash"), at, "left_anti").unionByName(decided(mine(rows.unionByName(given)))))
        discard(done, changed)
        done, told = following, given


class _Free:
    """Sorted places of which some are taken: the next and the previous free one, in nearly constant time."""

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down is shifted by one: 0 stands for none

    def take(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i

    @staticmethod
    def _find(at: list[int], i: int) -> int:
        top = i
        while at[top] != top:
            top = at[top]
        while at[i] != top:
            at[i], i = top, at[i]
        return top

    def next(self, i: int) -> int:
        """First free place from i on; n if there is none."""
        return self._find(self.up, i)

    def previous(self, i: int) -> int:
        """Last free place before i; -1 if there is none."""
        return self._find(self.down, i) - 1


class _Side:
    """Candidates by time; of one time the most confident first, then the smaller id. Places, times and confidences are lists."""

    def __init__(self, places, t: list[int], conf: list[float]):
        self.places, self.t, self.conf = places, t, conf
        self.free = _Free(len(t))

    def nearest(self, at: int, window: int) -> int | None:
        """Index of the nearest free candidate within window; of equally near ones by confidence, then the earlier."""
        pos = bisect_left(self.t, at)
        right, left = self.free.next(pos), self.free.previous(pos)
        best = None
        if left >= 0 and at - self.t[left] <= window:
            i = self.free.next(bisect_left(self.t, self.t[left]))
            best = (at - self.t[i], -self.conf[i], self.t[i], i)
        if right < len(self.t) and self.t[right] - at <= window:
            found = (self.t[right] - at, -self.conf[right], self.t[right], right)
            best = found if best is None or found < best else best
        return None if best is None else best[3]


def _matches(anchors: list[tuple], c: list[list], gone: set, tiers: bool):
    """(anchor, place of its candidate, gap, tier) for the anchors (place, t, side, window) of one run, in order, given lists of its candidates' id, t, conf, side, in order."""
    ids, t, conf, side = c
    whole = _Side(None, t, conf)
    sides, at = {}, [0] * len(t)  # of each candidate its index among those of its side
    if tiers:
        places: dict = {}
        for p, s in enumerate(side):
            own = places.setdefault(s, [])
            at[p] = len(own)
            own.append(p)
        sides = {s: _Side(own, [t[p] for p in own], [conf[p] for p in own]) for s, own in places.items()}

    def take(p: int) -> None:
        whole.free.take(p)
        if tiers:
            sides[side[p]].free.take(at[p])

    if gone:
        for p, i in enumerate(ids):
            if i in gone:
                take(p)
    for a, when, s, most in anchors:
        pick, tier = None, 0
        if tiers:
            own = sides.get(s)
            found = own.nearest(when, most) if own else None
            pick, tier = (None, 1) if found is None else (own.places[found], 0)
        if pick is None:
            pick = whole.nearest(when, most)
        if pick is not None:
            take(pick)
            yield a, pick, abs(t[pick] - when), tier


def _greedy(keys: list[str]):
    """The exclusive pairs of many runs; only the search of a run with anchors and candidates is a loop."""

    def decide(table, cuts):
        import pyarrow as pa
        import pyarrow.compute as pc

        col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        begins, sizes = np.array(cuts[:-1]), np.diff(cuts)
        run = np.repeat(np.arange(len(begins)), sizes)
        kind, ids, t, conf = col("kind"), col("id"), col("t"), np.nan_to_num(col("conf").astype(float))
        side = pc.fill_null(pc.dictionary_encode(table.column("side")).combine_chunks().indices, -1).to_numpy(zero_copy_only=False)
        window = pc.fill_null(table.column("window"), 0).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, -conf, t, run))  # anchors have no confidence: they come by (t, id)
        ends = np.arange(len(begins) + 1)
        split = lambda rows: (rows, np.searchsorted(run[rows], ends).tolist())
        (a, a_cuts), (c, c_cuts), (g, g_cuts) = (split(order[x]) for x in ((kind[order] == 0) | (kind[order] == 3), kind[order] == 1, kind[order] == 2))
        anchors = list(zip(a.tolist(), t[a].tolist(), side[a].tolist(), window[a].tolist()))
        tiers = (kind[a] == 3).tolist()
        every = [x[c].tolist() for x in (ids, t, conf, side)]
        taken, out = ids[g].tolist(), []
        for r in range(len(begins)):
            i, j, k, m = a_cuts[r], a_cuts[r + 1], c_cuts[r], c_cuts[r + 1]
            if i < j and k < m:
                out += [(r, x, k + p, gap, tier) for x, p, gap, tier in _matches(anchors[i:j], [x[k:m] for x in every], set(taken[g_cuts[r] : g_cuts[r + 1]]), tiers[i])]
        r, x, p, gap, tier = np.array(out, np.int64).reshape(-1, 5).T
        return pa.table([*table.select([*keys, "chunk"]).take(pa.array(begins[r])).columns, *map(pa.array, (ids[x], ids[c[p]], gap, tier.astype(np.int32), t[c[p]]))], [*keys, "chunk", "a_id", "c_id", "gap", "tier", "c_t"])

    return decide


def greedy_rows(rows: DataFrame, window: int, keys: list[str] = ["session_id"], width: int = WIDTH) -> DataFrame:
    """Exclusive pairs (keys, a_id, c_id, gap, tier) among the rows of one table: keys, kind, id, t, conf, side and window.

    kind is 1 for candidates (conf), 0 for anchors (window, at most `window`) and 3 for anchors that prefer candidates
    of their side; the anchors of one key are of one kind. Rows without a time take no part.
    """
    width = max(width, 2 * window)
    reach = F.when(F.col("kind") == 1, F.lit(window)).otherwise(0)
    chunks = F.sequence(F.floor((F.col("t") - reach) / width), F.floor((F.col("t") + reach) / width))
    dealt = rows.select(*keys, F.explode(chunks).alias("chunk"), F.lit(False).alias("carried"), F.col("kind").cast("int").alias("kind"), *(F.col(c).cast("long").alias(c) for c in ("id", "t")), F.col("conf").cast("double").alias("conf"), F.col("side").cast("string").alias("side"), F.col("window").cast("long").alias("window"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = ", ".join([*(f"{k} {types[k]}" for k in keys), "chunk long, a_id long, c_id long, gap long, tier int, c_t long"])

    def carry(done: DataFrame) -> DataFrame:
        """Candidates that a chunk took and the next one sees."""
        late, null = done.where(F.floor((F.col("c_t") + window) / width) > F.col("chunk")), F.lit(None)
        return late.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.lit(True).alias("carried"), F.lit(2).alias("kind"), F.col("c_id").alias("id"), F.col("c_t").alias("t"), null.cast("double").alias("conf"), null.cast("string").alias("side"), null.cast("long").alias("window"))

    return by_chunks(dealt, keys, _greedy(keys), shape, carry, many_runs).drop("chunk", "c_t")


def greedy_match(anchors: DataFrame, candidates: DataFrame, window: int, prefer: str | None = None, keys: list[str] = ["session_id"], width: int = WIDTH) -> DataFrame:
    """Exclusive pairs (keys, a_id, c_id, gap, tier): anchors (a_id, a_t) in time order take their nearest unused candidate (c_id, c_t, c_conf).

    With `prefer`, a column of both sides as a_<prefer> and c_<prefer>, unused candidates that agree in it come before
    all others. Ties: the more confident, the earlier, the smaller id. An anchor's own a_window, at most window, holds
    in place of window where anchors have that column. Pairs are never listed: a chunk finds the nearest free candidate
    by its place in time. A dense session costs time and memory in proportion to its rows; no rows give no pairs.
    """
    null = F.lit(None)
    text = lambda c: F.col(c).cast("string") if prefer else null.cast("string")
    own = F.col("a_window") if "a_window" in anchors.columns else F.lit(window)
    common = lambda kind, id, t, conf, side, w: [*keys, F.lit(kind).alias("kind"), F.col(id).cast("long").alias("id"), F.col(t).cast("long").alias("t"), conf.cast("double").alias("conf"), side.alias("side"), w.cast("long").alias("window")]
    a = anchors.select(*common(3 if prefer else 0, "a_id", "a_t", null, text(f"a_{prefer}"), own))
    c = candidates.select(*common(1, "c_id", "c_t", F.col("c_conf"), text(f"c_{prefer}"), null))
    return greedy_rows(a.unionByName(c), window, keys, width)


def throttle(events: DataFrame, keys: list[str], least: int, t: str = "t", tie: str = "event_id", width: int = WIDTH) -> DataFrame:
    """The rows of events that are at least `least` after the last kept row of their key, in (t, tie) order; all columns stay."""
    width = max(width, least)

    def decide(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = table.filter(pc.invert(table.column("carried"))).sort_by([(t, "ascending"), (tie, "ascending")])
        before = table.filter(table.column("carried")).column(t)
        last, keep = (pc.max(before).as_py() if len(before) else None), np.zeros(rows.num_rows, bool)
        when = rows.column(t).to_numpy()
        i = 0 if last is None else int(np.searchsorted(when, last + least, "left"))
        while i < len(when):
            keep[i] = True
            i = int(np.searchsorted(when, when[i] + least, "left")) if least > 0 else i + 1
        return rows.filter(pa.array(keep)).select([*keys, "chunk", *(c for c in rows.column_names if c not in (*keys, "chunk"))])

    def carry(done: DataFrame) -> DataFrame:
        """The last time that a chunk kept, where it can matter to the next one."""
        last = done.groupBy(*keys, "chunk").agg(F.max(t).alias(t)).where(F.col(t) + least > (F.col("chunk") + 1) * width)
        nulls = {c: F.lit(None).cast(f.dataType) for c, f in ((f.name, f) for f in done.schema) if c not in (*keys, "chunk", "carried", t)}
        return last.withColumns({"chunk": F.col("chunk") + 1, "carried": F.lit(True), **nulls})

    rows = events.withColumns({"chunk": F.floor(F.col(t) / width), "carried": F.lit(False)})
    order = [*keys, "chunk", *(c for c in rows.columns if c not in (*keys, "chunk"))]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in order)
    return by_chunks(rows.select(*order), keys, decide, shape, carry).select(*events.columns)
