"""The same operators over streams of events (session_id, event_id, ts, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream_events(spark: SparkSession, path: str, late: str = "1 day", per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; rows later than `late` behind the newest are dropped."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)


def rate_limit(events: DataFrame, every: str) -> DataFrame:
    """The first event of each tick of each session; a tick without events has none."""
    return events.groupBy("session_id", F.window("ts", every)).agg(F.min_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("session_id", "e.*")


def latest_per_session(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.max_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("session_id", "e.*")


def distinct_events(events: DataFrame) -> DataFrame:
    """events without repeats of an event (session_id, event_id), however late they come within the watermark; the first to come stays.

    An event is remembered until the watermark has passed it, so the state holds what the watermark's delay holds. A
    repeat behind the watermark is dropped with all late rows.
    """
    return events.dropDuplicatesWithinWatermark(["session_id", "event_id"])


def near_duplicates(events: DataFrame, gap: str) -> DataFrame:
    """Chains of events of one session and type with steps under gap; a repeated event is a member once."""
    events = distinct_events(events)
    return events.groupBy("session_id", "event_type", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("members"), F.max("value").alias("value")).drop("session_window")


def matches(anchors: DataFrame, candidates: DataFrame, within: str) -> DataFrame:
    """All pairs of a session within an interval; anchors without one come with nulls once the watermark has passed."""
    a = anchors.select("session_id", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    c = candidates.select(F.col("session_id").alias("c_session"), F.col("event_id").alias("c_id"), F.col("ts").alias("c_ts"))
    return a.join(c, F.expr(f"session_id = c_session and c_ts >= a_ts - interval {within} and c_ts <= a_ts + interval {within}"), "leftOuter").drop("c_session")


def nearest_matches(anchors: DataFrame, candidates: DataFrame, within: str) -> DataFrame:
    """Each anchor with its nearest candidate of the session within an interval, as operators.timeline.nearest_match has it.

    Ties: higher value, then earlier time, then smaller id. Pairs are reduced per anchor in the state, and an anchor's row
    comes once the watermark shows that no nearer candidate can come; anchors without one come with nulls.
    anchors, candidates: session_id, event_id, ts, value, each with a watermark. Gives session_id, a_id, a_ts, c_id, gap
    (microseconds).
    """
    a = anchors.select("session_id", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    c = candidates.select(F.col("session_id").alias("c_session"), F.col("event_id").alias("c_id"), F.col("ts").alias("c_ts"), F.col("value").alias("c_value"))
    pairs = a.join(c, F.expr(f"session_id = c_session and c_ts >= a_ts - interval {within} and c_ts <= a_ts + interval {within}"), "leftOuter")
    at = F.unix_micros("c_ts")
    flat = pairs.select("session_id", "a_id", "a_ts", "c_id", F.abs(at - F.unix_micros("a_ts")).alias("gap"), (-F.col("c_value")).alias("v"), at.alias("c_t"))
    best = F.min(F.when(F.col("c_id").isNotNull(), F.struct("gap", "v", "c_t", "c_id")))
    out = flat.groupBy("session_id", "a_id", "a_ts").agg(best.alias("m"))
    return out.select("session_id", "a_id", "a_ts", "m.c_id", "m.gap")


class ChangeEvents(StatefulProcessor):
    """Emits a session's changes of floor(value / size), at most one per least_gap seconds; state expires after idle seconds."""

    def __init__(self, size: float, least_gap: float, idle: float):
        self.size, self.least_gap, self.idle = size, least_gap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value long, t double, emitted double")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        data = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        value, t, emitted = self.last.get() if self.last.exists() else (None, None, None)
        out = []
        for event, ts, v in zip(data["event_id"], data["ts"], data["value"]):
            now, new = ts.timestamp(), int(v // self.size)
            if t is not None and now < t:
                continue  # behind what was already decided
            if value is not None and new != value and (emitted is None or now - emitted >= self.least_gap):
                out.append((key[0], event, value, new))
                emitted = now
            value, t = new, now
        self.last.update((value, t, emitted))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((t + self.idle) * 1000))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "from_value", "to_value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def change_events(events: DataFrame, size: float, least_gap: float, idle: float = 7 * 86_400.0) -> DataFrame:
    """Streaming change events; needs the RocksDB state store."""
    return events.groupBy("session_id").transformWithStateInPandas(ChangeEvents(size, least_gap, idle), "session_id long, event_id long, from_value long, to_value long", "append", "eventTime")


def to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is now, into Parquet, exactly once per batch."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def notify(stream: DataFrame, folder: str, checkpoint: str, queue: int) -> None:
    """Write a payload (session_id, payload as JSON) per event, at most `queue` of each session and batch, the earliest; the others are counted.

    Batches land in folder/payloads and folder/dropped by their number, so a batch that runs again replaces itself.
    """
    def put(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "event_id")))
        kept, full = placed.where(F.col("place") <= queue).drop("place"), placed.where(F.col("place") > queue)
        kept.select("session_id", F.to_json(F.struct(*batch.columns)).alias("payload")).write.mode("overwrite").parquet(f"{folder}/payloads/batch={number}")
        full.groupBy("session_id").agg(F.count("*").alias("dropped")).write.mode("overwrite").parquet(f"{folder}/dropped/batch={number}")

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def _in_order(rows: Iterator):
    import pandas as pd

    return pd.concat(list(rows)).sort_values(["ts", "event_id"])


def _newest(data, timerValues) -> float:
    """The newest time of the rows in seconds, not behind the watermark."""
    return max(data["ts"].max().timestamp(), timerValues.getCurrentWatermarkInMs() / 1000)


def _arm(handle: StatefulProcessorHandle, times: list[float]) -> None:
    """Timers at these times in seconds, and no others."""
    wanted = {int(t * 1000) + 1 for t in times}
    have = set(handle.listTimers())
    for at in have - wanted:
        handle.deleteTimer(at)
    for at in wanted - have:
        handle.registerTimer(at)


class LiveCounters(StatefulProcessor):
    """Counts a session's frames, what was dispatched (rows of one type) and failures in a row (rows of another type).

    Emits the counters once per batch and session. A session ends as `error` once over `cap` failures follow each
    other, as `done` once `needed` rows were dispatched; rows after its end do not count. A session without rows for
    `idle` seconds of event time is forgotten; rows after that begin anew.
    """

    def __init__(self, dispatched: str, failed: str, cap: int, needed: int, idle: float):
        self.dispatched, self.failed, self.cap, self.needed, self.idle = dispatched, failed, cap, needed, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", "frames long, dispatched long, failures long, state string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        frames, sent, failures, state = self.state.get() if self.state.exists() else (0, 0, 0, "running")
        data = _in_order(rows)
        for kind in data["event_type"]:
            if state != "running":
                break
            frames += 1
            failures = failures + 1 if kind == self.failed else 0
            sent += kind == self.dispatched
            state = "error" if failures > self.cap else "done" if sent >= self.needed else "running"
        self.state.update((frames, sent, failures, state))
        _arm(self.handle, [_newest(data, timerValues) + self.idle])
        yield pd.DataFrame([(key[0], frames, sent, failures, state)], columns=["session_id", "frames", "dispatched", "failures", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_counters(events: DataFrame, dispatched: str, failed: str, cap: int, needed: int, idle: float = 7 * 86_400.0) -> DataFrame:
    """Counters of each session as they change; needs the RocksDB state store."""
    return events.groupBy("session_id").transformWithStateInPandas(LiveCounters(dispatched, failed, cap, needed, idle), "session_id long, frames long, dispatched long, failures long, state string", "append", "eventTime")


class SessionTimeouts(StatefulProcessor):
    """Ends a session `seconds` after its first event, by a row behind that or by an event-time timer; later events begin the next one.

    The generation number tells the sessions of a key apart, and a timer of an ended one does nothing. Rows behind the
    start of the running session count for it. A key without a session for `idle` seconds is forgotten, its generations
    with it.
    """

    def __init__(self, seconds: float, idle: float):
        self.seconds, self.idle = seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "generation long, start double, events long, ended double")

    def _closed(self, key, generation, start, events):
        return (key[0], generation, start, start + self.seconds, events)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        generation, start, events, _ = self.state.get() if self.state.exists() else (0, None, 0, None)
        out = []
        for ts in _in_order(rows)["ts"]:
            now = ts.timestamp()
            if start is not None and now >= start + self.seconds:
                out.append(self._closed(key, generation, start, events))
                start, events, generation = None, 0, generation + 1
            if start is None:
                start = now
            events += 1
        self.state.update((generation, start, events, None))
        _arm(self.handle, [start + self.seconds])
        yield pd.DataFrame(out, columns=["session_id", "generation", "start", "stop", "events"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if not self.state.exists():
            return
        generation, start, events, ended = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if start is not None and at >= start + self.seconds:
            self.state.update((generation + 1, None, 0, start + self.seconds))
            self.handle.registerTimer(int((start + self.seconds + self.idle) * 1000) + 1)
            yield pd.DataFrame([self._closed(key, generation, start, events)], columns=["session_id", "generation", "start", "stop", "events"])
        elif start is None and ended is not None and at >= ended + self.idle:
            self.state.clear()

    def close(self) -> None:
        pass


def session_timeouts(events: DataFrame, seconds: float, idle: float = 7 * 86_400.0) -> DataFrame:
    """Sessions that ended (session_id, generation, start and stop in seconds, events); needs the RocksDB state store."""
    return events.groupBy("session_id").transformWithStateInPandas(SessionTimeouts(seconds, idle), "session_id long, generation long, start double, stop double, events long", "append", "eventTime")


@dataclass(frozen=True)
class Run:
    """Limits of a run: distances in the positions' unit, times in seconds."""

    jump: float = 200.0  # a step that may be a recovery
    near: float = 80.0  # of the first position, where it lands
    moved: float = 150.0  # distance from the first position since the last recovery
    most: int = 5  # recoveries; one more ends the run
    calm: float = 5.0  # a step that counts towards settling
    calm_rows: int = 5
    settle: float = 8.0  # longest wait for that
    waypoints: tuple[tuple[float, float], ...] = ()
    reach: float = 50.0
    waypoint: float = 30.0  # longest wait for a waypoint, then another try
    tries: int = 6  # of a waypoint, then it is left out
    idle: float = 7 * 86_400.0


class StreamRecoveries(StatefulProcessor):
    """Recoveries by teleport, as operators.spatial.teleports has them, when each has settled, and waypoints with time-outs.

    A jump over `jump` that lands within `near` of the session's first position, once it has been over `moved` away since
    the last recovery, is a recovery; `calm_rows` steps in a row under `calm` settle it, else `settle` seconds end the
    wait. Every recovery waits by itself, under a timer of its own. The waypoint ahead is reached within `reach` of it,
    one a row, or tried again after `waypoint` seconds and left out after `tries`; a recovery goes back to the first. The
    recovery after the `most`-th ends the run (`aborted`), the last waypoint completes it (`completed`); an ended run
    finds no more, though recoveries already found still settle. All state of a session goes once it has had no row for
    `idle` seconds.

    Rows are taken in order of (ts, event_id) within a batch. A row behind one already decided is left out, as what it
    would change has been emitted; one behind the watermark never comes. Waits end by a row behind their time or by their
    timer, whichever comes first, at the same time.
    """

    def __init__(self, run: Run):
        self.run = run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "hx double, hy double, x double, y double, far double, found long, t double, ended boolean")
        self.waits = handle.getMapState("waits", "event_id long", "since double, still long")
        self.goal = handle.getValueState("goal", "n long, since double, tries long")

    def _due(self, key, at: float, goal, out: list):
        """Ends what was to end by the time `at`, earliest first; the waypoint's state after that."""
        run = self.run
        for event, since in sorted(((k[0], v[0]) for k, v in self.waits.iterator()), key=lambda w: (w[1], w[0])):
            if at > since + run.settle:
                out.append((key[0], event, "timed_out", since + run.settle))
                self.waits.removeKey((event,))
        while goal is not None and at > goal[1] + run.waypoint:
            n, since, tries = goal
            since += run.waypoint
            if tries + 1 < run.tries:
                out.append((key[0], n, "waypoint_tried_again", since))
                goal = (n, since, tries + 1)
            else:
                out.append((key[0], n, "waypoint_left_out", since))
                goal = self._next(key, n, since, out)
        return goal

    def _next(self, key, n: int, now: float, out: list):
        if n + 1 < len(self.run.waypoints):
            return (n + 1, now, 0)
        out.append((key[0], n, "completed", now))
        return None

    def _done(self, goal, last: float, ended: bool) -> None:
        """Keep the waypoint and set the timers that are left."""
        if goal is None:
            self.goal.clear()
        else:
            self.goal.update(goal)
        waits = [v[0] + self.run.settle for _, v in self.waits.iterator()]
        _arm(self.handle, [*waits, *([goal[1] + self.run.waypoint] if goal else []), last + self.run.idle])

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import math

        import pandas as pd

        run, out, data = self.run, [], _in_order(rows)
        new = not self.place.exists()
        hx, hy, px, py, far, found, last, ended = (None, None, None, None, 0.0, 0, None, False) if new else self.place.get()
        goal = self.goal.get() if self.goal.exists() else None
        for event, ts, x, y in zip(data["event_id"], data["ts"], data["x"], data["y"]):
            now = ts.timestamp()
            if last is not None and now < last:
                continue
            if hx is None:
                hx, hy, goal = x, y, (0, now, 0) if run.waypoints else None
            step = 0.0 if px is None else math.hypot(x - px, y - py)
            home = math.hypot(x - hx, y - hy)
            far = max(far, home)
            goal = self._due(key, now, goal, out)
            ended = ended or bool(run.waypoints) and goal is None
            for (wait,), (since, still) in list(self.waits.iterator()):
                still = still + 1 if step < run.calm else 0
                if still >= run.calm_rows:
                    out.append((key[0], wait, "settled", now))
                    self.waits.removeKey((wait,))
                else:
                    self.waits.updateValue((wait,), (since, still))
            if not ended and far > run.moved and step > run.jump and home < run.near:
                far, found = 0.0, found + 1
                if found > run.most:
                    out.append((key[0], event, "aborted", now))
                    ended, goal = True, None
                else:
                    out.append((key[0], event, "recovered", now))
                    self.waits.updateValue((event,), (now, 0))
                    goal = (0, now, 0) if run.waypoints else None
            elif goal is not None and math.hypot(x - run.waypoints[goal[0]][0], y - run.waypoints[goal[0]][1]) <= run.reach:
                out.append((key[0], goal[0], "reached", now))
                goal = self._next(key, goal[0], now, out)
                ended = goal is None
            px, py, last = x, y, now
        self.place.update((hx, hy, px, py, far, found, last, ended))
        self._done(goal, last, ended)
        yield pd.DataFrame(out, columns=["session_id", "event_id", "what", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if not self.place.exists():
            return
        *place, last, ended = self.place.get()
        at, out = expiredTimerInfo.getExpiryTimeInMs() / 1000, []
        goal = self._due(key, at, self.goal.get() if self.goal.exists() else None, out)
        if at > last + self.run.idle:
            self.place.clear()
            self.waits.clear()
            self.goal.clear()
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        else:
            self.place.update((*place, last, ended or bool(self.run.waypoints) and goal is None))
            self._done(goal, last, ended)
        yield pd.DataFrame(out, columns=["session_id", "event_id", "what", "at"])

    def close(self) -> None:
        pass


def recoveries(positions: DataFrame, run: Run = Run()) -> DataFrame:
    """What happens in a stream of positions (session_id, event_id, ts, x, y): session_id, event_id, what, at in seconds.

    event_id names the recovery, or the waypoint by its place from 0. Needs the RocksDB state store.
    """
    return positions.groupBy("session_id").transformWithStateInPandas(StreamRecoveries(run), "session_id long, event_id long, what string, at double", "append", "eventTime")
