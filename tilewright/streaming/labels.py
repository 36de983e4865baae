"""Label state over frames: fades, placement throttling, placement memory. Each rule is a plain class with an injected
clock; a batch of events replays it per session, and a streaming processor keeps it per key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.folds import Rows, fold

MAX_INTERVAL_US = 300_000
MEMORY_RADIUS, MEMORY_FRAMES = 32.0, 90


def fade_progress(start: Column, now: Column, total: Column) -> Column:
    """How far a fade is, 0 to 1, in microseconds; 1 for one that has no start or no length."""
    t = F.least(F.greatest((now - start) / total, F.lit(0.0)), F.lit(1.0))
    return F.when(start.isNull() | (total <= 0), F.lit(1.0)).otherwise(t)


def placement_interval(fade_us: Column) -> Column:
    return F.least(fade_us, F.lit(MAX_INTERVAL_US))


@dataclass
class Fades:
    """One opacity per label key. A new key starts at 0; a frame moves those that are shown up and the others down by its
    share of the fade's duration; what has faded out is forgotten. The first frame, and no duration, are a whole step."""

    duration: int
    opacity: dict[Any, float] = field(default_factory=dict)
    last: int | None = None
    shown: set[Any] = field(default_factory=set)

    @property
    def active(self) -> bool:
        """Whether a fade is under way, so that frames have to go on without anything new."""
        return any(o < 1 or k not in self.shown for k, o in self.opacity.items())

    def ticks(self, tick: int, until: int | None = None) -> Iterator[tuple[int, dict[Any, float]]]:
        """Frames a tick apart, before ``until``, while a fade is under way: what was shown last stays shown."""
        while self.active and (until is None or self.last + tick < until):
            yield self.last + tick, self.frame(self.last + tick, self.shown)

    def frame(self, now: int, shown: set[Any]) -> dict[Any, float]:
        if self.last is None or self.duration <= 0:
            step = 1.0
        else:
            step = min(max((now - self.last) / self.duration, 0.0), 1.0)
        self.last, self.shown = now, shown
        out = {}
        for k in shown | set(self.opacity):
            if k not in self.opacity:
                after = 0.0
            else:
                after = min(1.0, self.opacity[k] + step) if k in shown else self.opacity[k] - step
            if after > 0 or k in shown:
                out[k] = after
        self.opacity = dict(out)
        return out


@dataclass
class Throttle:
    """Whether labels are placed anew: first, after the interval, when what is shown has changed, or when the clock went
    back; otherwise the placement is put off."""

    interval: int
    last: int | None = None
    seen: Any = None
    owed: bool = False

    def place(self, now: int, generation: Any = None) -> bool:
        due = self.last is None or self.interval <= 0 or generation != self.seen or now >= self.last + self.interval or now < self.last
        self.owed = not due
        if due:
            self.last, self.seen = now, generation
        return due

    def overdue(self, until: int | None = None) -> int | None:
        """When a pass that was put off runs by itself, if nothing places before; None if none is owed until then."""
        at = self.last + self.interval if self.owed else None
        return None if at is None or until is not None and at >= until else at


@dataclass
class Memory:
    """Where labels of a key sat: the nearest within the radius is the same label; unseen ones go after some frames."""

    entries: dict[Any, list[dict[str, Any]]] = field(default_factory=dict)
    frame: int = 0

    def begin(self, prune: bool = True) -> None:
        self.frame += 1
        if prune:
            for k in list(self.entries):
                self.entries[k] = [e for e in self.entries[k] if self.frame - e["seen"] <= MEMORY_FRAMES]
                if not self.entries[k]:
                    del self.entries[k]

    def lookup(self, key: Any, x: float, y: float) -> dict[str, Any] | None:
        near = [((e["x"] - x) ** 2 + (e["y"] - y) ** 2, i) for i, e in enumerate(self.entries.get(key, []))]
        d, i = min(near, default=(MEMORY_RADIUS**2, -1))
        return self.entries[key][i] if d < MEMORY_RADIUS**2 else None

    def sitting(self, key: Any, x: float, y: float) -> dict[str, Any]:
        e = self.lookup(key, x, y)
        if e is None:
            e = {"anchor": None}
            self.entries.setdefault(key, []).append(e)
        e.update(x=x, y=y, seen=self.frame)
        return e


@dataclass
class Retry:
    """At most ``limit`` tries, ``wait`` apart; progress gives the budget back."""

    limit: int = 4
    wait: int = 16_000_000
    used: int = 0
    last: int | None = None

    def may(self, now: int) -> bool:
        if self.used >= self.limit or (self.last is not None and now < self.last + self.wait):
            return False
        self.used, self.last = self.used + 1, now
        return True

    def progress(self) -> None:
        self.used = 0


# -- batches ----------------------------------------------------------------------------------------------------


def fade_states(frames: DataFrame, session: str, frame: str, key: str, duration: int, shift: int = 1, tick: int | None = None) -> DataFrame:
    """frames(session, frame, key): the keys shown in each frame of each session -> the opacity of every key that is
    shown or fading in each frame. ``shift`` is the time from one frame number to the next. With a ``tick`` frames so
    far apart go on between and after the given ones until all fades have ended."""

    def run(rows: Rows) -> Iterator[tuple]:
        state = Fades(duration)
        for f, part in groupby(rows, key=lambda r: r[frame]):
            for at, o in state.ticks(tick, int(f)) if tick else ():
                yield from ((rows[0][session], at, k, v) for k, v in sorted(o.items()))
            for k, o in sorted(state.frame(int(f) * shift, {r[key] for r in part}).items()):
                yield rows[0][session], f, k, o
        for at, o in state.ticks(tick) if tick else ():
            yield from ((rows[0][session], at, k, v) for k, v in sorted(o.items()))

    s = frames.select(session, frame, key).where(F.col(key).isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    return fold(s, [session], [frame, key], run, f"{session} {kinds[session]}, {frame} {kinds[frame]}, {key} {kinds[key]}, opacity double")


def throttled(events: DataFrame, session: str, time_us: str, order: str, interval: int, generation: str | None = None) -> DataFrame:
    """events with ``placed``: whether each leads to a placement."""

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    columns = events.columns

    def step(rows: Rows) -> Iterator[tuple]:
        t = Throttle(interval)
        for r in rows:
            yield *(r[c] for c in columns), t.place(int(r[time_us]), r[generation] if generation else None)

    return fold(events, [session], [time_us, order], step, f"{schema}, placed boolean")


def passes(events: DataFrame, session: str, time_us: str, generation: str, interval: int) -> DataFrame:
    """(session, time, generation, placed, owed): events(session, time, generation) in order of time, and, as rows that are
    owed, the passes that run by themselves an interval after the last one because an event was put off."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(rows: Rows) -> Iterator[tuple]:
        t = Throttle(interval)
        for r in rows:
            yield from _passes(t, rows[0][session], int(r[time_us]), int(r[generation]))
        yield from _owed(t, rows[0][session])

    return fold(events.select(session, time_us, generation), [session], [time_us, generation], step, f"{session} {kinds[session]}, time long, generation long, placed boolean, owed boolean")


def _owed(t: Throttle, session: Any, until: int | None = None) -> Iterator[tuple]:
    at = t.overdue(until)
    if at is not None:
        yield session, at, t.seen, t.place(at, t.seen), True


def _passes(t: Throttle, session: Any, now: int, generation: int) -> Iterator[tuple]:
    yield from _owed(t, session, now)
    yield session, now, generation, t.place(now, generation), False


def key_sightings(frames: DataFrame, session: str = "session", frame: str = "frame", key: str = "key", x: str = "x", y: str = "y") -> DataFrame:
    """frames(session, frame, key, x, y) with ``entry``: a label nearer than 32 pixels to where one of its key sat is that
    one; one that isn't seen for 90 frames is forgotten. Entries are numbered within session and key."""
    s = frames.select(session, frame, key, x, y)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields)

    def step(rows: Rows) -> Iterator[tuple]:
        memory, count = Memory(), 0
        for r in rows:
            e, count = _sighting(memory, r[key], int(r[frame]), r[x], r[y], count)
            yield r[session], r[frame], r[key], r[x], r[y], e["number"]

    return fold(s, [session, key], [frame, x, y], step, f"{schema}, entry int")


def _sighting(memory: Memory, key: Any, frame: int, x: float, y: float, count: int) -> tuple[dict[str, Any], int]:
    if memory.frame != frame + 1:
        memory.frame = frame  # frames without the key do nothing but pass
        memory.begin()
    e = memory.sitting(key, x, y)
    if "number" not in e:
        e["number"], count = count, count + 1
    return e, count


def load_status(age: Column, ttl: Column, present: Column, empty: Column) -> Column:
    """What a cache answers: fresh or stale bytes, known to be absent, or a miss that goes to the provider."""
    word = F.when(age <= ttl, F.lit("fresh")).otherwise(F.lit("stale"))
    return F.when(~present, F.lit("miss")).when(empty, F.concat(F.lit("absent_"), word)).otherwise(word)


def latest_generation(results: DataFrame, key: list[str], generation: str) -> DataFrame:
    """Results that belong to the latest generation of their tile; late ones of earlier generations are dropped."""
    top = results.groupBy(*key).agg(F.max(generation).alias("__top"))
    return results.join(top, key).where(F.col(generation) == F.col("__top")).drop("__top")


def queue_order(jobs: DataFrame) -> DataFrame:
    """jobs(tile, phase: raster or symbols, priority, seq) in the order they run: the last one queued for a tile and phase
    counts, a raster job takes the place of the tile's earlier symbols job, all rasters come first."""
    last = jobs.groupBy("tile", "phase").agg(F.max(F.struct("seq", "priority")).alias("j")).select("tile", "phase", "j.*")
    raster = last.where("phase = 'raster'").select("tile", F.col("seq").alias("rseq"))
    alive = last.join(raster, "tile", "left").where("phase = 'raster' or rseq is null or seq > rseq").drop("rseq")
    # turns within each phase and priority, after all of those before it: only their counts meet in one place
    late = (F.col("phase") != "raster").cast("int")
    before = Window.orderBy(late, "priority").rowsBetween(Window.unboundedPreceding, -1)
    sizes = alive.groupBy("phase", "priority").count().select("phase", "priority", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("phase", "priority").orderBy("seq"))
    return alive.withColumn("own", own).join(sizes, ["phase", "priority"]).withColumn("turn", F.col("before") + F.col("own")).drop("before", "own")


# -- streams ----------------------------------------------------------------------------------------------------


class FadeProcessor(StatefulProcessor):
    """Keyed by session; rows (session, frame, key), any number of frames in a batch. State: each key's opacity and
    whether it is shown, and the last frame's time.

    With a tick a timer, ``tick_ms`` of processing time later, runs the next frame of a session that has a fade
    under way, whether anything comes in or not. Frames that input finds missing are made up before it, so the
    result is the batch's, however late timers are.
    """

    def __init__(self, duration: int, tick: int | None = None, tick_ms: int = 16):
        self.duration, self.tick, self.tick_ms = duration, tick, tick_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.opacities = handle.getMapState("opacities", "key string", "opacity double, shown boolean")
        self.last = handle.getValueState("last", "time long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        every = pd.concat(list(rows))
        state, out = self._state(), []
        for f, part in every.groupby("frame", sort=True):
            out += list(state.ticks(self.tick, int(f))) if self.tick else []
            out.append((int(f), state.frame(int(f), set(part["key"]))))
        yield self._kept(key, state, out, timer_values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._state()
        yield self._kept(key, state, [(state.last + self.tick, state.frame(state.last + self.tick, state.shown))] if state.active else [], timerValues)

    def _state(self) -> Fades:
        held = {k[0]: v for k, v in self.opacities.iterator()}
        last = self.last.get()[0] if self.last.exists() else None
        return Fades(self.duration, {k: v[0] for k, v in held.items()}, last, {k for k, v in held.items() if v[1]})

    def _kept(self, key, state: Fades, frames: list[tuple[int, dict[str, float]]], timer_values) -> pd.DataFrame:
        for (k,) in list(self.opacities.keys()):
            if k not in state.opacity:
                self.opacities.removeKey((k,))
        for k, o in state.opacity.items():
            self.opacities.updateValue((k,), (o, k in state.shown))
        self.last.update((state.last,))
        if self.tick:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if state.active:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.tick_ms)
        out = [(key[0], f, k, o) for f, opacities in frames for k, o in sorted(opacities.items())]
        return pd.DataFrame(out, columns=["session", "frame", "key", "opacity"])

    def close(self) -> None:
        pass


def fade_stream(frames: DataFrame, duration: int, tick: int | None = None, tick_ms: int = 16) -> DataFrame:
    """The streaming twin of fade_states(): frames(session, frame, key)."""
    made = FadeProcessor(duration, tick, tick_ms)
    return frames.groupBy("session").transformWithStateInPandas(made, "session string, frame long, key string, opacity double", "append", "processingTime" if tick else "none")


class ThrottleProcessor(StatefulProcessor):
    """Keyed by session; rows (session, time, generation). A pass that is put off sets a timer, for when it is due
    by the time that has passed since; a placement before that takes it back."""

    def __init__(self, interval: int, owed: bool = False):
        self.interval, self.owed = interval, owed

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, generation long, owed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        t = self._throttle()
        every = pd.concat(list(rows)).sort_values(["time", "generation"])
        if not self.owed:
            every["placed"] = [t.place(int(a), int(g)) for a, g in zip(every["time"], every["generation"])]
            self.state.update((t.last, t.seen, t.owed))
            yield every[["session", "time", "generation", "placed"]]
            return
        out = [p for a, g in zip(every["time"], every["generation"]) for p in _passes(t, key[0], int(a), int(g))]
        yield self._kept(t, out, int(every["time"].iloc[-1]), timer_values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = self._throttle()
        yield self._kept(t, list(_owed(t, key[0])), t.last, timerValues)

    def _throttle(self) -> Throttle:
        return Throttle(self.interval, *self.state.get()) if self.state.exists() else Throttle(self.interval)

    def _kept(self, t: Throttle, out: list[tuple], now: int, timer_values) -> pd.DataFrame:
        self.state.update((t.last, t.seen, t.owed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if t.owed:
            wait = max(1, -(-(t.last + t.interval - now) // 1000))
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + wait)
        return pd.DataFrame(out, columns=["session", "time", "generation", "placed", "owed"])

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, interval: int) -> DataFrame:
    return events.groupBy("session").transformWithStateInPandas(
        ThrottleProcessor(interval), "session string, time long, generation long, placed boolean", "append", "none"
    )


def pass_stream(events: DataFrame, interval: int) -> DataFrame:
    """The streaming twin of passes(): events(session, time, generation), times in microseconds."""
    schema = "session string, time long, generation long, placed boolean, owed boolean"
    return events.groupBy("session").transformWithStateInPandas(ThrottleProcessor(interval, owed=True), schema, "append", "processingTime")


class MemoryProcessor(StatefulProcessor):
    """Keyed by session and label key; rows (session, frame, key, x, y). State: the list of where its labels sat, which is
    also forgotten if nothing is seen of the key for ``ttl_ms`` of processing time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.entries = handle.getListState("entries", "x double, y double, seen long, number int", self.ttl_ms)
        self.count = handle.getValueState("count", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        k = key[1]
        held = [dict(zip(("x", "y", "seen", "number"), e)) for e in self.entries.get()]
        memory, count = Memory({k: held} if held else {}), self.count.get()[0] if self.count.exists() else 0
        every = pd.concat(list(rows)).sort_values(["frame", "x", "y"])
        numbers = []
        for r in every.itertuples(index=False):
            e, count = _sighting(memory, k, int(r.frame), r.x, r.y, count)
            numbers.append(e["number"])
        self.entries.put([(e["x"], e["y"], e["seen"], e["number"]) for e in memory.entries.get(k, [])])
        self.count.update((count,))
        every["entry"] = numbers
        yield every[["session", "frame", "key", "x", "y", "entry"]]

    def close(self) -> None:
        pass


def memory_stream(frames: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """The streaming twin of key_sightings(): frames(session, frame, key, x, y)."""
    schema = "session string, frame long, key string, x double, y double, entry int"
    return frames.groupBy("session", "key").transformWithStateInPandas(MemoryProcessor(ttl_ms), schema, "append", "processingTime")
