"""Stateful stream operators that built-in aggregates can't state, on ``transformWithState``.

Rows of a key arrive in micro-batches; state lives in the state store and survives restarts. Within a batch rows are
taken in time order, so results do not depend on how a batch was read.
"""

from __future__ import annotations

import json
import pickle
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Aggregate = Callable[[list[Row]], tuple | None]


#: Types whose values are equal in Python where they are equal as grouping keys.
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.DecimalType)
SHARD = "_shard"


def _plain(rows: Iterator[Row], names: Sequence[str] | None = None) -> list[Row]:
    """The rows, with the named columns only."""
    found = [r if isinstance(r, Row) else Row(**r.asDict()) for r in rows]
    if names is None or not found or found[0].__fields__ == list(names):
        return found
    make, places = Row(*names), [found[0].__fields__.index(n) for n in names]
    return [make(*[r[i] for i in places]) for r in found]


def _dealt(df: DataFrame, keys: Sequence[str], shards: int | None) -> tuple[Any, list[str]]:
    """``df`` grouped for a processor, and the keys that the processor has to tell apart in a group.

    A group is a key, or with ``shards`` one of so many sets of keys: a call and its round trips to the state store then
    serve many keys. That suits large batches; a batch reads the state of all keys of the sets it meets.
    """
    if shards is None or not all(isinstance(df.schema[k].dataType, EXACT) or df.schema[k].dataType == T.StringType() for k in keys):
        return df.groupBy(*keys), []
    return df.withColumn(SHARD, F.pmod(F.hash(*keys), F.lit(shards))).groupBy(SHARD), list(keys)


def _by_key(rows: Sequence[Row], keys: Sequence[str]) -> dict[tuple, list[Row]]:
    if not keys:
        return {(): list(rows)} if rows else {}
    found: dict[tuple, list[Row]] = {}
    for r in rows:
        found.setdefault(tuple([r[k] for k in keys]), []).append(r)
    return found


def _held(state: Any, schema: T.StructType) -> list[Row]:
    make = Row(*schema.names)
    return [make(*s) for (blob,) in state.get() for s in pickle.loads(blob)] if state.exists() else []


#: State of held rows: pickled lists of row tuples, as the store takes tens of microseconds for a value of its own.
BLOBS, BLOB_ROWS = "blob binary", 10_000


def _blobs(rows: list[Row]) -> list[tuple]:
    return [(pickle.dumps([tuple(r) for r in rows[i : i + BLOB_ROWS]]),) for i in range(0, len(rows), BLOB_ROWS)]


def _store(state: Any, rows: list[Row]) -> None:
    """The store takes no empty list."""
    if rows:
        state.put(_blobs(rows))
    else:
        state.clear()


class RowsOver(StatefulProcessor):
    """For every arriving row an aggregate over the last ``size`` rows by order key, itself included."""

    def __init__(self, schema: T.StructType, order: Sequence[str], size: int, aggregate: Aggregate, outputs: Sequence[str], keys: Sequence[str] = ()):
        self.out, self.keys = [*schema.names, *outputs], keys
        self.schema, self.order, self.size, self.aggregate = schema, list(order), size, aggregate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", BLOBS)

    def _key(self, r: Row) -> tuple:
        return tuple((r[o] is not None, r[o]) for o in self.order)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held, make = _by_key(_held(self.rows, self.schema), self.keys), Row(*self.out)
        for k, new in _by_key(_plain(rows, self.schema.names), self.keys).items():
            last = held.setdefault(k, [])
            for r in sorted(new, key=self._key):
                insort(last, r, key=self._key)  # stays sorted; a row in time goes to its end
                del last[: max(0, len(last) - self.size)]
                got = self.aggregate(last)
                if got is not None:
                    yield make(*r, *got)
        _store(self.rows, [r for last in held.values() for r in last])

    def close(self) -> None:
        pass


class DurationOver(StatefulProcessor):
    """A row is final once event time has passed its time plus ``size_ms``; then it comes out with an aggregate over the rows of its key from its time up to ``size_ms - 1`` later."""

    def __init__(self, schema: T.StructType, time: str, size_ms: int, aggregate: Aggregate, outputs: Sequence[str], keys: Sequence[str] = ()):
        self.out, self.keys = [*schema.names, *outputs], keys
        self.schema, self.time, self.size, self.aggregate = schema, time, size_ms, aggregate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", BLOBS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = _plain(rows, self.schema.names)
        self.rows.appendList(_blobs(new))
        self.handle.registerTimer(min(r[self.time] for r in new) + self.size)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # the first timer of a batch takes all that is final by now, so that state is written once; the rest gets one timer
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.size
        make, out, rest, done = Row(*self.out), [], [], 0
        for held in _by_key(_held(self.rows, self.schema), self.keys).values():
            held.sort(key=lambda r: r[self.time])
            times = [r[self.time] for r in held]
            final = bisect_right(times, due)
            for r, t in zip(held[:final], times):
                got = self.aggregate(held[bisect_left(times, t) : bisect_left(times, t + self.size)])
                if got is not None:
                    out.append(make(*r, *got))
            rest += held[final:]
            done += final
        if done:
            _store(self.rows, rest)
        if done and rest:
            self.handle.registerTimer(min(r[self.time] for r in rest) + self.size)
        return iter(out)

    def close(self) -> None:
        pass


class Reorder(StatefulProcessor):
    """A reorder buffer: rows come out in time order once a batch of their key holds a time ``delay_ms`` above theirs.

    The clock is the newest time of the batch at hand; a late row is released at once, never dropped.
    """

    def __init__(self, schema: T.StructType, time: str, delay_ms: int):
        self.schema, self.time, self.delay = schema, time, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", BLOBS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = _plain(rows)
        held = _held(self.rows, self.schema)
        ready, held = release(held + new, max(r[self.time] for r in new), self.time, self.delay)
        _store(self.rows, held)
        yield from ready

    def close(self) -> None:
        pass


def release(rows: list[Row], clock: int, time: str, delay_ms: int) -> tuple[list[Row], list[Row]]:
    """(rows to release in time order, rows to hold) at a clock."""
    rows = sorted(rows, key=lambda r: r[time])
    return [r for r in rows if clock - r[time] >= delay_ms], [r for r in rows if clock - r[time] < delay_ms]


class CompatSlide:
    """Sliding windows on one clock for all keys, row by row, with two special rules.

    A row beyond the next window, too, fires alone in its tumbling bucket; so does a row older than the current window.
    ``add`` gives the fired windows as (key, start, rows) in order.
    """

    def __init__(self, size_ms: int, slide_ms: int, state: dict | None = None):
        if not 0 < slide_ms <= size_ms:
            raise ValueError("the slide must be positive and not above the size")
        self.size, self.slide = size_ms, slide_ms
        state = state or {"start": None, "rows": []}
        self.start: int | None = state["start"]
        self.rows: list[tuple[str, int, Any]] = [tuple(r) for r in state["rows"]]

    def state(self) -> dict:
        return {"start": self.start, "rows": self.rows}

    def _alone(self, key: str, ts: int, row: Any) -> tuple[str, int, list]:
        return key, ts - ts % self.size, [row]

    def _fire(self) -> list[tuple[str, int, list]]:
        found: dict[str, list] = {}
        for key, ts, row in self.rows:
            if self.start <= ts < self.start + self.size:
                found.setdefault(key, []).append(row)
        fired = [(k, self.start, r) for k, r in found.items()]
        self.start += self.slide
        self.rows = [r for r in self.rows if r[1] >= self.start]
        return fired

    def drain(self) -> list[tuple[str, int, list]]:
        """Fire until no row is held: what happens when event time goes on without data."""
        fired = []
        while self.rows:
            fired += self._fire()
        return fired

    def add(self, key: str, ts: int, row: Any) -> list[tuple[str, int, list]]:
        if self.start is None:
            self.start = ts - ts % self.size
        if ts < self.start:
            return [self._alone(key, ts, row)]
        fired = []
        if ts >= self.start + self.size:
            fired = self._fire()
            if ts >= self.start + self.size:
                return [*fired, self._alone(key, ts, row)]
        self.rows.append((key, ts, row))
        return fired


class CompatSlideProcessor(StatefulProcessor):
    """``CompatSlide`` on a stream: one key per clock. Emits (clock key, key, window_start, number of rows, rows as JSON).

    With ``idle_ms`` a clock that has had no rows for so long, by the wall clock, goes on by itself: windows fire until
    none holds a row.
    """

    def __init__(self, key: str, time: str, size_ms: int, slide_ms: int, order: str, idle_ms: int | None = None, whole: bool = False):
        self.whole = whole  # the order is a column of whole numbers
        self.key, self.time, self.size, self.slide, self.order, self.idle = key, time, size_ms, slide_ms, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "start long")
        self.rows = handle.getListState("rows", "key string, ts long")

    def _load(self) -> CompatSlide:
        held = [(k, t, t) for k, t in self.rows.get()] if self.rows.exists() else []
        return CompatSlide(self.size, self.slide, {"start": self.start.get()[0], "rows": held} if self.start.exists() else None)

    def _save(self, window: CompatSlide) -> None:
        self.start.update((window.start,))
        if window.rows:
            self.rows.put([(k, t) for k, t, _ in window.rows])
        else:
            self.rows.clear()

    def _out(self, key: Any, fired: list[tuple[str, int, list]]) -> Iterator[Row]:
        for k, start, found in fired:
            yield Row("clock", "key", "window_start", "n", "rows")(key[0], k, start, len(found), json.dumps(found))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        window = self._load()
        # a batch of a clock is put in order by its numbers: row objects of all of it would take a kilobyte each
        names: dict[str, str] = {}
        users, times, orders = [], array("q"), array("q") if self.whole else []
        for r in rows:
            users.append(names.setdefault(r[self.key], r[self.key]))
            times.append(r[self.time])
            orders.append(r[self.order])
        places = np.argsort(np.frombuffer(orders, np.int64), kind="stable") if self.whole else sorted(range(len(orders)), key=orders.__getitem__)
        for i in places:
            yield from self._out(key, window.add(users[i], times[i], times[i]))
        self._save(window)
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        window = self._load()
        yield from self._out(key, window.drain())
        self._save(window)

    def close(self) -> None:
        pass


class WindowRows(StatefulProcessor):
    """Hopping windows of a key by a callable: when event time has passed a window's end, ``function((start, end), rows in
    time order)`` gives any number of output rows. A row for a window that has fired is left out of it.
    """

    def __init__(self, schema: T.StructType, time: str, size_ms: int, slide_ms: int, function: Callable[[tuple[int, int], list[Row]], list[tuple]], outputs: Sequence[str], keys: Sequence[str] = ()):
        self.keys = keys
        self.schema, self.time, self.size, self.slide, self.function, self.outputs = schema, time, size_ms, slide_ms, function, list(outputs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", BLOBS)
        self.fired = handle.getValueState("fired", "upto long")

    def _starts(self, t: int) -> range:
        last = t - t % self.slide
        return range(last - (self.size - 1 - t % self.slide) // self.slide * self.slide, last + 1, self.slide)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = _plain(rows, self.schema.names)
        self.rows.appendList(_blobs(new))
        self.handle.registerTimer(min(self._starts(r[self.time])[0] for r in new) + self.size)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # the first timer of a batch fires all that is due by now; rows behind event time do not come in, so one mark does for all keys
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        before = self.fired.get()[0] if self.fired.exists() else None
        if before is not None and upto <= before or not self.rows.exists():
            return iter(())
        make, out, rest, next_end = Row(*self.outputs), [], [], None
        for held in _by_key(_held(self.rows, self.schema), self.keys).values():
            windows: dict[int, list[Row]] = {}
            for r in sorted(held, key=lambda r: r[self.time]):
                starts = self._starts(r[self.time])
                for s in starts:
                    if s + self.size > upto:
                        next_end = s + self.size if next_end is None else min(next_end, s + self.size)
                    elif before is None or s + self.size > before:
                        windows.setdefault(s, []).append(r)
                if starts[-1] + self.size > upto:
                    rest.append(r)
            out += [make(*x) for s in sorted(windows) for x in self.function((s, s + self.size), windows[s]) or ()]
        self.fired.update((upto,))
        _store(self.rows, rest)
        if next_end is not None:
            self.handle.registerTimer(next_end)
        return iter(out)

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows of a key that are no older than its newest one before them in ``order``; older ones are dropped."""

    def __init__(self, schema: T.StructType, time: str, order: str, keys: Sequence[str] = ()):
        self.schema, self.time, self.order, self.keys = schema, time, order, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", T.StructType([*[self.schema[k] for k in self.keys], T.StructField("newest", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest = {tuple(s)[:-1]: s[-1] for s in self.newest.get()} if self.newest.exists() else {}
        for k, new in _by_key(_plain(rows, self.schema.names), self.keys).items():
            last = newest.get(k)
            for r in sorted(new, key=lambda r: r[self.order]):
                if last is None or r[self.time] >= last:
                    last = r[self.time]
                    yield r
            newest[k] = last
        self.newest.put([(*k, t) for k, t in newest.items()])

    def close(self) -> None:
        pass


class LateRows(StatefulProcessor):
    """Rows whose tumbling window had closed on the key's clock when they came: each comes out with its window's start.

    The clock is the newest time seen, minus ``delay_ms``; it never goes back.
    """

    def __init__(self, time: str, size_ms: int, delay_ms: int):
        self.time, self.size, self.delay = time, size_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = _plain(rows)
        clock = self.clock.get()[0] if self.clock.exists() else None
        for r in new:
            start = r[self.time] - r[self.time] % self.size
            if clock is not None and start + self.size <= clock - self.delay:
                yield Row(*r.asDict(), "window_start")(*r, start)
        self.clock.update((max([r[self.time] for r in new] + ([] if clock is None else [clock])),))

    def close(self) -> None:
        pass


def _added(schema: T.StructType, outputs: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(outputs).fields])


def rows_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, aggregate: Aggregate, outputs: str, shards: int | None = None) -> DataFrame:
    """Streaming over-by-size: input columns and ``outputs`` (DDL) for every row; ``shards`` as in ``_dealt``."""
    groups, apart = _dealt(df, keys, shards)
    return groups.transformWithState(RowsOver(df.schema, order, size, aggregate, T.StructType.fromDDL(outputs).names, apart), _added(df.schema, outputs), "Append", "None")


def duration_over(df: DataFrame, keys: Sequence[str], time: str, size_ms: int, aggregate: Aggregate, outputs: str, watermark: str, delay: str = "0 seconds", shards: int | None = None) -> DataFrame:
    """Streaming over-by-duration; ``watermark`` is the timestamp column that event time follows, ``time`` its epoch ms; ``shards`` as in ``_dealt``."""
    groups, apart = _dealt(df.withWatermark(watermark, delay), keys, shards)
    return groups.transformWithState(DurationOver(df.schema, time, size_ms, aggregate, T.StructType.fromDDL(outputs).names, apart), _added(df.schema, outputs), "Append", "EventTime")


def reorder(df: DataFrame, keys: Sequence[str], time: str, delay_ms: int) -> DataFrame:
    """Rows of a stream through a reorder buffer per key: same columns, in time order within a release."""
    return df.groupBy(*keys).transformWithState(Reorder(df.schema, time, delay_ms), df.schema, "Append", "None")


def late_rows(df: DataFrame, keys: Sequence[str], time: str, size_ms: int, delay_ms: int = 0) -> DataFrame:
    """Late side output: rows that built-in windows would drop, with their tumbling window's start."""
    return df.groupBy(*keys).transformWithState(LateRows(time, size_ms, delay_ms), _added(df.schema, "window_start long"), "Append", "None")


def in_order(df: DataFrame, keys: Sequence[str], time: str, order: str, shards: int | None = None) -> DataFrame:
    """A stream without the rows that are older than one of their key that came before them; ``order`` is how rows of a batch came, ``shards`` as in ``_dealt``."""
    groups, apart = _dealt(df, keys, shards)
    return groups.transformWithState(InOrder(df.schema, time, order, apart), df.schema, "Append", "None")


def window_rows(df: DataFrame, keys: Sequence[str], time: str, size_ms: int, slide_ms: int, function: Callable[[tuple[int, int], list[Row]], list[tuple]], outputs: str, watermark: str, delay: str = "0 seconds", shards: int | None = None) -> DataFrame:
    """Streaming time-window callback: one or many rows a window, as the callable gives them; ``watermark`` is the
    timestamp column that event time follows, ``time`` its epoch ms. All rows of a key's window pass through one call; ``shards`` as in ``_dealt``.
    """
    out = T.StructType.fromDDL(outputs)
    groups, apart = _dealt(df.withWatermark(watermark, delay), keys, shards)
    return groups.transformWithState(WindowRows(df.schema, time, size_ms, slide_ms, function, out.names, apart), out, "Append", "EventTime")


def compat_slide(df: DataFrame, clock: str, key: str, time: str, order: str, size_ms: int, slide_ms: int, idle_ms: int | None = None) -> DataFrame:
    """Sliding windows by the one-clock rules; all rows of a ``clock`` value share a clock and so a task. With ``idle_ms``
    windows also fire when a clock has had no rows for so long.
    """
    out = "clock string, key string, window_start long, n long, rows string"
    mode = "None" if idle_ms is None else "ProcessingTime"
    whole = isinstance(df.schema[order].dataType, (T.IntegerType, T.LongType))
    return df.withColumn(clock, F.col(clock).cast("string")).groupBy(clock).transformWithState(CompatSlideProcessor(key, time, size_ms, slide_ms, order, idle_ms, whole), T.StructType.fromDDL(out), "Append", mode)
