"""Keyed states that outlive a restart: a value a column, removal, and a timer for keys that fall idle.

An event sets, updates or removes its key. ``set`` stands for all columns at once, a null being a value; ``update`` changes
the columns that are not null and is ignored for a key that is not there; ``remove`` clears the key's state. Events carry
the number of their arrival, which decides between them whatever task and order they come in, so a key of any number of
events is merged row by row in bounded memory. Numbers are kept with the values: an event that comes late changes only
what no later event has.

Each micro-batch gives a row for every key that it touched: its columns now, the number of its last event, and whether it
is gone. ``current`` of those rows is the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.sources.work import new_path

SET, UPDATE, REMOVE = "set", "update", "remove"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of the state beside the columns': numbers of the last set and of the last event, and the timer.
KNOWN = "known"


def moved(handle: StatefulProcessorHandle, old: int | None, new: int) -> int:
    """The timer of a key at its new time."""
    if old != new:
        if old is not None:
            handle.deleteTimer(old)
        handle.registerTimer(new)
    return new


class KeyedStates(StatefulProcessor):
    """Merges the events (key, action, at, columns, _time) of each key; ``idle_ms``: after so much event time without an
    event it is dropped."""

    def __init__(self, columns: list[T.StructField], idle_ms: int | None = None):
        self.columns, self.idle_ms = columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        at = T.StructField("at", T.LongType())
        self.values = {c.name: handle.getValueState(f"of_{c.name}", T.StructType([at, T.StructField("value", c.dataType)])) for c in self.columns}
        self.known = handle.getValueState(KNOWN, T.StructType([T.StructField("born", T.LongType()), at, T.StructField("timer", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.known.get() if self.known.exists() else None
        # the number of the event that set or removed the key last, and whether it is there since
        born, there = (before[0], True) if before else (-1, False)
        last = before[1] if before else -1
        seen = (before[2] or 0) - (self.idle_ms or 0) if before else 0
        newest: dict[str, tuple[int, Any]] = {}
        for row in rows:
            last, seen = max(last, row.at), max(seen, row._time or 0)
            if row.action != UPDATE and row.at > born:
                born, there = row.at, row.action == SET
            if row.action != REMOVE:
                for c in self.columns:
                    if row[c.name] is not None and row.at > newest.get(c.name, (-1,))[0]:
                        newest[c.name] = row.at, row[c.name]
        if not there:
            if before:
                self._clear(before[2])
            if before or born >= 0:
                yield self._row(key, {}, last, True)
            return
        now = {}
        for c in self.columns:
            state = self.values[c.name]
            old = state.get() if before and state.exists() else None
            at, value = max(old or (-1, None), newest.get(c.name, (-1, None)), key=lambda x: x[0])
            if at >= born:
                now[c.name] = value
                if not old or at > old[0]:
                    state.update((at, value))
            elif old:
                state.clear()
        timer = None if self.idle_ms is None else moved(self.handle, before[2] if before else None, seen + self.idle_ms)
        self.known.update((born, last, timer))
        yield self._row(key, now, last, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = self.known.get()[1] if self.known.exists() else -1
        self._clear(None)
        yield self._row(key, {}, last, True)

    def _clear(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        for state in (*self.values.values(), self.known):
            state.clear()

    def _row(self, key: Any, now: dict[str, Any], last: int, gone: bool) -> Row:
        return Row("key", "at", "gone", *[c.name for c in self.columns])(key[0], last, gone, *[now.get(c.name) for c in self.columns])

    def close(self) -> None:
        pass


class FirstRows(StatefulProcessor):
    """Of each key's rows the one with the smallest number among those of the batch that it comes in first; a key is
    forgotten when it has not come for ``idle_ms`` of event time."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("timer", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, first, seen = self.seen.exists(), None, 0
        old = self.seen.get()[0] if known else None
        for row in rows:
            seen = max(seen, row._time or 0)
            if first is None or row._at < first._at:
                first = row
        if not known:
            yield first
        timer = None if self.idle_ms is None else moved(self.handle, old, max(old or 0, seen + self.idle_ms))
        if not known or timer != old:
            self.seen.update((timer,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_rows(events: DataFrame, keys: list[str], at: str, time: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """The whole first row of each key. With ``idle_ms`` the stream needs a watermark on ``time``, and the state is bounded
    by the keys that came within that much of it."""
    marked = events.withColumns({"_at": F.col(at), "_time": _ms(time)})
    mode = "none" if idle_ms is None else "eventtime"
    return marked.groupBy(*keys).transformWithState(FirstRows(idle_ms), marked.schema, "append", mode).drop("_at", "_time")


def _ms(time: str | None):
    return F.unix_millis(F.col(time)) if time else F.lit(None).cast("long")


def states(events: DataFrame, key: str, action: str, at: str, columns: list[str], time: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """(key, at, gone, columns) of every key a micro-batch touched. The session has to use the RocksDB state store, which
    ``use_rocks`` sets. With ``idle_ms`` the stream needs a watermark on ``time``."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    if not isinstance(kinds[at], T.LongType):
        raise TypeError(f"numbers of arrival are 64-bit integers: {at}")
    fields = [T.StructField(c, kinds[c]) for c in columns]
    schema = T.StructType([T.StructField("key", kinds[key]), T.StructField("at", T.LongType()), T.StructField("gone", T.BooleanType()), *fields])
    watched = [time] if idle_ms is not None and time not in columns else []
    narrow = events.select(F.col(key).alias("key"), F.col(action).alias("action"), F.col(at).alias("at"), _ms(time).alias("_time"), *columns, *watched)
    return narrow.groupBy("key").transformWithState(KeyedStates(fields, idle_ms), schema, "update", "none" if idle_ms is None else "eventtime")


def use_rocks(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def current(changes: DataFrame, key: str = "key") -> DataFrame:
    """The last row of each key, of keys that are there. ``changes``: rows of ``states`` with the number of their batch."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch", "at")).alias("_last"))
    return last.where("NOT _last.gone").select(key, *[F.col(f"_last.{c}").alias(c) for c in rest if c not in ("batch", "gone")])


def replayable(rows: DataFrame, order: str, batches: int, path: str | None = None) -> str:
    """A folder with ``rows`` added in ``batches`` files by ``order``, one written after the other, for a stream of as many
    micro-batches."""
    path = path or new_path(rows.sparkSession, "replay")
    cuts = rows.agg(F.percentile_approx(order, [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first().cuts or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = rows if low is None else rows.where(F.col(order) > low)
        some = some if high is None else some.where(F.col(order) <= high)
        some.coalesce(1).write.mode("append").parquet(path)
    return path
