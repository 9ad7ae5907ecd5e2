"""Alerts with snoozes, as state with event-time timers.

An alert opens by an error, sleeps for a while when it is snoozed, opens again when that ends, and is resolved. Rows
wait in state until the watermark passes them and are then folded in order of time, so the result does not
depend on how the log is cut into files or batches. A timer wakes a key at its next row or the end of its snooze; a
resolved alert leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import LATE

OPENS, SNOOZES, RESOLVES = "error", "click", "purchase"
SNOOZE_MS = 6 * 3600 * 1000
OUT = "user_id long, at_ms long, kind string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(state: tuple[str, int], rows: list[tuple[int, int, str]], until: int) -> tuple[tuple[str, int], list[tuple[int, str]]]:
    """The state (status, end of its snooze) after sorted rows (ms, id, type) and the time up to ``until``, with what happened."""
    status, end = state
    out = []

    def wake(now: int):
        nonlocal status
        if status == "snoozed" and end <= now:
            status = "open"
            out.append((end, "reopened"))

    for at, _, kind in rows:
        wake(at)
        if kind == OPENS and status == "none":
            status = "open"
            out.append((at, "opened"))
        elif kind == SNOOZES and status == "open":
            status, end = "snoozed", at + SNOOZE_MS
            out.append((at, "snoozed"))
        elif kind == RESOLVES and status != "none":
            status = "none"
            out.append((at, "resolved"))
    wake(until)
    return (status, end), out


class Alerts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, id long, kind string")
        self.alert = handle.getValueState("alert", "status string, until long")

    def _wake_at(self, rows: list, state: tuple) -> None:
        times = [r[0] for r in rows] + ([state[1]] if state[0] == "snoozed" else [])
        if times:
            self.handle.registerTimer(min(times))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), int(i), k) for b in rows for ms, i, k in zip(b["ms"], b["event_id"], b["event_type"], strict=True)]
        self.waiting.appendList(new)
        self._wake_at(new, ("none", 0))
        yield pd.DataFrame({"user_id": [], "at_ms": [], "kind": []}).astype({"user_id": "int64", "at_ms": "int64", "kind": "str"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((int(r[0]), int(r[1]), r[2]) for r in self.waiting.get())
        due = [r for r in rows if r[0] <= now]
        state = tuple(self.alert.get()) if self.alert.exists() else ("none", 0)
        state, out = fold(state, due, now)
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if state[0] == "none":
            self.alert.clear()
        else:
            self.alert.update(state)
        self._wake_at(rest, state)
        yield pd.DataFrame({"user_id": [int(key[0])] * len(out), "at_ms": [a for a, _ in out], "kind": [k for _, k in out]}).astype({"user_id": "int64", "at_ms": "int64", "kind": "str"})

    def close(self) -> None:
        pass


def alerts(rows: DataFrame) -> DataFrame:
    """(user_id, at_ms, kind): what happens to each user's alert, up to the watermark.

    State with timers needs the RocksDB store; the session's own store is kept if it is that.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keyed = rows.withWatermark("ts", LATE).select("user_id", "ts", "event_id", "event_type", F.unix_millis("ts").alias("ms"))
    return keyed.groupBy("user_id").transformWithStateInPandas(Alerts(), OUT, "Append", "EventTime")
