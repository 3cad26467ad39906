"""Replay of events in event-time order over a stream, with state per key: what a batch replay gives, whatever order they arrive in.

Events wait in the key's state until the watermark has passed them, and are then taken in the order of (ts, event_id). Spark drops
events that come more than the delay after the latest one seen (they are in the query's metrics); all others count exactly once,
repeated deliveries of an event_id included while it waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from .events import ALLOWED

Step = Callable[[str | None, str | None, int | None], tuple[str, tuple]]


class InOrder(StatefulProcessor):
    """Folds a key's events (event_id, ts, action, value) with ``step``: (state or None, action, value) -> (state, columns of the row)."""

    def __init__(self, step: Step, columns: list[str]):
        self.step, self.columns = step, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id long", "ms long, action string, value long")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for event_id, ms, action, value in zip(part["event_id"], part["ms"], part["action"], part["value"], strict=True):
                ms = int(ms)
                if not self.waiting.containsKey((int(event_id),)):
                    self.waiting.updateValue((int(event_id),), (ms, None if pd.isna(action) else str(action), None if pd.isna(value) else int(value)))
                    self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((v[0], k[0], v[1], v[2]) for k, v in self.waiting.iterator() if v[0] <= until)
        state = self.state.get()[0] if self.state.exists() else None
        out = []
        for ms, event_id, action, value in due:
            state, row = self.step(state, action, value)
            out.append((*key, event_id, *row))
            self.waiting.removeKey((event_id,))
        if out:
            self.state.update((state,))
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, delay: str, step: Step, row: str) -> DataFrame:
    """A row for each event of a stream (key, event_id, ts, action, value: long), in order within its key: key, event_id and ``row``.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), which keeps waiting events on disk.
    """
    form = StructType.fromDDL(f"{key} long, event_id long, {row}")
    stream = events.selectExpr(key, "event_id", "ts", "unix_millis(ts) AS ms", "action", "value").withWatermark("ts", delay)
    return stream.groupBy(key).transformWithStateInPandas(InOrder(step, form.names), form, "Append", "EventTime")


def status_step(state: str | None, to: str | None, _: int | None) -> tuple[str, tuple]:
    """Plan status: an illegal change is reported and not made; any plan may be superseded."""
    was = state or "DRAFT"
    legal = to == "SUPERSEDED" or (was, to) in ALLOWED
    return (to if legal else was), (was, to, legal)


def status_stream(events: DataFrame, delay: str) -> DataFrame:
    """``events.replay`` over a stream (plan_id, event_id, ts, to_status): plan_id, event_id, from_status, to_status, legal."""
    rows = events.selectExpr("plan_id", "event_id", "ts", "to_status AS action", "CAST(NULL AS BIGINT) AS value")
    return in_order(rows, "plan_id", delay, status_step, "from_status string, to_status string, legal boolean")


def link_step(state: str | None, action: str | None, feature: int | None) -> tuple[str, tuple]:
    """Link of a requirement: reassigning and marking decide; a confirmation counts where neither has come."""
    by, status, own = state.split("|") if state else ("", "PENDING", "")
    if action == "mark_drawing_only":
        by, status, own = action, "DRAWING_ONLY", ""
    elif action == "reassign":
        by, status, own = action, "USER_MATCHED", "" if feature is None else str(feature)
    elif action == "confirm" and not by:
        status, own = "USER_MATCHED", "" if feature is None else str(feature)
    return f"{by}|{status}|{own}", (int(own) if own else None, status)


def link_stream(events: DataFrame, delay: str) -> DataFrame:
    """``drawing.link_state`` over a stream (requirement_id, event_id, ts, action, feature_id): the link after each event."""
    rows = events.selectExpr("requirement_id", "event_id", "ts", "action", "feature_id AS value")
    return in_order(rows, "requirement_id", delay, link_step, "feature_id long, status string")
