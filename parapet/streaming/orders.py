"""Orders as a state machine over their events: in batch, and on a stream with timers.

An order that has ended (success, partial, failed, cancelled) takes no further
event. Of the others the last event by time and number counts. What an order's
state means for its download is the same in both forms:

* success: ``ready``; partial: ``blocked_partial_order``, for some of its items are
  missing; queued and running: ``not_ready``, or ``stuck`` once ``patience`` has
  passed since the last event; any other: ``not_downloaded_state_`` and the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States that end an order, and states in which it is not complete yet.
TERMINAL = ("success", "partial", "failed", "cancelled")
NOT_READY = ("queued", "running")


def download_status(state: Column, stuck: Column) -> Column:
    waiting = F.when(stuck, "stuck").otherwise("not_ready")
    return F.when(state == "success", "ready").when(state == "partial", "blocked_partial_order").when(state.isin(*NOT_READY), waiting).otherwise(F.concat(F.lit("not_downloaded_state_"), state))


def order_states(events: DataFrame, as_of, patience: timedelta) -> DataFrame:
    """(order_id, state, at, accepted, ignored, status) of each order, from events (order_id, number, at, state).

    Two sums a task for each order go to one row an order; the second pass joins
    the first end of an order to its events, so no order's events are sorted or held.
    """
    moment = F.struct("at", "number")
    ends = events.where(F.col("state").isin(*TERMINAL)).groupBy("order_id").agg(F.min(moment).alias("end"))
    met = events.join(ends, "order_id", "left").withColumn("taken", F.col("end").isNull() | (moment <= F.col("end")))
    last = F.max(F.when(F.col("taken"), F.struct("at", "number", "state")))
    found = met.groupBy("order_id").agg(last.alias("last"), F.count_if("taken").alias("accepted"), F.count_if(~F.col("taken")).alias("ignored"))
    stuck = F.col("last.at") + F.expr(f"INTERVAL {int(patience.total_seconds())} SECONDS") <= F.lit(as_of)
    return found.select("order_id", "last.state", "last.at", "accepted", "ignored", download_status(F.col("last.state"), stuck).alias("status"))


class _Orders(StatefulProcessor):
    """Holds an order's events until no earlier one can come, then takes them in order."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("order", "state string, at long, accepted long, ignored long")
        self.waiting = handle.getListState("waiting", "at long, number long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for some in rows:
            for at, number, state in zip(some["at"].astype("datetime64[ms]").astype("int64"), some["number"], some["state"], strict=True):
                self.waiting.appendValue((int(at), int(number), state))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, found = expiredTimerInfo.getExpiryTimeInMs(), self.state.get()
        state, at, accepted, ignored = found if found else (None, None, 0, 0)
        left = []
        for event in sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []:
            if event[0] > now:
                left.append(event)
            elif state in TERMINAL:
                ignored += 1
            else:
                at, state, accepted = event[0], event[2], accepted + 1
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if state is None:
            return iter(())
        self.state.update((state, at, accepted, ignored))
        stuck = state in NOT_READY and now >= at + self.patience
        if state in NOT_READY and not stuck:
            self.handle.registerTimer(at + self.patience)
        return iter([pd.DataFrame({"order_id": [key[0]], "state": [state], "at": [pd.Timestamp(at, unit="ms")], "accepted": [accepted], "ignored": [ignored], "stuck": [stuck]})])

    def close(self) -> None:
        pass


def stream_order_states(events: DataFrame, late: str, patience: timedelta) -> DataFrame:
    """The rows of ``order_states`` as they change, from a stream of events; the row of an order with most events is its last.

    Events are taken once the watermark, ``late`` behind the newest event, has
    passed them, so they may come in any order within that time. What comes later
    is dropped and counted (``dropped_rows``). An order that stays not ready for
    ``patience`` is told once more by its timer. Needs the RocksDB state store.
    """
    keyed = events.withWatermark("at", late).groupBy("order_id")
    id_type = events.schema["order_id"].dataType.simpleString()
    states = keyed.transformWithStateInPandas(_Orders(int(patience.total_seconds() * 1000)), f"order_id {id_type}, state string, at timestamp, accepted long, ignored long, stuck boolean", "Append", "EventTime")
    return states.select("order_id", "state", "at", "accepted", "ignored", download_status(F.col("state"), F.col("stuck")).alias("status"))


def dropped_rows(query) -> int:
    """Rows that came after the watermark, over all batches that the query still remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
