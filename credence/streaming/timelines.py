"""Timelines of beliefs as a stream: the tracker of operators.timelines as state, with an event-time timer for each lapse.

Turns of a session are buffered until the watermark has passed them, so that they act in order of time whatever the order in
which they come; turns behind the watermark are dropped by Spark's late-data rule. A timer stands at each buffered turn and at
each time at which an open belief lapses; when it fires, the turns and lapses up to that time are applied in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import timelines


class Timelines(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "pickled binary")
        self.waiting = handle.getListState("waiting", "at long, turn_idx long, signals array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for f in rows:
            for at, idx, given in zip(f["at"].tolist(), f["turn_idx"].tolist(), f["signals"].tolist()):
                self.waiting.appendValue((at, idx, list(given)))
                self.handle.registerTimer(at)
        yield timelines.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        upto = expiredTimerInfo.getExpiryTimeInMs()
        state = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else timelines.Tracker()
        rows = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        out, before = [], state.deadlines()
        for at, idx, given in (r for r in rows if r[0] <= upto):
            out += timelines.rows_of(key[0], [*state.lapses(at), *state.turn(at, idx, list(given))])
        out += timelines.rows_of(key[0], state.lapses(upto))
        left = [(r[0], r[1], list(r[2])) for r in rows if r[0] > upto]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        for deadline in state.deadlines() - before:
            self.handle.registerTimer(deadline)
        self.state.update((pickle.dumps(state),))
        yield timelines.frame(out)

    def close(self) -> None:
        pass


def timelines_stream(session_turns: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Belief events of a streaming DataFrame of turns (as operators.timelines.timelines takes them). Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass)."""
    rows = timelines.signal_rows(session_turns).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(Timelines(), outputStructType=timelines.EVENTS, outputMode="append", timeMode="EventTime")
