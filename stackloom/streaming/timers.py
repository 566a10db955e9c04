"""The state machine of documents with timers: batch jobs that stay out too long fail, and done documents are forgotten in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stackloom import vocab

#: Sets the state store that timers need: spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "id string, status string, changes long, error string"
HOUR = 3_600_000
DONE = "EXPORTED"


class Documents(StatefulProcessor):
    """One document's state after ``(id, new_status, time)`` rows; its only timer is that of its current state."""

    def __init__(self, window_hours: float = 24, forget_hours: float = 24 * 30):
        self.window, self.forget = int(window_hours * HOUR), int(forget_hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, changes long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, changes = self.state.get() if self.state.exists() else ("PARSED", 0)
        before, since = changes, None
        for row in pd.concat(list(rows)).sort_values("time", kind="stable").itertuples():
            if status != DONE and row.new_status in vocab.STATES and row.new_status != status:
                status, changes, since = row.new_status, changes + 1, int(row.time.timestamp() * 1000)
        if changes != before or not self.state.exists():
            self.state.update((status, changes))
            for old in [*self.handle.listTimers()]:
                self.handle.deleteTimer(old)
            if status == "BATCH_SUBMITTED":
                self.handle.registerTimer(since + self.window)
            elif status == DONE:
                self.handle.registerTimer(since + self.forget)
        yield pd.DataFrame({"id": [key[0]], "status": [status], "changes": [changes], "error": [""]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, changes = self.state.get() if self.state.exists() else (None, 0)
        if status == "BATCH_SUBMITTED":
            self.state.update(("BATCH_FAILED", changes + 1))
            yield pd.DataFrame({"id": [key[0]], "status": ["BATCH_FAILED"], "changes": [changes + 1], "error": ["no result within the window"]})
        elif status == DONE:
            self.state.clear()

    def close(self) -> None:
        pass


def watched(stream: DataFrame, window_hours: float = 24, forget_hours: float = 24 * 30, late: str = "10 minutes") -> DataFrame:
    """(id, status, changes, error) after ``stream(id, new_status, time)``, by the stream's own time.

    A document that was submitted and has no later state ``window_hours`` afterwards becomes BATCH_FAILED, and may be submitted
    again.  Done documents stay done; ``forget_hours`` afterwards their state is let go, so that it does not grow for ever.
    """
    rows = stream.select("id", "new_status", "time").withWatermark("time", late)
    return rows.groupBy("id").transformWithStateInPandas(Documents(window_hours, forget_hours), OUT, "Update", "EventTime")
