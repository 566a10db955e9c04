"""Notices: a hook is called with the counters of a run or of a micro-batch, and only when one that matters has moved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener

Hook = Callable[[str, dict[str, int]], None]

#: The counters of each job that are worth a notice; others only go along with them.
WORTH = {
    "realtime": ("processed",),
    "prepare": ("submitted", "parsed_failed", "submit_failed"),
    "fetch": ("completed", "failed", "exported"),
    "books": ("ok", "failed"),
}


def moved(job: str, counters: dict[str, int]) -> bool:
    """Whether one of the counters that are worth a notice of this job is above zero."""
    return any((counters.get(c) or 0) > 0 for c in WORTH[job])


def observed(df: DataFrame, job: str, counters: dict[str, Column]) -> DataFrame:
    """A stream that counts, in each micro-batch, what ``Notices`` tells of the job."""
    return df.observe(job, *[c.alias(name) for name, c in counters.items()])


def counted(df: DataFrame, job: str, counters: dict[str, Column], write: Callable[[DataFrame], None], hook: Hook) -> dict[str, int]:
    """Writes a batch ``df``, counting in the same pass; the hook is told of it if a counter has moved, and of an error before it is raised."""
    seen = Observation(job)
    try:
        write(df.observe(seen, *[c.alias(name) for name, c in counters.items()]))
    except Exception as e:
        hook(job, {"error": str(e)})
        raise
    found = {k: int(v or 0) for k, v in seen.get.items()}
    if moved(job, found):
        hook(job, found)
    return found


class Notices(StreamingQueryListener):
    """Add to ``spark.streams``: tells the hook of micro-batches in which a job's counters moved, and of queries that failed; empty ticks stay silent."""

    def __init__(self, hook: Hook):
        self.hook = hook

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        for job, row in event.progress.observedMetrics.items():
            found = {k: int(v or 0) for k, v in row.asDict().items()}
            if job in WORTH and moved(job, found):
                self.hook(job, found)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self.hook("error", {"query": str(event.id)})
