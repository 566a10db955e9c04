"""Run history: daily counters and the latest failures of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["parsed_ok", "parsed_fail", "submitted_ok", "submitted_fail", "completed", "failed", "exported", "realtime_ok", "realtime_fail"]


def within(day: Column, days: int, today: Column) -> Column:
    """Not more than ``days`` ago; days to come count too."""
    return F.datediff(today, day) <= days


def daily(events: DataFrame, days: int | None = None, today: Column | None = None) -> DataFrame:
    """A row a day with any event, newest first; events of other modes add nothing."""
    rows = events.withColumn("day", F.try_to_date(F.left("ts", F.lit(10)))).filter("day is not null")
    if days is not None:
        rows = rows.filter(within(F.col("day"), days, today if today is not None else F.current_date()))
    ok = F.col("status") == "success"

    def total(mode: str, event: str, when: Column, amount: Column) -> Column:
        hit = (F.col("mode") == mode) & (F.col("event") == event) & when
        return F.coalesce(F.sum(F.when(hit, amount)), F.lit(0)).cast("long")

    one, count = F.lit(1), F.coalesce("count", F.lit(1))
    fail = ~F.coalesce(ok, F.lit(False))
    sums = [
        total("batch", "paper_parsed", ok, one),
        total("batch", "paper_parsed", fail, one),
        total("batch", "batch_submitted", ok, count),
        total("batch", "batch_submitted", fail, count),
        total("batch", "batch_fetched", ok, F.coalesce("completed", F.lit(0))),
        total("batch", "batch_fetched", ok, F.coalesce("failed", F.lit(0))),
        total("batch", "paper_exported", ok, one),
        total("realtime", "paper_processed", ok, one),
        total("realtime", "paper_processed", fail, one),
    ]
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(*[s.alias(n) for s, n in zip(sums, COUNTERS)]).orderBy(F.desc("day"))


def recent_failures(events: DataFrame, n: int = 5, order: str = "ord") -> DataFrame:
    """The last failed or quarantined events, by the place in the log that ``sources.files.events`` gives."""
    return events.filter(F.col("status").isin("failed", "quarantined")).orderBy(F.desc(order)).limit(n)
