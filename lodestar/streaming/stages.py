"""Stages of jobs as a stream: starts and ends pair in the state, and a timer fails what never ends.

The state of a (job, stage) is one open start, or nothing.  An end within `limit` closes
it; a further start closes it as restarted; and once the watermark has passed the start by
`limit`, an event-time timer closes it as failed.  Ends without an open start are left out.
So the state holds open stages only, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = StructType([StructField("job_id", LongType()), StructField("stage", StringType()), StructField("log_id", LongType()), StructField("status", StringType()), StructField("duration_ms", LongType())])


class Stages(StatefulProcessor):
    """Rows (job_id, stage, log_id, status, ms), grouped by job and stage; ms is the instant in milliseconds, as timers count."""

    def __init__(self, limit: timedelta):
        self.limit = int(limit.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "log_id bigint, at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A batch's rows of one stage of one job, in order of time and id.

        The state is read before them and written after them, and has a timer only for what is then open."""
        before = self.open.get() if self.open.exists() else None
        start = before
        done = lambda status, took: Row(job_id=key[0], stage=key[1], log_id=start[0], status=status, duration_ms=took)
        for now, log_id, status in sorted((r["ms"], r["log_id"], r["status"]) for r in rows):
            if start is not None:
                took = now - start[1]
                if took > self.limit:
                    yield done("failed", self.limit)
                elif status == "started":
                    yield done("restarted", took)
                else:
                    yield done(status, took)
                    start = None
                    continue
                start = None
            if status == "started":
                start = (log_id, now)
        if start is before:
            return
        if before is not None:
            self.handle.deleteTimer(before[1] + self.limit)
        if start is None:
            self.open.clear()
        else:
            self.open.update(start)
            self.handle.registerTimer(start[1] + self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists() and self.open.get()[1] + self.limit <= expiredTimerInfo.getExpiryTimeInMs():
            log_id, _ = self.open.get()
            self.open.clear()
            yield Row(job_id=key[0], stage=key[1], log_id=log_id, status="failed", duration_ms=self.limit)

    def close(self) -> None:
        pass


def paired(log: DataFrame, hours: float, late: str = "1 hour") -> DataFrame:
    """(job_id, stage, log_id, status, duration_ms) of every start that is closed, from a stream
    whose session keeps its state in RocksDB (STORE, ROCKS)."""
    rows = log.withWatermark("at", late).withColumn("ms", F.unix_millis("at")).groupBy("job_id", "stage")
    return rows.transformWithState(Stages(timedelta(hours=hours)), OUT, "append", "EventTime")
