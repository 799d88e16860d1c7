"""Running progress of jobs over a stream: each event with the counts of its job so far, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What the stateful operator needs; set before the query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COUNTS = "completed long, success long, failed long"


class Progress(StatefulProcessor):
    """Adds to each event of a job what completed, succeeded and failed up to it; three numbers a job are kept, gone after `idle_ms`
    without events if that is above 0."""

    def __init__(self, order: list[str], idle_ms: int = 0):
        self.order, self.idle_ms = order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", COUNTS, self.idle_ms or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        completed, success, failed = self.counts.get() if self.counts.exists() else (0, 0, 0)
        events["completed"] = completed + 1 + events.index
        events["success"] = success + events["progress_done"].astype("int64").cumsum()
        events["failed"] = failed + events["progress_failed"].astype("int64").cumsum()
        self.counts.update(tuple(int(events[c].iloc[-1]) for c in ("completed", "success", "failed")))
        events["progress_job"] = key[0]
        yield events.drop(columns=["progress_done", "progress_failed"])

    def close(self) -> None:
        pass


def stream_progress(events: DataFrame, job: str, order: list[str], done: Column, failed: Column, keep: list[str] | None = None, idle_ms: int = 0) -> DataFrame:
    """(job, order columns, keep, completed, success, failed) of arriving events: the streaming form of relational.progress, without the
    total, which isn't known while events arrive.

    Events of a job count in the order of the micro-batches and inside one by `order`; where they arrive in order the counts are those
    of the batch form. Null done and failed count as no; null jobs are one job. The session needs STATE_STORE.
    """
    keep = [*order, *(c for c in keep or [] if c not in order)]
    flags = [F.coalesce(c, F.lit(False)).alias(a) for c, a in ((done, "progress_done"), (failed, "progress_failed"))]
    rows = events.select(F.coalesce(F.col(job).cast("string"), F.lit("")).alias("progress_job"), F.col(job), *keep, *flags)
    fields = [StructField("progress_job", StringType()), *(rows.schema[c] for c in (job, *keep)), *(StructField(c, LongType()) for c in ("completed", "success", "failed"))]
    made = rows.groupBy("progress_job").transformWithStateInPandas(Progress(order, idle_ms), StructType(fields), "Append", "None" if not idle_ms else "ProcessingTime")
    return made.drop("progress_job")
