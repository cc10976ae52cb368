"""Life of tasks as a stream with bounded state: open rows, one final row, late events apart."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import pixel
from .journal import run_once

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE = "state string, seq long, events long, last_ms long, first_final string, first_seq long, second_seq long, unknown long"
EMPTY = (None, -1, 0, -1, None, -1, -1, 0)
LIFE = "task_id long, kind string, state string, seq long, events long, first_final string, has_second boolean, unknown_events long, verdict string"
COLUMNS = ["task_id", "kind", "state", "seq", "events", "first_final", "has_second", "unknown_events", "verdict"]


@contextmanager
def rocksdb(spark: SparkSession):
    """State on local disk while a stream is started; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class TaskLife(StatefulProcessor):
    """Eight values a task, whatever its history; they are dropped ``keep_ms`` of event time after its last event."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        old = tuple(self.task.get()) if self.task.exists() else EMPTY
        now = old
        for pdf in rows:
            late = pdf[pdf["ms"] < mark]
            if len(late):
                yield pd.DataFrame({"task_id": int(key[0]), "kind": "late", "state": late["state"], "seq": late["seq"], "events": 1, "first_final": None,
                                    "has_second": None, "unknown_events": None, "verdict": None})[COLUMNS].astype({"has_second": "boolean", "unknown_events": "Int64"})
            now = self.fold(now, pdf[pdf["ms"] >= mark])
        if now[2] > old[2]:
            if old[3] >= 0:
                self.handle.deleteTimer(int(old[3]) + self.keep_ms)
            self.handle.registerTimer(int(now[3]) + self.keep_ms)
            self.task.update(now)
            yield self.row(key, "open", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.task.exists():
            yield self.row(key, "final", tuple(self.task.get()))
            self.task.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def fold(now: tuple, pdf: pd.DataFrame) -> tuple:
        """Add events to the values of a task; their order does not matter."""
        if not len(pdf):
            return now
        state, seq, events, last, first_final, first_seq, second_seq, unknown = now
        one, two = pdf[pdf["attempt"] == 1], pdf[pdf["attempt"] == 2]
        if int(pdf["seq"].max()) > seq:
            top = pdf.loc[pdf["seq"].idxmax()]
            state, seq = top["state"], int(top["seq"])
        if len(one) and int(one["seq"].max()) > first_seq:
            top = one.loc[one["seq"].idxmax()]
            first_final, first_seq = top["state"], int(top["seq"])
        if len(two):
            low = int(two["seq"].min())
            second_seq = low if second_seq < 0 else min(second_seq, low)
        unknown += int((~pdf["state"].isin(list(pixel.TASK_STATES))).sum())
        return state, seq, events + len(pdf), max(last, int(pdf["ms"].max())), first_final, first_seq, second_seq, unknown

    @staticmethod
    def row(key, kind: str, now: tuple) -> pd.DataFrame:
        state, seq, events, _, first_final, first_seq, second_seq, unknown = now
        if second_seq < 0:
            verdict = "no_retry"
        elif unknown:
            verdict = "blocked_unknown"
        else:
            verdict = "retry_ok" if first_final == "FAILED" and second_seq > first_seq else "retry_violation"
        return pd.DataFrame([(int(key[0]), kind, state, int(seq), int(events), first_final, second_seq >= 0, int(unknown), verdict)], columns=COLUMNS)


def task_life_stream(journal: DataFrame, path: str, checkpoint: str, delay: str = "1 day", keep_days: float = 7.0) -> None:
    """Write the life of every task (``journal``: seq, ts, task_id, state, attempt); one folder a batch, so a replay overwrites itself.

    A row is ``open`` (the task after a batch that touched it), ``final`` (no event for ``keep_days`` of event time: the task is
    forgotten) or ``late`` (one event older than the watermark, which is ``delay`` behind the newest event; it changes nothing).
    The state holds the tasks of the last ``keep_days`` and ``delay`` only. An event on time after the final row starts the task anew.
    Rows without task, time or seq cannot be placed and are left out.
    """
    spark = journal.sparkSession
    rows = journal.where("task_id IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", delay)
    # milliseconds as plain numbers: late rows reach the processor instead of being dropped before it
    rows = rows.select("seq", "task_id", "state", "attempt", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("task_id").transformWithStateInPandas(TaskLife(int(keep_days * 86_400_000)), LIFE, "update", "eventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb(spark):
        run_once(out.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def read_life(spark: SparkSession, path: str) -> DataFrame:
    """Newest open or final row of each task. A batch that ends a task and starts it anew gives both rows; the open one is the newer."""
    t = spark.read.option("basePath", path).schema(LIFE + ", batch long").parquet(path).where("kind <> 'late'")
    rest = [c for c in COLUMNS if c != "task_id"]
    newest = F.max_by(F.struct(*rest), F.struct(F.col("batch"), F.col("kind") == "open"))
    return t.groupBy("task_id").agg(newest.alias("x")).select("task_id", "x.*")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).schema(LIFE + ", batch long").parquet(path).where("kind = 'late'").select("task_id", "seq", "state", "batch")
