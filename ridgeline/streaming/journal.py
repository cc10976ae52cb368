"""Event-journal streams: quarantine, latest state, duplicate removal, retry rule.

All use an available-now trigger in the queries and tests; a service runs the
same functions with a processing-time trigger. Checkpoints live in the shared
folder, sinks are idempotent per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import pixel
from ..sources import io

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """Stream of the events table (declared schema, one known file pattern)."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)


def as_journal(events: DataFrame) -> DataFrame:
    states = {"signup": "READY", "view": "RUNNING", "purchase": "COMPLETED", "error": "FAILED", "click": "CANCELLED"}
    m = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("task_id"),
                         m[F.col("event_type")].alias("state"), (F.col("event_id") % 3 + 1).alias("attempt"))


def read_lines(spark: SparkSession, folder: str, schema: str = io.JOURNAL) -> DataFrame:
    """Stream of JSON lines; lines that do not parse keep their text in ``corrupt``."""
    return spark.readStream.schema(schema + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(folder)


def run_once(stream_writer, checkpoint: str) -> None:
    stream_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quarantine(lines: DataFrame, good_path: str, bad_path: str, checkpoint: str, corrupt: str = "corrupt") -> None:
    """Split a stream into accepted and corrupt rows; each batch owns one folder, so a replay overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        bad = F.col(corrupt).isNotNull()
        batch.where(~bad).drop(corrupt).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        batch.where(bad).select(corrupt).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
    run_once(lines.writeStream.foreachBatch(write), checkpoint)


def latest_state_stream(journal: DataFrame, path: str, checkpoint: str) -> None:
    """Running latest state per task; every batch writes the tasks it changed."""
    g = journal.groupBy("task_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.count("*").alias("events"))
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    run_once(g.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current table of ``latest_state_stream``: the row of the newest batch per task."""
    t = spark.read.option("basePath", path).parquet(path)
    g = t.groupBy("task_id").agg(F.max_by(F.struct("state", "seq", "events"), "batch").alias("x")).select("task_id", "x.*")
    life = pixel.lifecycle(F.col("state"))
    return g.withColumns({"lifecycle": F.coalesce(life, F.lit("unknown")), "blocks": life.isNull() | F.col("state").isin("READY", "RUNNING")})


def first_submissions(journal: DataFrame, delay: str = "30 days") -> DataFrame:
    """One event per task and attempt inside the watermark delay."""
    return journal.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["task_id", "attempt"])


RETRY_SCHEMA = "task_id long, first_final string, has_second boolean, unknown_events long, verdict string"
STATE_SCHEMA = "first_state string, first_seq long, second_seq long, unknown long"


def _retry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold new events of one task into four numbers; the state never grows with its history."""
    first_state, first_seq, second_seq, unknown = state.get if state.exists else (None, -1, -1, 0)
    for pdf in frames:
        known = pdf["state"].isin(list(pixel.TASK_STATES))
        unknown += int((~known).sum())
        one = pdf[pdf["attempt"] == 1]
        if len(one) and int(one["seq"].max()) > first_seq:
            top = one.loc[one["seq"].idxmax()]
            first_state, first_seq = top["state"], int(top["seq"])
        two = pdf[pdf["attempt"] == 2]
        if len(two):
            low = int(two["seq"].min())
            second_seq = low if second_seq < 0 else min(second_seq, low)
    state.update((first_state, first_seq, second_seq, unknown))
    if second_seq < 0:
        verdict = "no_retry"
    elif unknown:
        verdict = "blocked_unknown"
    else:
        verdict = "retry_ok" if first_state == "FAILED" and second_seq > first_seq else "retry_violation"
    yield pd.DataFrame([(int(key[0]), first_state, second_seq >= 0, unknown, verdict)],
                       columns=["task_id", "first_final", "has_second", "unknown_events", "verdict"])


def retry_stream(journal: DataFrame, path: str, checkpoint: str) -> None:
    """Retry verdict per task as a state machine over the stream."""
    out = journal.groupBy("task_id").applyInPandasWithState(_retry, RETRY_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    run_once(out.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    t = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in t.columns if c not in (key, "batch")]
    return t.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(key, "x.*")
