"""Task journals: order checks, latest states, next item, retry rule (batch forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import pixel

ACTIVE_STATES = ["READY", "RUNNING"]


def order_check(items: DataFrame, order: str, time: str, key: str) -> DataFrame:
    """Is ``order`` 1..N without gaps, and ascending in (time, key)?

    Neighbours are found by an equi-join on order, so no task sorts all items.
    """
    head = items.agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"), F.count_distinct(order).alias("distinct"))
    nxt = items.select((F.col(order) - 1).alias(order), F.struct(time, key).alias("_next"))
    wrong = items.join(nxt, order).where(F.struct(time, key) >= F.col("_next")).agg(F.count("*").alias("inversions"))
    return head.crossJoin(F.broadcast(wrong)).select(
        "n", ((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("distinct") == F.col("n"))).alias("contiguous"),
        "inversions", (F.col("inversions") == 0).alias("order_matches_time"))


def next_untouched(items: DataFrame, journal: DataFrame, key: str, order: str) -> DataFrame:
    """First item in order with no journal event."""
    free = items.join(journal.select(key).distinct(), key, "left_anti")
    return free.agg(F.min_by(key, order).alias("next_item"), F.min(order).alias("next_order"), F.count("*").alias("untouched"))


def latest_state(journal: DataFrame) -> DataFrame:
    """Last state per task by journal order; unknown or active states block a submission."""
    g = journal.groupBy("task_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.count("*").alias("events"))
    life = pixel.lifecycle(F.col("state"))
    return g.withColumns({"lifecycle": F.coalesce(life, F.lit("unknown")), "blocks": life.isNull() | F.col("state").isin(ACTIVE_STATES)})


def may_run(items: DataFrame, journal: DataFrame) -> DataFrame:
    """An item may run when every earlier one has succeeded and it has not.

    'All earlier succeeded' means the item is not beyond the first unfinished
    one, which is a single minimum: no running window over all items.
    """
    done = journal.where("state = 'COMPLETED'").select("task_id").distinct().withColumn("succeeded", F.lit(True))
    j = items.join(done, "task_id", "left").withColumn("succeeded", F.coalesce("succeeded", F.lit(False)))
    first = j.where(~F.col("succeeded")).agg(F.min("ord").alias("_first"))
    earlier = F.col("_first").isNull() | (F.col("ord") <= F.col("_first"))
    return j.crossJoin(F.broadcast(first)).select("task_id", "ord", "succeeded", earlier.alias("earlier_done"), (earlier & ~F.col("succeeded")).alias("may_run"))


def retry_rule(journal: DataFrame) -> DataFrame:
    """A second attempt is allowed only after a terminal FAILED first attempt with no unknown state."""
    g = journal.groupBy("task_id").agg(
        F.max_by(F.when(F.col("attempt") == 1, F.col("state")), F.when(F.col("attempt") == 1, F.col("seq"))).alias("first_final"),
        F.max(F.when(F.col("attempt") == 1, F.col("seq"))).alias("_first_seq"), F.min(F.when(F.col("attempt") == 2, F.col("seq"))).alias("_second_seq"),
        F.count_if(pixel.lifecycle(F.col("state")).isNull()).alias("unknown_events"))
    second = F.col("_second_seq").isNotNull()
    return g.select("task_id", "first_final", second.alias("has_second"), "unknown_events",
                    F.when(~second, "no_retry").when(F.col("unknown_events") > 0, "blocked_unknown")
                    .when((F.col("first_final") == "FAILED") & (F.col("_second_seq") > F.col("_first_seq")), "retry_ok").otherwise("retry_violation").alias("verdict"))


def first_per_attempt(journal: DataFrame) -> DataFrame:
    """One submission per task and attempt: the earliest event stays, the rest are counted."""
    return journal.groupBy("task_id", "attempt").agg(F.min("seq").alias("kept_seq"), (F.count("*") - 1).alias("dropped"))
