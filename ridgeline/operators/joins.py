"""Joins beyond a plain equi-join: lookups with a match count, set reconciliation, nearest dates, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unique_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the number of matches in right and a one / none / many state."""
    n = right.groupBy(key).agg(F.count("*").alias("n_match"))
    out = left.join(n, key, "left").withColumn("n_match", F.coalesce("n_match", F.lit(0)))
    return out.withColumn("lookup", F.when(F.col("n_match") == 1, "one").when(F.col("n_match") == 0, "none").otherwise("many"))


def identity_difference(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Per named id set: members, and ids only in it or only in the first set."""
    names = list(sources)
    tagged = None
    for n, df in sources.items():
        part = df.select(F.col(key).cast("string").alias("id"), F.lit(n).alias("src")).distinct()
        tagged = part if tagged is None else tagged.unionByName(part)
    per_id = tagged.groupBy("id").agg(*[F.max(F.col("src") == n).alias(n) for n in names])
    ref = F.col(names[0])
    rows = F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("has"), ref.alias("in_ref")) for n in names])
    return per_id.select(F.explode(rows).alias("x")).select("x.*").groupBy("source").agg(
        F.count_if("has").alias("members"), F.count_if(F.col("has") & ~F.col("in_ref")).alias("extra"),
        F.count_if(~F.col("has") & F.col("in_ref")).alias("missing"))


def membership(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer reconciliation of key sets, duplicates counted."""
    n = actual.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    j = e.join(n, keys, "full_outer").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    state = (F.when(F.col("_e").isNull(), "unexpected").when(F.col("n_rows") == 0, "missing")
             .when(F.col("n_rows") > 1, "duplicate").otherwise("present"))
    return j.select(*keys, "n_rows", state.alias("membership"))


def nearest_date(days: DataFrame, refs: DataFrame, key: str, tight: int = 3, loose: int = 7) -> DataFrame:
    """Smallest gap in days to a reference day of the same key, with tight / loose / unmatched.

    Days are put into bins of loose + 1 days and each reference is copied to
    its own and the two next bins, so the match is an equi-join on (key, bin):
    a key with very many days spreads over its bins.
    """
    size = loose + 1
    epoch = F.lit("1970-01-01").cast("date")
    def bin_of(c: str) -> Column:
        return F.floor(F.datediff(F.col(c), epoch) / size)
    r = refs.select(key, F.col("day").alias("ref_day")).distinct()
    r = r.withColumn("_bin", F.explode(F.sequence(bin_of("ref_day") - 1, bin_of("ref_day") + 1)))
    left = days.select(key, "day").distinct().withColumn("_bin", bin_of("day"))
    gap = F.abs(F.datediff("day", "ref_day"))
    best = (left.join(r, [key, "_bin"]).withColumn("gap", gap).where(F.col("gap") <= loose)
            .groupBy(key, "day").agg(F.min("gap").alias("gap")))
    state = F.when(F.col("gap").isNull(), "unmatched").when(F.col("gap") <= tight, "tight").otherwise("loose")
    return left.drop("_bin").join(best, [key, "day"], "left").withColumn("match", state)


def task_lineage(events: DataFrame) -> DataFrame:
    """Per task: intents, ready and completed events and whether the chain closes.

    All three steps share the task key, so one aggregate replaces two joins.
    """
    g = events.groupBy("task_id").agg(
        F.count_if(F.col("state") == "READY").alias("ready"),
        F.count_if(F.col("state") == "COMPLETED").alias("completed"),
        F.min(F.when(F.col("state") == "READY", F.col("seq"))).alias("_r"),
        F.max(F.when(F.col("state") == "COMPLETED", F.col("seq"))).alias("_c"))
    return g.select(
        "task_id", "ready", "completed",
        F.when((F.col("ready") > 0) & (F.col("completed") > 0) & (F.col("_r") < F.col("_c")), "linked")
        .when(F.col("completed") > 0, "completed_without_ready")
        .when(F.col("ready") > 0, "ready_without_completion").otherwise("untracked").alias("lineage"))
