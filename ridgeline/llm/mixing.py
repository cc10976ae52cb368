"""Mixing sources to target weights by nested hash-threshold histograms.

Tokens are summed by source and hash bucket. The bucket in which a source's
budget ends is the only one looked into again, with finer buckets, until it
holds one key. A document is in the mix when its hash lies below its source's
threshold: no sort, and a larger budget takes a superset of a smaller one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

BITS, STEP = 60, 12
WEIGHTS = (5, 2, 1)


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 15 hex digits of the content key as a long."""
    return F.conv(F.substring(common.content_key(doc_id, text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """One row a source (``source``, ``source_size``) -> the same plus ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` (a fraction) of all sizes; a target stops at ``cap`` times its source's
    size and the excess goes to the others by weight. Ordered by cap per weight,
    the capped sources come first, so one running sum finds the level; comparisons are exact.
    The table has one row a source, which a mix configures one by one; its two
    windows sort it in one task.
    """
    num, den = share
    big = lambda c: F.col(c).cast("decimal(19,0)")
    everything = W.partitionBy(F.lit(0))
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), rank + 1))
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    ratio = F.col("source_size") * F.expr(f"{math.lcm(*weights)} div w")
    before = W.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    s = s.withColumn("num", num * F.col("total") - den * cap * F.coalesce(F.sum("source_size").over(before), none)) \
         .withColumn("den", F.col("all_w") - F.coalesce(F.sum("w").over(before), none)) \
         .withColumn("under", big("w") * big("num") <= den * cap * big("source_size") * big("den")) \
         .withColumn("at", F.max(F.when(F.col("under"), F.struct("den", "num"))).over(everything))
    return s.select("source", "source_size",
                    F.when(F.col("under"), F.col("w") * (F.col("at.num").cast("double") / (float(den) * F.col("at.den"))))
                    .otherwise(float(cap) * F.col("source_size")).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, h) and ``plan`` (source, source_size, target) -> plan plus ``passes`` and ``below``.

    A document is taken ``passes`` times, and once more when h < ``below``.
    The boundary key, whose documents cross the budget, is taken if that comes nearer to it.
    """
    p = plan.select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("passes")) \
            .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")) \
            .withColumns({"lo": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "sum": F.lit(0).cast("long"), "one": F.lit(None).cast("long")})
    p = common.written(p, "mix-plan")
    live = rows.where("size > 0")
    for shift in range(BITS - STEP, -1, -STEP):
        q = p.where("one is null").select(F.col("source").alias("_s"), "budget", "lo", "base")
        inside = (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + (1 << (shift + STEP)))
        hist = live.join(q, inside).groupBy("_s", "budget", "base", F.expr(f"shiftright(h, {shift})").alias("b")).agg(
            F.sum("size").alias("sum"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        upto = F.col("base") + F.sum("sum").over(W.partitionBy("_s").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        cut = hist.withColumn("upto", upto).where(F.col("upto") > F.col("budget")).groupBy("_s").agg(
            F.min(F.struct("b", "upto", "sum", "h0", "h1")).alias("x"))
        new = p.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
        hit = F.col("x").isNotNull()
        p = common.written(new.select(
            "source", "source_size", "target", "passes", "budget",
            F.when(hit, F.shiftleft(F.col("x.b"), shift)).otherwise(F.col("lo")).alias("lo"),
            F.when(hit, F.col("x.upto") - F.col("x.sum")).otherwise(F.col("base")).alias("base"),
            F.when(hit, F.col("x.sum")).otherwise(F.col("sum")).alias("sum"),
            F.when(hit & (F.col("x.h0") == F.col("x.h1")), F.col("x.h0")).otherwise(F.col("one")).alias("one")), "mix-plan")
        if not p.where("one is null and source_size > 0").limit(1).count():
            break
    nearer = F.col("base") + F.col("sum") - F.col("budget") < F.col("budget") - F.col("base")
    return common.written(p.select("source", "source_size", "target", "passes",
                                   F.coalesce(F.col("one") + F.when(nearer, 1).otherwise(0), F.lit(0)).cast("long").alias("below")), "mix-plan")


def plan_mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    sizes = common.written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    return thresholds(rows, targets(sizes, weights))


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies`` (0 to 2). The plan is a written table of one row a source:
    Spark broadcasts it while its files are below its threshold and splits hot sources by skew join beyond."""
    p = plan.select(F.col("source").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "passes", "below")])
    out = rows.join(p, F.col("source").eqNullSafe(F.col("_s")))
    return out.withColumns({"source_size": F.col("_source_size"), "target": F.col("_target"),
                            "copies": (F.col("_passes") + F.when(F.col("h") < F.col("_below"), 1).otherwise(0)).cast("long")}) \
              .drop("_s", "_source_size", "_target", "_passes", "_below")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h"), *more)


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The documents of the mix with their own columns; one taken twice is there twice.

    Null sources are one source, listed last. Documents without words have size
    0 and follow their hash. Repeated rows share a key and are taken together.
    An empty table gives an empty mix; all other columns pass through whatever their names.
    """
    plan = plan_mix(common.written(sized(docs), "mix-rows"), weights)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", hash60(F.col("doc_id"), F.col("text")).alias("h"))
    taken = copies(packed, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = common.written(sized(docs), "mix-rows")
    return copies(rows, plan_mix(rows)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
