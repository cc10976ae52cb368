"""Change propagation: change classes per consumer, descendants, marks, version digests."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import identity
from ..sources import io

BLOCK = 64


def influence(consumers: DataFrame) -> DataFrame:
    """Add the influence window (half open, cells): the compute window grown by the radius."""
    return consumers.withColumns({"ir0": F.col("r0") - F.col("radius"), "ic0": F.col("c0") - F.col("radius"),
                                  "ir1": F.col("r1") + F.col("radius"), "ic1": F.col("c1") + F.col("radius")})


def registered(consumers: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach radii; a consumer without a registered radius stops the job instead of counting as 0."""
    j = consumers.join(registry, "role", "left")
    return j.withColumn("radius", F.when(F.col("radius").isNull(), F.raise_error(F.lit("unregistered consumer")).cast("long")).otherwise(F.col("radius")))


def unregistered(consumers: DataFrame, registry: DataFrame) -> DataFrame:
    return consumers.join(registry, "role", "left_anti")


def in_window(consumers: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Consumers x cells inside their influence window, through an equi-join on grid blocks."""
    def blocks(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(F.col(lo), F.lit(0)) / BLOCK), F.floor(F.greatest(F.col(hi) - 1, F.lit(0)) / BLOCK)))
    w = consumers.select("consumer", "ir0", "ic0", "ir1", "ic1").withColumn("_br", blocks("ir0", "ir1")).withColumn("_bc", blocks("ic0", "ic1"))
    k = cells.select("r", "c", *columns).withColumns({"_br": F.floor(F.col("r") / BLOCK), "_bc": F.floor(F.col("c") / BLOCK)})
    return w.join(k, ["_br", "_bc"]).where(
        (F.col("r") >= F.col("ir0")) & (F.col("r") < F.col("ir1")) & (F.col("c") >= F.col("ic0")) & (F.col("c") < F.col("ic1"))
    ).select("consumer", "r", "c", *columns)


def change_classes(consumers: DataFrame, old: DataFrame, new: DataFrame, old_box: dict[str, Column], new_box: dict[str, Column]) -> DataFrame:
    """Per consumer: artifact_only, value_change_in_scope or scope_extension.

    Only cells that differ meet the consumers, not the whole grids.
    """
    a = old.select("r", "c", F.col("z").alias("_a"))
    b = new.select("r", "c", F.col("z").alias("_b"))
    diff = a.join(b, ["r", "c"]).where(~F.col("_a").eqNullSafe(F.col("_b"))).select("r", "c", F.abs(F.col("_b") - F.col("_a")).alias("delta"))
    hit = in_window(consumers, diff, ["delta"]).groupBy("consumer").agg(F.count("*").alias("differing"), F.max("delta").alias("max_delta"))

    def covers(box: dict[str, Column]) -> Column:
        return (F.col("ir0") >= box["r0"]) & (F.col("ic0") >= box["c0"]) & (F.col("ir1") <= box["r1"]) & (F.col("ic1") <= box["c1"])

    j = consumers.join(hit, "consumer", "left").withColumn("differing", F.coalesce("differing", F.lit(0)))
    old_ok, new_ok = covers(old_box), covers(new_box)
    return j.withColumns({
        "old_covers": old_ok, "new_covers": new_ok, "insufficient": ~new_ok,
        "change_class": F.when(~new_ok | ~old_ok, "scope_extension").when(F.col("differing") == 0, "artifact_only").otherwise("value_change_in_scope")})


def descendants(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Transitive dependents of all roots with depth and one path each (smallest text at the first depth).

    Breadth first over all roots at once: a node is visited one time, so the
    work is linear in the edges. Each level is written before the next.
    """
    edges = io.materialize(spark, edges.select("src", "dst").distinct(), "edges")
    level = io.materialize(spark, roots.select("node", F.col("node").alias("path"), F.lit(0).alias("depth")).distinct(), "level")
    seen, out = level, []
    for depth in itertools.count(1):
        step = level.join(edges, level["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(
            F.min(F.concat_ws(">", "path", "dst")).alias("path")).withColumn("depth", F.lit(depth))
        level = io.materialize(spark, step.join(seen.select("node"), "node", "left_anti"), "level")
        if level.isEmpty():
            break
        out.append(level)
        seen = seen.unionByName(level)
    return seen.where("depth > 0")


def propagate(nodes: DataFrame, invalid: DataFrame, desc: DataFrame) -> DataFrame:
    """Marks of all artifacts: invalidated roots, quarantined descendants, the rest valid."""
    i = invalid.select("node", F.lit(True).alias("_i")).distinct()
    j = nodes.select("node").distinct().join(i, "node", "left").join(desc.select("node", F.col("path").alias("_p")), "node", "left")
    return j.select("node", F.when(F.col("_i"), "invalidated").when(F.col("_p").isNotNull(), "quarantined").otherwise("valid").alias("mark"),
                    F.when(F.col("_i"), F.col("node")).otherwise(F.col("_p")).alias("path"))


def version_digests(consumers: DataFrame, cells: DataFrame, value: str = "z") -> DataFrame:
    """Digest of the values each consumer sees; sums of row hashes, so a window of any size stays distributed."""
    return in_window(consumers, cells, [value]).groupBy("consumer").agg(
        identity.set_digest(identity.row_text(F.col("r"), F.col("c"), F.round(F.col(value) * 100).cast("long"))).alias("digest"), F.count("*").alias("cells"))


def load_cached(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Cache entries whose recorded digest is current; any stale entry stops the job."""
    j = cache.join(current.select("consumer", F.col("digest").alias("_now")), "consumer", "left")
    return j.withColumn("digest", F.when(F.col("digest").eqNullSafe(F.col("_now")), F.col("digest"))
                        .otherwise(F.raise_error(F.lit("cache version differs from the current geometry")).cast("string"))).drop("_now")


def receipt(marks: DataFrame) -> DataFrame:
    """One row that stands for a table of marks: number of rows and a digest of (node, mark), the same in any order and partitioning."""
    return marks.agg(F.count("*").alias("rows"), identity.set_digest(identity.row_text(F.col("node"), F.col("mark"))).alias("digest"))


def publish_marks(marks: DataFrame, folder: str, version: int) -> DataFrame:
    """Write ``marks`` as a new version of the table of marks in ``folder``; returns the receipt of what was written.

    A version that exists is an error, so earlier versions and their receipts stay as they were.
    """
    spark = marks.sparkSession
    path = f"{folder}/marks/version={version}"
    io.write_new(marks.select("node", "mark"), path)
    io.write_new(receipt(spark.read.parquet(path)), f"{folder}/receipts/version={version}")
    return spark.read.parquet(f"{folder}/receipts/version={version}")


def marks_of(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/marks/version={version}")


def agrees(spark: SparkSession, folder: str, version: int, given: DataFrame) -> bool:
    """Whether the receipt ``given`` is that of the marks stored as ``version`` now, whatever receipt is stored beside them."""
    return receipt(marks_of(spark, folder, version)).exceptAll(given.select("rows", "digest")).isEmpty()


def rollback(spark: SparkSession, folder: str, version: int, given: DataFrame, as_version: int) -> DataFrame:
    """Publish the marks of an earlier version once more, as the newest, provided ``given`` is their receipt; returns them.

    Otherwise nothing is written. A rollback is a version of its own, so it can be rolled back in turn.
    """
    if not agrees(spark, folder, version, given):
        raise ValueError(f"receipt does not match the marks of version {version}")
    publish_marks(marks_of(spark, folder, version), folder, as_version)
    return marks_of(spark, folder, as_version)
