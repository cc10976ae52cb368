"""Observation-shaped views over the star-schema tables.

Each view reads its whole table. They give the shapes of a mountain scene
archive (a DEM, acquisitions, observed cells, a scene catalogue, journals,
domains); the values are synthetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import masks, pixel
from ..functions.numeric import flag
from ..operators import grid
from . import io

WIDTH, RES = 50, 30.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dem(spark: SparkSession, d: str) -> DataFrame:
    """part as elevation cells: z has gaps, zf is the gap-free surface."""
    k, z = F.col("p_partkey"), F.col("p_retailprice") + F.col("p_size")
    return table(spark, d, "part").select(
        F.floor(k / WIDTH).alias("r"), F.pmod(k, F.lit(WIDTH)).alias("c"),
        F.when(F.col("p_size") != 50, z).alias("z"), z.alias("zf"), "p_size")


def dem_v2(spark: SparkSession, d: str) -> DataFrame:
    """A second DEM version with one changed block of cells."""
    changed = F.col("r").between(1, 2) & F.col("c").between(20, 22)
    return dem(spark, d).withColumn("z", F.when(changed, F.col("z") + 1).otherwise(F.col("z")))


def terrain(spark: SparkSession, d: str) -> DataFrame:
    return grid.terrain(dem(spark, d), RES)


def acq(spark: SparkSession, d: str) -> DataFrame:
    """One acquisition per supplier nation; sun angles and day from its balances."""
    cents = F.sum(F.round(F.abs("s_acctbal") * 100).cast("long"))
    base = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("a")).agg(
        cents.alias("cents"), F.count("*").alias("n_scene"))
    return base.select(
        "a", "cents", "n_scene",
        (F.pmod("cents", F.lit(18000)) / 100.0 + 90).alias("sun_az"),
        (F.pmod("cents", F.lit(3000)) / 100.0 + 15).alias("sun_el"),
        F.date_add(F.lit("2013-01-01").cast("date"), F.pmod("cents", F.lit(4000)).cast("int")).alias("day"))


def scene(spark: SparkSession, d: str) -> DataFrame:
    """supplier as a scene catalogue: time, path/row, cloud, sun angles and footprint."""
    cents = F.round(F.abs("s_acctbal") * 100).cast("long")
    s = table(spark, d, "supplier").select(
        F.col("s_name").alias("scene_id"), F.col("s_nationkey").alias("a"), cents.alias("cents"))
    def mod(n: int) -> Column:
        return F.pmod(F.col("cents"), F.lit(n))
    x0, y0 = mod(60) - 40, mod(45) - 30
    return s.select(
        "scene_id", "a", "cents",
        F.date_add(F.lit("2013-01-01").cast("date"), mod(4000).cast("int")).alias("day"),
        (F.col("a") % 4 + 128).alias("wrs_path"), (F.col("a") % 3 + 36).alias("wrs_row"),
        F.when(mod(97) != 0, mod(101) / 1.0).alias("cloud"),
        F.when(mod(89) != 0, mod(18000) / 100.0 + 90).alias("sun_az"),
        F.when(mod(83) != 0, mod(3000) / 100.0 + 15).alias("sun_el"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 1490 + mod(80)).alias("x1"), (y0 + 1200 + mod(55)).alias("y1"))


REGION = (0, 0, 1500, 1200)


def obs(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as observed cells, one per (a, r, c), latest first.

    The pick is a min over an ordered struct, so it combines on the map side
    and a cell with very many copies is not gathered in one task.
    """
    li = table(spark, d, "lineitem").join(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a")),
        "l_suppkey")
    order = [(-F.unix_timestamp("l_shipdate")).alias("o1"), "l_orderkey", "l_linenumber", "l_suppkey",
             "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    one = li.groupBy("a", "l_partkey").agg(F.min(F.struct(*order)).alias("x")).select(  # one cell per part key
        "a", F.floor(F.col("l_partkey") / WIDTH).alias("r"), F.pmod("l_partkey", F.lit(WIDTH)).alias("c"), "x.*")
    v4 = F.when(F.col("l_linenumber") == 7, 0).otherwise(1)
    v5 = F.when((F.col("l_linenumber") == 6) & (F.col("l_tax") > 0.065), 0).otherwise(1)
    disc = F.round(F.col("l_discount") * 100).cast("int")
    qa = F.create_map(*[F.lit(x) for kv in QA_BY_DISCOUNT.items() for x in kv])[disc]
    return one.select(
        "a", "r", "c",
        F.when(v4 == 1, F.floor(F.col("l_extendedprice") / 2.7 + 5000)).otherwise(0).alias("dn4"),
        F.when(v5 == 1, (F.col("l_quantity") * 760 + 5000).cast("long")).otherwise(0).alias("dn5"),
        F.coalesce(qa, F.lit(64)).alias("qa"), v4.alias("v4"), v5.alias("v5"), F.lit(1).alias("vqa"))


QA_BY_DISCOUNT = {0: 1, 1: 2, 2: 8, 3: 16, 4: 32, 5: 128}


def with_masks(o: DataFrame) -> DataFrame:
    """Add reflectances and the per-cell predicates, up to base-valid land."""
    o = o.withColumns({"rho4": pixel.reflectance(F.col("dn4")), "rho5": pixel.reflectance(F.col("dn5"))})
    o = o.withColumns({
        "msource": masks.source_valid(F.col("v4"), F.col("v5"), F.col("vqa")),
        "clear": masks.qa_clear(F.col("qa")), "water": masks.water(F.col("qa")),
        "inrange": masks.in_range(F.col("rho4")) & masks.in_range(F.col("rho5")),
        "tvalid": flag(F.col("terrain_valid"))})
    base = F.col("msource") & F.col("clear") & F.col("inrange") & F.col("tvalid")
    return o.withColumn("base", base).withColumn("land", F.col("base") & ~F.col("water"))


def px(spark: SparkSession, d: str) -> DataFrame:
    """Observed cells with terrain, illumination and masks."""
    t = terrain(spark, d).select("r", "c", "z", "slope", "aspect", "terrain_valid")
    o = obs(spark, d).join(t, ["r", "c"], "left")
    o = o.join(acq(spark, d).select("a", "sun_az", "sun_el"), "a")
    o = with_masks(o)
    o = o.withColumn("cos_i", pixel.cos_incidence(F.col("slope"), F.col("aspect"), F.col("sun_az"), F.col("sun_el")))
    return o.withColumns({"mu": pixel.direct_factor(F.col("cos_i")), "lit": masks.lit(F.col("cos_i"))})


def journal(spark: SparkSession, d: str) -> DataFrame:
    """events as a task journal."""
    states = {"signup": "READY", "view": "RUNNING", "purchase": "COMPLETED", "error": "FAILED", "click": "CANCELLED"}
    m = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("task_id"),
        m[F.col("event_type")].alias("state"), (F.col("event_id") % 3 + 1).alias("attempt"))


def domain_day(spark: SparkSession, d: str) -> DataFrame:
    """Coverage per domain and day: share of order value with status F; null when nothing was ordered for value."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.groupBy(F.col("c_nationkey").alias("d"), F.to_date("o_orderdate").alias("day")).agg(
        F.when(F.count_if(F.col("o_orderstatus") == "O") < F.count("*"),
               F.sum(F.when(F.col("o_orderstatus") == "F", cents).otherwise(0)) / F.sum(cents)).alias("coverage"),
        F.count("*").alias("scenes"))


def ref_day(spark: SparkSession, d: str) -> DataFrame:
    """Distinct reference days per domain: returned lines with a large quantity."""
    li = table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    s = table(spark, d, "supplier")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("d"), F.to_date("l_shipdate").alias("day")).distinct()


def domain_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(
        F.col("c_nationkey").alias("d"), F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n"))


def zero_mask(spark: SparkSession, d: str) -> DataFrame:
    return dem(spark, d).select("r", "c", (F.col("p_size") > 35).cast("int").alias("m"))


def artifact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("role"), "text")


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """Design rows from embeddings; x3 repeats x1 + x2 to force a rank loss."""
    e = table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(3)])
    return e.select("vec_id", "label", F.col("e0").alias("x1"), F.col("e1").alias("x2"),
                    (F.col("e0") + F.col("e1")).alias("x3"), F.col("e2").alias("y"))


def sky(spark: SparkSession, d: str) -> DataFrame:
    """Sky view of the gap-free surface: 8 azimuths, 150 m."""
    from ..operators.skyview import sky_view
    return sky_view(dem(spark, d), "zf", RES, 8, 150.0)


CELL_COLUMNS = ["a", "r", "c", "z", "qa", "v4", "v5", "rho4", "rho5", "msource", "clear", "water", "inrange", "tvalid",
                "base", "land", "lit", "cos_i", "mu"]


def px_table(spark: SparkSession, d: str) -> DataFrame:
    """``px`` written once for plans with several branches."""
    return io.derived(spark, d, "cells", lambda: px(spark, d).select(*CELL_COLUMNS))


LAND_COLUMNS = ["a", "r", "c", "lit", "rho4", "rho5", "mu"]


def land_sky_table(spark: SparkSession, d: str) -> DataFrame:
    """Land cells with their sky view and what the candidate models read; other cells and columns are not joined."""
    land = px_table(spark, d).where("land").select(*LAND_COLUMNS)
    return io.derived(spark, d, "land_sky", lambda: land.join(sky(spark, d), ["r", "c"], "left").withColumn("land", F.lit(True)))


def px_sky(spark: SparkSession, d: str) -> DataFrame:
    return px(spark, d).join(sky(spark, d), ["r", "c"], "left")
