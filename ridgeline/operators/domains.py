"""Domain screening: class histograms, opportunity ledgers, admission rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays, geometry as geo
from ..functions.numeric import ratio
from .prefix import exact_quantiles


def dominant_class(hist: DataFrame, human: list[str]) -> DataFrame:
    """Argmax class with its share, the share of a class set and the five largest, per domain.

    ``hist`` has one row per (d, class); the class list of a product is short.
    """
    w = W.partitionBy("d").orderBy(F.desc("n"), "class")
    h = hist.withColumn("rn", F.row_number().over(w))
    top = F.sort_array(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", F.concat_ws("=", "class", "n").alias("t")))))
    g = h.groupBy("d").agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("rn") == 1, F.col("class"))).alias("dominant"),
        F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("_n1"),
        F.sum(F.when(F.col("class").isin(*human), F.col("n")).otherwise(0)).alias("_h"), top.alias("_top"))
    return g.select("d", "total", "dominant", ratio(F.col("_n1"), F.col("total")).alias("dominant_share"),
                    ratio(F.col("_h"), F.col("total")).alias("human_share"),
                    F.array_join(F.transform("_top", lambda x: x["t"]), ",").alias("top5"))


def opportunity_ledger(days: DataFrame, floor: float, strong: float) -> DataFrame:
    """Every date of a domain stays in the ledger: scored or not, qualified or rejected."""
    c = F.col("coverage")
    g = days.groupBy("d").agg(
        F.count("*").alias("total"), F.count(c).alias("scored"), F.count_if(c.isNull()).alias("unscored"),
        F.count_if(c >= floor).alias("qualified"), F.count_if(c < floor).alias("rejected"),
        F.count_if(c >= strong).alias("strong"), F.max(c).alias("max_coverage"))
    q = exact_quantiles(days.where(c >= floor), ["d"], c, {"median_qualified": 0.5}, 1 / 4096)
    return g.join(q, "d", "left").withColumn(
        "closes", (F.col("scored") + F.col("unscored") == F.col("total"))
        & (F.col("qualified") + F.col("rejected") == F.col("scored")))


def admission(domains: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Pass or fail codes per domain; every domain stays, with the codes it failed."""
    out = domains.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    failed = arrays.failed_names({n: F.col(n) for n in checks})
    return out.withColumn("failed", F.array_join(failed, ",")).withColumn("admitted", F.col("failed") == "")


def rank_domains(adm: DataFrame, keys: list, target: int) -> DataFrame:
    """Order of the admitted domains: first ``target`` selected, the rest in reserve (domains are few)."""
    w = W.orderBy(*keys)
    r = adm.where("admitted").withColumn("rank", F.row_number().over(w))
    return r.withColumn("selection", F.when(F.col("rank") <= target, "selected").otherwise("reserve"))


def sensor_days(scenes: DataFrame, sensors: list[str], first: str, last: str) -> DataFrame:
    """Per domain: ``scenes`` in all and ``foreign`` ones, of another sensor or outside [first, last]; no sensor or day is foreign."""
    own = F.col("sensor").isin(*sensors) & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return scenes.groupBy("d").agg(F.count("*").alias("scenes"), F.count_if(~F.coalesce(own, F.lit(False))).alias("foreign"))


def cover_share(footprints: DataFrame, cells: DataFrame, buffer: int, block: int = 64) -> DataFrame:
    """Share of the cell places of each footprint, widened by ``buffer`` cells on all sides, that hold a valid cell: (d, places, covered, cover).

    ``footprints``: d and the half-open box r0, c0, r1, c1 in cells; places beyond the grid count as not covered. ``cells``: valid (r, c),
    each once. Counts per block answer for blocks inside a box; only blocks on its edge meet their cells, so the work
    of a domain follows the blocks of its area and the cells of its rim. Every domain stays; an empty box has a null cover.
    """
    b, half = F.lit(block), F.lit(buffer)
    box = footprints.select("d", (F.col("r0") - half).alias("r0"), (F.col("c0") - half).alias("c0"), (F.col("r1") + half).alias("r1"), (F.col("c1") + half).alias("c1"))
    size = F.greatest(F.col("r1") - F.col("r0"), F.lit(0)) * F.greatest(F.col("c1") - F.col("c0"), F.lit(0))

    def spans(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / b), F.floor((F.col(hi) - 1) / b)))
    met = box.where(size > 0).select("*", spans("r0", "r1").alias("br")).select("*", spans("c0", "c1").alias("bc"))
    inside = ((F.col("br") * b >= F.col("r0")) & ((F.col("br") + 1) * b <= F.col("r1")) & (F.col("bc") * b >= F.col("c0")) & ((F.col("bc") + 1) * b <= F.col("c1")))
    placed = cells.select("r", "c", F.floor(F.col("r") / b).alias("br"), F.floor(F.col("c") / b).alias("bc"))
    full = met.where(inside).join(placed.groupBy("br", "bc").agg(F.count("*").alias("n")), ["br", "bc"]).select("d", "n")
    hit = (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))
    rim = met.where(~inside).join(placed, ["br", "bc"]).where(hit).groupBy("d").agg(F.count("*").alias("n"))
    got = full.unionByName(rim).groupBy("d").agg(F.sum("n").alias("covered"))
    out = box.select("d", size.alias("places")).join(got, "d", "left").na.fill(0, ["covered"])
    return out.withColumn("cover", F.when(F.col("places") > 0, ratio(F.col("covered"), F.col("places"))))


def separation_km(centres: DataFrame, base: DataFrame) -> DataFrame:
    """Great-circle distance of every domain centre (d, lon, lat) from the one row (lon, lat) of the baseline domain."""
    b = base.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).limit(1)
    return centres.join(F.broadcast(b), how="left").select("d", geo.great_circle_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")).alias("separation_km"))
