"""Filters, masks and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, masks, pixel
from ..functions.numeric import ratio
from ..operators import folds as fd
from ..sources import views
from ..sources.config import FOLDS
from .common import C, long, r6c, rounded, text_list
from .duck import STRATUM, r6 as R
from .registry import query


@query("flt01_valid_value_mask", """
    SELECT r, c, (code IS NOT NULL AND NOT isnan(code) AND NOT isinf(code) AND code <> -9999e0) AS valid
    FROM (SELECT r, c, CASE WHEN p_size=50 THEN -9999e0 WHEN p_size=49 THEN 'nan'::DOUBLE WHEN p_size=48 THEN 'inf'::DOUBLE
      ELSE z END AS code FROM dem)""")
def valid_value_mask(s, d):
    code = (F.when(C("p_size") == 50, -9999.0).when(C("p_size") == 49, float("nan"))
            .when(C("p_size") == 48, float("inf")).otherwise(C("z")))
    return views.dem(s, d).select("r", "c", masks.valid_value(code, -9999.0).alias("valid"))


@query("flt02_reflectance_range", f"""
    SELECT a, r, c, {R('rho4')} AS rho4 FROM px0 WHERE rho4 BETWEEN -5e-2 AND 1e0""")
def reflectance_range(s, d):
    o = views.obs(s, d).withColumn("rho4", pixel.reflectance(C("dn4")))
    return o.where(masks.in_range(C("rho4"))).select("a", "r", "c", *r6c("rho4"))


@query("flt03_qa_clear_mask", "SELECT a, r, c, (qa & 63)=0 AS clear FROM obs")
def qa_clear_mask(s, d):
    return views.obs(s, d).select("a", "r", "c", masks.qa_clear(C("qa")).alias("clear"))


@query("flt04_qa_bit_counts", "SELECT a, " + ", ".join(
    f"count(*) FILTER (WHERE (qa>>{i})&1=1) AS n_{n}" for i, n in enumerate(masks.QA_BITS)) + " FROM obs GROUP BY a")
def qa_bit_counts(s, d):
    return views.obs(s, d).groupBy("a").agg(*[
        F.count_if(masks.qa_flag(C("qa"), i)).alias(f"n_{n}") for i, n in enumerate(masks.QA_BITS)])


@query("flt05_water_flag", """SELECT a, count(*) FILTER (WHERE (qa>>7)&1=1) AS water,
    count(*) FILTER (WHERE (qa>>7)&1=1 AND (qa&63)=0) AS water_clear FROM obs GROUP BY a""")
def water_flag(s, d):
    w = masks.water(C("qa"))
    return views.obs(s, d).groupBy("a").agg(
        F.count_if(w).alias("water"), F.count_if(w & masks.qa_clear(C("qa"))).alias("water_clear"))


@query("flt06_source_mask", "SELECT a, r, c, v4=1 AND v5=1 AND vqa=1 AS msource FROM obs")
def source_mask(s, d):
    return views.obs(s, d).select("a", "r", "c", masks.source_valid(C("v4"), C("v5"), C("vqa")).alias("msource"))


@query("flt07_terrain_validity", "SELECT r, c, terrain_valid FROM terrain")
def terrain_validity(s, d):
    t = views.terrain(s, d)
    return t.select("r", "c", masks.all_present(C("z"), C("slope"), C("aspect")).alias("terrain_valid"))


@query("flt08_base_valid_land", "SELECT a, r, c, base, land FROM px")
def base_valid_land(s, d):
    t = views.terrain(s, d).select("r", "c", "terrain_valid")
    return views.with_masks(views.obs(s, d).join(t, ["r", "c"], "left")).select("a", "r", "c", "base", "land")


@query("flt09_two_readings", """SELECT a, n_in, n_out, n_in>0 AS in_positive, n_out>0 AS out_positive,
    (n_in>0)=(n_out>0) AS verdict_same FROM (SELECT a, count(*) FILTER (WHERE land) AS n_in,
    count(*) FILTER (WHERE msource AND inrange AND tvalid AND NOT water) AS n_out FROM px GROUP BY a)""")
def two_readings(s, d):
    loose = C("msource") & C("inrange") & C("tvalid") & ~C("water")
    p = views.px(s, d).groupBy("a").agg(F.count_if("land").alias("n_in"), F.count_if(loose).alias("n_out"))
    return p.withColumns({"in_positive": C("n_in") > 0, "out_positive": C("n_out") > 0,
                          "verdict_same": (C("n_in") > 0) == (C("n_out") > 0)})


@query("flt10_illumination_partition", """SELECT a, count(*) FILTER (WHERE cos_i<=0) AS shadow,
    count(*) FILTER (WHERE cos_i>0 AND cos_i<=1e-1) AS near_zero, count(*) FILTER (WHERE cos_i>1e-1) AS lit,
    count(*) FILTER (WHERE (cos_i<=0 AND cos_i>1e-1)) AS overlap,
    count(*) - count(*) FILTER (WHERE cos_i IS NOT NULL) AS union_difference FROM px WHERE base GROUP BY a""")
def illumination_partition(s, d):
    x = C("cos_i")
    sh, nz, lt = x <= 0, (x > 0) & (x <= 0.1), x > 0.1
    return views.px(s, d).where("base").groupBy("a").agg(
        F.count_if(sh).alias("shadow"), F.count_if(nz).alias("near_zero"), F.count_if(lt).alias("lit"),
        F.count_if((sh & nz) | (sh & lt) | (nz & lt)).alias("overlap"),
        F.count_if(~F.coalesce(sh | nz | lt, F.lit(False))).alias("union_difference"))


@query("flt11_five_strata", f"SELECT a, {STRATUM} AS stratum, count(*) AS n FROM px WHERE land GROUP BY 1, 2")
def five_strata(s, d):
    return views.px(s, d).where("land").groupBy("a", masks.stratum(C("cos_i")).alias("stratum")).agg(
        F.count("*").alias("n"))


@query("flt12_visibility_mask", "SELECT a, r, c, (CASE WHEN tvalid THEN (cos_i>1e-1)::INT ELSE 255 END)::INT AS mconf FROM px")
def visibility_mask(s, d):
    return views.px(s, d).select("a", "r", "c", masks.coded_mask(C("lit"), C("tvalid")).cast("int").alias("mconf"))


@query("flt13_scope_mask", f"""SELECT a, scope, count(*) AS n FROM (SELECT a, unnest(['unit_all_scored', {STRATUM}]) AS scope
    FROM px WHERE land AND lit) GROUP BY 1, 2""")
def scope_mask(s, d):
    p = views.px(s, d).where("land AND lit")
    return p.select("a", F.explode(F.array(F.lit("unit_all_scored"), masks.stratum(C("cos_i")))).alias("scope")).groupBy(
        "a", "scope").agg(F.count("*").alias("n"))


@query("flt15_range_gate", f"""SELECT a, below, above, n, {R('(below+above)::DOUBLE/n')} AS outside_share,
    (below+above)::DOUBLE/n<=5e-2 AS passes FROM (SELECT a, count(*) AS n, count(*) FILTER (WHERE rho4 < -5e-2) AS below,
    count(*) FILTER (WHERE rho4 > 1e0) AS above FROM px0 WHERE v4=1 GROUP BY a)""")
def range_gate(s, d):
    o = views.obs(s, d).where("v4 = 1").withColumn("rho4", pixel.reflectance(C("dn4")))
    g = o.groupBy("a").agg(F.count_if(C("rho4") < masks.RHO_MIN).alias("below"),
                           F.count_if(C("rho4") > masks.RHO_MAX).alias("above"), F.count("*").alias("n"))
    share = ratio(C("below") + C("above"), C("n"))
    return g.select("a", "below", "above", "n", *rounded(outside_share=share), (share <= 0.05).alias("passes"))


@query("flt16_layer_gates", """SELECT smin>=-1e-6 AND smax<=90+1e-6 AS slope_range_ok, amin>=-1e-6 AND amax<=360+1e-6 AS aspect_range_ok,
    nmin>=-1 AND nmax<=1 AS ndvi_range_ok, hstd>5 AS hillshade_has_relief, n_terrain FROM
    (SELECT min(slope) smin, max(slope) smax, min(aspect) amin, max(aspect) amax, stddev_pop(hillshade) hstd,
       count(slope) AS n_terrain FROM terrain),
    (SELECT min(v) nmin, max(v) nmax FROM (SELECT (rho5-rho4)/(rho5+rho4) AS v FROM px0 WHERE abs(rho5+rho4)>5e-2))""")
def layer_gates(s, d):
    t = views.terrain(s, d).agg(
        F.min("slope").alias("smin"), F.max("slope").alias("smax"), F.min("aspect").alias("amin"),
        F.max("aspect").alias("amax"), F.stddev_pop("hillshade").alias("hstd"), F.count("slope").alias("n_terrain"))
    red, nir = pixel.reflectance(C("dn4")), pixel.reflectance(C("dn5"))
    v = F.when(F.abs(nir + red) > 0.05, (nir - red) / (nir + red))  # before values out of range are dropped, or the gate could not fail
    n = views.obs(s, d).agg(F.min(v).alias("nmin"), F.max(v).alias("nmax"))
    return t.crossJoin(F.broadcast(n)).select(
        ((C("smin") >= -1e-6) & (C("smax") <= 90 + 1e-6)).alias("slope_range_ok"),
        ((C("amin") >= -1e-6) & (C("amax") <= 360 + 1e-6)).alias("aspect_range_ok"),
        ((C("nmin") >= -1) & (C("nmax") <= 1)).alias("ndvi_range_ok"),
        (C("hstd") > 5).alias("hillshade_has_relief"), "n_terrain")
