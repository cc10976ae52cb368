"""Closed-form cases of the column functions and of terrain."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import arrays, geometry as geo, identity, masks, pixel
from ridgeline.operators import grid


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def cells(spark, z):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "r long, c long, z double")


def test_strata_edges(spark):
    x = [-1.0, 0.0, 0.1, 0.10001, 0.4, 0.40001, 0.7, 0.70001, 1.0]
    df = spark.createDataFrame([(v,) for v in x], "x double").select(masks.stratum(F.col("x")).alias("s"))
    n = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert [n[s] for s in masks.STRATA] == [2, 1, 2, 2, 2]


def test_stratum_outside_stops(spark):
    with pytest.raises(Exception, match="outside"):
        one(spark, masks.stratum(F.lit(1.5)).alias("s"))


def test_responses(spark):
    r = one(spark, pixel.soft_response(0.3, F.lit(-50.0)).alias("dark"), pixel.soft_response(0.3, F.lit(100.0)).alias("bright"),
            pixel.support_weight(F.lit(0.1)).alias("half"), pixel.support_weight(F.lit(1e9)).alias("one"),
            pixel.corrected(F.lit(0.15), F.lit(0.5)).alias("back"), pixel.ndvi(F.lit(0.1), F.lit(-0.1)).alias("guard"))
    assert r["dark"] == pytest.approx(0, abs=1e-12) and r["bright"] == pytest.approx(30)
    assert r["half"] == 0.5 and r["one"] == 1.0 and r["back"] == pytest.approx(0.3) and r["guard"] is None


def test_null_has_no_weight(spark):
    r = one(spark, pixel.support_weight(F.lit(None).cast("double")).alias("w"), pixel.direct_factor(F.lit(None).cast("double")).alias("m"))
    assert r["w"] is None and r["m"] is None


def test_geometry(spark):
    f = [F.lit(float(v)) for v in (0, 0, 2, 2)]
    g = [F.lit(float(v)) for v in (5, 6, 7, 8)]
    r = one(spark, geo.rect_gap(f, g).alias("gap"), geo.half_open_overlap(f, [F.lit(2.0), F.lit(0.0), F.lit(3.0), F.lit(1.0)]).alias("touch"),
            geo.rect_distance(F.lit(1.0), F.lit(1.0), *[float(v) for v in (0, 0, 2, 2)]).alias("inside"),
            geo.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("half"),
            geo.utm_epsg(F.lit(104.0), F.lit(31.0)).alias("zone"), pixel.circular_error(F.lit(359.0), F.lit(1.0)).alias("err"))
    assert r["gap"] == 5.0 and r["touch"] is False and r["inside"] == 0.0 and r["zone"] == 32648 and r["err"] == 2
    assert r["half"] == pytest.approx(math.pi * 6371.0088)


def test_distances_grow():
    d = arrays.growing_distances(6000, 30)
    steps = np.diff([0, *d])
    assert d[0] == 30 and set(steps) == {30, 60, 120} and max(d) <= 6000
    assert all(s == 30 for s, x in zip(steps, [0, *d]) if x <= 1000)


def test_digest_ignores_order_and_sees_change(spark):
    a = spark.range(100).select(F.col("id").cast("string").alias("t"))
    b = a.orderBy(F.desc("t")).repartition(7)
    dig = lambda df: df.agg(identity.set_digest(F.col("t")).alias("d")).first()["d"]
    assert dig(a) == dig(b) != dig(a.where("t <> '5'"))


@pytest.mark.parametrize("sx,sy,aspect", [(0, 0, 0.0), (1, 0, 270.0), (-1, 0, 90.0), (0, 1, 180.0), (0, -1, 0.0)])
def test_planes(spark, sx, sy, aspect):
    """Slope 10 degrees, facing down; sy is the rise to the north, rows run south."""
    k = math.tan(math.radians(10)) * 30
    r, c = np.mgrid[0:9, 0:9]
    t = grid.terrain(cells(spark, 100 + k * (sx * c - sy * r)), 30.0).collect()
    want = 10.0 if sx or sy else 0.0
    assert all(x["terrain_valid"] for x in t)
    assert max(abs(x["slope"] - want) for x in t) < 1e-6
    assert max(abs((x["aspect"] - aspect + 180) % 360 - 180) for x in t) < 1e-6


def test_terrain_matches_numpy_for_any_tile(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 50, (23, 31))
    z[5, 7] = z[0, 3] = z[22, 30] = np.nan
    gr, gc = np.gradient(z, 30.0, 30.0)
    k = np.gradient(gc, 30.0, axis=1) + np.gradient(gr, 30.0, axis=0)
    slope = np.degrees(np.arctan(np.hypot(gr, gc)))
    ok = np.isfinite(z) & np.isfinite(slope) & np.isfinite(k)
    for tile in (4, 7, 128):
        got = grid.terrain(cells(spark, z), 30.0, tile=tile).collect()
        assert len(got) == z.size
        for x in got:
            i = x["r"], x["c"]
            assert x["terrain_valid"] == ok[i]
            if ok[i]:
                assert x["slope"] == pytest.approx(slope[i], abs=1e-9) and x["curvature"] == pytest.approx(k[i], abs=1e-12)
            else:
                assert x["slope"] is None


def test_bilinear_drops_empty_cells(spark):
    dem = cells(spark, np.array([[0.0, 10.0], [20.0, np.nan]]))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 1.0), (3, -4.0, 0.25), (4, 1.0, 1.0)], "p int, fr double, fc double")
    v = {x["p"]: x["z"] for x in grid.bilinear(pts, dem, "z", "fr", "fc", ["p"]).collect()}
    assert v[1] == pytest.approx(10.0) and v[2] == 10.0 and v[3] == 2.5 and v[4] is None


def test_integral_image(spark):
    rng = np.random.default_rng(5)
    m = (rng.uniform(size=(37, 11)) < 0.4).astype(int)
    df = cells(spark, m.astype(float)).select("r", "c", F.col("z").cast("int").alias("m"))
    want = m.cumsum(0).cumsum(1)
    for band in (4, 64):
        got = {(x["r"], x["c"]): x["integral"] for x in grid.integral_image(df, band).collect()}
        assert all(got[i] == want[i] for i in np.ndindex(*m.shape))
