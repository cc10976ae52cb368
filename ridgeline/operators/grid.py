"""Grid operators: halo tiles, gradients, terrain, sampling, prefix sums, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays, geometry as geo
from ..functions.masks import all_present
from ..functions.numeric import clip

TILE = 128  # cells per tile edge; a 2-cell halo then copies 6 % more rows


def extent(cells: DataFrame) -> DataFrame:
    """One row with the last row and column index of a grid that starts at (0, 0)."""
    return cells.agg(F.max("r").alias("_rmax"), F.max("c").alias("_cmax"))


def universe(cells: DataFrame) -> DataFrame:
    """All (r, c) up to the last row and column; rows are generated in the tasks."""
    last = cells.agg(F.max("r"), F.max("c")).first()
    h, w = (0, 1) if last[0] is None else (last[0] + 1, last[1] + 1)
    return cells.sparkSession.range(h * w).select(F.expr(f"id div {w}").alias("r"), (F.col("id") % w).alias("c"))


def dense(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row for every cell of the grid; 0/1 columns ``names`` are 0 where a cell is absent or null."""
    full = universe(cells).join(cells.select("r", "c", *names), ["r", "c"], "left")
    return full.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def halo_copies(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """Copy each cell to every tile whose halo covers it (adds ``_tr``, ``_tc``)."""
    def span(x: str) -> Column:
        low = F.greatest(F.floor((F.col(x) - halo) / tile), F.lit(0))
        return F.explode(F.sequence(low, F.floor((F.col(x) + halo) / tile)))
    return cells.withColumn("_tr", span("r")).withColumn("_tc", span("c"))


def halo_tiles(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """``halo_copies``, dealt by tile."""
    return halo_copies(cells, tile, halo).repartition("_tr", "_tc")


def owned(tile: int) -> Column:
    """True for the cells a tile owns, false for its halo copies."""
    return (F.floor(F.col("r") / tile) == F.col("_tr")) & (F.floor(F.col("c") / tile) == F.col("_tc"))


def _gradient(value: str, axis: str, last: str, res: float) -> Column:
    """Central difference inside, one-sided on the grid border, null next to a gap.

    Both windows cluster on the tile, so the one shuffle by tile serves them.
    """
    line, other = (axis, "c" if axis == "r" else "r")
    w = W.partitionBy("_tr", "_tc", other).orderBy(line)
    v, x = F.col(value), F.col(line)
    before = F.when(F.lag(x).over(w) == x - 1, F.lag(v).over(w))
    after = F.when(F.lead(x).over(w) == x + 1, F.lead(v).over(w))
    return (F.when(x == 0, (after - v) / res)
            .when(x == F.col(last), (v - before) / res)
            .otherwise((after - before) / (2 * res)))


def terrain(dem: DataFrame, res: float, tile: int = TILE, sun_az: float = 315.0, sun_el: float = 45.0) -> DataFrame:
    """Gradient, slope, aspect, curvature and hillshade of ``dem(r, c, z)``; null outside support."""
    t = halo_tiles(dem.select("r", "c", "z").crossJoin(F.broadcast(extent(dem))), tile, 2)
    t = t.withColumns({"dz_dr": _gradient("z", "r", "_rmax", res), "dz_dc": _gradient("z", "c", "_cmax", res)})
    t = t.withColumns({"_d2r": _gradient("dz_dr", "r", "_rmax", res), "_d2c": _gradient("dz_dc", "c", "_cmax", res)})
    t = t.where(owned(tile))
    slope_rad = F.atan(F.sqrt(F.col("dz_dc") * F.col("dz_dc") + F.col("dz_dr") * F.col("dz_dr")))
    slope = F.degrees(slope_rad)
    # rows run south, so the downslope azimuth uses +dz_dr for north
    azimuth = F.pmod(F.degrees(F.atan2(-F.col("dz_dc"), F.col("dz_dr"))) + 360, F.lit(360.0))
    t = t.withColumn("_s", slope).withColumn("_a", F.when(slope < 1e-8, 0.0).otherwise(azimuth))
    alt = F.radians(F.lit(sun_el))
    shade = (F.sin(alt) * F.cos(F.radians("_s"))
             + F.cos(alt) * F.sin(F.radians("_s")) * F.cos(F.radians(F.lit(90.0 - sun_az)) - F.radians(90 - F.col("_a")))) * 255
    t = t.withColumns({"_k": F.col("_d2c") + F.col("_d2r"), "_h": clip(shade, 0.0, 255.0)})
    ok = all_present(F.col("z"), F.col("_s"), F.col("_a"), F.col("_k"))
    return t.select(
        "r", "c", "z", "dz_dr", "dz_dc",
        *[F.when(ok, F.col(s)).alias(n) for s, n in
          (("_s", "slope"), ("_a", "aspect"), ("_k", "curvature"), ("_h", "hillshade"))],
        ok.alias("terrain_valid"))


def cell_join(left: DataFrame, *layers: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join of layers on one grid."""
    for layer in layers:
        left = left.join(layer, ["r", "c"], how)
    return left


def bilinear(points: DataFrame, dem: DataFrame, value: str, fr: str, fc: str, key: list[str]) -> DataFrame:
    """Bilinear value at fractional (row, col) of each point, indices clamped to the grid.

    A corner whose cell is empty drops out and the remaining weights are
    rescaled; a point with no cell left is null. One equi-join in long form.
    """
    p = points.crossJoin(F.broadcast(extent(dem)))
    y = F.least(F.greatest(F.col(fr).cast("double"), F.lit(0.0)), F.col("_rmax").cast("double"))
    x = F.least(F.greatest(F.col(fc).cast("double"), F.lit(0.0)), F.col("_cmax").cast("double"))
    p = p.withColumns({"_y": y, "_x": x})
    p = p.withColumns({"_r0": F.floor("_y"), "_c0": F.floor("_x")})
    p = p.withColumns({"_wr": F.col("_y") - F.col("_r0"), "_wc": F.col("_x") - F.col("_c0")})

    def corner(dr: int, dc: int) -> Column:
        wr = F.col("_wr") if dr else 1 - F.col("_wr")
        wc = F.col("_wc") if dc else 1 - F.col("_wc")
        return F.struct(F.least(F.col("_r0") + dr, F.col("_rmax")).alias("r"),
                        F.least(F.col("_c0") + dc, F.col("_cmax")).alias("c"), (wr * wc).alias("w"))

    corners = F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))
    long = p.select(*key, F.explode(F.filter(corners, lambda s: s["w"] > 0)).alias("k")).select(
        *key, F.col("k.r").alias("r"), F.col("k.c").alias("c"), F.col("k.w").alias("_w"))
    hit = long.join(dem.select("r", "c", F.col(value).alias("_v")), ["r", "c"], "left")
    weight = F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))
    return hit.groupBy(*key).agg((F.sum(F.col("_v") * F.col("_w")) / weight).alias(value))


def nearest(points: DataFrame, dem: DataFrame, value: str, fr: str, fc: str, key: list[str]) -> DataFrame:
    """Value of the nearest cell (half away from zero), null outside the grid."""
    p = points.select(*key, F.round(fr).cast("long").alias("r"), F.round(fc).cast("long").alias("c"))
    return p.join(dem.select("r", "c", value), ["r", "c"], "left").select(*key, value)


def align(target: DataFrame, source: DataFrame, value: str, source_grid: tuple, target_grid: tuple,
          valid: Column | None = None) -> DataFrame:
    """Sample a source band at target cell centres (same CRS), masked before and after.

    A grid is (left, top, res). Only target cells whose centre lies inside the
    source extent get a value.
    """
    sl, st, sres = source_grid
    tl, tt, tres = target_grid
    x, y = geo.cell_centre(F.col("r"), F.col("c"), tl, tt, tres)
    pts = target.select(F.col("r").alias("tr"), F.col("c").alias("tc"),
                        ((F.lit(st) - y) / sres - 0.5).alias("fr"), ((x - sl) / sres - 0.5).alias("fc"))
    inside = pts.crossJoin(F.broadcast(extent(source))).where(
        (F.col("fr") >= -0.5) & (F.col("fr") <= F.col("_rmax") + 0.5)
        & (F.col("fc") >= -0.5) & (F.col("fc") <= F.col("_cmax") + 0.5)).drop("_rmax", "_cmax")
    src = source if valid is None else source.withColumn(value, F.when(valid, F.col(value)))
    return bilinear(inside, src, value, "fr", "fc", ["tr", "tc"]).select(
        F.col("tr").alias("r"), F.col("tc").alias("c"), value)


def row_prefix(mask: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Running mask count along each row (a row is bounded by the grid width)."""
    w = W.partitionBy(*(keys or []), "r").orderBy("c").rowsBetween(W.unboundedPreceding, 0)
    return mask.withColumn("row_sum", F.sum("m").over(w))


def integral_image(mask: DataFrame, band: int = 64) -> DataFrame:
    """2-D prefix sums of ``mask(r, c, m)`` for every cell of the grid; absent cells count 0.

    Row sums first; then down each column inside a band of rows, plus the
    totals of the bands above. No column is ever sorted as a whole.
    """
    rows = row_prefix(dense(mask, ["m"])).withColumn("_band", F.floor(F.col("r") / band))
    inside = W.partitionBy("_band", "c").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy("c").orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    run = rows.withColumn("_in", F.sum("row_sum").over(inside))
    offset = (rows.groupBy("_band", "c").agg(F.sum("row_sum").alias("_t"))
              .select("_band", "c", F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_off")))
    return run.join(offset, ["_band", "c"]).select(
        "r", "c", "m", "row_sum", (F.col("_in") + F.col("_off")).alias("integral"))


def last_next(mask: DataFrame) -> DataFrame:
    """Column of the last set cell at or before, and of the next at or after, each cell."""
    w = W.partitionBy("r").orderBy("c")
    hit = F.when(F.col("m") == 1, F.col("c"))
    back = w.rowsBetween(W.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    return mask.withColumns({"last_set": F.last(hit, ignorenulls=True).over(back),
                             "next_set": F.first(hit, ignorenulls=True).over(ahead)})


def grid_failures(cand: dict[str, Column], want: dict[str, Column], tol: float = 0.0) -> Column:
    """Names of the header parts that differ: crs, shape, transform, bounds, resolution."""
    def close(name: str) -> Column:
        if tol == 0.0:
            return cand[name] == want[name]
        return F.forall(F.zip_with(cand[name], want[name], lambda a, b: F.abs(a - b) <= tol), lambda ok: ok)
    checks = {"crs": cand["crs"] == want["crs"], "shape": cand["shape"] == want["shape"]}
    checks.update({n: close(n) for n in ("transform", "bounds", "resolution") if n in cand})
    return arrays.failed_names(checks)
