"""Sky-view factor by horizon search, on halo tiles or as a join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays, pixel
from . import grid

SAMPLES = 1_000_000  # rows of sight lines a task


def sky_view(dem: DataFrame, value: str, res: float, n_az: int, distance: float,
             curvature: bool = False, tile: int = 256, half_cell: bool = False) -> DataFrame:
    """v_sky per cell: mean over azimuths of cos^2 of the highest horizon within ``distance``.

    A group is one tile with its halo, so its size is set by ``tile`` and
    ``distance`` and not by the data. An empty cell on a line of sight makes
    the value null. With ``half_cell`` cell (r, c) is read at index
    (r + 0.5, c + 0.5), the convention of codes that skip the centre shift.
    """
    steps = np.asarray(arrays.growing_distances(distance, res))
    drop = steps ** 2 / (2 * pixel.EARTH_RADIUS_M) if curvature else np.zeros_like(steps)
    halo = int(math.ceil(distance / res)) + 2
    shift = 0.5 if half_cell else 0.0

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["_tr"].iloc[0]), int(pdf["_tc"].iloc[0])
        rmax, cmax = int(pdf["_rmax"].iloc[0]), int(pdf["_cmax"].iloc[0])
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r_low, c_low = int(r.min()), int(c.min())
        z = np.full((int(r.max()) - r_low + 1, int(c.max()) - c_low + 1), np.nan)
        z[r - r_low, c - c_low] = pdf[value].to_numpy(dtype="float64")
        mine = (r // tile == tr) & (c // tile == tc)
        pr, pc = r[mine].astype("float64") + shift, c[mine].astype("float64") + shift

        def sample(y, x):
            y, x = np.clip(y, 0, rmax), np.clip(x, 0, cmax)
            y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
            wy, wx = y - y0, x - x0
            total = np.zeros(y.shape)
            for dy, dx, w in ((0, 0, (1 - wy) * (1 - wx)), (1, 0, wy * (1 - wx)), (0, 1, (1 - wy) * wx), (1, 1, wy * wx)):
                yy, xx = np.minimum(y0 + dy, rmax) - r_low, np.minimum(x0 + dx, cmax) - c_low
                total += np.where(w > 0, w * z[np.minimum(yy, z.shape[0] - 1), np.minimum(xx, z.shape[1] - 1)], 0.0)
            return total

        own = sample(pr, pc)
        sky = np.zeros(own.shape)
        for az in np.arange(n_az) * (2 * np.pi / n_az):
            horizon = np.zeros(own.shape)
            for dist, low in zip(steps, drop):
                tangent = (sample(pr - dist * np.cos(az) / res, pc + dist * np.sin(az) / res) - own - low) / dist
                horizon = np.maximum(horizon, tangent)  # keeps NaN
            sky += 1.0 / (1.0 + horizon ** 2)
        return pd.DataFrame({"r": r[mine], "c": c[mine], "v_sky": sky / n_az})

    cells = dem.select("r", "c", value).crossJoin(F.broadcast(grid.extent(dem)))
    tiles = grid.halo_tiles(cells, tile, halo)
    out = tiles.groupBy("_tr", "_tc").applyInPandas(search, "r long, c long, v_sky double")
    return out.withColumn("v_sky", F.when(~F.isnan("v_sky"), F.col("v_sky")))


def tile_edge(dem: DataFrame, most: int = 256, least: int = 16) -> int:
    """``most``, or less where a grid is too small to give every core a tile."""
    last = grid.extent(dem).first()
    h, w = (0, 0) if last[0] is None else (last[0] + 1, last[1] + 1)
    edge = most
    while edge > least and math.ceil(h / edge) * math.ceil(w / edge) < dem.sparkSession.sparkContext.defaultParallelism:
        edge //= 2
    return edge


def far_sky_view(dem: DataFrame, value: str, res: float, n_az: int, distance: float, curvature: bool = True, tile: int | None = None) -> DataFrame:
    """v_sky per cell for search distances of many kilometres; ``far_sky_views`` of one setting."""
    return far_sky_views(dem, value, res, [n_az], [distance], curvature, tile).select("r", "c", F.col(setting_name(n_az, distance)).alias("v_sky"))


def setting_name(n_az: int, distance: float) -> str:
    return f"v_{n_az}_{distance:g}".replace(".", "_").replace("+", "")


def far_sky_views(dem: DataFrame, value: str, res: float, counts: list[int], distances: list[float], curvature: bool = True, tile: int | None = None) -> DataFrame:
    """v_sky per cell for all azimuth counts (divisors of the last) and rising search distances, on a pyramid of the surface.

    One search serves all settings: the sight lines of a smaller count are among those of the largest, and a nearer
    distance is a stage on the way. All cells of a tile look the same way at once, so a sample is an interpolation by rows
    and then by columns. Sight lines step by 1, 2 and 4 cells past 1 and 5 km, so far samples are read from means over 2 x 2 and 4 x 4
    cells (a plane is read exactly). A tile takes a halo of its own level for each band of distance: some 36 cells,
    then 5 km of cells twice as wide, then the rest of cells four times as wide. So a group holds a few
    hundred thousand rows at 20 km, where a halo of full cells would hold over a million. An empty cell near the
    line, or a coarse cell without any value, makes the value null. ``tile`` (a multiple of 4) does not change the result.
    """
    tile, most = tile or tile_edge(dem), counts[-1]
    steps = np.asarray(arrays.growing_distances(distances[-1], res))
    width = np.rint(np.diff(np.concatenate(([0.0], steps))) / res).astype(int)
    drop = steps ** 2 / (2 * pixel.EARTH_RADIUS_M) if curvature else np.zeros_like(steps)
    halo = {f: int(math.ceil(steps[width == f].max() / (res * f))) + 2 for f in sorted(set(width.tolist()))}
    names = [setting_name(n, x) for x in distances for n in counts]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc, rmax, cmax = (int(pdf[x].iloc[0]) for x in ("_tr", "_tc", "_rmax", "_cmax"))
        levels, own_r = {}, None
        for f, part in pdf.groupby("_f"):
            f, r, c = int(f), part["r"].to_numpy(), part["c"].to_numpy()
            edge, last = tile // f, (rmax // f, cmax // f)
            low = [max(t * edge - halo[f], 0) for t in (tr, tc)]
            z = np.full([min((t + 1) * edge - 1 + halo[f], top) - at + 1 for t, top, at in zip((tr, tc), last, low)], np.nan)
            z[r - low[0], c - low[1]] = part[value].to_numpy(dtype="float64")
            levels[f] = z, low, last
            if f == 1:
                mine = (r // tile == tr) & (c // tile == tc)
                own_r, own_c = r[mine], c[mine]
        if own_r is None or not len(own_r):
            return pd.DataFrame({x: [] for x in ("r", "c", *names)})

        def axis(f, at, top, low, last):
            """Lower and upper index and weight of the upper one along an axis; without weight both are the lower."""
            x = np.clip((np.clip(at, 0, top) - (f - 1) / 2) / f, 0, last)
            i = np.floor(x).astype(int)
            w = x - i
            return i - low, np.where(w > 0, np.minimum(i + 1, last), i) - low, w

        def sample(f, y, x):
            z, low, last = levels[f]
            i0, i1, wy = axis(f, y, rmax, low[0], last[0])
            j0, j1, wx = axis(f, x, cmax, low[1], last[1])
            left = j0.min()
            z = z[:, left:j1.max() + 1]
            rows = z[i0] * (1 - wy)[:, None] + z[i1] * wy[:, None]
            return rows[:, j0 - left] * (1 - wx) + rows[:, j1 - left] * wx

        pr, pc = (np.arange(x.min(), x.max() + 1).astype("float64") for x in (own_r, own_c))
        own, sky = sample(1, pr, pc), {x: np.zeros((len(pr), len(pc))) for x in names}
        for k, az in enumerate(np.arange(most) * (2 * np.pi / most)):
            use = [n for n in counts if k % (most // n) == 0]
            if not use:
                continue
            horizon, at = np.zeros(own.shape), 0
            for limit in distances:
                while at < len(steps) and steps[at] <= limit:
                    seen = sample(int(width[at]), pr - steps[at] * np.cos(az) / res, pc + steps[at] * np.sin(az) / res)
                    horizon = np.maximum(horizon, (seen - own - drop[at]) / steps[at])  # keeps NaN
                    at += 1
                part = 1.0 / (1.0 + horizon ** 2)
                for n in use:
                    sky[setting_name(n, limit)] += part
        place = own_r - own_r.min(), own_c - own_c.min()
        return pd.DataFrame({"r": own_r, "c": own_c, **{setting_name(n, x): sky[setting_name(n, x)][place] / n for x in distances for n in counts}})

    rows = None
    for f, reach in halo.items():
        cells = dem.select("r", "c", value)
        if f > 1:
            cells = cells.groupBy(F.floor(F.col("r") / f).alias("r"), F.floor(F.col("c") / f).alias("c")).agg(F.avg(value).alias(value))
        part = grid.halo_copies(cells, tile // f, reach).withColumn("_f", F.lit(f))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.crossJoin(F.broadcast(grid.extent(dem)))
    out = rows.groupBy("_tr", "_tc").applyInPandas(search, "r long, c long, " + ", ".join(f"{x} double" for x in names))
    return out.select("r", "c", *[F.when(~F.isnan(x), F.col(x)).alias(x) for x in names])


def sky_view_join(points: DataFrame, dem: DataFrame, value: str, res: float, n_az: int, distance: float,
                  curvature: bool = False) -> DataFrame:
    """The same for a list of points ``(pid, r, c)``: sight lines as rows, sampled by one join.

    Every cell is given its three neighbours to the south and east beforehand, so that a sample meets one row and
    needs no grouping; a corner without a value drops out and the other weights are rescaled. All samples of a point
    then meet in one exchange. The number of parts follows the number of samples, so a task holds about a million at any size.
    """
    dists = arrays.growing_distances(distance, res)
    n = points.count() * n_az * len(dists)
    parts = max(dem.sparkSession.sparkContext.defaultParallelism, -(-n // SAMPLES))
    corners = [(0, 0), (1, 0), (0, 1), (1, 1)]
    cells = dem.select("r", "c", F.col(value).alias("_v"))
    to = F.explode(F.array(*[F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c"), F.lit(k).alias("k")) for k, (i, j) in enumerate(corners)]))
    quad = cells.select("_v", to.alias("_t")).groupBy("_t.r", "_t.c").agg(*[F.max(F.when(F.col("_t.k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(4)])
    lines = points.withColumn("az", F.explode(arrays.azimuths(n_az))).withColumn("dist", F.explode(F.array(*[F.lit(x) for x in dists])))
    lines = lines.crossJoin(F.broadcast(grid.extent(dem)))
    lines = lines.withColumns({"_y": F.col("r") - F.col("dist") * F.cos("az") / res, "_x": F.col("c") + F.col("dist") * F.sin("az") / res})
    lines = lines.withColumns({a: F.least(F.greatest(F.col(a).cast("double"), F.lit(0.0)), F.col(b).cast("double")) for a, b in (("_y", "_rmax"), ("_x", "_cmax"))})
    at = lines.select("pid", "az", "dist", F.floor("_y").alias("r"), F.floor("_x").alias("c"), (F.col("_y") - F.floor("_y")).alias("_wr"), (F.col("_x") - F.floor("_x")).alias("_wc"))
    hit = at.repartition(parts, "r", "c").join(quad.repartition(parts, "r", "c").hint("merge"), ["r", "c"], "left")
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, (i, j) in enumerate(corners):
        w = (F.col("_wr") if i else 1 - F.col("_wr")) * (F.col("_wc") if j else 1 - F.col("_wc"))
        there = F.col(f"_v{k}").isNotNull() & (w > 0)
        total, weight = total + F.when(there, w * F.col(f"_v{k}")).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    z = hit.select("pid", "az", "dist", F.when(weight > 0, total / weight).alias("_z"))
    own = points.join(cells.withColumnRenamed("_v", "_z0"), ["r", "c"]).select("pid", "_z0")
    drop = pixel.curvature_drop(F.col("dist")) if curvature else F.lit(0.0)
    tangent = (F.col("_z") - F.col("_z0") - drop) / F.col("dist")
    seen = z.repartition(parts, "pid").join(own.repartition(parts, "pid").hint("merge"), "pid")
    horizon = seen.groupBy("pid", "az").agg(F.when(F.count(tangent) == F.count("*"), F.greatest(F.max(tangent), F.lit(0.0))).alias("t"))
    return horizon.groupBy("pid").agg(
        F.when(F.count("t") == F.count("*"), F.avg(1 / (1 + F.col("t") * F.col("t")))).alias("v_sky"))
