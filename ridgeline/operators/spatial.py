"""Spatial statistics: exact sums over pairs by lag, components of a mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..sources import io


def bound_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand Python at most ``rows`` pairs of tiles at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def hash_number(*parts) -> Column:
    """A 60-bit number from md5 of the parts; the same in any engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sample_points(points: DataFrame, keys: list[str], size: int, seed: str) -> DataFrame:
    """At most ``size`` points per key in hash order, numbered from 0 (``i``), with the sample size ``n``.

    The first ``size`` of a key are among the first ``size`` of each of 64
    salted parts, so a key with very many points is never sorted in one task.
    """
    h = points.withColumn("_h", hash_number(seed, F.col("r"), F.col("c"))).withColumn("_salt", F.pmod(F.xxhash64("r", "c"), F.lit(64)))
    part = W.partitionBy(*keys, "_salt").orderBy("_h", "r", "c")
    few = h.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= size)
    s = few.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("_h", "r", "c"))).where(F.col("_rn") <= size)
    return s.select(*keys, "r", "c", "v", (F.col("_rn") - 1).alias("i"), F.count("*").over(W.partitionBy(*keys)).alias("n"))


def sample_pairs(sample: DataFrame, keys: list[str], pairs: int, seed: str) -> DataFrame:
    """``pairs`` drawn index pairs per key with replacement; distance in cells and half squared difference."""
    heads = sample.where("i = 0").select(*keys, "n")
    draws = heads.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    draws = draws.withColumns({"i1": hash_number(seed, "L", F.col("p")) % F.col("n"), "i2": hash_number(seed, "R", F.col("p")) % F.col("n")})
    def side(s: str) -> DataFrame:
        return sample.select(*keys, F.col("i").cast("long").alias(f"i{s}"), *[F.col(x).alias(f"{x}{s}") for x in ("r", "c", "v")])
    j = draws.where("i1 <> i2").join(side("1"), [*keys, "i1"]).join(side("2"), [*keys, "i2"])
    d = F.col("v1") - F.col("v2")
    return j.select(*keys, "p", F.hypot(F.col("r1") - F.col("r2"), F.col("c1") - F.col("c2")).alias("dist"), (d * d * 0.5).alias("half_sq"))


def dense_tiles(points: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """One row a key and tile: its values ``v`` as doubles (bytes) over the box ``_r``, ``_c``, ``_w`` (width) of its cells; absent cells are NaN.

    With count, sum and sum of squares (``n``, ``s``, ``q``). The group is one tile.
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, v = pdf["r"].to_numpy(), pdf["c"].to_numpy(), pdf["v"].to_numpy(dtype="float64")
        z = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        z[r - r.min(), c - c.min()] = v
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in [*keys, "_tr", "_tc"]}, "_z": [z.tobytes()], "_r": [r.min()], "_c": [c.min()], "_w": [z.shape[1]],
                             "n": [len(v)], "s": [v.sum()], "q": [(v * v).sum()]})
    rows = points.select(*keys, "r", "c", "v").where(F.col("v").isNotNull()).withColumns(
        {"_tr": F.floor(F.col("r") / tile).cast("long"), "_tc": F.floor(F.col("c") / tile).cast("long")})
    fields = [f for f in rows.schema.fields if f.name in (*keys, "_tr", "_tc")]
    longs, doubles = ([T.StructField(n, kind) for n in names] for names, kind in ((("_r", "_c", "_w", "n"), T.LongType()), (("s", "q"), T.DoubleType())))
    schema = T.StructType([*fields, T.StructField("_z", T.BinaryType()), *longs, *doubles])
    return rows.groupBy(*keys, "_tr", "_tc").applyInPandas(pack, schema)


BOX = ["_z", "_r", "_c", "_w"]


def pair_sums(a: dict, b: dict, edges: np.ndarray) -> list[dict]:
    """Pairs, distances and half squared differences by lag class between two tiles, over all offsets at once.

    Sums over all pairs of one offset are correlations of values and masks: products of transforms. Values are centred first.
    """
    x, y = (np.frombuffer(t["_z"], dtype="float64").reshape(-1, t["_w"]) for t in (a, b))
    mx, my = ~np.isnan(x), ~np.isnan(y)
    centre = (x[mx].sum() + y[my].sum()) / (mx.sum() + my.sum())
    fx, fy = np.where(mx, x - centre, 0.0), np.where(my, y - centre, 0.0)
    size = tuple(-(-(i + j) // 8) * 8 for i, j in zip(x.shape, y.shape))
    fx, fx2, fm = (np.conj(np.fft.rfft2(v, size)) for v in (fx, fx * fx, mx.astype(float)))
    gy, gy2, gm = (np.fft.rfft2(v, size) for v in (fy, fy * fy, my.astype(float)))
    pairs = np.rint(np.fft.irfft2(fm * gm, size))
    half = np.fft.irfft2((fx2 * gm + fm * gy2) / 2 - fx * gy, size)
    down, right = (np.where(np.arange(n) < j, np.arange(n), np.arange(n) - n) for n, j in zip(size, y.shape))
    dist = np.hypot(b["_r"] - a["_r"] + down[:, None], b["_c"] - a["_c"] + right[None, :])
    use = (pairs > 0) & (dist > 0) & (dist >= edges[0]) & (dist <= edges[-1])
    lag = np.searchsorted(edges[1:-1], dist[use], side="right")
    share = 0.5 if (a["_r"], a["_c"]) == (b["_r"], b["_c"]) else 1.0  # a tile meets itself from both sides
    n, d, g = (np.bincount(lag, weights=w[use] * share, minlength=len(edges) - 1) for w in (pairs, pairs * dist, half))
    return [{"lag": i, "pairs": int(round(n[i])), "dist": d[i], "half_sq": max(g[i], 0.0)} for i in range(len(n)) if n[i] > 0]


LAGS = T.ArrayType(T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("pairs", T.LongType()),
                                 T.StructField("dist", T.DoubleType()), T.StructField("half_sq", T.DoubleType())]))


def lag_sums(points: DataFrame, keys: list[str], edges: DataFrame, tile: int = 128) -> DataFrame:
    """Exact pair counts, sums of distances (in cells) and of half squared differences by lag class of all pairs of points of a key.

    ``points``: keys, r, c, v, one row a cell; ``edges``: keys, edges (rising array; classes are half open, the last closed;
    distance zero never counts). Nothing is drawn: a pair of tiles gives the sums of all its offsets
    in one task, and only tiles within the last edge meet. Work follows tile pairs, not cell pairs.
    """
    tiles = io.materialize(points.sparkSession, dense_tiles(points, keys, tile), "lag-tiles")
    near = tiles.join(edges, keys).withColumn("_m", F.ceil(F.element_at("edges", -1) / tile).cast("long") + 1)
    ways = F.expr("flatten(transform(sequence(0L, _m), i -> transform(sequence(IF(i = 0, 0L, -_m), _m), j -> struct(i AS i, j AS j))))")
    one = near.select(*keys, "edges", "_tr", "_tc", F.explode(ways).alias("_w"))
    one = one.where(F.hypot(F.greatest(F.abs("_w.i") - 1, F.lit(0)), F.greatest(F.abs("_w.j") - 1, F.lit(0))) * tile <= F.element_at("edges", -1))
    one = one.select(*keys, "edges", "_tr", "_tc", (F.col("_tr") + F.col("_w.i")).alias("_tr2"), (F.col("_tc") + F.col("_w.j")).alias("_tc2"))
    rows = met(one, tiles, keys).select(*keys, "x.*")
    return rows.groupBy(*keys, "lag").agg(F.sum("pairs").alias("pairs"), F.sum("dist").alias("dist"), F.sum("half_sq").alias("half_sq"))


def met(pairs: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """``pair_sums`` (``x``, one row a lag class) of the pairs of tiles (keys, _tr, _tc, _tr2, _tc2, edges)."""
    bound_batches(tiles.sparkSession)

    @F.pandas_udf(LAGS)
    def sums(a: pd.DataFrame, b: pd.DataFrame, edges: pd.Series) -> pd.Series:
        return pd.Series([pair_sums(x, y, np.asarray(e, dtype=float)) for x, y, e in zip(a.to_dict("records"), b.to_dict("records"), edges, strict=True)], dtype=object)
    box = F.struct(*BOX)
    there = tiles.select(*keys, F.col("_tr").alias("_tr2"), F.col("_tc").alias("_tc2"), box.alias("_b"))
    both = pairs.join(tiles.select(*keys, "_tr", "_tc", box.alias("_a")), [*keys, "_tr", "_tc"]).join(there, [*keys, "_tr2", "_tc2"])
    return both.withColumn("x", F.explode(sums("_a", "_b", "edges"))).drop("_a", "_b")


def pairs_within(points: DataFrame, keys: list[str], radii: DataFrame, tile: int = 128) -> DataFrame:
    """Exact pairs and sums of half squared differences of all pairs of points of a key nearer than ``radius``: keys, ring, pairs, half_sq.

    ``points``: keys, r, c, v (near zero on average), one row a cell; ``radii``: keys, ring, radius. Two tiles all of whose
    cells are nearer need their counts, sums and squares only, and these are taken from running sums down each column of
    tiles; tiles on the rim meet cell by cell. So a tile meets a few others, however many lie within the radius.
    """
    spark = points.sparkSession
    tiles = io.materialize(spark, dense_tiles(points, keys, tile), "lag-tiles")
    size = tiles.select(*keys, "_tr", "_tc", "n", "s", "q")
    columns = size.groupBy(*keys, "_tc").agg(F.min("_tr").alias("_lo"), F.max("_tr").alias("_hi"))
    down = W.partitionBy(*keys, "_tc").orderBy("_tr").rowsBetween(W.unboundedPreceding, 0)
    run = columns.select(*keys, "_tc", F.explode(F.sequence(F.col("_lo") - 1, F.col("_hi"))).alias("_tr")).join(size, [*keys, "_tc", "_tr"], "left")
    run = run.select(*keys, F.col("_tc").alias("_tc2"), "_tr", *[F.coalesce(F.sum(x).over(down), F.lit(0)).alias(x) for x in ("n", "s", "q")])
    run = io.materialize(spark, run, "lag-runs")
    R, right = F.col("radius"), F.col("_tc2") - F.col("_tc")
    apart, wide = F.greatest((right - 1) * tile + 1, F.lit(0)), (right + 1) * tile - 1
    j = size.join(radii, keys).join(columns.withColumnRenamed("_tc", "_tc2"), keys).where((right >= 0) & (apart < R))
    # tiles up to ``_in`` rows of tiles away lie within the radius whole, those up to ``_rim`` in part
    last = lambda x: F.sqrt(F.greatest(R * R - x * x, F.lit(0.0)))
    j = j.withColumns({"_in": F.greatest(F.floor((last(wide) - 1e-6 + 1) / tile) - 1, F.lit(-1)).cast("long"),
                       "_rim": F.greatest(F.floor((last(apart) - 1) / tile) + 1, F.lit(0)).cast("long")})
    j = io.materialize(spark, j, "lag-reach")
    upto = F.least(F.col("_tr") + F.col("_in"), F.col("_hi"))
    after = F.when(right == 0, F.col("_tr")).otherwise(F.greatest(F.col("_tr") - F.col("_in"), F.col("_lo")) - 1)
    whole = j.where("_in >= 0").withColumns({"_u": upto, "_f": after})
    side = lambda x: run.select(*keys, "_tc2", F.col("_tr").alias(f"_{x}"), *[F.col(y).alias(f"{y}_{x}") for y in ("n", "s", "q")])
    whole = whole.where("_u > _f").join(side("u"), [*keys, "_tc2", "_u"]).join(side("f"), [*keys, "_tc2", "_f"])
    n, s, q = (F.col(f"{x}_u") - F.col(f"{x}_f") for x in ("n", "s", "q"))
    inner = whole.select(*keys, "ring", (F.col("n") * n).alias("pairs"), ((F.col("n") * q + n * F.col("q")) / 2 - F.col("s") * s).alias("half_sq"))
    own = j.where((F.col("_in") >= 0) & (right == 0)).select(
        *keys, "ring", F.expr("n * (n - 1) div 2").alias("pairs"), ((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / 2).alias("half_sq"))
    ways = F.sequence(F.col("_in") + 1, F.col("_rim"))
    both = F.concat(ways, F.transform(F.filter(ways, lambda i: (i > 0) & (right > 0)), lambda i: -i))
    rim = j.select(*keys, "ring", "_tr", "_tc", "_tc2", "_lo", "_hi", F.array(F.lit(0.0), R, F.lit(float("inf"))).alias("edges"), F.explode(both).alias("_i"))
    rim = rim.withColumn("_tr2", F.col("_tr") + F.col("_i")).where("_tr2 BETWEEN _lo AND _hi").drop("_lo", "_hi", "_i")
    rim = met(rim, tiles, keys).where("x.lag = 0").select(*keys, "ring", "x.pairs", "x.half_sq")
    return inner.unionByName(own).unionByName(rim).groupBy(*keys, "ring").agg(F.sum("pairs").alias("pairs"), F.sum("half_sq").alias("half_sq"))


def variogram(points: DataFrame, shape: tuple[int, int], res: float, bins: int, fraction: float, min_pairs: int) -> DataFrame:
    """Lag bins of the semivariogram over all pairs of ``points(r, c, v)``, with the number of points (population).

    Lags reach ``fraction`` of the shorter side of the grid; bins without pairs give no row.
    """
    far = min(shape) * fraction
    p = points.withColumn("_k", F.lit(1))
    edges = p.sparkSession.range(1).select(F.lit(1).alias("_k"), F.array(*[F.lit(i * (far / bins)) for i in range(bins)], F.lit(far)).alias("edges"))
    g = lag_sums(p, ["_k"], edges).crossJoin(F.broadcast(points.where(F.col("v").isNotNull()).agg(F.count("*").alias("population"))))
    return g.select("lag", "pairs", (F.col("dist") / F.col("pairs") * res).alias("mean_lag"), (F.col("half_sq") / F.col("pairs")).alias("gamma"),
                    (F.col("pairs") >= min_pairs).alias("sufficient"), "population")


def variogram_range(bins_df: DataFrame, bins: int, tail: int, share: float = 0.95, tolerance: float = 0.2, min_bins: int = 6) -> DataFrame:
    """Tail sill, first stable lag at 95 % of it, and the reason when no range is reliable (at most ``bins`` rows)."""
    ks = bins_df.sparkSession.range(bins).select(F.col("id").cast("int").alias("lag"))
    g = ks.join(bins_df, "lag", "left").withColumn("sufficient", F.coalesce("sufficient", F.lit(False)))
    sill = g.agg(F.count_if("sufficient").alias("populated"), F.min(F.when(F.col("lag") >= bins - tail, F.col("sufficient"))).alias("tail_ok"),
                 F.median(F.when(F.col("lag") >= bins - tail, F.col("gamma"))).alias("sill"))
    after = W.orderBy(F.desc("lag")).rowsBetween(W.unboundedPreceding, 0)
    j = g.crossJoin(F.broadcast(sill))
    stable = F.col("sufficient") & (F.abs(F.col("gamma") - F.col("sill")) <= F.col("sill") * tolerance)
    j = j.withColumn("_stable", F.min(F.coalesce(stable, F.lit(False))).over(after))
    first = F.min(F.when(F.col("_stable") & (F.col("gamma") >= F.col("sill") * share), F.col("lag")))
    out = j.groupBy("populated", "tail_ok", "sill").agg(first.alias("range_lag"))
    return out.withColumn("reason", F.when(F.col("populated") < min_bins, "too_few_populated_bins").when(~F.col("tail_ok"), "tail_bins_insufficient")
                          .when(F.coalesce("sill", F.lit(0.0)) <= 0, "nonpositive_sill").when(F.col("range_lag").isNull(), "no_stable_range"))


def two_bin_check(res: DataFrame, keys: list[str], near: float, min_support: int = 200, min_pairs: int = 200) -> DataFrame:
    """Semivariance of all pairs of residuals in two lag bins past ``near`` cells against the variance, with inconclusive states.

    Gives support (residuals), extent (cells), pairs and semivariance of both bins, sill and status of every key.
    """
    pts = res.where(F.col("e").isNotNull()).select(*keys, "r", "c", F.col("e").alias("v"))
    box = pts.groupBy(*keys).agg(F.count("*").alias("support"), F.hypot(F.max("c") - F.min("c"), F.max("r") - F.min("r")).alias("extent"), F.var_pop("v").alias("sill"), F.avg("v").alias("mean"))
    box = io.materialize(res.sparkSession, box, "lag-units")
    ok = box.where((F.col("support") >= min_support) & (F.col("extent") > near))
    mid = (F.col("extent") + near) / 2
    mean = io.materialize(res.sparkSession, ok.select(*keys, "support", "extent", "sill", "mean"), "lag-edges")
    radii = mean.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), x.alias("radius")) for i, x in ((0, F.lit(near)), (1, mid))])).alias("x")).select(*keys, "x.*")
    centred = pts.join(mean.select(*keys, "mean"), keys).select(*keys, "r", "c", (F.col("v") - F.col("mean")).alias("v"))
    g = pairs_within(centred, keys, radii).groupBy(*keys).agg(*[F.max(F.when(F.col("ring") == i, F.col(x))).alias(f"{x}{i}") for i in (0, 1) for x in ("pairs", "half_sq")])
    g = mean.join(g, keys, "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("pairs0", "pairs1", "half_sq0", "half_sq1")})
    # no pair is farther apart than the extent, so the second bin is what remains of all pairs
    n1, n2 = F.col("pairs1") - F.col("pairs0"), F.expr("support * (support - 1) div 2") - F.col("pairs1")
    h1, h2 = F.col("half_sq1") - F.col("half_sq0"), F.col("support").cast("double") * F.col("support") * F.col("sill") / 2 - F.col("half_sq1")
    g = g.select(*keys, *[x for i, n, h in ((1, n1, h1), (2, n2, h2)) for x in (F.when(n > 0, n).alias(f"pairs{i}"), F.when(n > 0, F.greatest(h, F.lit(0.0)) / n).alias(f"gamma{i}"))])
    j = box.drop("mean").join(g, keys, "left")
    enough = (F.col("pairs1") >= min_pairs) & (F.col("pairs2") >= min_pairs) & (F.col("sill") > 0)
    warn = (F.col("gamma1") < 0.95 * F.col("sill")) & (F.col("gamma2") < 0.95 * F.col("sill"))
    return j.withColumn("status", F.when(F.col("support") < min_support, "inconclusive_insufficient_residual_support")
                        .when(F.col("extent") <= near, "inconclusive_core_extent").when(~F.coalesce(enough, F.lit(False)), "inconclusive_insufficient_lag_support")
                        .when(warn, "spatial_dependence_warning").otherwise("no_warning_at_resolved_lags"))


def components(spark: SparkSession, mask: DataFrame) -> DataFrame:
    """8-connected components of ``mask(r, c)``: (r, c, label), label = smallest cell id of the component.

    Alternates neighbour minima with pointer jumping, so long components need
    few rounds; every round is written and read back.
    """
    cells = mask.select("r", "c", (F.col("r") * F.lit(1 << 31) + F.col("c")).alias("id"))
    shift = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)])
    near = cells.select(F.col("id").alias("src"), "r", "c", F.explode(shift).alias("s"))
    near = near.select("src", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    # merge joins: files of labels are small by their coding, but whole in the driver when broadcast
    edges = io.materialize(spark, near.join(cells.hint("merge"), ["r", "c"]).select("src", F.col("id").alias("dst")), "edges")
    label = io.materialize(spark, cells.select("id", F.col("id").alias("label")), "label")
    while True:
        low = edges.join(label.select(F.col("id").alias("dst"), "label").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("_n"))
        step = label.join(low.hint("merge"), "id", "left").select("id", F.col("label").alias("_old"), F.least("label", F.coalesce("_n", F.col("label"))).alias("_l"))
        step = io.materialize(spark, step, "step")
        # jump to the label of the label: halves the distance to the root
        to = step.select(F.col("id").alias("_l"), F.col("_l").alias("_jump"))
        nxt = io.materialize(spark, step.join(to.hint("merge"), "_l", "left").select("id", "_old", F.least("_l", F.coalesce("_jump", F.col("_l"))).alias("label")), "label")
        if nxt.where(F.col("_old") != F.col("label")).isEmpty():
            return cells.join(nxt.select("id", "label").hint("merge"), "id").select("r", "c", "label")
        label = nxt.select("id", "label")
