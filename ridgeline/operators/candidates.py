"""Search for fold cores: candidate scan, exact counts, selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import geometry as geo
from ..sources import io
from . import grid
from .support import describe

ID = ["r0", "c0", "edge"]
KINDS = ["clean", "shadow", "near_zero", "combined_risk"]


def scan_cores(cells: DataFrame, edges: list[int], stride: int) -> DataFrame:
    """All square cores by edge and stride, border positions included.

    Candidates come from the extent, so a start cell may be absent; positions
    are generated in the tasks and nothing is listed on the driver.
    """
    sized = grid.universe(cells).crossJoin(F.broadcast(grid.extent(cells))).withColumn("edge", F.explode(F.array(*[F.lit(e) for e in edges])))
    e, h, w = F.col("edge"), F.col("_rmax") + 1, F.col("_cmax") + 1
    fits = (F.col("r") + e <= h) & (F.col("c") + e <= w)
    on_row = (F.col("r") % stride == 0) | (F.col("r") == h - e)
    on_col = (F.col("c") % stride == 0) | (F.col("c") == w - e)
    return sized.where(fits & on_row & on_col).select(
        F.col("r").alias("r0"), F.col("c").alias("c0"), "edge", (F.col("r") + e).alias("r1"), (F.col("c") + e).alias("c1"))


def prefixes(cells: DataFrame, names: list[str], band: int = 64) -> DataFrame:
    """Row sums ``row_<n>`` and 2-D prefix sums ``int_<n>`` of several 0/1 columns, for every cell of the grid."""
    cells = grid.dense(cells, names)
    row = W.partitionBy("r").orderBy("c").rowsBetween(W.unboundedPreceding, 0)
    rows = cells.withColumns({f"row_{n}": F.sum(n).over(row) for n in names}).withColumn("_band", F.floor(F.col("r") / band))
    inside = W.partitionBy("_band", "c").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy("c").orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    run = rows.withColumns({f"_in_{n}": F.sum(f"row_{n}").over(inside) for n in names})
    off = rows.groupBy("_band", "c").agg(*[F.sum(f"row_{n}").alias(f"_t_{n}") for n in names]).select(
        "_band", "c", *[F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)).alias(f"_o_{n}") for n in names])
    return run.join(off, ["_band", "c"]).select(
        "r", "c", *[f"row_{n}" for n in names], *[(F.col(f"_in_{n}") + F.col(f"_o_{n}")).alias(f"int_{n}") for n in names])


def rectangle_counts(cores: DataFrame, prefix: DataFrame, names: list[str]) -> DataFrame:
    """Cells of each class inside a core: four signed corner lookups in one join."""
    def corner(r: Column, c: Column, sign: int) -> Column:
        return F.struct((r - 1).alias("r"), (c - 1).alias("c"), F.lit(sign).alias("sign"))
    r0, c0, r1, c1 = (F.col(x) for x in ("r0", "c0", "r1", "c1"))
    corners = F.array(corner(r1, c1, 1), corner(r0, c1, -1), corner(r1, c0, -1), corner(r0, c0, 1))
    q = cores.select(*ID, F.explode(corners).alias("k")).select(*ID, "k.*")
    return q.join(prefix, ["r", "c"], "left").groupBy(*ID).agg(
        *[F.coalesce(F.sum(F.col("sign") * F.col(f"int_{n}")), F.lit(0)).alias(f"holdout_{n}") for n in names])


def buffer_counts(cores: DataFrame, prefix: DataFrame, names: list[str], buffer: int) -> DataFrame:
    """Cells of each class at Euclidean distance < buffer of a core, core included.

    Per touched row the excluded span is known, so two row-prefix lookups give
    its count; a core touches edge + 2 (buffer - 1) rows at most.
    """
    q = cores.crossJoin(F.broadcast(grid.extent(prefix)))
    rows = F.sequence(F.greatest(F.col("r0") - (buffer - 1), F.lit(0)), F.least(F.col("r1") + buffer - 2, F.col("_rmax")))
    q = q.withColumn("r", F.explode(rows))
    v = F.greatest(F.col("r0") - F.col("r"), F.col("r") - (F.col("r1") - 1), F.lit(0))
    reach = F.ceil(F.sqrt(F.greatest(buffer * buffer - v * v, F.lit(0)).cast("double"))) - 1
    q = q.withColumn("_reach", reach)
    ends = F.array(
        F.struct((F.least(F.col("c1") + F.col("_reach"), F.col("_cmax") + 1) - 1).alias("c"), F.lit(1).alias("sign")),
        F.struct((F.greatest(F.col("c0") - F.col("_reach"), F.lit(0)) - 1).alias("c"), F.lit(-1).alias("sign")))
    q = q.select(*ID, "r", F.explode(ends).alias("k")).select(*ID, "r", "k.*")
    return q.join(prefix, ["r", "c"], "left").groupBy(*ID).agg(
        *[F.coalesce(F.sum(F.col("sign") * F.col(f"row_{n}")), F.lit(0)).alias(f"near_{n}") for n in names])


def nearest_outside(spark: SparkSession, cores: DataFrame, mask: DataFrame, buffer: int) -> DataFrame:
    """Exact smallest distance from a core to a set cell at distance >= buffer; null when there is none.

    Rows close to the core are searched first. A hit no farther than the
    searched rows cannot be beaten, so only open candidates go on, with twice
    the rows; the loop ends when none is open or the whole grid was searched.
    """
    look = io.materialize(spark, grid.last_next(grid.dense(mask, ["m"])).select("r", "c", "last_set", "next_set"), "look")
    height = mask.agg(F.max("r") + 1).first()[0]
    reach, done, open_ = buffer + 16, None, cores
    while True:
        ext = open_.crossJoin(F.broadcast(grid.extent(mask)))
        q = ext.withColumn("r", F.explode(F.sequence(F.greatest(F.col("r0") - reach, F.lit(0)), F.least(F.col("r1") - 1 + reach, F.col("_rmax")))))
        q = q.withColumn("_v", F.greatest(F.col("r0") - F.col("r"), F.col("r") - (F.col("r1") - 1), F.lit(0)))
        need = F.when(F.col("_v") < buffer, F.ceil(F.sqrt((buffer * buffer - F.col("_v") * F.col("_v")).cast("double")))).otherwise(0)
        q = q.withColumn("_need", need)
        sides = F.array(
            F.struct((F.col("c0") - F.greatest(F.col("_need"), F.lit(1))).alias("c"), F.lit(True).alias("left")),
            F.struct(F.when(F.col("_need") > 0, F.col("c1") - 1 + F.col("_need")).otherwise(F.col("c0")).alias("c"), F.lit(False).alias("left")))
        q = q.select(*ID, "r1", "c1", "r", "_v", F.explode(sides).alias("k")).select(*ID, "r1", "c1", "r", "_v", "k.*")
        h = F.when(F.col("left"), F.col("c0") - F.col("last_set")).when(
            F.col("next_set").isNotNull(), F.greatest(F.col("next_set") - (F.col("c1") - 1), F.lit(0)))
        d = q.join(look, ["r", "c"], "left").groupBy(*ID, "r1", "c1").agg(F.min(F.hypot(F.col("_v"), h)).alias("nearest_outside"))
        if reach >= height:
            return d.select(*ID, "nearest_outside") if done is None else done.unionByName(d.select(*ID, "nearest_outside"))
        d = io.materialize(spark, d, "nearest")
        closed = d.where(F.col("nearest_outside") <= reach).select(*ID, "nearest_outside")
        done = closed if done is None else done.unionByName(closed)
        open_ = d.where(F.coalesce(F.col("nearest_outside") > reach, F.lit(True))).select(*ID, "r1", "c1")
        if open_.isEmpty():
            return done
        reach *= 2


def candidate_records(spark: SparkSession, cells: DataFrame, edges: list[int], stride: int, buffer: int, names: list[str]) -> DataFrame:
    """Holdout, near and calibration counts per class, distance rule and centre of every candidate."""
    cores = scan_cores(cells, edges, stride)
    pre = io.materialize(spark, prefixes(cells, names), "prefix")
    total = cells.agg(*[F.sum(n).alias(f"total_{n}") for n in names])
    near = nearest_outside(spark, cores, cells.select("r", "c", F.col(names[0]).alias("m")), buffer)
    j = rectangle_counts(cores, pre, names).join(buffer_counts(cores, pre, names, buffer), ID).join(near, ID, "left").crossJoin(F.broadcast(total))
    return j.select(
        *ID, *[f"holdout_{n}" for n in names], *[f"near_{n}" for n in names],
        *[(F.col(f"total_{n}") - F.col(f"near_{n}")).alias(f"calibration_{n}") for n in names], "nearest_outside",
        (F.col("nearest_outside").isNull() | (F.col("nearest_outside") + 1e-9 >= buffer)).alias("distance_ok"),
        (F.col("r0") + (F.col("edge") - 1) / 2 + 0.5).alias("centre_r"), (F.col("c0") + (F.col("edge") - 1) / 2 + 0.5).alias("centre_c"))


def kind_rule(kind: Column, risk_minimum: Column) -> Column:
    sh, nz = F.col("holdout_shadow") >= risk_minimum, F.col("holdout_near_zero") >= risk_minimum
    return (kind == KINDS[0]) | ((kind == KINDS[1]) & sh) | ((kind == KINDS[2]) & nz) | ((kind == KINDS[3]) & sh & nz)


def qualifying(cand: DataFrame, thresholds: list[tuple[int, int, int]]) -> DataFrame:
    """Candidates that pass, per threshold triple (calibration, holdout, risk) and kind.

    Thresholds and kinds are configuration and ride along as array literals.
    """
    rows = F.array(*[F.struct(F.lit(a).alias("min_calibration"), F.lit(b).alias("min_holdout"), F.lit(c).alias("min_risk"), F.lit(k).alias("kind"))
                     for a, b, c in thresholds for k in KINDS])
    q = cand.withColumn("_t", F.explode(rows)).select("*", "_t.*").drop("_t")
    return q.where(F.col("distance_ok") & (F.col("calibration_land") >= F.col("min_calibration"))
                   & (F.col("holdout_land") >= F.col("min_holdout")) & kind_rule(F.col("kind"), F.col("min_risk")))


def top_candidates(q: DataFrame, limit: int = 5) -> DataFrame:
    """Best ``limit`` per threshold triple and kind by the kind's own count, then land, calibration, edge, row, column."""
    primary = (F.when(F.col("kind") == "shadow", F.col("holdout_shadow")).when(F.col("kind") == "near_zero", F.col("holdout_near_zero"))
               .when(F.col("kind") == "combined_risk", F.col("holdout_shadow") + F.col("holdout_near_zero")).otherwise(F.col("holdout_land")))
    w = W.partitionBy(*[k for k in ("min_calibration", "min_holdout", "min_risk") if k in q.columns], "kind").orderBy(F.desc("_p"), F.desc("holdout_land"), F.desc("calibration_land"), "edge", "r0", "c0")
    return q.withColumn("_p", primary).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumnRenamed("_p", "primary_count")


def greedy_nonoverlap(spark: SparkSession, cand: DataFrame, keys: list[str], tile: int = 512) -> DataFrame:
    """Cores kept when scanned by (edge, row, column) and overlapping none kept before.

    A group is one tile of start cells: it is scanned in order, with the cores that its neighbours keep near the border
    in their places of the order. Tiles whose border has changed are scanned again until none has. A core
    depends on earlier ones only, so what holds still everywhere is the one sequential scan; a chain of overlapping cores costs
    a round per tile that it crosses with effect, not per core. Several scans (``keys``) run in the same rounds.
    """
    ident, group = [*keys, *ID], [*keys, "_tr", "_tc"]
    place = {"_tr": F.floor(F.col("r0") / tile).cast("long"), "_tc": F.floor(F.col("c0") / tile).cast("long")}
    live = io.materialize(spark, cand.select(*ident).withColumns(place), "live")
    most = live.agg(F.max("edge")).first()[0]
    if most is None:
        return live.select(*ident)

    def scan(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own
        e, r, c = (np.concatenate([own[x].to_numpy(), near[x].to_numpy()]).astype(int) for x in ("edge", "r0", "c0"))
        r, c = r - r.min(), c - c.min()
        taken, keep = np.zeros(((r + e).max(), (c + e).max()), dtype=bool), []
        for i in np.lexsort((c, r, e)).tolist():
            box = taken[r[i]:r[i] + e[i], c[i]:c[i] + e[i]]
            if i < len(own):
                if box.any():
                    continue
                keep.append(i)
            box[:] = True
        return own.iloc[keep]

    def scanned(own: DataFrame, near: DataFrame) -> DataFrame:
        return own.groupBy(*group).cogroup(near.groupBy(*group)).applyInPandas(scan, live.schema)

    def borders(kept: DataFrame) -> DataFrame:
        """Kept cores in each other tile of which a core may overlap them."""
        def reach(x: str) -> Column:
            return F.explode(F.sequence(F.floor((F.col(x) - (most - 1)) / tile), F.floor((F.col(x) + F.col("edge") - 1) / tile)))
        far = kept.withColumn("_r", reach("r0")).withColumn("_c", reach("c0")).where((F.col("_r") != F.col("_tr")) | (F.col("_c") != F.col("_tc")))
        return io.materialize(spark, far.select(*ident, F.col("_r").alias("_tr"), F.col("_c").alias("_tc")), "border")
    border = live.where("false")
    kept = io.materialize(spark, scanned(live, border), "kept")
    while True:
        old, border = border, borders(kept)
        moved = old.unionByName(border).groupBy(*ident, "_tr", "_tc").agg(F.count("*").alias("_n")).where("_n = 1")
        moved = io.materialize(spark, moved.select(*group).distinct(), "moved")
        if moved.isEmpty():
            return kept.select(*ident)
        again = scanned(*[x.join(moved, group, "left_semi") for x in (live, border)])
        kept = io.materialize(spark, kept.join(moved, group, "left_anti").unionByName(again), "kept")


def maximin(spark: SparkSession, cand: DataFrame, keys: list[str], count: int, tie: list[Column]) -> DataFrame:
    """Per key: first the core that is greatest by ``tie``, then repeatedly the one farthest from all chosen and overlapping none.

    ``tie``: numbers, greater ones first; they also break equal distances. All keys (config groups such as thresholds and
    kinds) go through the same ``count`` rounds. A candidate carries its least distance so far, so a round is one
    maximum per key, with map-side combine, and one update; picks and candidates stay in written tables.
    """
    named = {f"_t{i}": t.cast("double") for i, t in enumerate(tie)}
    live = cand.select(*keys, *ID, "centre_r", "centre_c", *[t.alias(n) for n, t in named.items()], F.lit(None).cast("double").alias("gap"))
    live, picks = io.materialize(spark, live, "maximin"), None
    for turn in range(1, count + 1):
        best = live.groupBy(*keys).agg(F.max(F.struct("gap", *named, *ID, "centre_r", "centre_c")).alias("b")).select(*keys, F.lit(turn).alias("pick"), "b.*")
        best = io.materialize(spark, best.drop(*named), "maximin-picks")
        picks = best if picks is None else picks.unionByName(best)
        if turn == count:
            break
        last = best.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*ID, "centre_r", "centre_c")])
        far = live.join(last, keys)
        boxes = [[F.col(f"{x}r0"), F.col(f"{x}c0"), F.col(f"{x}r0") + F.col(f"{x}edge"), F.col(f"{x}c0") + F.col(f"{x}edge")] for x in ("", "_")]
        gap = F.hypot(F.col("centre_r") - F.col("_centre_r"), F.col("centre_c") - F.col("_centre_c"))
        far = far.where(~geo.half_open_overlap(*boxes)).withColumn("gap", F.least("gap", gap))
        live = io.materialize(spark, far.select(live.columns), "maximin")
    return picks.select(*keys, "pick", *ID, "gap")


def pick_order() -> list[Column]:
    """Ties between candidates of a kind: for risk kinds first the scarcer risk and both together, then land, calibration, edge, row, column."""
    sh, nz = F.col("holdout_shadow"), F.col("holdout_near_zero")
    risk = F.col("kind") != KINDS[0]
    return [F.when(risk, F.least(sh, nz)).otherwise(0), F.when(risk, sh + nz).otherwise(0), F.col("holdout_land"), F.col("calibration_land"), -F.col("edge"), -F.col("r0"), -F.col("c0")]


def support_matrix(spark: SparkSession, cand: DataFrame, thresholds: list[tuple[int, int, int]]) -> DataFrame:
    """Per threshold triple and kind: qualifying folds, non-overlapping folds, land medians and ranges."""
    keys = ["min_calibration", "min_holdout", "min_risk", "kind"]
    q = io.materialize(spark, qualifying(cand, thresholds), "qualified")
    kept = greedy_nonoverlap(spark, q, keys).groupBy(*keys).agg(F.count("*").alias("nonoverlapping"))
    s = describe(q, keys, "holdout_land").select(*keys, F.col("count").alias("folds"), F.col("median").alias("median_land"),
                                                 F.col("min").alias("min_land"), F.col("max").alias("max_land"))
    return s.join(kept, keys)
