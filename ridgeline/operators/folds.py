"""Space and time splits: fold roles, topology, blocks, contiguous time split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geometry as geo
from .prefix import running_sums

CORE, BUFFER, DOMAIN = 0, 1, 2
ROLE_NAMES = ["core", "buffer", "domain"]


def role_code(r: Column, c: Column, fold: dict, buffer_cells: float) -> Column:
    """0 core, 1 buffer ring, 2 calibration domain, by cell distance to the core box."""
    gap = geo.rect_distance(
        c.cast("double"), r.cast("double"), float(fold["c0"]), float(fold["r0"]), float(fold["c1"]), float(fold["r1"]))
    return F.when(gap == 0, CORE).when(gap < buffer_cells, BUFFER).otherwise(DOMAIN)


def with_zone(cells: DataFrame, folds: list[dict], buffer_cells: float) -> DataFrame:
    """Add ``zone``: the role code of the cell in every fold, in fold order.

    Folds are configuration, so roles are plain expressions: no join, and no
    row is multiplied. Cells with the same zone behave alike in every fold,
    which lets sums be taken per zone first and spread to folds afterwards.
    """
    return cells.withColumn("zone", F.array(*[
        role_code(F.col("r"), F.col("c"), f, buffer_cells).cast("tinyint") for f in folds]))


def fold_index(folds: list[dict]) -> Column:
    return F.array(*[F.lit(f["k"]) for f in folds])


def explode_roles(cells: DataFrame, folds: list[dict], roles: tuple[int, ...]) -> DataFrame:
    """One row per cell and fold in which the cell has one of ``roles`` (adds ``k``, ``role``)."""
    pairs = F.filter(F.arrays_zip(fold_index(folds).alias("k"), F.col("zone").alias("role")),
                     lambda p: p["role"].isin(*roles))
    return cells.withColumn("_p", F.explode(pairs)).withColumns(
        {"k": F.col("_p.k"), "role": F.col("_p.role")}).drop("_p", "zone")


def sums_by_fold(cells: DataFrame, keys: list[str], folds: list[dict], role: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over the cells of one role, per key and fold.

    First per (key, zone), a handful of groups per key with full map-side
    combine; only those small sums are exploded to folds.
    """
    zoned = cells.groupBy(*keys, "zone").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    return explode_roles(zoned, folds, (role,)).groupBy(*keys, "k").agg(*[F.sum(n).alias(n) for n in sums])


def quantiles_by_fold(
    cells: DataFrame, keys: list[str], folds: list[dict], role: int, value: Column, probs: dict[str, float], width: float,
) -> DataFrame:
    """Exact quantiles over the cells of one role, per key and fold, with one sort per key.

    A calibration domain holds most cells in every fold, so copying cells to
    folds would multiply the rows by the number of folds. Here each value
    carries one running count per fold instead.
    """
    v = F.col("_v")
    member = {f["k"]: (F.element_at("zone", i + 1) == role).cast("long") for i, f in enumerate(folds)}
    counted = (cells.select(*keys, "zone", value.cast("double").alias("_v")).where(v.isNotNull())
               .groupBy(*keys, "_v").agg(*[F.sum(m).alias(f"_n{k}") for k, m in member.items()]))
    run = running_sums(counted, keys, ["_v"], F.floor(v / width), {f"_c{k}": F.col(f"_n{k}") for k in member},
                       {f"_all{k}": F.col(f"_n{k}") for k in member})

    def at(k, rank: Column) -> Column:
        c, n = F.col(f"_c{k}"), F.col(f"_n{k}")
        return F.max(F.when((c - n <= rank) & (rank < c), v))

    aggs = []
    for k in member:
        aggs.append(F.max(f"_all{k}").alias(f"_m{k}"))
        for name, p in probs.items():
            pos = (F.col(f"_all{k}") - 1) * F.lit(float(p))
            aggs += [at(k, F.floor(pos)).alias(f"_lo{k}{name}"), at(k, F.ceil(pos)).alias(f"_hi{k}{name}"),
                     F.max(pos - F.floor(pos)).alias(f"_f{k}{name}")]
    wide = run.groupBy(*keys).agg(*aggs)

    def line(k) -> Column:
        return F.struct(F.lit(k).alias("k"), F.col(f"_m{k}").alias("n"), *[
            (F.col(f"_lo{k}{x}") + (F.col(f"_hi{k}{x}") - F.col(f"_lo{k}{x}")) * F.col(f"_f{k}{x}")).alias(x) for x in probs])

    out = wide.select(*keys, F.explode(F.array(*[line(k) for k in member])).alias("x"))
    return out.select(*keys, "x.k", "x.n", *[f"x.{x}" for x in probs]).where("n > 0").drop("n")


def roles_by_join(cells: DataFrame, folds: DataFrame, buffer_cells: float, block: int = 64) -> DataFrame:
    """Core and buffer cells of every fold when the folds are a table (k, r0, c0, r1, c1) of any size.

    Matched by an equi-join on the blocks a fold and its buffer can touch. Every
    other cell is calibration domain of the fold; that default is not stored.
    """
    reach = int(buffer_cells) + 1

    def blocks(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(low) - reach) / block), F.floor((F.col(high) + reach) / block)))

    near = folds.withColumn("_br", blocks("r0", "r1")).withColumn("_bc", blocks("c0", "c1"))
    hit = cells.withColumns({"_br": F.floor(F.col("r") / block), "_bc": F.floor(F.col("c") / block)}).join(near, ["_br", "_bc"])
    return hit.drop("_br", "_bc").withColumn("role", role_code_columns(buffer_cells)).where(F.col("role") != DOMAIN)


def role_code_columns(buffer_cells: float) -> Column:
    gap = geo.rect_distance(F.col("c").cast("double"), F.col("r").cast("double"),
                            F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1"))
    return F.when(gap == 0, CORE).when(gap < buffer_cells, BUFFER).otherwise(DOMAIN)


def role_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in ROLE_NAMES]), code.cast("int") + 1)


def topology(cells: DataFrame, folds: list[dict], buffer_cells: float) -> DataFrame:
    """Per fold: cells by role, smallest core-to-domain distance, isolation, nearest other core."""
    out = []
    for f in folds:
        gap = geo.rect_distance(F.col("c").cast("double"), F.col("r").cast("double"),
                                float(f["c0"]), float(f["r0"]), float(f["c1"]), float(f["r1"]))
        out.append(F.struct(F.lit(f["k"]).alias("k"), gap.alias("gap"), F.lit(min(
            [cell_gap(f, g) for g in folds if g["k"] != f["k"]], default=None)).alias("nearest_other_core")))
    per = cells.select(F.explode(F.array(*out)).alias("x")).select("x.*")
    return per.groupBy("k", "nearest_other_core").agg(
        F.count_if(F.col("gap") == 0).alias("core_cells"),
        F.count_if((F.col("gap") > 0) & (F.col("gap") < buffer_cells)).alias("buffer_cells"),
        F.count_if(F.col("gap") >= buffer_cells).alias("domain_cells"),
        F.count("*").alias("total_cells"),
        F.min(F.when(F.col("gap") >= buffer_cells, F.col("gap"))).alias("min_core_domain_distance"),
    ).withColumns({
        "isolated": F.col("min_core_domain_distance") >= buffer_cells,
        "partition_closes": F.col("core_cells") + F.col("buffer_cells") + F.col("domain_cells") == F.col("total_cells")})


def cell_gap(f: dict, g: dict) -> float:
    dx = max(f["c0"] - g["c1"], g["c0"] - f["c1"], 0)
    dy = max(f["r0"] - g["r1"], g["r0"] - f["r1"], 0)
    return float((dx * dx + dy * dy) ** 0.5)


def fold_pairs(folds: DataFrame) -> DataFrame:
    """Every pair of folds of a configuration table with gap, overlap and shared cells."""
    a, b = folds.alias("x"), folds.alias("y")
    p = a.join(b, F.col("x.k") < F.col("y.k"))
    box = {s: [F.col(f"{s}.{n}") for n in ("c0", "r0", "c1", "r1")] for s in "xy"}
    half = {s: [v[0], v[1], v[2] + 1, v[3] + 1] for s, v in box.items()}
    return p.select(
        F.col("x.k").alias("fold_a"), F.col("y.k").alias("fold_b"), geo.rect_gap(box["x"], box["y"]).alias("gap"),
        geo.half_open_overlap(half["x"], half["y"]).alias("overlaps"),
        geo.overlap_area(half["x"], half["y"]).alias("shared_cells"))


def time_split(acq: DataFrame, order: list[str]) -> DataFrame:
    """Contiguous split in time: floor(.6 N) train, floor(.2 N) validation, rest test.

    Acquisitions are a dimension table, so the one global order is small.
    """
    n = F.count("*").over(W.partitionBy())
    i = F.row_number().over(W.orderBy(*order))
    train = F.greatest(F.floor(n * 0.6), F.lit(1))
    val = F.greatest(F.floor(n * 0.2), F.lit(1))
    return acq.withColumns({"position": i, "n": n}).withColumn(
        "split", F.when(n < 3, "none").when(i <= train, "train").when(i <= train + val, "validation").otherwise("test"))


def checkerboard(cells: DataFrame, edge: int, gap: int, minimum: int) -> DataFrame:
    """Blocks of ``edge`` cells with ``gap`` cells between, split by parity; ``cells`` has 0/1 ``m``.

    Only blocks that lie whole inside the grid are used.
    """
    stride = edge + gap
    whole = ((F.floor(F.col("r") / stride) * stride + edge - 1 <= F.col("_rmax"))
             & (F.floor(F.col("c") / stride) * stride + edge - 1 <= F.col("_cmax")))
    from .grid import extent
    inside = cells.crossJoin(F.broadcast(extent(cells))).where(
        whole & (F.pmod("r", F.lit(stride)) < edge) & (F.pmod("c", F.lit(stride)) < edge))
    blocks = inside.groupBy(F.floor(F.col("r") / stride).alias("block_row"),
                            F.floor(F.col("c") / stride).alias("block_col")).agg(F.sum("m").alias("land_cells"))
    return blocks.where(F.col("land_cells") >= minimum).withColumn(
        "split", F.when((F.col("block_row") + F.col("block_col")) % 2 == 0, "calibration").otherwise("holdout"))
