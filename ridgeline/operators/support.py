"""Counts, ledgers and statistics of usable data, each closed by a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays, masks
from ..functions.numeric import ratio


def band_statistics(df: DataFrame, keys: list[str], v: Column, nodata: float | None = None) -> DataFrame:
    """Counts by kind and population statistics over valid cells; always one row when keys are empty."""
    ok = masks.valid_value(v, nodata)
    x = F.when(ok, v)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count(x).alias("valid"),
        F.count_if(F.isnan(v)).alias("nan_count"), F.count_if(F.abs(v) == float("inf")).alias("inf_count"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return out.withColumn("nodata_ratio", ratio(F.col("total") - F.col("valid"), F.col("total")))


def health_warnings(stats: DataFrame, limit: float = 1e7) -> DataFrame:
    """Names of the warnings that apply to a statistics row."""
    none = F.col("valid") == 0
    return stats.withColumn("warnings", arrays.failed_names({
        "has_nan": F.col("nan_count") == 0, "has_inf": F.col("inf_count") == 0, "no_valid_cell": ~none,
        "constant": none | (F.col("min") != F.col("max")),
        "extreme_value": none | (F.greatest(F.abs("min"), F.abs("max")) <= limit)}))


def histogram(df: DataFrame, keys: list[str], v: Column, low: Column, high: Column, bins: int) -> DataFrame:
    """Equal bins between low and high; the top edge belongs to the last bin."""
    b = F.least(F.width_bucket(v, low, high, F.lit(bins)), F.lit(bins))
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def mask_agreement(df: DataFrame, keys: list[str], ref: Column, cand: Column, support: Column) -> DataFrame:
    out = df.where(support).groupBy(*keys).agg(
        F.count("*").alias("support"), F.count_if(ref == cand).alias("agree"), F.count_if(ref != cand).alias("differ"),
        F.count_if(ref & ~cand).alias("reference_only"), F.count_if(cand & ~ref).alias("candidate_only"))
    return out.withColumn("differ_ratio", ratio(F.col("differ"), F.col("support")))


def over_universe(counts: DataFrame, universe: DataFrame, keys: list[str], absent: list[str]) -> DataFrame:
    """Counts per key over all cells of the grid.

    ``universe`` has one row a key with ``grid_cells``; ``counts`` has ``_rows`` observed rows a key. A
    cell without a row is a cell without a source: it goes to the ``absent`` columns, so no cell is ever listed.
    """
    out = universe.select(*keys, "grid_cells").join(counts, keys, "left").na.fill(0)
    missing = F.col("grid_cells") - F.col("_rows")
    return out.withColumns({c: F.col(c) + missing for c in absent}).drop("grid_cells", "_rows")


def support_record(px: DataFrame, keys: list[str], universe: DataFrame) -> DataFrame:
    """Counts of every validity primitive over all cells of a key."""
    names = {"msource": "msource", "clear": "clear", "inrange": "inrange", "water": "water", "tvalid": "tvalid",
             "base": "base", "land": "land"}
    counts = px.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count("*").alias("cells"), *[F.count_if(c).alias(f"n_{n}") for n, c in names.items()])
    return over_universe(counts, universe, keys, ["cells"])


def loss_ledger(px: DataFrame, keys: list[str], universe: DataFrame) -> DataFrame:
    """Exclusive split of the lost cells of the grid and the overlapping loss kinds."""
    src, q = F.col("msource"), ~F.col("clear")
    rng, ter = ~F.col("inrange"), ~F.col("tvalid")
    several = q.cast("int") + rng.cast("int") + ter.cast("int") > 1
    out = px.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.count_if(~src).alias("passive"), F.count_if(src & ~F.col("base")).alias("active"),
        F.count_if(~F.col("base")).alias("not_base"), F.count_if(src & q).alias("qa_rejected"),
        F.count_if(src & rng).alias("out_of_range"), F.count_if(src & ter).alias("terrain_missing"),
        F.count_if(src & several).alias("several_kinds"), F.count_if(F.col("base") & F.col("water")).alias("water_excluded"))
    out = over_universe(out, universe, keys, ["passive", "not_base"])
    return out.withColumn("closes", F.col("passive") + F.col("active") == F.col("not_base"))


def waterfall(px: DataFrame, keys: list[str], universe: DataFrame) -> DataFrame:
    """All cells of the grid -> upstream loss -> water -> dark cells -> calibration, with the closing sum."""
    dark = F.col("land") & ~F.col("lit")
    out = px.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.count("*").alias("total"), F.count_if(~F.col("msource")).alias("passive"),
        F.count_if(F.col("msource") & ~F.col("base")).alias("active"),
        F.count_if(F.col("base") & F.col("water")).alias("water"),
        F.count_if(dark & (F.col("cos_i") > 0)).alias("near_zero"), F.count_if(dark & (F.col("cos_i") <= 0)).alias("self_shadow"),
        F.count_if(F.col("land") & F.col("lit")).alias("calibration"))
    out = over_universe(out, universe, keys, ["total", "passive"])
    parts = ["passive", "active", "water", "near_zero", "self_shadow", "calibration"]
    return out.withColumn("closes", sum((F.col(p) for p in parts), F.lit(0)) == F.col("total"))


def cell_support(px: DataFrame, cells: DataFrame) -> DataFrame:
    """Times each cell of ``cells`` (r, c) was seen, sourced, clear and base-valid land over all acquisitions."""
    counts = px.groupBy("r", "c").agg(
        F.count("*").alias("seen"), F.count_if("msource").alias("sourced"), F.count_if("clear").alias("cleared"),
        F.count_if("land").alias("supported"))
    return cells.select("r", "c").join(counts, ["r", "c"], "left").na.fill(0)


def cause(zero: Column, native: Column, edge: Column, explained: Column) -> tuple[Column, Column]:
    """Primary cause of zero-mask cells by precedence, and all flags that apply."""
    flags = {
        "target_grid_reprojection_introduced": native == 0, "source_native_missing": native != 0,
        "edge_only": edge == zero, "qa_explained": explained == zero}
    hit = F.array_compact(F.array(*[F.when((zero > 0) & c, F.lit(n)) for n, c in flags.items()]))
    order = ["target_grid_reprojection_introduced", "edge_only", "qa_explained", "source_native_missing"]
    primary = F.when(zero == 0, "no_mask_zero")
    for n in order:
        primary = primary.when(flags[n], n)
    return primary.otherwise("unresolved"), hit


def coverage_identities(total: Column, base: Column, scored: Column, accepted: Column) -> dict[str, Column]:
    """Coverage ratios of stored counts. The product rules hold the ratios as reported against ratios of the counts."""
    evidence = F.when(base > 0, ratio(base, total)).otherwise(F.lit(0.0))
    scoring, selective, acceptance = ratio(scored, base), ratio(accepted, base), ratio(accepted, scored)
    return {"evidence": evidence, "scoring": scoring, "selective": selective, "acceptance": acceptance,
            **identity_rules(total, base, scored, accepted, evidence, scoring, selective, acceptance)}


def identity_rules(total: Column, base: Column, scored: Column, accepted: Column, evidence: Column, scoring: Column,
                   selective: Column, acceptance: Column, tol: float = 1e-9) -> dict[str, Column]:
    """Whether reported ratios agree with stored counts, which may come from another table."""
    def near(x: Column, y: Column) -> Column:
        return F.coalesce(F.abs(x - y) <= tol, x.isNull() & y.isNull())
    return {
        "ordered": (accepted <= scored) & (scored <= base) & (base <= total),
        "identities_hold": near(evidence * total, base.cast("double")) & near(evidence * scoring, F.when(base > 0, ratio(scored, total)))
        & near(F.when(scored > 0, scoring * acceptance), F.when(scored > 0, selective)),
        "reason": F.when(total == 0, "zero_total").when(base == 0, "zero_base_valid_land_denominator")
        .when(scored == 0, "zero_scored_denominator")}


def describe(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """count, median, min, max; for groups bounded by configuration (folds, domains)."""
    return df.groupBy(*keys).agg(F.count(v).alias("count"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


def two_level_median(df: DataFrame, outer: list[str], inner: list[str], v: str) -> DataFrame:
    """Median inside each inner unit, then equal-weight median over units; cells are never pooled."""
    per = df.groupBy(*outer, *inner).agg(F.median(v).alias("m"))
    return per.groupBy(*outer).agg(F.count("m").alias("units"), F.median("m").alias("median"),
                                   F.min("m").alias("min"), F.max("m").alias("max"))


def closed_set_counts(df: DataFrame, keys: list[str], col: str, closed: list[str]) -> DataFrame:
    """One count column per member of a closed set, zeros included."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in closed])
