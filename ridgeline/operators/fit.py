"""Small models per unit, fitted from sums; scoring; model comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixel
from ..functions.numeric import clip, ratio
from ..sources import io
from . import folds as fd
from .prefix import sums_profile, two_pass_profile

BANDS = {"B4": "rho4", "B5": "rho5"}
ERROR_WIDTH = 1.0 / 4096  # bucket of an absolute reflectance error in exact quantiles

# Fixed names and limits.
R_SUPPORT = "calibration_support_below_minimum"
R_DENOMINATOR = "nonpositive_mu_squared_denominator"
MIN_SUPPORT = 271
OFFSET_SHARE = 0.1
RANK_RTOL = 1e-10


def by_band(df: DataFrame, per_band: dict[str, dict[str, Column]]) -> DataFrame:
    """Turn per-band columns into rows: ``per_band[band][name]`` gives column ``name``."""
    rows = F.array(*[F.struct(F.lit(b).alias("band"), *[v.alias(n) for n, v in cols.items()])
                     for b, cols in per_band.items()])
    used = list(next(iter(per_band.values())))
    return df.withColumn("_b", F.explode(rows)).withColumns(
        {"band": F.col("_b.band"), **{n: F.col(f"_b.{n}") for n in used}}).drop("_b")


def through_origin(n: Column, sxy: Column, sxx: Column, minimum: int) -> dict[str, Column]:
    """State, reason and clipped slope of y = alpha x; no default when unsupported."""
    reason = F.when(F.coalesce(n, F.lit(0)) < minimum, R_SUPPORT).when(F.coalesce(sxx, F.lit(0.0)) <= 0, R_DENOMINATOR)
    return {
        "reason": reason,
        "alpha": F.when(reason.isNull(), clip(ratio(sxy, sxx), 0.0, 1.0)),
        "state": F.when(reason.isNull(), "fitted").otherwise("unsupported_calibration")}


def error_metrics(df: DataFrame, keys: list[str], error: str = "e", width: float = ERROR_WIDTH, quantiles: bool = True) -> DataFrame:
    """count, bias, MAE, median and P90 of |error| per key; ``df`` is read twice, or once without ``quantiles``."""
    probs, extra = {"median_abs": 0.5, "p90_abs": 0.9} if quantiles else {}, {"_e": F.col(error)}
    p = two_pass_profile(df, keys, F.abs(error), probs, width, extra) if quantiles else sums_profile(df, keys, F.abs(error), extra)
    return p.where("valid > 0").select(
        *keys, F.col("rows").alias("population"), F.col("valid").alias("count"), (F.col("_e") / F.col("valid")).alias("bias"),
        (F.col("total") / F.col("valid")).alias("mae"), *probs)


def fold_alpha(px: DataFrame, folds: list[dict], minimum: int) -> DataFrame:
    """Slope per acquisition, fold and band from lit land outside the own core and buffer."""
    cal = px.where(F.col("land") & F.col("lit"))
    sums = {"n_cal": F.lit(1), "sxx": F.col("mu") * F.col("mu"),
            **{f"sxy_{b}": F.col("mu") * F.col(c) for b, c in BANDS.items()}}
    s = fd.sums_by_fold(cal, ["a"], folds, fd.DOMAIN, sums)
    s = by_band(s, {b: {"sxy": F.col(f"sxy_{b}")} for b in BANDS})
    return s.select("a", "k", "band", "n_cal", "sxy", "sxx").withColumns(
        through_origin(F.col("n_cal"), F.col("sxy"), F.col("sxx"), minimum))


def core_rows(px: DataFrame, folds: list[dict]) -> DataFrame:
    """Cells of each fold core (a cell lies in few cores, so rows hardly multiply)."""
    return fd.explode_roles(px, folds, (fd.CORE,))


def scored_residuals(px: DataFrame, folds: list[dict], minimum: int) -> DataFrame:
    """predicted - observed on lit land of the core, for fitted units."""
    alpha = fold_alpha(px, folds, minimum).where(F.col("alpha").isNotNull()).select("a", "k", "band", "alpha")
    alpha = io.materialize(px.sparkSession, alpha, "alpha")  # one value for all readers
    rows = core_rows(px.where(F.col("land") & F.col("lit")), folds)
    rows = by_band(rows, {b: {"rho": F.col(c)} for b, c in BANDS.items()})
    return rows.join(alpha, ["a", "k", "band"]).withColumns({
        "e": F.col("alpha") * F.col("mu") - F.col("rho"), "score": pixel.risk_score(F.col("cos_i"))})


def unit_universe(acq: DataFrame, folds: list[dict], bands=tuple(BANDS)) -> DataFrame:
    """Every acquisition x fold x band key; the base of every ledger."""
    return (acq.withColumn("k", F.explode(fd.fold_index(folds)))
            .withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands]))))


def core_accounting(px: DataFrame, folds: list[dict]) -> DataFrame:
    return core_rows(px, folds).groupBy("a", "k").agg(
        F.count("*").alias("core_total"), F.count_if("land").alias("core_land"),
        F.count_if("lit").alias("core_geometry"), F.count_if(F.col("land") & F.col("lit")).alias("core_scored"))


def holdout_units(px: DataFrame, acq_split: DataFrame, folds: list[dict], minimum: int, quantiles: bool = True) -> DataFrame:
    """The spatial-holdout table: one row per unit, unsupported units kept with their reason; median and P90 only with ``quantiles``."""
    z = fd.with_zone(px, folds, BUFFER_CELLS)
    alpha = fold_alpha(z, folds, minimum)
    metrics = error_metrics(scored_residuals(z, folds, minimum), ["a", "k", "band"], quantiles=quantiles).drop("population")
    u = unit_universe(acq_split.select("a", "split"), folds)
    u = u.join(alpha, ["a", "k", "band"], "left").join(core_accounting(z, folds), ["a", "k"], "left")
    u = u.join(metrics, ["a", "k", "band"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_cal", "core_total", "core_land", "core_geometry", "core_scored")}
    return u.withColumns(zero).withColumns({
        "reason": F.when(F.col("n_cal") < minimum, R_SUPPORT).otherwise(F.col("reason")),
        "state": F.when(F.col("alpha").isNotNull(), "fitted").otherwise("unsupported_calibration"),
        "coverage": ratio(F.col("core_scored"), F.col("core_land"))})


BUFFER_CELLS = 3.0


def bounded_two_parameter(n, sx, sy, sxx, sxy, syy) -> Column:
    """Best (alpha, d) of y = alpha x + d under 0 <= alpha <= 1, 0 <= d <= 0.1 alpha.

    The objective is a quadratic form in the six sums, so the feasible corner
    and edge solutions can be compared per unit without touching cells again.
    Struct order (objective, rank) keeps the first listed solution on a tie.
    """
    share = F.lit(OFFSET_SHARE)

    def objective(al, d):
        return al * al * sxx + 2 * al * d * sx - 2 * al * sxy + d * d * n - 2 * d * sy + syy

    def cand(rank: int, name: str, al: Column, d: Column) -> Column:
        ok = (al >= -1e-12) & (al <= 1 + 1e-12) & (d >= -1e-12) & (d <= share * al + 1e-12)
        al2, d2 = clip(al, 0.0, 1.0), F.greatest(d, F.lit(0.0))
        return F.when(ok, F.struct(objective(al2, d2).alias("objective"), F.lit(rank).alias("rank"),
                                   al2.alias("alpha"), d2.alias("d"), F.lit(name).alias("status")))

    det = sxx * n - sx * sx
    shifted = sxx + 2 * share * sx + share * share * n
    upper = clip(ratio(sxy + share * sy, shifted), 0.0, 1.0)
    cands = F.array_compact(F.array(
        F.when(det > 1e-12, cand(0, "interior", ratio(sxy * n - sx * sy, det), ratio(sxx * sy - sx * sxy, det))),
        F.when(sxx > 0, cand(1, "delta_lower", ratio(sxy, sxx), F.lit(0.0))),
        F.when(shifted > 0, cand(2, "delta_upper", upper, share * upper)),
        cand(3, "alpha_upper", F.lit(1.0), clip(ratio(sy - sx, n), 0.0, OFFSET_SHARE)),
        cand(4, "zero", F.lit(0.0), F.lit(0.0))))
    return F.array_min(cands)


def gram_solve(g11, g12, g22, b1, b2) -> dict[str, Column]:
    """Two-column least squares from its Gram matrix: parameters, condition number, rank flag."""
    mean, half = (g11 + g22) / 2, F.sqrt(F.pow((g11 - g22) / 2, 2) + g12 * g12)
    big = mean + half
    det = g11 * g22 - g12 * g12
    small = F.when(big > 0, F.greatest(det, F.lit(0.0)) / big)  # product of the eigenvalues over the larger
    return {
        "theta1": F.when(det > 0, (g22 * b1 - g12 * b2) / det),
        "theta2": F.when(det > 0, (g11 * b2 - g12 * b1) / det),
        "condition": F.when(small > 0, F.sqrt(big / small)),
        "rank_short": F.coalesce(F.sqrt(small) <= F.sqrt(big) * RANK_RTOL, F.lit(True))}


def weighted_inversion(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted y = albedo x per group in closed form, then residual spread and support figures.

    The residual spread also follows from sums, so the data are read once.
    """
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w * x * y).alias("_wxy"), F.sum(w * x * x).alias("_wxx"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
        F.covar_pop(x, y).alias("_cxy"), F.avg(w).alias("mean_confidence"), F.min(w).alias("min_confidence"),
        F.sum(w).alias("effective_count"))
    a = clip(ratio(F.col("_wxy"), F.col("_wxx")), 0.0, 1.0)
    var = F.col("albedo") * F.col("albedo") * F.col("_vx") - 2 * F.col("albedo") * F.col("_cxy") + F.col("_vy")
    out = s.withColumn("albedo", a).withColumn("residual_std", F.sqrt(F.greatest(var, F.lit(0.0))))
    return out.drop("_wxy", "_wxx", "_mx", "_my", "_vx", "_vy", "_cxy")


def reliability(mean_conf: Column, effective: Column, std: Column) -> Column:
    return (F.when((mean_conf < 0.2) | (effective < 0.75), "LOW")
            .when((mean_conf >= 0.85) & (effective >= 2.5) & (std <= 0.012), "HIGH").otherwise("MEDIUM"))


def uncertainty(std: Column, mean_conf: Column, effective: Column) -> Column:
    return std / F.sqrt(effective + 1e-8) + (1 - mean_conf) + F.greatest(3 - effective, F.lit(0.0)) / 3
