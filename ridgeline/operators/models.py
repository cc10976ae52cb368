"""Method and candidate comparisons over spatial folds, and the verdict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import masks, pixel
from ..functions.numeric import clip, ratio
from ..sources import io
from . import fit, folds as fd
from .prefix import two_pass_profile

BANDS = fit.BANDS
METHODS = ["hard_mask", "soft_weight_k15", "soft_weight_k30", "soft_weight_k60", "bounded_scene_constant_diffuse"]
MAIN_METHODS = ["hard_mask", "soft_weight_k30", "bounded_scene_constant_diffuse"]
CANDIDATES = ["C0", "C1p", "C1", "C2a"]
R_FLAT = "insufficient_v_sky_variation"
R_SINGULAR = "singular_design_matrix"
R_NO_CELL = "no_supported_pixel_in_core"


def method_fits(px: DataFrame, folds: list[dict]) -> DataFrame:
    """Fit rows of all methods per acquisition, fold and band, from one pass of sums over land.

    hard_mask uses lit cells only; the weighted and the offset model use all
    calibration land. Needs ``zone`` (fold roles) on the cells.
    """
    land = px.where("land")
    mu, lit = F.col("mu"), F.col("lit")
    sums: dict[str, Column] = {"n": F.lit(1), "n_lit": lit.cast("int"), "sx": mu, "sxx": mu * mu,
                               "hxx": F.when(lit, mu * mu).otherwise(0.0)}
    for k in (15, 30, 60):
        sums[f"w{k}xx"] = pixel.support_weight(F.col("cos_i"), float(k)) * mu * mu
    for b, rho in BANDS.items():
        y = F.col(rho)
        sums |= {f"sy_{b}": y, f"sxy_{b}": mu * y, f"syy_{b}": y * y,
                 f"hxy_{b}": F.when(lit, mu * y).otherwise(0.0), f"hyy_{b}": F.when(lit, y * y).otherwise(0.0)}
        for k in (15, 30, 60):
            w = pixel.support_weight(F.col("cos_i"), float(k))
            sums |= {f"w{k}xy_{b}": w * mu * y, f"w{k}yy_{b}": w * y * y}
    s = fd.sums_by_fold(land, ["a"], folds, fd.DOMAIN, sums)
    names = [n[:-3] for n in sums if n.endswith("_B4")]
    s = fit.by_band(s, {b: {n: F.col(f"{n}_{b}") for n in names} for b in BANDS})

    def slope(method: str, n: Column, xy: Column, xx: Column, yy: Column) -> Column:
        al = F.when((n > 0) & (xx > 0), clip(ratio(xy, xx), 0.0, 1.0))
        return F.struct(F.lit(method).alias("method"), al.alias("alpha"), F.lit(0.0).alias("d"), n.alias("n_cal"),
                        (al * al * xx - 2 * al * xy + yy).alias("objective"), F.lit(False).alias("boundary_hit"))

    c = F.col
    best = fit.bounded_two_parameter(c("n").cast("double"), c("sx"), c("sy"), c("sxx"), c("sxy"), c("syy"))
    s = s.withColumn("_best", F.when(c("n") > 0, best))
    delta = F.when(c("_best.alpha") <= 1e-12, 0.0).otherwise(clip(ratio(c("_best.d"), c("_best.alpha")), 0.0, fit.OFFSET_SHARE))
    rows = F.array(
        slope(METHODS[0], c("n_lit"), c("hxy"), c("hxx"), c("hyy")),
        *[slope(f"soft_weight_k{k}", c("n"), c(f"w{k}xy"), c(f"w{k}xx"), c(f"w{k}yy")) for k in (15, 30, 60)],
        F.struct(F.lit(METHODS[4]).alias("method"), c("_best.alpha").alias("alpha"), c("_best.d").alias("d"), c("n").alias("n_cal"),
                 c("_best.objective").alias("objective"),
                 ((delta <= 1e-12) | (delta >= fit.OFFSET_SHARE - 1e-12)).alias("boundary_hit")))
    return s.select("a", "k", "band", F.explode(rows).alias("m")).select("a", "k", "band", "m.*")


def method_residuals(px: DataFrame, fits: DataFrame, folds: list[dict], methods: list[str]) -> DataFrame:
    """Residual of every core land cell under every method; null where the method has no support.

    The fits of a unit ride along as one array, so cells meet them in a single join.
    """
    per_unit = (fits.where(F.col("method").isin(*methods)).groupBy("a", "k", "band")
                .agg(F.collect_list(F.struct("method", "alpha", "d")).alias("ms")))  # one entry per method
    per_unit = io.materialize(px.sparkSession, per_unit, "fits")  # residuals may be read more than once
    rows = fd.explode_roles(px.where("land"), folds, (fd.CORE,))
    rows = fit.by_band(rows, {b: {"rho": F.col(r)} for b, r in BANDS.items()})
    rows = rows.join(per_unit, ["a", "k", "band"]).withColumn("m", F.explode("ms")).drop("ms")
    e = F.col("m.alpha") * F.col("mu") + F.col("m.d") - F.col("rho")
    hard = F.col("m.method") == METHODS[0]
    return rows.select("a", "k", "band", F.col("m.method").alias("method"), "r", "c", "cos_i", "lit", "rho", "rho4", "rho5",
                       masks.illumination_class(F.col("cos_i")).alias("part"),
                       F.when(~hard | F.col("lit"), e).alias("e"),
                       F.when(hard, F.when(F.col("lit"), 1.0)).otherwise(pixel.support_weight(F.col("cos_i"), 30.0)).alias("rel"))


def metric_rows(res: DataFrame, keys: list[str]) -> DataFrame:
    """Population, support and error metrics for all cells and per partition; unsupported cells stay counted."""
    long = res.withColumn("partition", F.explode(F.array(F.lit("all"), F.col("part"))))
    k = [*keys, "partition"]
    p = two_pass_profile(long, k, F.abs("e"), {"median_abs": 0.5, "p90_abs": 0.9}, fit.ERROR_WIDTH, {"_e": F.col("e")})
    return p.select(
        *k, F.col("rows").alias("population"), F.col("valid").alias("supported"), (F.col("rows") - F.col("valid")).alias("unsupported"),
        ratio(F.col("valid"), F.col("rows")).alias("coverage"), ratio(F.col("_e"), F.col("valid")).alias("bias"),
        ratio(F.col("total"), F.col("valid")).alias("mae"), "median_abs", "p90_abs")


def candidate_gram(px: DataFrame, folds: list[dict]) -> DataFrame:
    """Sums behind every candidate design per acquisition and fold, over lit calibration land with a v_sky."""
    cal = px.where(F.col("land") & F.col("lit") & F.col("v_sky").isNotNull())
    mu, v = F.col("mu"), F.col("v_sky")
    sums = {"n": F.lit(1), "m": mu, "mm": mu * mu, "mv": mu * v, "v": v, "vv": v * v}
    for b, rho in BANDS.items():
        y = F.col(rho)
        sums |= {f"my_{b}": mu * y, f"y_{b}": y, f"vy_{b}": v * y}
    return fd.sums_by_fold(cal, ["a"], folds, fd.DOMAIN, sums)


# Candidate id -> Gram entries from the sums; the first column is always mu.
# "one" is the constant column, v the sky view, 1 - v its complement.
DESIGNS = {
    "C1p": lambda s: (s("mm"), s("m"), s("n"), s("my"), s("y")),
    "C1": lambda s: (s("mm"), s("mv"), s("vv"), s("my"), s("vy")),
    "C2a": lambda s: (s("mm"), s("m") - s("mv"), s("n") - 2 * s("v") + s("vv"), s("my"), s("y") - s("vy")),
}


def candidate_fits(px: DataFrame, folds: list[dict], minimum: int, min_iqr: float) -> DataFrame:
    """Candidate parameters per unit with state and reason; the IQR gate applies to two-column models."""
    gram = candidate_gram(px, folds)
    gram = fit.by_band(gram, {b: {n: F.col(f"{n}_{b}") for n in ("my", "y", "vy")} for b in BANDS})
    gram = gram.join(train_iqr(px, folds), ["a", "k"])

    def s(name: str) -> Column:
        return F.col(name).cast("double")

    def row(cid: str) -> Column:
        if cid == "C0":
            sol = {"theta1": ratio(s("my"), s("mm")), "theta2": F.lit(None).cast("double"),
                   "condition": F.lit(1.0), "rank_short": F.lit(False)}
            flat = F.lit(False)
        else:
            sol, flat = fit.gram_solve(*DESIGNS[cid](s)), F.col("iqr") < min_iqr
        reason = (F.when(F.col("n") < minimum, fit.R_SUPPORT).when(s("mm") <= 0, fit.R_DENOMINATOR)
                  .when(flat, R_FLAT).when(sol["rank_short"], R_SINGULAR))
        ok = reason.isNull()
        return F.struct(F.lit(cid).alias("candidate"), reason.alias("reason"), *[
            F.when(ok, sol[x]).alias(x) for x in ("theta1", "theta2", "condition")])

    rows = F.array(*[row(c) for c in CANDIDATES])
    return gram.select("a", "k", "band", "n", "iqr", F.explode(rows).alias("q")).select("a", "k", "band", "n", "iqr", "q.*")


def train_iqr(px: DataFrame, folds: list[dict]) -> DataFrame:
    """Interquartile range of v_sky over the calibration cells of each acquisition and fold."""
    cal = px.where(F.col("land") & F.col("lit") & F.col("v_sky").isNotNull())
    q = fd.quantiles_by_fold(cal, ["a"], folds, fd.DOMAIN, F.col("v_sky"), {"q1": 0.25, "q3": 0.75}, 1.0 / 4096)
    return q.select("a", "k", (F.col("q3") - F.col("q1")).alias("iqr"))


def ablation(px: DataFrame, acq_split: DataFrame, folds: list[dict], minimum: int, min_iqr: float, quantiles: bool = True) -> DataFrame:
    """Every acquisition x fold x band x candidate with state, parameters and core scores; median and P90 of errors only with ``quantiles``.

    Cells that are not land may be left out of ``px``.
    """
    fits = io.materialize(px.sparkSession, candidate_fits(px, folds, minimum, min_iqr), "fits")
    packed = fits.where("reason IS NULL").groupBy("a", "k", "band").agg(
        F.collect_list(F.struct("candidate", "theta1", "theta2")).alias("ms"))  # at most four
    core = fd.explode_roles(px, folds, (fd.CORE,))
    land = core.groupBy("a", "k").agg(F.count_if("land").alias("core_land"))
    rows = fit.by_band(core.where(F.col("land") & F.col("lit") & F.col("v_sky").isNotNull()),
                       {b: {"rho": F.col(r)} for b, r in BANDS.items()})
    rows = rows.join(packed, ["a", "k", "band"]).withColumn("m", F.explode("ms"))
    cid = F.col("m.candidate")
    second = F.when(cid == "C1p", 1.0).when(cid == "C1", F.col("v_sky")).when(cid == "C2a", 1 - F.col("v_sky")).otherwise(0.0)
    rows = rows.select("a", "k", "band", cid.alias("candidate"),
                       (F.col("m.theta1") * F.col("mu") + F.coalesce("m.theta2", F.lit(0.0)) * second - F.col("rho")).alias("e"))
    score = fit.error_metrics(rows, ["a", "k", "band", "candidate"], quantiles=quantiles).drop("population")
    u = fit.unit_universe(acq_split.select("a", "split"), folds).withColumn(
        "candidate", F.explode(F.array(*[F.lit(c) for c in CANDIDATES])))
    u = u.join(fits, ["a", "k", "band", "candidate"], "left").join(land, ["a", "k"], "left")
    u = u.join(score, ["a", "k", "band", "candidate"], "left")
    reason = F.when(F.col("n").isNull(), fit.R_SUPPORT).otherwise(F.col("reason"))
    return u.withColumns({
        "n": F.coalesce("n", F.lit(0)), "core_land": F.coalesce("core_land", F.lit(0)),
        "state": F.when(reason.isNotNull(), "unsupported").when(F.col("count").isNull(), "not_scored").otherwise("scored"),
        "reason": F.when(reason.isNotNull(), reason).when(F.col("count").isNull(), R_NO_CELL),
        "coverage": ratio(F.col("count"), F.col("core_land"))})


def pair_with_baseline(units: DataFrame, tolerance: float = 1e-3, baseline: str = "C0") -> DataFrame:
    """Scored candidate units beside the baseline of the same unit, with a comparable flag."""
    keep = ["a", "k", "band", "split", "candidate", "state", "mae", "bias", "p90_abs", "coverage", "theta1", "theta2", "condition"]
    base = units.where((F.col("candidate") == baseline) & (F.col("state") == "scored")).select(
        "a", "k", "band", F.col("mae").alias("mae_base"), F.col("coverage").alias("coverage_base"), F.col("theta1").alias("alpha_base"))
    cand = units.where((F.col("candidate") != baseline) & (F.col("state") == "scored")).select(*[c for c in keep if c in units.columns])
    return cand.join(base, ["a", "k", "band"]).withColumns({
        "comparable": F.abs(F.coalesce("coverage", F.lit(0.0)) - F.coalesce("coverage_base", F.lit(0.0))) <= tolerance,
        "improvement": pixel.relative_improvement(F.col("mae_base"), F.col("mae"))})


def verdicts(pairs: DataFrame, min_improvement: float = 0.05, min_folds: int = 4, max_boundary: float = 0.10,
             max_condition: float = 1e10) -> DataFrame:
    """Rule-based outcome per candidate from train units only; one row per candidate.

    Units are a small table (acquisitions x folds x bands), so plain medians serve. ``median_p90`` needs units with quantiles.
    """
    excluded = pairs.groupBy("candidate").agg(F.count_if(~F.col("comparable")).alias("excluded_coverage_mismatch"))
    train = pairs.where((F.col("split") == "train") & F.col("comparable") & F.col("improvement").isNotNull())
    outside = (F.col("theta1") < 0) | (F.col("theta1") > 1)
    v = train.groupBy("candidate").agg(
        F.count("*").alias("train_units"), F.median("improvement").alias("median_improvement"),
        F.avg("improvement").alias("mean_improvement"), F.avg(outside.cast("double")).alias("boundary_share"),
        F.max("condition").alias("max_condition"), F.median(F.abs("theta2")).alias("median_new_parameter"),
        F.median("mae_base").alias("median_mae_base"), F.median("bias").alias("median_bias"),
        *[F.median(x).alias("median_p90") for x in pairs.columns if x == "p90_abs"], F.median("coverage").alias("median_coverage"),
        F.median(F.when(F.col("alpha_base") != 0, (F.col("theta1") - F.col("alpha_base")) / F.col("alpha_base"))).alias("median_alpha_shift"))
    per_fold = train.groupBy("candidate", "k").agg(F.median("improvement").alias("m")).groupBy("candidate").agg(
        F.count_if(F.col("m") > 0).alias("folds_positive"), F.count("*").alias("folds"))
    v = excluded.join(v, "candidate", "left").join(per_fold, "candidate", "left")
    v = v.withColumns({
        "improvement_ok": F.col("median_improvement") >= min_improvement, "direction_ok": F.col("folds_positive") >= min_folds,
        "boundary_ok": F.col("boundary_share") <= max_boundary, "stability_ok": F.col("max_condition") < max_condition})
    all_hold = F.col("improvement_ok") & F.col("direction_ok") & F.col("boundary_ok") & F.col("stability_ok")
    return v.withColumns({
        "train_units": F.coalesce("train_units", F.lit(0)),
        "terminal_state": F.when(F.col("train_units") > 0, F.when(all_hold, "qualified").otherwise("unsupported_by_evidence"))
        .otherwise("unsupported_by_evidence"),
        "reason": F.when(F.coalesce("train_units", F.lit(0)) == 0, "empty_train_comparison_set")
        .when(~all_hold, "improvement_below_threshold_on_heldout_core")})


def tie_rule(v: DataFrame, first: str = "C1", second: str = "C1p", gap: float = 0.01) -> DataFrame:
    """Order of two candidates: a small gap takes the one without the offset; grants no qualification."""
    a = v.where(F.col("candidate") == first).select(F.col("median_improvement").alias("m1"))
    b = v.where(F.col("candidate") == second).select(F.col("median_improvement").alias("m2"))
    j = a.crossJoin(F.broadcast(b))  # one row each
    diff = F.abs(F.col("m1") - F.col("m2"))
    return j.select(F.lit(f"{first},{second}").alias("pair"), diff.alias("gap"), (diff < gap).alias("tie"),
                    F.when((diff < gap) | (F.col("m1") > F.col("m2")), first).otherwise(second).alias("chosen"))
