"""Error-versus-coverage curves, fixed-grid mapping, scope verdicts and rank agreement."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import masks
from ..functions.numeric import ratio
from ..sources import io
from . import folds as fd
from .prefix import average_ranks, exact_quantiles, running_sums, two_pass_profile

# Fixed names of the closed sets.
SHAPE_VERDICT = {"order_consistent": "descriptive_ordering_signal", "order_inverted": "directionally_adverse",
                 "flat": "descriptive_non_discriminative", "mixed": "descriptive_non_discriminative"}
V_SUPPORT = "not_evaluable_insufficient_scored_support"
V_DEGENERATE = "not_evaluable_score_degenerate"
SCOPES = ["unit_all_scored", "mu_band_low", "mu_band_mid", "mu_band_high"]


def agreement(df: DataFrame, a: str, b: str, width: float) -> DataFrame:
    """Spearman rho, max and P99 of |a - b| over the whole table, in one row."""
    r = average_ranks(average_ranks(df, a, width, "_ra"), b, width, "_rb")
    delta = F.abs(F.col(a) - F.col(b))
    g = r.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"), F.max(delta).alias("max_abs"))
    q = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], delta, {"p99_abs": 0.99}, width)
    return g.crossJoin(F.broadcast(q.select("p99_abs")))


def with_scopes(scored: DataFrame) -> DataFrame:
    """Copy each scored cell to the whole-unit scope and to its stratum."""
    return scored.withColumn("scope", F.explode(F.array(F.lit(SCOPES[0]), masks.stratum(F.col("cos_i")))))


def exact_points(rows: DataFrame, keys: list[str], denominators: DataFrame, on: list[str]) -> DataFrame:
    """One curve point per distinct score: equal scores are accepted together.

    Ties collapse in the first aggregate. Scores of 1 - cos_i lie in [0, 2],
    so a fixed bucket width splits even one huge unit over many tasks.
    """
    ties = rows.groupBy(*keys, "score").agg(F.count("*").alias("_n"), F.sum(F.abs("e")).alias("_s"))
    run = running_sums(ties, keys, ["score"], F.floor(F.col("score").cast("double") * 4096),
                       {"accepted": F.col("_n"), "_sum": F.col("_s"), "point": F.lit(1)},
                       {"scored": F.col("_n"), "points": F.lit(1)})
    run = run.join(denominators, on)
    return run.select(
        *keys, F.col("point").cast("long").alias("point"), F.col("score").cast("double").alias("score"), F.col("accepted"),
        "denominator", "scored", "points",
        ratio(F.col("accepted"), F.col("denominator")).alias("coverage"), (F.col("_sum") / F.col("accepted")).alias("mae"))


def fixed_grid(points: DataFrame, keys: list[str], targets: int = 20) -> DataFrame:
    """For k/targets the last point with targets*accepted <= k*denominator; first hit reachable, repeats duplicate.

    Every point knows the first k it serves, ceil(targets*accepted/denominator),
    so the best point per k is a running max over at most ``targets`` rows.
    """
    acc, den = F.col("accepted"), F.col("denominator")
    first_k = F.ceil(acc * targets / den.cast("decimal(20,0)"))
    best = points.where(den > 0).groupBy(*keys, first_k.cast("long").alias("q")).agg(
        F.max(F.struct("point", "accepted", "coverage", "mae")).alias("p"))
    top = points.where(den > 0).groupBy(*keys).agg(F.max("accepted").alias("_top"), F.first("denominator").alias("_den"))
    ks = top.withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(targets).cast("long"))))
    w = W.partitionBy(*keys).orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    g = ks.join(best, [*keys, "q"], "left").withColumn("p", F.max("p").over(w))
    above = F.col("q") * F.col("_den") > F.col("_top") * targets
    reach = F.col("p").isNotNull() & ~above
    same = W.partitionBy(*keys, "_pt").orderBy("q")
    g = g.withColumn("_pt", F.when(reach, F.col("p.point")))
    g = g.withColumn("_first", F.min("q").over(W.partitionBy(*keys, "_pt")))
    return g.select(
        *keys, "q", (F.col("q") / targets).alias("target"),
        F.when(~reach, "unreachable").when(F.col("q") == F.col("_first"), "reachable").otherwise("duplicate").alias("status"),
        F.when(F.col("p").isNull(), "below_min_accepted_support").when(above, "above_max_reachable_coverage")
        .when(F.col("q") != F.col("_first"), "duplicate_exact_point").alias("reason"),
        F.col("_pt").alias("point"), F.when(reach, F.col("p.coverage")).alias("coverage"),
        F.when(reach, F.col("p.mae")).alias("mae"), F.when(reach, F.col("p.accepted")).alias("accepted"),
        F.when(reach, F.col("_first") / targets).alias("canonical_target"))


def staircase_area(points: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Area under the left-step curve, its span, and the normalised area.

    The step to the next point needs only the next coverage; because coverage
    is a running count, area = sum of mae_i * (coverage_{i+1} - coverage_i).
    The last point of a bucket borrows the first coverage of the next bucket.
    """
    p = points.withColumn("_bucket", bucket)
    w = W.partitionBy(*keys, "_bucket").orderBy("point")
    edge = p.groupBy(*keys, "_bucket").agg(F.min(F.struct("point", "coverage")).alias("_f"))
    nxt = edge.select(*keys, "_bucket", F.lead("_f.coverage").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_next"))
    step = p.withColumn("_ahead", F.lead("coverage").over(w)).join(nxt, [*keys, "_bucket"])
    width = F.coalesce("_ahead", "_next") - F.col("coverage")
    g = step.groupBy(*keys).agg(F.sum(F.col("mae") * width).alias("area"), F.count("*").alias("_n"),
                                (F.max("coverage") - F.min("coverage")).alias("span"))
    many = F.col("_n") >= 2
    return g.select(*keys, F.when(many, F.col("area")).alias("area"), F.when(many, F.col("span")).alias("span"),
                    F.when(many & (F.col("span") > 0), F.col("area") / F.col("span")).alias("normalized"))


def curve_shape(grid: DataFrame, keys: list[str], tau_abs: float, tau_rel: float) -> DataFrame:
    """Signs of the successive differences of the reachable grid points (at most 20 per key)."""
    w = W.partitionBy(*keys).orderBy("q")
    g = grid.where("status = 'reachable'").withColumn("_prev", F.lag("mae").over(w))
    delta = F.col("mae") - F.col("_prev")
    tau = F.greatest(F.abs("mae"), F.abs("_prev")) * tau_rel + tau_abs
    s = g.groupBy(*keys).agg(F.count("*").alias("reachable"), F.max(F.coalesce(delta > tau, F.lit(False))).alias("_up"),
                             F.max(F.coalesce(delta < -tau, F.lit(False))).alias("_down"))
    return s.select(*keys, "reachable", F.when(F.col("_up") & F.col("_down"), "mixed").when(F.col("_up"), "order_consistent")
                    .when(F.col("_down"), "order_inverted").otherwise("flat").alias("shape"))


def evaluate_scopes(rows: DataFrame, unit: DataFrame, keys: list[str], minimum: int = 271, min_points: int = 3, min_accept: int = 271,
                    tau: tuple[float, float] = (1e-12, 1e-12)) -> dict[str, DataFrame]:
    """Ordered gates, then curve, area, shape and verdict per unit and scope.

    ``rows`` are scored cells (keys, cos_i, score, e); ``unit`` has one row per
    key with core_total, core_land and a boolean ``unit_scored``. Every unit
    and scope gets a row, whatever gate it fails.
    """
    k = [*keys, "scope"]
    scoped = with_scopes(rows)
    universe = unit.withColumn("scope", F.explode(F.array(*[F.lit(x) for x in SCOPES])))
    den = unit.select(*keys, F.col("core_land").alias("denominator"))
    stats = scoped.groupBy(*k).agg(F.count("*").alias("n_scored"), F.min("score").cast("double").alias("s_min"), F.max("score").cast("double").alias("s_max"))
    points = exact_points(scoped, k, den, keys)
    bucket = F.floor(F.col("score") * 4096)
    admissible = points.where(F.col("accepted") >= min_accept)
    n_points = points.groupBy(*k).agg(F.max("points").alias("exact_points"), F.count_if(F.col("accepted") >= min_accept).alias("admissible_points"))
    grid = fixed_grid(admissible, k)
    area = staircase_area(admissible, k, bucket)
    shape = curve_shape(grid, k, *tau)
    out = universe.join(stats, k, "left").join(n_points, k, "left").join(area, k, "left").join(shape, k, "left")
    n = F.coalesce("n_scored", F.lit(0))
    span = F.col("s_max") - F.col("s_min")
    limit = F.greatest(F.abs("s_min"), F.abs("s_max")) * tau[1] + tau[0]
    gates = [
        (~F.col("unit_scored"), V_SUPPORT, "unit_gate_not_scored"),
        (F.col("core_land") == 0, V_SUPPORT, "zero_base_valid_land_denominator"),
        (n == 0, V_SUPPORT, "zero_scored_denominator"),
        (n < minimum, V_SUPPORT, f"N_scored_below_{minimum}"),
        (span <= limit, V_DEGENERATE, "score_range_at_or_below_tau_score"),
        (F.coalesce("exact_points", F.lit(0)) < min_points, V_DEGENERATE, "unique_proxy_values_below_3"),
        (F.coalesce("admissible_points", F.lit(0)) < min_points, V_DEGENERATE, "admissible_exact_points_below_3"),
        (F.coalesce("reachable", F.lit(0)) < min_points, V_DEGENERATE, "canonical_reachable_grid_points_below_3"),
        (F.coalesce("span", F.lit(0.0)) <= 0, V_DEGENERATE, "AURC_nonpositive_span")]
    reason, verdict = None, None
    for cond, v, r in gates:
        reason = F.when(cond, r) if reason is None else reason.when(cond, r)
        verdict = F.when(cond, v) if verdict is None else verdict.when(cond, v)
    for name, v in SHAPE_VERDICT.items():
        verdict = verdict.when(F.col("shape") == name, v)
    out = out.withColumns({"n_scored": n, "reason": reason, "verdict": verdict})
    ok = F.col("reason").isNull()
    summary = out.select(*k, "n_scored", "s_min", "s_max", "exact_points", "admissible_points", "reason", "verdict",
                         F.when(ok, "evaluated").otherwise("not_evaluable").alias("gate"),
                         *[F.when(ok, F.col(c)).alias(c) for c in ("area", "span", "normalized", "shape")])
    return {"summary": summary, "grid": grid, "points": points}


def order_positions(rows: DataFrame, keys: list[str], band: int = 64) -> DataFrame:
    """1-based position of each cell by reliability (highest first), then row and column.

    Equal reliabilities may be a whole unit (a hard mask), so a tie group is cut into bands of rows: the place of a
    band comes from counts, the place inside it from its own rows, and the offset travels by band.
    """
    b = rows.withColumn("_b", F.floor(F.col("r") / band))
    counts = b.groupBy(*keys, "rel", "_b").agg(F.count("*").alias("_n"))
    place = running_sums(counts, keys, [F.desc("rel"), "_b"], F.floor(-F.col("rel") * 4096), {"_upto": F.col("_n")})
    place = place.select(*keys, "rel", "_b", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = b.withColumn("_pos", F.row_number().over(W.partitionBy(*keys, "rel", "_b").orderBy("r", "c")))
    return inside.join(place, [*keys, "rel", "_b"]).withColumn("position", F.col("_pos") + F.col("_before")).drop("_b", "_pos", "_before")


def entered(res: DataFrame, keys: list[str], pop: DataFrame, targets: int) -> DataFrame:
    """Supported cells with ``q``, the smallest target whose first ceil(q n / targets) cells include them."""
    ranked = order_positions(res.where(F.col("e").isNotNull()), keys)
    q = F.floor((F.col("position") - 1) * targets / F.col("denominator").cast("decimal(20,0)")) + 1
    return ranked.join(pop, keys).withColumn("q", q.cast("long"))


def nested_order_statistics(spark: SparkSession, counted: DataFrame, keys: list[str], wanted: DataFrame, targets: int, width: float, chunk: int = 4096) -> DataFrame:
    """Values at given ranks within nested sets: the members of target q are all rows that entered at q or before.

    ``counted``: keys, q (entry target), v, _n (rows); ``wanted``: keys, q, name, rank (from 0). Rows are cut by value into
    chunks of about ``chunk``; counts by chunk and entry target, summed over targets and then over chunks, tell in which
    chunk a rank lies, and only such chunks are opened, each with the ranks that fall into it. No row is copied per target.
    """
    run = running_sums(counted, keys, ["v", "q"], F.floor(F.col("v") / width), {"_cum": F.col("_n")})
    cut = io.materialize(spark, run.withColumn("_chunk", F.floor((F.col("_cum") - 1) / chunk)).drop("_cum"), "chunks")
    sizes = cut.groupBy(*keys, "_chunk", "q").agg(F.sum("_n").alias("_n"))
    full = sizes.select(*keys, "_chunk").distinct().withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(targets).cast("long"))))
    over_q = W.partitionBy(*keys, "_chunk").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    held = full.join(sizes, [*keys, "_chunk", "q"], "left").withColumn("_h", F.coalesce(F.sum("_n").over(over_q), F.lit(0)))
    over_chunk = W.partitionBy(*keys, "q").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    held = held.withColumn("_to", F.sum("_h").over(over_chunk)).where("_h > 0")
    ask = held.join(wanted, [*keys, "q"]).where((F.col("rank") >= F.col("_to") - F.col("_h")) & (F.col("rank") < F.col("_to")))
    ask = ask.select(*keys, "_chunk", "q", "name", (F.col("rank") - F.col("_to") + F.col("_h")).alias("_at"))
    ask = io.materialize(spark, ask, "ranks")
    kind = {f.name: f.dataType for f in cut.schema.fields}
    schema = T.StructType([*[T.StructField(k, kind[k]) for k in keys], T.StructField("q", T.LongType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])

    def look(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return asks[[*keys, "q", "name"]].assign(value=[])
        v, q, n = (rows[x].to_numpy() for x in ("v", "q", "_n"))
        order = np.lexsort((q, v))
        v, q, n = v[order], q[order], n[order]
        target, at, out = asks["q"].to_numpy(), asks["_at"].to_numpy(), np.empty(len(asks))
        for t in np.unique(target):
            part = target == t
            out[part] = v[np.searchsorted(np.cumsum(np.where(q <= t, n, 0)), at[part], side="right")]
        return asks[[*keys, "q", "name"]].assign(value=out)
    return cut.groupBy(*keys, "_chunk").cogroup(ask.groupBy(*keys, "_chunk")).applyInPandas(look, schema)


def curve_quantiles(spark: SparkSession, res: DataFrame, keys: list[str], targets: int = 100, width: float = 1 / 4096) -> DataFrame:
    """Exact median and P90 of |error| at every reachable coverage target of the curve (linear interpolation)."""
    pop = io.materialize(spark, res.groupBy(*keys).agg(F.count("*").alias("denominator"), F.count("e").alias("supported")), "curve-units")
    counted = entered(res, keys, pop, targets).groupBy(*keys, "q", F.abs("e").cast("double").alias("v")).agg(F.count("*").alias("_n"))
    need = F.ceil(F.col("q") * F.col("denominator") / F.lit(targets).cast("decimal(20,0)")).cast("long")
    ks = pop.withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(targets).cast("long")))).withColumn("selected", need)
    ks = io.materialize(spark, ks.where(F.col("selected").between(1, F.col("supported"))).select(*keys, "q", "selected"), "curve-targets")
    at = {n: (F.col("selected") - 1) * F.lit(p) for n, p in (("median_abs", 0.5), ("p90_abs", 0.9))}
    ranks = F.array(*[F.struct(F.lit(f"{side}_{n}").alias("name"), f(x).cast("long").alias("rank")) for n, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    wanted = ks.select(*keys, "q", F.explode(ranks).alias("_w")).select(*keys, "q", "_w.*")
    got = nested_order_statistics(spark, counted, keys, wanted, targets, width)
    wide = got.groupBy(*keys, "q").agg(*[F.max(F.when(F.col("name") == f"{side}_{n}", F.col("value"))).alias(f"{side}_{n}") for n in at for side in ("lo", "hi")])
    between = {n: F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * (x - F.floor(x)) for n, x in at.items()}
    return ks.join(wide, [*keys, "q"]).select(*keys, "q", "selected", *[v.alias(n) for n, v in between.items()])


def coverage_curve(res: DataFrame, keys: list[str], targets: int = 100) -> DataFrame:
    """Metrics of the first ceil(q n) cells by reliability for q = 1..targets percent.

    A cell enters at one target and stays in all later ones. Counts and sums
    are taken per entry target and then accumulated over at most ``targets``
    rows, so cells are never multiplied by the number of targets.
    """
    pop = res.groupBy(*keys).agg(F.count("*").alias("denominator"), F.count("e").alias("supported"))
    n = F.col("denominator")
    per_q = entered(res, keys, pop, targets).groupBy(*keys, "q").agg(F.count("*").alias("_n"), F.sum(F.abs("e")).alias("_s"))
    ks = pop.withColumn("q", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(targets).cast("long"))))
    w = W.partitionBy(*keys).orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    g = ks.join(per_q, [*keys, "q"], "left").withColumns({"_n": F.sum("_n").over(w), "_s": F.sum("_s").over(w)})
    need = F.ceil(F.col("q") * n / F.lit(targets).cast("decimal(20,0)")).cast("long")
    ok = need <= F.col("supported")
    return g.select(*keys, "q", "denominator", "supported", ratio(F.col("supported"), n).alias("maximum_coverage"),
                    F.when(ok, "reachable").otherwise("not_reachable").alias("status"), F.when(ok, need).otherwise(F.lit(0)).alias("selected"),
                    F.when(ok, F.col("_s") / F.col("_n")).alias("mae"), F.when(ok, ratio(need, n)).alias("actual_coverage"))


def convergence_gate(spark: SparkSession, compared: Callable[[tuple, tuple], DataFrame], counts: list[int], distances: list[float]) -> DataFrame:
    """Choose the smallest azimuth count, then the smallest search distance, whose next larger setting changes nothing that matters.

    ``compared(lower, upper)`` gives one row (n, rho, max_abs, p99_abs, converged) for two settings (count, distance). Counts are
    compared at the largest distance, distances at the chosen count, and the chosen pair once more with
    both doubled (up to the largest distance). The last row is the outcome.
    """
    out, far = [], distances[-1]

    def first(step: str, pairs: list[tuple[tuple, tuple]]) -> tuple | None:
        chosen = None
        for lower, upper in pairs:
            row = compared(lower, upper).first()
            out.append((step, f"{lower[0]} x {lower[1]:g}", f"{upper[0]} x {upper[1]:g}", row["n"], row["rho"], row["max_abs"], row["p99_abs"], row["converged"]))
            chosen = chosen or (lower if row["converged"] else None)
        return chosen
    found = first("azimuth", [((a, far), (b, far)) for a, b in zip(counts, counts[1:])])
    if found:
        found = first("distance", [((found[0], a), (found[0], b)) for a, b in zip(distances, distances[1:])])
    if found:
        ok = first("cross_check", [(found, (2 * found[0], min(2 * found[1], far)))])
        out.append(("passed" if ok else "cross_check_failed", f"{found[0]} x {found[1]:g}", None, None, None, None, None, ok is not None))
    else:
        out.append(("not_converged", None, None, None, None, None, None, False))
    return spark.createDataFrame(out, "step string, lower string, upper string, n long, rho double, max_abs double, p99_abs double, converged boolean")


def comparison_scope(curve: DataFrame, unit: list[str], targets: int = 100) -> DataFrame:
    """Largest coverage that every method of a unit reaches, and whether a point of a curve may be compared across methods."""
    common = curve.groupBy(*unit).agg(F.min("maximum_coverage").alias("common_maximum"))
    inside = (F.col("status") == "reachable") & (F.col("q") / targets <= F.col("common_maximum") + 1e-12)
    return curve.join(common, unit).withColumn("comparison_scope", F.when(inside, "common_reachable").otherwise("extended_or_unreachable"))


DEFINITIONS = ["ndvi", "brightness"]


def surface_values(rho4: Column, rho5: Column) -> Column:
    """Array of (definition, value) for the two surface measures; null where undefined."""
    from ..functions import pixel
    values = {"ndvi": pixel.ndvi(rho4, rho5, 1e-6, bounded=False), "brightness": pixel.brightness(rho4, rho5)}
    return F.array(*[F.struct(F.lit(n).alias("definition"), values[n].alias("value")) for n in DEFINITIONS])


def with_surface(df: DataFrame) -> DataFrame:
    return (df.withColumn("_d", F.explode(surface_values(F.col("rho4"), F.col("rho5")))).select("*", "_d.*").drop("_d")
            .where(F.col("value").isNotNull()))


def quartile_cuts(land: DataFrame, keys: list[str], folds: list[dict]) -> DataFrame:
    """Quartile cut points of each surface measure over the calibration domain of every fold."""
    rows = with_surface(land.select(*keys, "zone", "rho4", "rho5"))
    return fd.quantiles_by_fold(rows, [*keys, "definition"], folds, fd.DOMAIN, F.col("value"), {"t1": 0.25, "t2": 0.5, "t3": 0.75}, 1 / 4096)


def quartile_metrics(res: DataFrame, cuts: DataFrame, unit: list[str], cut_keys: list[str]) -> DataFrame:
    """Metrics per stratum and method over the common lit cells, plus a ``global`` line.

    Cut points come from calibration cells only and are applied to holdout cells.
    """
    v, cuts = F.col("value"), io.materialize(res.sparkSession, cuts, "cuts")
    rows = with_surface(res.where("lit")).join(cuts, [*cut_keys, "definition"])
    stratum = F.when(v <= F.col("t1"), "q1").when(v <= F.col("t2"), "q2").when(v <= F.col("t3"), "q3").otherwise("q4")
    rows = rows.withColumn("stratum", F.explode(F.array(F.lit("global"), stratum)))
    p = two_pass_profile(rows, [*unit, "definition", "stratum", "method"], F.abs("e"), {"p90": 0.9}, 1 / 4096)
    return p.select(*unit, "definition", "stratum", "method", F.col("rows").alias("n"), (F.col("total") / F.col("valid")).alias("mae"), "p90")


def ranking_verdicts(metrics: DataFrame, unit: list[str], minimum: int) -> DataFrame:
    """Method order overall and per sufficient stratum, reversals, strict wins and the sensitivity flag."""
    k = [*unit, "definition"]
    order = F.sort_array(F.collect_list(F.struct("mae", "method")))  # one entry per method
    r = metrics.groupBy(*k, "stratum").agg(order.alias("o"), F.min("n").alias("n"))
    r = r.select(*k, "stratum", "n", F.array_join(F.transform("o", lambda x: x["method"]), ">").alias("ranking"),
                 F.col("o")[0]["method"].alias("first"),
                 (F.get("o", F.lit(1)).isNotNull() & (F.col("o")[0]["mae"] < F.get("o", F.lit(1))["mae"])).alias("strict"))
    g = r.where("stratum = 'global'").select(*k, F.col("ranking").alias("global_ranking"), F.col("first").alias("_winner"))
    s = r.where(F.col("stratum") != "global").join(g, k)
    enough = F.col("n") >= minimum
    out = s.groupBy(*k, "global_ranking").agg(
        F.count_if(enough).alias("sufficient_strata"), F.count_if(enough & (F.col("ranking") != F.col("global_ranking"))).alias("reversed_strata"),
        F.count_if(enough & F.col("strict") & (F.col("first") == F.col("_winner"))).alias("strict_wins"))
    return out.withColumn("sensitive", (F.col("reversed_strata") >= 2) | ((F.col("sufficient_strata") > 0) & (F.col("strict_wins") <= 1)))
