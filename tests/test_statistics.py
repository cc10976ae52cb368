"""Quantiles, ranks, curves and fits against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import pixel
from ridgeline.operators import fit, folds as fd, identify as idn, models, risk, support as sp
from ridgeline.operators.prefix import average_ranks, exact_quantiles, value_profile
from ridgeline.sources import io

SMALL = "/root/testdata/sf0.001"


def test_quantiles_with_one_hot_key(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(x)) for x in np.round(rng.normal(0, 1, 4000), 2)] + [("one", 3.0)] + [("two", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    q = {r["k"]: r for r in value_profile(df, ["k"], F.col("v"), {"a": 0.25, "b": 0.9}, 0.01, {"s": F.col("v")}).collect()}
    hot = np.array([v for k, v in rows if k == "hot"])
    assert q["hot"]["a"] == pytest.approx(np.percentile(hot, 25)) and q["hot"]["b"] == pytest.approx(np.percentile(hot, 90))
    assert q["hot"]["total"] == pytest.approx(hot.sum()) and q["one"]["b"] == 3.0
    assert (q["two"]["rows"], q["two"]["valid"], q["two"]["a"]) == (3, 2, 1.25)


def test_error_metrics_keep_few_rows(spark, monkeypatch):
    """Distinct errors are counted by bucket; only the buckets of the quantiles are opened."""
    rng, kept = np.random.default_rng(3), []
    rows = [("hot", float(x)) for x in rng.normal(0, 0.1, 5000)] + [("one", 0.5)] + [("two", None), ("two", -1.0), ("two", 2.0)] + [("none", None)]
    write = io.materialize
    monkeypatch.setattr(io, "materialize", lambda s, df, name: kept.append(write(s, df, name)) or kept[-1])
    got = {r["k"]: r for r in fit.error_metrics(spark.createDataFrame(rows, "k string, e double"), ["k"]).collect()}
    assert kept and sum(x.count() for x in kept) < 300
    for k in ("hot", "one", "two"):
        e = np.array([v for u, v in rows if u == k and v is not None])
        assert got[k]["count"] == len(e) and got[k]["population"] == sum(u == k for u, _ in rows) and got[k]["bias"] == pytest.approx(e.mean())
        assert [got[k][x] for x in ("mae", "median_abs", "p90_abs")] == pytest.approx([abs(e).mean(), np.percentile(abs(e), 50), np.percentile(abs(e), 90)])
    assert set(got) == {"hot", "one", "two"}


def test_equal_errors_have_equal_means(spark):
    """In whatever order they are read, so that a tie between methods stays one."""
    rng = np.random.default_rng(5)
    e = rng.normal(0, 0.1, 700)
    rows = [(k, float(x)) for k in range(12) for x in rng.permutation(e)]
    got = fit.error_metrics(spark.createDataFrame(rows, "k long, e double").repartition(3), ["k"]).collect()
    assert len(got) == 12 and len({r["mae"] for r in got}) == 1


def test_width_does_not_change_quantiles(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), (F.rand(7) * 10).alias("v")).persist()
    got = [exact_quantiles(df, ["k"], F.col("v"), {"p": 0.37}, w).first()["p"] for w in (1e-4, 0.5, 100.0)]
    assert got[0] == got[1] == got[2]


def test_average_ranks(spark):
    v = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    assert {r["i"]: r["rk"] for r in average_ranks(df, "v", 0.5, "rk").collect()} == {0: 4.0, 1: 1.0, 2: 4.0, 3: 2.0, 4: 4.0}


def points(spark, score, e, den):
    rows = spark.createDataFrame([(1, float(s), float(x)) for s, x in zip(score, e)], "u int, s double, e double").select("u", F.col("s").cast("float").alias("score"), "e")
    d = spark.createDataFrame([(1, den)], "u int, denominator long")
    return risk.exact_points(rows, ["u"], d, ["u"])


def test_ties_are_accepted_together(spark):
    p = points(spark, [0.1, 0.1, 0.2, 0.3], [1, -3, 2, 4], 5).orderBy("point").collect()
    assert [r["accepted"] for r in p] == [2, 3, 4] and p[0]["mae"] == 2.0
    assert [r["coverage"] for r in p] == [0.4, 0.6, 0.8] and {r["points"] for r in p} == {3}


def curve(spark, pts):
    return spark.createDataFrame([(1, i + 1, a, a / 10, float(m), 10) for i, (a, m) in enumerate(pts)],
                                 "u int, point long, accepted long, coverage double, mae double, denominator long").withColumn("score", F.col("coverage"))


def test_fixed_grid_states(spark):
    g = risk.fixed_grid(curve(spark, [(2, 1.0), (5, 2.0)]), ["u"]).orderBy("q").collect()
    st = [(r["q"], r["status"], r["reason"], r["point"]) for r in g]
    assert len(g) == 20
    assert st[2] == (3, "unreachable", "below_min_accepted_support", None)
    assert st[3] == (4, "reachable", None, 1) and st[4] == (5, "duplicate", "duplicate_exact_point", 1)
    assert st[9] == (10, "reachable", None, 2) and st[10] == (11, "unreachable", "above_max_reachable_coverage", None)


def test_staircase(spark):
    p = curve(spark, [(2, 1.0), (5, 2.0), (10, 4.0)])
    for b in (F.lit(0), F.col("point")):  # one bucket, or one per point
        a = risk.staircase_area(p, ["u"], b).first()
        assert a["area"] == pytest.approx(1.0 * 0.3 + 2.0 * 0.5) and a["span"] == pytest.approx(0.8) and a["normalized"] == pytest.approx(1.3 / 0.8)
    assert risk.staircase_area(curve(spark, [(2, 1.0)]), ["u"], F.lit(0)).first()["area"] is None


@pytest.mark.parametrize("mae,shape", [([1, 1, 1], "flat"), ([1, 2, 3], "order_consistent"), ([3, 2, 1], "order_inverted"), ([1, 3, 2], "mixed")])
def test_shapes(spark, mae, shape):
    g = spark.createDataFrame([(1, i, "reachable", float(m)) for i, m in enumerate(mae)], "u int, q long, status string, mae double")
    assert risk.curve_shape(g, ["u"], 1e-12, 1e-12).first()["shape"] == shape


def test_coverage_curve_against_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 37
    rel, e, has = np.round(rng.uniform(size=n), 1), rng.normal(size=n), rng.uniform(size=n) < 0.8
    rows = [(1, i // 6, i % 6, float(rel[i]), float(e[i]) if has[i] else None) for i in range(n)]
    got = risk.coverage_curve(spark.createDataFrame(rows, "u int, r long, c long, rel double, e double"), ["u"]).orderBy("q").collect()
    order = sorted((i for i in range(n) if has[i]), key=lambda i: (-rel[i], i // 6, i % 6))
    for r in got:
        need = -(-r["q"] * n // 100)
        if need <= len(order):
            assert r["status"] == "reachable" and r["selected"] == need and r["mae"] == pytest.approx(np.abs(e[order[:need]]).mean())
        else:
            assert r["status"] == "not_reachable" and r["mae"] is None


def test_gates_name_a_reason_for_every_scope(spark):
    unit = spark.createDataFrame([(1, 10, 0, True), (2, 10, 8, False), (3, 10, 8, True)], "u int, core_total long, core_land long, unit_scored boolean")
    rows = spark.createDataFrame([(3, 0.5, 0.5, 0.1)] * 3, "u int, cos_i double, s double, e double").select("u", "cos_i", F.col("s").cast("float").alias("score"), "e")
    s = risk.evaluate_scopes(rows, unit, ["u"], 2, 3, 1)["summary"].where("scope = 'unit_all_scored'").orderBy("u").collect()
    assert [r["reason"] for r in s] == ["zero_base_valid_land_denominator", "unit_gate_not_scored", "score_range_at_or_below_tau_score"]


def test_two_level_median_is_not_pooled(spark):
    rows = [("A", 1, 2.0), ("A", 2, 4.0), ("B", 1, 9.0), ("B", 2, 9.0), ("B", 3, 9.0)]
    m = sp.two_level_median(spark.createDataFrame(rows, "a string, k int, v double"), [], ["a"], "v").first()
    assert m["median"] == 6.0 and m["units"] == 2


def test_bounded_fit_against_a_fine_grid(spark):
    rng = np.random.default_rng(1)
    for true_a, true_d in [(0.4, 0.02), (0.4, 0.3), (1.3, 0.0), (0.5, -0.2), (-0.3, 0.0)]:
        x = rng.uniform(0.1, 1, 60)
        y = true_a * x + true_d + rng.normal(0, 0.01, 60)
        args = [F.lit(float(v)) for v in (60, x.sum(), y.sum(), (x * x).sum(), (x * y).sum(), (y * y).sum())]
        b = spark.range(1).select(fit.bounded_two_parameter(*args).alias("b")).first()["b"]
        a, sh = np.meshgrid(np.linspace(0, 1, 201), np.linspace(0, 0.1, 101))
        obj = sum((a * xi + sh * a - yi) ** 2 for xi, yi in zip(x, y)).min()
        assert 0 <= b["alpha"] <= 1 and -1e-12 <= b["d"] <= 0.1 * b["alpha"] + 1e-12
        assert b["objective"] <= obj + 1e-9


def test_gram_solve(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(size=(50, 2)), rng.uniform(size=50)
    g, b = x.T @ x, x.T @ y
    s = fit.gram_solve(*[F.lit(float(v)) for v in (g[0, 0], g[0, 1], g[1, 1], b[0], b[1])])
    r = spark.range(1).select(*[v.alias(k) for k, v in s.items()]).first()
    t = np.linalg.lstsq(x, y, rcond=None)[0]
    sv = np.linalg.svd(x, compute_uv=False)
    assert (r["theta1"], r["theta2"]) == (pytest.approx(t[0]), pytest.approx(t[1])) and r["condition"] == pytest.approx(sv[0] / sv[1]) and not r["rank_short"]


def test_inversion_recovers_albedo(spark):
    cos = [0.5, 0.7, 0.9]
    df = spark.createDataFrame([(1, c) for c in cos], "g int, x double")
    mu, w = pixel.soft_response(1.0, F.col("x")), pixel.support_weight(F.col("x"))
    r = fit.weighted_inversion(df.withColumn("y", mu * 0.3), ["g"], mu, F.col("y"), w).first()
    assert r["albedo"] == pytest.approx(0.3) and r["residual_std"] == pytest.approx(0, abs=1e-7) and r["n"] == 3


def test_holdout_keeps_unsupported_units(spark):
    folds = [{"k": 1, "r0": 0, "c0": 0, "r1": 9, "c1": 1}, {"k": 2, "r0": 0, "c0": 6, "r1": 9, "c1": 7}]
    rows = [(1, r, c, 0.2 * 0.5, 0.4 * 0.5, 0.5, 0.5, True, True) for r in range(10) for c in range(12)]
    px = spark.createDataFrame(rows, "a int, r long, c long, rho4 double, rho5 double, cos_i double, mu double, land boolean, lit boolean")
    acq = spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string")
    u = {(r["a"], r["k"], r["band"]): r for r in fit.holdout_units(px, acq, folds, 5).collect()}
    assert len(u) == 8
    assert u[1, 1, "B4"]["alpha"] == pytest.approx(0.2) and u[1, 2, "B5"]["mae"] == pytest.approx(0, abs=1e-12)
    assert u[2, 1, "B4"]["state"] == "unsupported_calibration" and u[2, 1, "B4"]["reason"] == fit.R_SUPPORT and u[2, 1, "B4"]["core_total"] == 0


def test_zone_sums_equal_the_long_form(spark):
    rng = np.random.default_rng(6)
    rows = [(1, int(r), int(c), float(rng.uniform())) for r in range(20) for c in range(30)]
    df = spark.createDataFrame(rows, "a int, r long, c long, v double")
    folds = [{"k": 1, "r0": 2, "c0": 3, "r1": 8, "c1": 9}, {"k": 2, "r0": 5, "c0": 15, "r1": 12, "c1": 20}]
    z = fd.with_zone(df, folds, 3.5)
    a = {r["k"]: r["s"] for r in fd.sums_by_fold(z, ["a"], folds, fd.DOMAIN, {"s": F.col("v")}).collect()}
    for f in folds:
        want = sum(v for _, r, c, v in rows if np.hypot(max(f["r0"] - r, r - f["r1"], 0), max(f["c0"] - c, c - f["c1"], 0)) >= 3.5)
        assert a[f["k"]] == pytest.approx(want)
    t = spark.createDataFrame([(f["k"], f["r0"], f["c0"], f["r1"], f["c1"]) for f in folds], "k int, r0 long, c0 long, r1 long, c1 long")
    by_zone = fd.explode_roles(z, folds, (fd.CORE, fd.BUFFER)).select("r", "c", "k", "role").collect()
    for block in (5, 64):
        by_join = fd.roles_by_join(df, t, 3.5, block).select("r", "c", "k", "role").collect()
        assert sorted(by_zone) == sorted(by_join) and len(by_join) > 0
    q = {r["k"]: r["p"] for r in fd.quantiles_by_fold(z, ["a"], folds, fd.DOMAIN, F.col("v"), {"p": 0.3}, 1 / 64).collect()}
    for f in folds:
        vals = [v for _, r, c, v in rows if np.hypot(max(f["r0"] - r, r - f["r1"], 0), max(f["c0"] - c, c - f["c1"], 0)) >= 3.5]
        assert q[f["k"]] == pytest.approx(np.percentile(vals, 30))


MODELS = {
    "single": (idn.Model(["a"], lambda t: [F.col("x")]), [0.4], ("not_applicable", 1)),
    "product": (idn.Model(["p", "q"], lambda t: [F.col("x") * t[1], F.col("x") * t[0]]), [0.8, 0.5], ("ok", 1)),
    "offset": (idn.Model(["a", "b"], lambda t: [F.col("x"), F.lit(1.0)]), [0.4, 0.05], ("ok", 2)),
    "scaled": (idn.Model(["s", "a", "b"], lambda t: [F.col("x") * t[1] + t[2], F.col("x") * t[0], F.lit(t[0])]), [0.9, 0.4, 0.05], ("ok", 2)),
}


@pytest.mark.parametrize("name", list(MODELS))
def test_known_ranks(spark, name):
    model, theta, (status, rank) = MODELS[name]
    x = spark.range(60).select((F.col("id") / 59.0 * 0.9 + 0.1).alias("x")).repartition(3)
    cols = [f"j{i}" for i in range(len(model.params))]
    j = idn.jacobian_rows(x, model, [theta])
    s = idn.spectrum(j, ["start"], cols).first()
    assert (s["status"], s["rank"]) == (status, rank)
    if status == "ok":
        m = np.array(j.select(*cols).collect())
        assert s["singular"][0] == pytest.approx(np.linalg.svd(m, compute_uv=False)[0])
        if rank < len(cols):
            assert np.linalg.norm(m @ np.array(s["null_direction"])) < 1e-10


def test_too_few_rows_is_no_rank_statement(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "g int, j0 double, j1 double")
    assert idn.spectrum(df, ["g"], ["j0", "j1"]).first()["status"] == "insufficient_data"


@pytest.mark.parametrize("good, last", [(lambda a, b: True, ("passed", "4 x 90")), (lambda a, b: False, ("not_converged", None)),
                                        (lambda a, b: a[0] >= 8, ("passed", "8 x 90")), (lambda a, b: a != (4, 90.0) or b != (8, 180.0), ("cross_check_failed", "4 x 90"))])
def test_convergence_gate_outcomes(spark, good, last):
    def compared(lower, upper):
        return spark.createDataFrame([(5, 1.0, 0.0, 0.0, good(lower, upper))], "n long, rho double, max_abs double, p99_abs double, converged boolean")
    rows = risk.convergence_gate(spark, compared, [4, 8, 16], [90.0, 180.0, 360.0]).collect()
    assert (rows[-1]["step"], rows[-1]["lower"]) == last


def test_comparison_scope(spark):
    rows = [(1, "x", 50, 0.8, "reachable"), (1, "y", 50, 0.6, "reachable"), (1, "x", 70, 0.8, "reachable"), (1, "y", 70, 0.6, "not_reachable")]
    df = spark.createDataFrame(rows, "a int, method string, q int, maximum_coverage double, status string")
    got = {(r["method"], r["q"]): (r["common_maximum"], r["comparison_scope"]) for r in risk.comparison_scope(df, ["a"]).collect()}
    assert got["x", 50] == got["y", 50] == (0.6, "common_reachable") and got["x", 70] == got["y", 70] == (0.6, "extended_or_unreachable")


def test_requalification_needs_all_gates(spark):
    from ridgeline.plans.modeling import requalify
    df = spark.createDataFrame([(1, 0.2, 0.2, 1, 1), (2, 0.2, 0.2, 0, 1), (3, 0.2, 0.2, 1, 0), (4, 0.05, 0.05, 1, 1)], "a int, iqr double, med double, anchors long, operators long")
    got = {r["a"]: r["verdict"] for r in requalify(df).collect()}
    assert [a for a, v in got.items() if v == "requalification_warranted"] == [1]


def residual_rows(n, units, share):
    """Residuals of several units; the first holds ``share`` of the rows, and one method has a single reliability."""
    rng = np.random.default_rng(17)
    out = []
    for u in range(units):
        size = int(n * share) if u == 0 else max(3, int(n * (1 - share) / (units - 1)))
        for i in range(size):
            e = None if rng.random() < 0.15 else float(np.round(rng.normal(0, 0.05), 3))
            out.append((u, "hard" if u % 2 == 0 else "soft", i // 50, i % 50, e, 1.0 if u % 2 == 0 else float(np.float32(rng.random()))))
    return out


def test_curve_quantiles_at_every_percent(spark):
    rows = residual_rows(4000, 5, 0.9)
    df = spark.createDataFrame(rows, "a int, method string, r long, c long, e double, rel double")
    got = {(r["a"], r["q"]): (r["selected"], r["median_abs"], r["p90_abs"]) for r in risk.curve_quantiles(spark, df, ["a", "method"]).collect()}
    n = 0
    for u in range(5):
        own = [x for x in rows if x[0] == u]
        order = [abs(x[4]) for x in sorted((x for x in own if x[4] is not None), key=lambda x: (-x[5], x[2], x[3]))]
        for q in range(1, 101):
            need = -(-q * len(own) // 100)
            if need <= len(order):
                n += 1
                assert got[u, q][0] == need and np.allclose(got[u, q][1:], np.quantile(order[:need], [0.5, 0.9]), atol=1e-12)
    assert len(got) == n


def test_nested_statistics_open_few_chunks(spark):
    """Small chunks give the same values, and a hot unit is spread over groups of about the chunk's size."""
    rows = residual_rows(3000, 2, 0.9)
    df = spark.createDataFrame(rows, "a int, method string, r long, c long, e double, rel double")
    pop = df.groupBy("a").agg(F.count("*").alias("denominator"), F.count("e").alias("supported"))
    counted = risk.entered(df, ["a"], pop, 20).groupBy("a", "q", F.abs("e").alias("v")).agg(F.count("*").alias("_n"))
    wanted = spark.createDataFrame([(0, q, "x", q * 3) for q in range(1, 16)], "a int, q long, name string, rank long")
    a, b = (sorted(map(tuple, risk.nested_order_statistics(spark, counted, ["a"], wanted, 20, 1 / 64, chunk).collect())) for chunk in (16, 100_000))
    assert a == b and len(a) == 15


def test_positions_of_one_reliability_are_spread(spark):
    """A unit of 90 % of the rows with one reliability: places are right and no window holds more than a band of rows."""
    rows = residual_rows(9000, 3, 0.9)
    df = spark.createDataFrame(rows, "a int, method string, r long, c long, e double, rel double")
    got = {(x["a"], x["r"], x["c"]): x["position"] for x in risk.order_positions(df, ["a"], band=8).collect()}
    for u in range(3):
        own = sorted((x for x in rows if x[0] == u), key=lambda x: (-x[5], x[2], x[3]))
        assert [got[u, x[2], x[3]] for x in own] == list(range(1, len(own) + 1))
    assert df.groupBy("a", "rel", F.floor(F.col("r") / 8)).count().agg(F.max("count")).first()[0] <= 8 * 50


def recorded(monkeypatch):
    """Names of the intermediates that are written from here on; tables of earlier tests are not read."""
    names, write = [], io.materialize
    monkeypatch.setattr(io, "REUSE", False)
    monkeypatch.setattr(io, "materialize", lambda s, df, name: names.append((name, df.columns)) or write(s, df, name))
    return names


def test_transferred_slopes_need_no_scores(spark, monkeypatch):
    from ridgeline import plans
    want = sorted(plans.QUERIES["ag28_leave_acquisition_out"](spark, SMALL).collect())
    monkeypatch.setattr(io, "REUSE", False)
    monkeypatch.setattr(fit, "scored_residuals", lambda *a: pytest.fail("scored"))
    assert want and sorted(plans.QUERIES["ag28_leave_acquisition_out"](spark, SMALL).collect()) == want


def test_units_are_scored_in_one_pass(spark, monkeypatch):
    from ridgeline import plans
    from ridgeline.sources import config, views
    names = recorded(monkeypatch)
    rows = plans.QUERIES["ar06_nested_record"](spark, SMALL).collect()
    assert rows and "histogram" not in [n for n, _ in names]
    px, split = views.px_table(spark, SMALL), fd.time_split(views.acq(spark, SMALL), ["day", "a"])
    one, two = ({(r["a"], r["k"], r["band"]): r for r in fit.holdout_units(px, split, config.FOLDS, config.MIN_CALIBRATION, quantiles=q).collect()} for q in (False, True))
    assert set(one) == set(two) and any(r["mae"] for r in one.values())
    for k, r in one.items():
        assert [r[x] for x in ("count", "core_scored", "state")] == [two[k][x] for x in ("count", "core_scored", "state")]
        assert all((r[x] is None) == (two[k][x] is None) and (r[x] is None or r[x] == pytest.approx(two[k][x], abs=1e-12)) for x in ("mae", "bias"))
    rng = np.random.default_rng(5)
    e = rng.normal(0, 0.1, 700)
    df = spark.createDataFrame([(k, float(x)) for k in range(12) for x in rng.permutation(e)], "k long, e double").repartition(3)
    assert len({r["mae"] for r in fit.error_metrics(df, ["k"], quantiles=False).collect()}) == 1  # ties stay ties


def test_candidates_are_fitted_from_narrow_land_cells(spark, monkeypatch):
    from ridgeline import plans
    from ridgeline.sources import config, views
    names = recorded(monkeypatch)
    assert len(plans.QUERIES["md05_verdict_rules"](spark, SMALL).collect()) > 0
    wide = [c for _, c in names if "v_sky" in c]
    assert wide and all(len(c) <= 9 for c in wide) and "histogram" not in [n for n, _ in names]
    split = fd.time_split(views.acq(spark, SMALL), ["day", "a"])
    cells = [views.px_sky(spark, SMALL), views.land_sky_table(spark, SMALL)]
    assert cells[1].count() == cells[0].where("land").count()
    full, land = ({(r["a"], r["k"], r["band"], r["candidate"]): r for r in models.ablation(
        fd.with_zone(c, config.FOLDS, fit.BUFFER_CELLS), split, config.FOLDS, config.MIN_CALIBRATION, 0.05, quantiles=q).collect()} for c, q in zip(cells, (True, False)))
    assert set(full) == set(land)
    for k, r in land.items():
        assert [r[x] for x in ("n", "core_land", "state", "reason", "count")] == [full[k][x] for x in ("n", "core_land", "state", "reason", "count")]
        assert r["mae"] == (None if full[k]["mae"] is None else pytest.approx(full[k]["mae"], abs=1e-9))
