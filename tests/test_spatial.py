"""Candidate search, components, sky view and change propagation against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import candidates as cd, grid, joins as jn, lineage as ln, skyview, spatial as st


def cells(spark, **layers):
    names = list(layers)
    h, w = layers[names[0]].shape
    rows = [(r, c, *[float(layers[n][r, c]) for n in names]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "r long, c long, " + ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("absent", [0.0, 0.25])
def test_candidates_against_brute_force(spark, absent):
    rng = np.random.default_rng(8)
    land = (rng.uniform(size=(70, 22)) < 0.03).astype(int)
    land[5:60] = 0  # sparse on purpose: the nearest cell lies beyond the first search band
    land[65, 20] = land[1, 1] = 1
    df = cells(spark, land=land).withColumn("land", F.col("land").cast("int"))
    gone = rng.uniform(size=land.shape) < absent
    gone[69, 21] = False  # the extent is that of the cells present
    gone[0, 0] = absent > 0
    keep = [(int(r), int(c)) for r, c in zip(*np.nonzero(~gone))]
    df = df.join(spark.createDataFrame(keep, "r long, c long"), ["r", "c"])
    land[gone] = 0
    buf = 4
    cores = cd.scan_cores(df, [5], 7)
    near = {(r["r0"], r["c0"]): r["nearest_outside"] for r in cd.nearest_outside(spark, cores, df.select("r", "c", F.col("land").alias("m")), buf).collect()}
    pre = cd.prefixes(df, ["land"], 8).persist()
    hold = {(r["r0"], r["c0"]): r["holdout_land"] for r in cd.rectangle_counts(cores, pre, ["land"]).collect()}
    buff = {(r["r0"], r["c0"]): r["near_land"] for r in cd.buffer_counts(cores, pre, ["land"], buf).collect()}
    starts = {(r, c) for r in sorted({*range(0, 66, 7), 65}) for c in sorted({*range(0, 18, 7), 17})}
    assert set(near) == set(hold) == set(buff) == starts
    rr, cc = np.nonzero(land)
    for r0, c0 in starts:
        d = np.hypot(np.maximum(np.maximum(r0 - rr, rr - r0 - 4), 0), np.maximum(np.maximum(c0 - cc, cc - c0 - 4), 0))
        assert hold[r0, c0] == (d == 0).sum() and buff[r0, c0] == (d < buf).sum()
        out = d[d >= buf]
        assert near[r0, c0] == (pytest.approx(out.min()) if len(out) else None)


def test_prefix_sums_with_absent_cells(spark):
    m = (np.random.default_rng(2).uniform(size=(9, 7)) < 0.5).astype(int)
    gone = {(3, 3), (7, 5), (0, 4), (0, 0)}
    rows = [(r, c, int(m[r, c])) for r in range(9) for c in range(7) if (r, c) not in gone]
    for x in gone:
        m[x] = 0
    got = {(r["r"], r["c"]): r["integral"] for r in grid.integral_image(spark.createDataFrame(rows, "r long, c long, m int"), 4).collect()}
    want = m.cumsum(axis=0).cumsum(axis=1)
    assert got == {(r, c): want[r, c] for r in range(9) for c in range(7)}


def test_descent_has_no_depth_limit(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "src string, dst string")
    roots = spark.createDataFrame([("0",)], "node string")
    assert {r["node"]: r["depth"] for r in ln.descendants(spark, e, roots).collect()} == {str(i): i for i in range(1, 13)}


def overlap(a, b):
    return a[1] < b[1] + b[0] and b[1] < a[1] + a[0] and a[2] < b[2] + b[0] and b[2] < a[2] + a[0]


def test_greedy_selection(spark):
    rng = np.random.default_rng(9)
    cand = sorted({(int(e), int(r), int(c)) for e, r, c in zip(rng.choice([4, 6], 60), rng.integers(0, 25, 60), rng.integers(0, 25, 60))})
    df = spark.createDataFrame([("x", r, c, e) for e, r, c in cand] + [("y", r, c, e) for e, r, c in cand[::2]], "kind string, r0 long, c0 long, edge int")
    got = cd.greedy_nonoverlap(spark, df, ["kind"]).collect()
    for kind, pool in (("x", cand), ("y", cand[::2])):
        want = []
        for k in pool:
            if not any(overlap(k, s) for s in want):
                want.append(k)
        assert sorted((r["edge"], r["r0"], r["c0"]) for r in got if r["kind"] == kind) == sorted(want)


def test_greedy_selection_over_tiles(spark, monkeypatch):
    """A chain of overlapping cores across many small tiles, and a dense field; few writes for a long chain."""
    written, write = [], cd.io.materialize
    monkeypatch.setattr(cd.io, "materialize", lambda s, df, name: written.append(name) or write(s, df, name))
    chain = [(6, 4 * i, 0) for i in range(150)]
    rng = np.random.default_rng(4)
    field = sorted({(int(e), int(r), int(c)) for e, r, c in zip(rng.choice([3, 5], 500), rng.integers(0, 60, 500), rng.integers(0, 60, 500))})
    df = spark.createDataFrame([(k, r, c, e) for k, pool in (("chain", chain), ("field", field)) for e, r, c in pool], "kind string, r0 long, c0 long, edge int")
    for tile in (16, 512):
        written.clear()
        got = cd.greedy_nonoverlap(spark, df, ["kind"], tile).collect()
        assert tile == 16 or len(written) < 10
        for kind, pool in (("chain", chain), ("field", field)):
            want = []
            for k in pool:
                if not any(overlap(k, s) for s in want):
                    want.append(k)
            assert sorted((r["edge"], r["r0"], r["c0"]) for r in got if r["kind"] == kind) == sorted(want)


def test_maximin_selection(spark):
    rng = np.random.default_rng(10)
    cand = sorted({(5, int(r), int(c), int(n)) for r, c, n in zip(rng.integers(0, 60, 40), rng.integers(0, 60, 40), rng.integers(1, 90, 40))})
    df = spark.createDataFrame([(r, c, e, r + 2.5, c + 2.5, n) for e, r, c, n in cand], "r0 long, c0 long, edge int, centre_r double, centre_c double, n long")
    got = [(r["edge"], r["r0"], r["c0"]) for r in cd.maximin(spark, df.withColumn("g", F.lit("x")), ["g"], 4, [F.col("n"), -F.col("edge"), -F.col("r0"), -F.col("c0")]).orderBy("pick").collect()]
    chosen = [min(cand, key=lambda k: (-k[3], k[:3]))]
    while len(chosen) < 4:
        free = [k for k in cand if not any(overlap(k, s) for s in chosen)]
        chosen.append(min(free, key=lambda k: (-min(np.hypot(k[1] - s[1], k[2] - s[2]) for s in chosen), -k[3], k[:3])))
    assert got == [k[:3] for k in chosen]


def label(m):
    seen, sizes = set(), []
    for start in zip(*np.nonzero(m)):
        if start in seen:
            continue
        stack, n = [start], 0
        seen.add(start)
        while stack:
            r, c = stack.pop()
            n += 1
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    k = (r + i, c + j)
                    if 0 <= k[0] < m.shape[0] and 0 <= k[1] < m.shape[1] and m[k] and k not in seen:
                        seen.add(k)
                        stack.append(k)
        sizes.append(n)
    return sorted(sizes)


def test_components(spark):
    rng = np.random.default_rng(11)
    m = (rng.uniform(size=(16, 18)) < 0.35).astype(int)
    m[0, :] = 1  # one long run
    df = cells(spark, m=m).where("m = 1")
    got = st.components(spark, df).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == label(m)


def test_sky_view_flat_and_tiles(spark):
    flat = cells(spark, z=np.full((9, 9), 5.0))
    assert {r["v_sky"] for r in skyview.sky_view(flat, "z", 30.0, 4, 90.0).collect()} == {1.0}
    rng = np.random.default_rng(12)
    dem = cells(spark, z=rng.uniform(0, 60, (17, 13)))
    a, b = ({(r["r"], r["c"]): r["v_sky"] for r in skyview.sky_view(dem, "z", 30.0, 8, 120.0, tile=t).collect()} for t in (5, 256))
    pts = dem.select((F.col("r") * 100 + F.col("c")).alias("pid"), "r", "c")
    j = {(r["pid"] // 100, r["pid"] % 100): r["v_sky"] for r in skyview.sky_view_join(pts, dem, "z", 30.0, 8, 120.0).collect()}
    assert a == pytest.approx(b) and a == pytest.approx(j) and len(a) == 17 * 13


def test_sky_view_gap_is_null(spark):
    z = np.full((7, 7), 5.0)
    dem = cells(spark, z=z).withColumn("z", F.when((F.col("r") == 3) & (F.col("c") == 5), None).otherwise(F.col("z")))
    v = {(r["r"], r["c"]): r["v_sky"] for r in skyview.sky_view(dem, "z", 30.0, 4, 60.0).collect()}
    assert v[3, 4] is None and v[3, 5] is None and v[0, 0] == 1.0


def test_sampled_pairs_stay_in_the_sample(spark):
    pts = spark.range(500).select(F.lit(1).alias("k"), F.floor(F.col("id") / 25).alias("r"), (F.col("id") % 25).alias("c"), F.col("id").cast("double").alias("v"))
    s = st.sample_points(pts, ["k"], 40, "seed")
    assert s.count() == 40 and s.agg(F.max("i")).first()[0] == 39 and s.first()["n"] == 40
    assert sorted(s.select("r", "c").collect()) == sorted(st.sample_points(pts.repartition(5), ["k"], 40, "seed").select("r", "c").collect())
    p = st.sample_pairs(s, ["k"], 100, "seed")
    assert p.count() <= 100 and p.where("dist = 0").count() == 0


def test_nearest_date_brute_force(spark):
    rng = np.random.default_rng(13)
    days = [(int(k), int(x)) for k, x in zip(rng.integers(0, 3, 60), rng.integers(0, 300, 60))]
    refs = [(int(k), int(x)) for k, x in zip(rng.integers(0, 2, 25), rng.integers(0, 300, 25))]
    mk = lambda rows: spark.createDataFrame(rows, "d int, n int").select("d", F.date_add(F.lit("2015-01-01").cast("date"), F.col("n")).alias("day"))
    got = {(r["d"], (r["day"] - __import__("datetime").date(2015, 1, 1)).days): r["match"] for r in jn.nearest_date(mk(days), mk(refs), "d").collect()}
    for k, x in set(days):
        gap = min((abs(x - y) for j, y in refs if j == k), default=99)
        assert got[k, x] == ("tight" if gap <= 3 else "loose" if gap <= 7 else "unmatched")


def consumers(spark, rows):
    return ln.influence(spark.createDataFrame(rows, "consumer string, role string, r0 long, c0 long, r1 long, c1 long, radius long"))


def test_change_classes(spark):
    z = np.zeros((10, 10))
    z2 = z.copy()
    z2[4, 4] = 3.0
    cons = consumers(spark, [("near", "x", 5, 5, 6, 6, 1), ("far", "x", 0, 0, 2, 2, 0), ("wide", "x", 0, 7, 2, 8, 1), ("out", "x", 8, 8, 10, 10, 1)])
    box = lambda w: {"r0": F.lit(0), "c0": F.lit(0), "r1": F.lit(10), "c1": F.lit(w)}
    wide_old = ln.change_classes(cons.where("consumer = 'wide'").withColumn("ir0", F.lit(0)), cells(spark, z=z), cells(spark, z=z2), box(8), box(10)).first()
    got = {r["consumer"]: r for r in ln.change_classes(cons, cells(spark, z=z), cells(spark, z=z2), box(10), box(10)).collect()}
    assert got["near"]["change_class"] == "value_change_in_scope" and got["near"]["differing"] == 1 and got["near"]["max_delta"] == 3.0
    assert got["far"]["change_class"] == "artifact_only" and got["out"]["insufficient"] and wide_old["change_class"] == "scope_extension"


def test_marks_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "b")], "src string, dst string")  # with a cycle
    bad = spark.createDataFrame([("a",)], "node string")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    m = {r["node"]: (r["mark"], r["path"]) for r in ln.propagate(nodes, bad, ln.descendants(spark, e, bad)).collect()}
    assert m["a"] == ("invalidated", "a") and m["d"] == ("quarantined", "a>b>c>d") and m["x"] == ("valid", None) and m["y"][0] == "valid"


def test_unregistered_consumer_stops(spark):
    c = spark.createDataFrame([("k", "known"), ("u", "unknown")], "consumer string, role string")
    reg = spark.createDataFrame([("known", 3)], "role string, radius long")
    assert ln.unregistered(c, reg).count() == 1
    with pytest.raises(Exception, match="unregistered"):
        ln.registered(c, reg).collect()


def test_stale_cache_and_wrong_receipt_stop(spark):
    now = spark.createDataFrame([("k", "d1")], "consumer string, digest string")
    assert ln.load_cached(now, now).count() == 1
    with pytest.raises(Exception, match="cache"):
        ln.load_cached(spark.createDataFrame([("k", "d0")], "consumer string, digest string"), now).collect()


def test_rollback_over_versions(spark, tmp_path):
    schema, f = "node string, mark string", str(tmp_path)
    first = ln.publish_marks(spark.createDataFrame([("n", "valid"), ("m", "valid"), (None, "valid")], schema).repartition(3), f, 1)
    second = ln.publish_marks(spark.createDataFrame([("n", "invalidated"), ("m", "quarantined"), (None, "valid")], schema), f, 2)
    for version, wrong in ((1, second), (2, first)):
        with pytest.raises(ValueError, match="receipt"):
            ln.rollback(spark, f, version, wrong, 3)
    assert not (tmp_path / "marks" / "version=3").exists()
    back = ln.rollback(spark, f, 1, first, 3)
    assert sorted(back.collect(), key=str) == sorted(ln.marks_of(spark, f, 1).collect(), key=str)
    again = ln.rollback(spark, f, 2, second, 4)  # a rollback can be taken back
    assert {r["node"]: r["mark"] for r in again.collect()} == {"n": "invalidated", "m": "quarantined", None: "valid"}
    with pytest.raises(Exception, match="(?i)exists"):
        ln.publish_marks(back, f, 2)
    spark.createDataFrame([("n", "valid")], schema).write.mode("append").parquet(f"{f}/marks/version=1")  # stored marks changed later
    assert not ln.agrees(spark, f, 1, first)
    empty = ln.publish_marks(spark.createDataFrame([], schema), f, 5)
    assert ln.rollback(spark, f, 5, empty, 6).count() == 0


def test_maximin_of_many_groups_at_once(spark):
    """32 groups, some with fewer cores than picks, in one set of rounds."""
    rng = np.random.default_rng(21)
    cand = sorted({(g, int(r), int(c), int(n)) for g in range(32) for r, c, n in zip(*rng.integers(0, 40, (2, 1 + g)), rng.integers(1, 4, 1 + g))})
    df = spark.createDataFrame([(g, r, c, 6, r + 3.0, c + 3.0, n) for g, r, c, n in cand], "g int, r0 long, c0 long, edge int, centre_r double, centre_c double, n long")
    got = {}
    for x in cd.maximin(spark, df, ["g"], 5, [F.col("n"), -F.col("r0"), -F.col("c0")]).orderBy("g", "pick").collect():
        got.setdefault(x["g"], []).append((x["r0"], x["c0"]))
    for g in range(32):
        own = [x[1:] for x in cand if x[0] == g]
        chosen = [min(own, key=lambda k: (-k[2], k[:2]))]
        while len(chosen) < 5:
            free = [k for k in own if all(abs(k[0] - s[0]) >= 6 or abs(k[1] - s[1]) >= 6 for s in chosen)]
            if not free:
                break
            chosen.append(min(free, key=lambda k: (-min(np.hypot(k[0] - s[0], k[1] - s[1]) for s in chosen), -k[2], k[:2])))
        assert got[g] == [k[:2] for k in chosen]


def test_lag_sums_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(1000, 30, (23, 31))
    z[rng.random(z.shape) < 0.2] = np.nan
    pts = [(k, int(r), int(c), float(z[r, c]) if (r + k) % 5 else None) for k in (1, 2) for r, c in np.ndindex(z.shape) if not np.isnan(z[r, c])]
    df = spark.createDataFrame(pts, "k int, r long, c long, v double")
    edges = {1: [0.0, 3.0, 5.0, 11.0], 2: [4.0, 4.5, 30.0, 40.0]}
    e = spark.createDataFrame(list(edges.items()), "k int, edges array<double>")
    for tile in (8, 64):
        got = {(r["k"], r["lag"]): (r["pairs"], r["dist"], r["half_sq"]) for r in st.lag_sums(df, ["k"], e, tile).collect()}
        for k, cuts in edges.items():
            p = np.array([x[1:] for x in pts if x[0] == k and x[3] is not None])
            i, j = np.triu_indices(len(p), 1)
            d, g = np.hypot(*(p[i, :2] - p[j, :2]).T), (p[i, 2] - p[j, 2]) ** 2 / 2
            for lag in range(3):
                m = (d > 0) & (d >= cuts[lag]) & ((d < cuts[lag + 1]) | ((lag == 2) & (d <= cuts[3])))
                assert (k, lag) in got or not m.any()
                if m.any():
                    assert got[k, lag][0] == m.sum() and np.allclose(got[k, lag][1:], (d[m].sum(), g[m].sum()), rtol=1e-9)


def test_pairs_within_a_radius(spark, monkeypatch):
    """All pairs nearer than a radius, by brute force; on a long strip a tile meets few others cell by cell."""
    rng = np.random.default_rng(7)
    pts = [(1, int(r), int(c), float(rng.normal())) for r, c in np.ndindex(60, 40) if rng.random() < 0.3] + [(2, 3 * i, int(rng.integers(5)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(pts, "k int, r long, c long, v double")
    radii = {(1, 0): 3.0, (1, 1): 35.5, (2, 0): 4.0, (2, 1): 451.0}
    rd = spark.createDataFrame([(*k, x) for k, x in radii.items()], "k int, ring int, radius double")
    counts, meet = [], st.met
    monkeypatch.setattr(st, "met", lambda pairs, *a: counts.append({tuple(x)[:2]: x[2] for x in pairs.groupBy("k", "ring").count().collect()}) or meet(pairs, *a))
    for tile in (4, 16):
        got = {(x["k"], x["ring"]): (x["pairs"], x["half_sq"]) for x in st.pairs_within(df, ["k"], rd, tile).collect()}
        for k, far in radii.items():
            p = np.array([x[1:] for x in pts if x[0] == k[0]])
            i, j = np.triu_indices(len(p), 1)
            m = np.hypot(*(p[i, :2] - p[j, :2]).T) < far
            assert got[k][0] == m.sum() and got[k][1] == pytest.approx(((p[i, 2] - p[j, 2]) ** 2 / 2)[m].sum(), rel=1e-9)
    assert counts[0][2, 1] < 10 * 450  # some 225 rows of tiles, two columns; all pairs of tiles were 25,000 and more


def test_variogram_names_population_and_pairs(spark):
    df = spark.range(200).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), F.when(F.col("id") != 7, F.col("id") % 20).cast("double").alias("v"))
    rows = st.variogram(df, (10, 20), 30.0, 5, 0.5, 30).collect()
    assert {r["population"] for r in rows} == {199} and all(r["sufficient"] == (r["pairs"] >= 30) for r in rows)
    p = [(i // 20, i % 20) for i in range(200) if i != 7]
    assert sum(r["pairs"] for r in rows) == sum(0 < np.hypot(a[0] - b[0], a[1] - b[1]) <= 5 for n, a in enumerate(p) for b in p[:n])


def test_two_bins_of_dependent_and_independent_residuals(spark):
    rng = np.random.default_rng(6)
    rows = [("noise", r, c, float(rng.normal())) for r in range(16) for c in range(16)]
    rows += [("few", r, c, 1.0 * r) for r in range(10) for c in range(10)] + [("flat", r, c, 0.5) for r in range(16) for c in range(16)]
    rows += [("narrow", 0, c, float(rng.normal())) for c in range(3)] + [("rings", r, c, float((r // 3 + c // 3) % 2 * 0 + (np.hypot(r - 8, c - 8) > 11))) for r in range(16) for c in range(16)]
    df = spark.createDataFrame(rows, "u string, r long, c long, e double")
    got = {x["u"]: x for x in st.two_bin_check(df, ["u"], 3.0).collect()}
    assert got["few"]["status"] == got["narrow"]["status"] == "inconclusive_insufficient_residual_support" and got["few"]["pairs1"] is None
    assert got["flat"]["status"] == "inconclusive_insufficient_lag_support" and got["flat"]["pairs1"] > 200
    assert got["noise"]["status"] == "no_warning_at_resolved_lags" and got["noise"]["support"] == 256
    narrow = st.two_bin_check(df.where("u = 'narrow'"), ["u"], 3.0, min_support=2).first()
    assert narrow["status"] == "inconclusive_core_extent"


def pyramid_sky(z, res, n_az, steps):
    """Cell by cell on means of 1, 2 and 4 cells, with curvature."""
    h, w = z.shape
    level = {f: np.array([[np.nanmean(z[i:i + f, j:j + f]) for j in range(0, w, f)] for i in range(0, h, f)]) for f in (1, 2, 4)}

    def at(f, y, x):
        a = level[f]
        y = min(max((min(max(y, 0), h - 1) - (f - 1) / 2) / f, 0), a.shape[0] - 1)
        x = min(max((min(max(x, 0), w - 1) - (f - 1) / 2) / f, 0), a.shape[1] - 1)
        i, j = int(y), int(x)
        return sum(a[min(i + p, a.shape[0] - 1), min(j + q, a.shape[1] - 1)] * (y - i if p else 1 - y + i) * (x - j if q else 1 - x + j) for p in (0, 1) for q in (0, 1))
    out = {}
    for r, c in np.ndindex(z.shape):
        total = 0.0
        for a in range(n_az):
            t, before = 0.0, 0.0
            for d in steps:
                f = round((d - before) / res)
                before = d
                y, x = r - d * np.cos(2 * np.pi * a / n_az) / res, c + d * np.sin(2 * np.pi * a / n_az) / res
                t = max(t, (at(f, y, x) - z[r, c] - d * d / (2 * 6371000.0)) / d)
            total += 1 / (1 + t * t)
        out[r, c] = total / n_az
    return out


def test_far_ridge_is_seen_across_the_steps(spark):
    """A ridge 8 km to the east of flat land: read from the coarsest level, seen at 10 km, not at 5 km; tiles do not matter."""
    z = np.zeros((2, 300))
    z[:, 264:276] = 900.0
    dem = cells(spark, z=z)
    near = {(r["r"], r["c"]): r["v_sky"] for r in skyview.far_sky_view(dem, "z", 30.0, 4, 5000.0, tile=64).collect()}
    far = {(r["r"], r["c"]): r["v_sky"] for r in skyview.far_sky_view(dem, "z", 30.0, 4, 10_000.0, tile=64).collect()}
    wide = {(r["r"], r["c"]): r["v_sky"] for r in skyview.far_sky_view(dem, "z", 30.0, 4, 10_000.0, tile=256).collect()}
    assert near[0, 0] == 1.0 and far[0, 0] < 0.999 and far == wide
    from ridgeline.functions import arrays
    want = pyramid_sky(z[:, ::1], 30.0, 4, arrays.growing_distances(10_000.0, 30.0))
    assert all(abs(far[k] - want[k]) < 1e-12 for k in want)


def test_far_search_equals_the_plain_one_where_it_must(spark):
    """Within 1 km both read the same cells; on a plane means are exact at any distance inside the grid."""
    rng = np.random.default_rng(8)
    rough = cells(spark, z=rng.uniform(0, 400, (30, 40)))
    a, b = ({(r["r"], r["c"]): r["v_sky"] for r in f(rough, "z", 30.0, 8, 900.0, curvature=True).collect()} for f in (skyview.sky_view, skyview.far_sky_view))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    slope = cells(spark, z=np.add.outer(np.arange(120) * 3.0, np.zeros(6)))
    a, b = ({(r["r"], r["c"]): r["v_sky"] for r in f(slope, "z", 30.0, 2, 1500.0, curvature=True).collect()} for f in (skyview.sky_view, skyview.far_sky_view))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a if 51 <= k[0] < 69)
    gap = rough.withColumn("z", F.when((F.col("r") == 5) & (F.col("c") == 6), None).otherwise(F.col("z")))
    v = {(r["r"], r["c"]): r["v_sky"] for r in skyview.far_sky_view(gap, "z", 30.0, 8, 90.0).collect()}
    assert v[5, 6] is None and v[5, 7] is None and v[20, 30] is not None


def test_one_far_search_serves_all_settings(spark):
    rng = np.random.default_rng(3)
    z = np.add.outer(60 * rng.random(44), 40 * rng.random(30))
    z[20, 7] = np.nan
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in np.ndindex(z.shape) if (r, c) not in ((0, 0), (43, 29), (12, 3))]
    dem = spark.createDataFrame(rows, "r long, c long, z double")
    counts, distances = [4, 8], [300.0, 1500.0]
    every = skyview.far_sky_views(dem, "z", 30.0, counts, distances, tile=16).collect()
    for n in counts:
        for far in distances:
            one = {(x["r"], x["c"]): x["v_sky"] for x in skyview.far_sky_view(dem, "z", 30.0, n, far, tile=64).collect()}
            assert len(one) == len(every)
            for x in every:
                v = x[skyview.setting_name(n, far)]
                assert (v is None) == (one[x["r"], x["c"]] is None) and (v is None or v == pytest.approx(one[x["r"], x["c"]], abs=1e-12))


def test_components_send_no_labels_through_the_driver(spark, monkeypatch):
    plans, write = [], st.io.materialize
    monkeypatch.setattr(st.io, "materialize", lambda s, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(s, df, name))
    mask = spark.range(200).select(F.col("id").alias("r"), (F.col("id") % 3).alias("c"))
    assert st.components(spark, mask).select("label").distinct().count() == 67
    assert plans and not any("Broadcast" in p for p in plans)


def test_sight_lines_take_more_parts_as_they_grow(spark, monkeypatch):
    """A part holds a bounded number of samples, and its size changes no value."""
    rng = np.random.default_rng(12)
    dem = cells(spark, z=rng.uniform(0, 60, (12, 9)))
    pts = dem.select((F.col("r") * 100 + F.col("c")).alias("pid"), "r", "c")
    want = {x["pid"]: x["v_sky"] for x in skyview.sky_view_join(pts, dem, "z", 30.0, 8, 120.0).collect()}
    monkeypatch.setattr(skyview, "SAMPLES", 200)
    few = skyview.sky_view_join(pts, dem, "z", 30.0, 8, 120.0)
    assert f", {-(-108 * 32 // 200)}), REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()
    assert {x["pid"]: x["v_sky"] for x in few.collect()} == pytest.approx(want, abs=1e-12)
