"""Fold search, spatial statistics, sky view, grid identity and change propagation."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays, geometry as geo
from ..functions.numeric import ratio
from ..operators import candidates as cd, fit, folds as fd, grid, lineage as ln, risk, skyview, spatial as st
from ..sources import io, views
from ..sources.config import FOLDS, MIN_CALIBRATION
from .aggregates import zoned
from .common import C, long, r6c, rounded, text_list
from .duck import r6 as R
from .pixels import DIGEST
from .registry import query

EDGES, STRIDE, BUF = [6, 10], 4, 5
NAMES = ["land", "shadow", "near_zero", "lit"]
THRESHOLDS = [(c, h, k) for c in (200, 400) for h in (20, 30) for k in (3, 5)]  # calibration x holdout x risk minima
TRIPLE = ["min_calibration", "min_holdout", "min_risk"]


def classes(s, d):
    p = C("p_size")
    return views.dem(s, d).select("r", "c", *[x.cast("int").alias(n) for n, x in (
        ("land", p <= 35), ("shadow", p <= 5), ("near_zero", p.between(6, 10)), ("lit", p.between(11, 35)))])


def records(s, d):
    return io.derived(s, d, "candidates", lambda: cd.candidate_records(s, classes(s, d), EDGES, STRIDE, BUF, NAMES))


@query("sp01_sky_view", f"SELECT r, c, {R('v_sky')} AS v_sky FROM vsky")
def sky_view(s, d):
    return views.sky(s, d).select("r", "c", *r6c("v_sky"))


@query("sp01_sky_view_join_form", f"SELECT r, c, {R('v_sky')} AS v_sky FROM vsky")
def sky_view_join_form(s, d):
    dem = views.dem(s, d)
    pts = dem.select((C("r") * 2**31 + C("c")).alias("pid"), "r", "c")
    v = skyview.sky_view_join(pts, dem, "zf", views.RES, 8, 150.0)
    return v.select(F.shiftright("pid", 31).alias("r"), (C("pid") % 2**31).alias("c"), *r6c("v_sky"))


@query("sp02_halo_tiles", """SELECT tr, tc, count(*) AS cells, count(*) FILTER (WHERE r//16=tr AND c//16=tc) AS owned, sum(p_size)::BIGINT AS total FROM
    (SELECT d.*, tr, tc FROM dem d, (SELECT * FROM range(0,100000) t(tr)) a, (SELECT * FROM range(0,5) t(tc)) b WHERE tr BETWEEN greatest((r-3)//16,0) AND (r+3)//16
     AND tc BETWEEN greatest((c-3)//16,0) AND (c+3)//16 AND tr<=(SELECT rmax FROM ext)//16+1) GROUP BY tr, tc""")
def halo_tiles(s, d):
    t = grid.halo_tiles(views.dem(s, d), 16, 3)
    return t.groupBy(C("_tr").alias("tr"), C("_tc").alias("tc")).agg(
        F.count("*").alias("cells"), F.count_if((F.floor(C("r") / 16) == C("_tr")) & (F.floor(C("c") / 16) == C("_tc"))).alias("owned"), F.sum("p_size").alias("total"))


def far_sql(settings):
    """Sight lines of every cell on the pyramid, in long form."""
    steps = {d: arrays.growing_distances(d, views.RES) for _, d in settings}
    width = lambda d: [round((x - y) / views.RES) for x, y in zip(steps[d], [0.0, *steps[d]])]
    rows = ",".join(f"({n},{dist:g}e0,{x:g}e0,{f})" for n, dist in settings for x, f in zip(steps[dist], width(dist)))
    corner = lambda i, j: f"LEFT JOIN lv l{i}{j} ON l{i}{j}.f=s.f AND l{i}{j}.r=least(y0+{i}, rmax//s.f) AND l{i}{j}.c=least(x0+{j}, cmax//s.f)"
    part = lambda i, j: f"CASE WHEN {'wy' if i else '(1-wy)'}*{'wx' if j else '(1-wx)'}>0 THEN {'wy' if i else '(1-wy)'}*{'wx' if j else '(1-wx)'}*l{i}{j}.z ELSE 0 END"
    pairs = [(0, 0), (1, 0), (0, 1), (1, 1)]
    return f"""WITH lv AS MATERIALIZED (SELECT f, r//f AS r, c//f AS c, avg(zf) AS z FROM dem, (VALUES (1),(2),(4)) q(f) GROUP BY 1,2,3),
    st AS (SELECT * FROM (VALUES {rows}) q(n_az, distance, dist, f)),
    w AS (SELECT d.r AS pr, d.c AS pc, d.zf AS z0, st.*, az, d.r-dist*cos(az*(2*pi()/n_az))/30e0 AS y, d.c+dist*sin(az*(2*pi()/n_az))/30e0 AS x FROM dem d, st, range(0,144) t(az) WHERE az<n_az),
    k AS (SELECT w.*, rmax, cmax, least(greatest((least(greatest(y,0),rmax)-(f-1)/2e0)/f,0),rmax//f) AS yy, least(greatest((least(greatest(x,0),cmax)-(f-1)/2e0)/f,0),cmax//f) AS xx FROM w, ext),
    s AS (SELECT *, floor(yy)::BIGINT AS y0, floor(xx)::BIGINT AS x0, yy-floor(yy) AS wy, xx-floor(xx) AS wx FROM k),
    h AS (SELECT pr, pc, n_az, distance, az, greatest(max(({"+".join(part(*p) for p in pairs)}-z0-dist*dist/(2*6371000e0))/dist),0e0) AS t FROM s {" ".join(corner(*p) for p in pairs)} GROUP BY 1,2,3,4,5)
    SELECT n_az, distance, pr AS r, pc AS c, {R('avg(1e0/(1e0+t*t))')} AS v_sky FROM h GROUP BY 1,2,3,4"""


FAR_SETTINGS = [(36, 10000.0), (72, 5000.0)]


@query("sp01_far_sky_view", far_sql(FAR_SETTINGS))
def far_sky_view(s, d):
    """Two settings of the far search, with curvature."""
    dem, out = views.dem(s, d), None
    for n, dist in FAR_SETTINGS:
        v = skyview.far_sky_view(dem, "zf", views.RES, n, dist).select(F.lit(n).alias("n_az"), F.lit(dist).alias("distance"), "r", "c", *r6c("v_sky"))
        out = v if out is None else out.unionByName(v)
    return out


@query("sp03_convergence_gate")
def convergence_gate(s, d):
    """Azimuth counts 36 to 144 and distances 5 to 20 km, with curvature, over every cell."""
    counts, distances = [36, 72, 144], [5000.0, 10000.0, 20000.0]
    maps = io.materialize(s, skyview.far_sky_views(views.dem(s, d), "zf", views.RES, counts, distances), "sky")

    def compared(lower, upper):
        pair = maps.select("r", "c", *[C(skyview.setting_name(*k)).alias(n) for k, n in ((lower, "u"), (upper, "w"))])
        g = risk.agreement(pair.where("u IS NOT NULL AND w IS NOT NULL"), "u", "w", 1 / 4096)
        return g.select("n", *r6c("rho", "max_abs", "p99_abs"),
                        F.coalesce((C("max_abs") <= 0.01) & (C("p99_abs") <= 0.005) & (C("rho") >= 0.999), F.lit(False)).alias("converged"))
    return risk.convergence_gate(s, compared, counts, distances)


@query("sp04_fold_topology", f"""SELECT k, 6e0 AS nearest_other_core, core AS core_cells, buffer AS buffer_cells, dom AS domain_cells, total AS total_cells, {R('mind')} AS min_core_domain_distance,
    mind>=3 AS isolated, core+buffer+dom=total AS partition_closes FROM (SELECT k, count(*) FILTER (WHERE g=0) AS core, count(*) FILTER (WHERE g>0 AND g<3) AS buffer,
    count(*) FILTER (WHERE g>=3) AS dom, count(*) AS total, min(CASE WHEN g>=3 THEN g END)::DOUBLE AS mind FROM (SELECT k, greatest(c0-c, c-c1, 0) AS g FROM dem, fold) GROUP BY k)""")
def fold_topology(s, d):
    t = fd.topology(views.dem(s, d), FOLDS, fit.BUFFER_CELLS)
    return t.withColumn("min_core_domain_distance", rounded(v="min_core_domain_distance")[0])


@query("sp05_checkerboard", """SELECT r//8 AS block_row, c//8 AS block_col, sum(m)::BIGINT AS land_cells, CASE WHEN (r//8+c//8)%2=0 THEN 'calibration' ELSE 'holdout' END AS split FROM zmask, ext
    WHERE (r//8)*8+5<=rmax AND (c//8)*8+5<=cmax AND r%8<6 AND c%8<6 GROUP BY 1, 2, 4 HAVING sum(m)>=8""")
def checkerboard(s, d):
    return fd.checkerboard(views.zero_mask(s, d), 6, 2, 8)


@query("sp06_candidate_scan", "SELECT r0, c0, edge, r1, c1 FROM core0")
def candidate_scan(s, d):
    return cd.scan_cores(classes(s, d), EDGES, STRIDE)


@query("sp07_rectangle_counts", "SELECT r0, c0, edge, holdout_land, holdout_shadow, holdout_near_zero, holdout_lit FROM cand")
def rectangle_counts(s, d):
    cells = classes(s, d)
    return cd.rectangle_counts(cd.scan_cores(cells, EDGES, STRIDE), cd.prefixes(cells, NAMES), NAMES)


@query("sp08_buffer_counts", "SELECT r0, c0, edge, near_land FROM cand")
def buffer_counts(s, d):
    cells = classes(s, d)
    return cd.buffer_counts(cd.scan_cores(cells, EDGES, STRIDE), cd.prefixes(cells, ["land"]), ["land"], BUF)


@query("sp09_nearest_outside", f"SELECT r0, c0, edge, {R('nearest_outside')} AS nearest_outside FROM cand")
def nearest_outside(s, d):
    cells = classes(s, d)
    n = cd.nearest_outside(s, cd.scan_cores(cells, EDGES, STRIDE), cells.select("r", "c", C("land").alias("m")), BUF)
    return n.select(*cd.ID, *r6c("nearest_outside"))


@query("sp10_candidate_record", f"""SELECT r0, c0, edge, holdout_land, near_land, calibration_land, holdout_shadow, holdout_near_zero, calibration_shadow, {R('nearest_outside')} AS nearest_outside,
    coalesce(nearest_outside,1e9)+1e-9>=5 AS distance_ok, r0+(edge-1)/2e0+5e-1 AS centre_r, c0+(edge-1)/2e0+5e-1 AS centre_c FROM cand""")
def candidate_record(s, d):
    return records(s, d).select(*cd.ID, "holdout_land", "near_land", "calibration_land", "holdout_shadow", "holdout_near_zero", "calibration_shadow",
                                *r6c("nearest_outside"), "distance_ok", "centre_r", "centre_c")


@query("flt14_threshold_predicate", "SELECT min_calibration, min_holdout, min_risk, kind, r0, c0, edge FROM qual")
def threshold_predicate(s, d):
    return cd.qualifying(records(s, d), THRESHOLDS).select(*TRIPLE, "kind", *cd.ID)


@query("tk01_top_candidates", """SELECT min_calibration, min_holdout, min_risk, kind, rank, r0, c0, edge, p AS primary_count FROM (SELECT *, row_number() OVER (PARTITION BY min_calibration, min_holdout, min_risk, kind ORDER BY p DESC, holdout_land DESC, calibration_land DESC, edge, r0, c0) AS rank
    FROM (SELECT *, CASE kind WHEN 'shadow' THEN holdout_shadow WHEN 'near_zero' THEN holdout_near_zero WHEN 'combined_risk' THEN holdout_shadow+holdout_near_zero ELSE holdout_land END AS p FROM qual)) WHERE rank<=5""")
def top_candidates(s, d):
    t = cd.top_candidates(cd.qualifying(records(s, d), THRESHOLDS))
    return t.select(*TRIPLE, "kind", long("rank").alias("rank"), *cd.ID, "primary_count")


@query("sp11_greedy_nonoverlap")
def greedy_nonoverlap(s, d):
    return cd.greedy_nonoverlap(s, cd.qualifying(records(s, d), THRESHOLDS), [*TRIPLE, "kind"])


SP12 = """WITH RECURSIVE q AS MATERIALIZED (SELECT min_calibration, min_holdout, min_risk, kind, r0, c0, edge, r0+(edge-1)/2e0+5e-1 AS y, c0+(edge-1)/2e0+5e-1 AS x,
      CASE WHEN kind='clean' THEN 0 ELSE least(holdout_shadow, holdout_near_zero) END AS t0, CASE WHEN kind='clean' THEN 0 ELSE holdout_shadow+holdout_near_zero END AS t1, holdout_land, calibration_land FROM qual),
    g AS (SELECT min_calibration, min_holdout, min_risk, kind, 1 AS pick, r0, c0, edge, NULL::DOUBLE AS gap, [{'y': y, 'x': x, 'r': r0, 'c': c0, 'e': edge}] AS s FROM q
      QUALIFY row_number() OVER (PARTITION BY min_calibration, min_holdout, min_risk, kind ORDER BY t0 DESC, t1 DESC, holdout_land DESC, calibration_land DESC, edge, r0, c0)=1
      UNION ALL SELECT min_calibration, min_holdout, min_risk, kind, pick, r0, c0, edge, gap, list_append(s, {'y': y, 'x': x, 'r': r0, 'c': c0, 'e': edge}) FROM (
        SELECT q.*, g.pick+1 AS pick, s, list_min(list_transform(s, lambda p: sqrt((p.y-q.y)*(p.y-q.y)+(p.x-q.x)*(p.x-q.x)))) AS gap FROM g JOIN q USING (min_calibration, min_holdout, min_risk, kind)
        WHERE g.pick<5 AND len(list_filter(s, lambda p: p.r<q.r0+q.edge AND q.r0<p.r+p.e AND p.c<q.c0+q.edge AND q.c0<p.c+p.e))=0)
      QUALIFY row_number() OVER (PARTITION BY min_calibration, min_holdout, min_risk, kind ORDER BY gap DESC, t0 DESC, t1 DESC, holdout_land DESC, calibration_land DESC, edge, r0, c0)=1)
    """


@query("sp12_maximin_folds", SP12 + f"SELECT min_calibration, min_holdout, min_risk, kind, pick, r0, c0, edge, {R('gap')} AS gap FROM g")
def maximin_folds(s, d):
    m = cd.maximin(s, cd.qualifying(records(s, d), THRESHOLDS), [*TRIPLE, "kind"], 5, cd.pick_order())
    return m.select(*TRIPLE, "kind", "pick", *cd.ID, *r6c("gap"))


@query("sp13_support_matrix")
def support_matrix(s, d):
    return cd.support_matrix(s, records(s, d), THRESHOLDS)


def grid_shape(pts):
    last = grid.extent(pts).first()
    return last[0] + 1, last[1] + 1


LAG_SQL = f"""WITH p AS (SELECT r, c, z AS v FROM dem WHERE z IS NOT NULL), f AS (SELECT (least(max(r), max(c))+1)*5e-1 AS far, count(*) AS population FROM p),
    pr AS (SELECT sqrt(((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c))::DOUBLE) AS dist, (a.v-b.v)*(a.v-b.v)/2 AS g FROM p a JOIN p b ON a.r<b.r OR (a.r=b.r AND a.c<b.c)),
    v AS (SELECT len(list_filter(range(1,12), lambda i: i*(far/12)<=dist))::INT AS lag, count(*) AS pairs, avg(dist)*30 AS mean_lag, avg(g) AS gamma, count(*)>=30 AS sufficient,
      any_value(population) AS population FROM pr, f WHERE dist<=far GROUP BY 1)"""


def lag_bins(s, d):
    pts = views.dem(s, d).where("z IS NOT NULL").select("r", "c", C("z").alias("v"))
    return st.variogram(pts, grid_shape(pts), 30.0, 12, 0.5, 30)


@query("sp14_semivariogram", f"{LAG_SQL} SELECT lag, pairs, {R('mean_lag')} AS mean_lag, {R('gamma')} AS gamma, sufficient, population FROM v")
def semivariogram(s, d):
    return lag_bins(s, d).select("lag", "pairs", *r6c("mean_lag", "gamma"), "sufficient", "population")


@query("sp14_variogram_range", f"""{LAG_SQL}, k AS (SELECT i::INT AS lag, coalesce(sufficient, false) AS sufficient, gamma FROM range(0,12) t(i) LEFT JOIN v ON i=lag),
    s AS (SELECT count(*) FILTER (WHERE sufficient) AS populated, bool_and(sufficient) FILTER (WHERE lag>=8) AS tail_ok, median(gamma) FILTER (WHERE lag>=8) AS sill FROM k),
    j AS (SELECT *, bool_and(coalesce(sufficient AND abs(gamma-sill)<=sill*2e-1, false)) OVER (ORDER BY lag DESC) AS stable FROM k, s),
    r AS (SELECT populated, tail_ok, sill, min(lag) FILTER (WHERE stable AND gamma>=sill*95e-2) AS range_lag FROM j GROUP BY 1,2,3)
    SELECT populated, tail_ok, {R('sill')} AS sill, range_lag, CASE WHEN populated<6 THEN 'too_few_populated_bins' WHEN NOT tail_ok THEN 'tail_bins_insufficient' WHEN coalesce(sill,0)<=0 THEN 'nonpositive_sill'
      WHEN range_lag IS NULL THEN 'no_stable_range' END AS reason FROM r""")
def variogram_range(s, d):
    g = io.materialize(s, lag_bins(s, d).drop("population"), "bins")
    return st.variogram_range(g, 12, 4).select("populated", "tail_ok", *r6c("sill"), "range_lag", "reason")


def two_bin_sql(unit):
    on = " AND ".join(f"a.{k}=b.{k}" for k in unit.split(","))
    return f"""WITH p AS MATERIALIZED (SELECT a,k,band,r,c,e FROM resid WHERE e IS NOT NULL),
    x AS (SELECT {unit}, count(*) AS support, sqrt(pow(max(r)-min(r),2)+pow(max(c)-min(c),2)) AS extent, var_pop(e) AS sill FROM p GROUP BY {unit}),
    h AS (SELECT {unit}, extent FROM x WHERE support>=200 AND extent>3), w AS (SELECT p.*, extent FROM p JOIN h USING ({unit})),
    pr AS (SELECT {",".join("a." + k for k in unit.split(","))}, a.extent, sqrt(((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c))::DOUBLE) AS dist, (a.e-b.e)*(a.e-b.e)/2 AS g
      FROM w a JOIN w b ON {on} AND (a.r<b.r OR (a.r=b.r AND a.c<b.c))),
    y AS (SELECT {unit}, count(*) FILTER (WHERE dist<(extent+3)/2) AS n1, count(*) FILTER (WHERE dist>=(extent+3)/2) AS n2,
      avg(g) FILTER (WHERE dist<(extent+3)/2) AS g1, avg(g) FILTER (WHERE dist>=(extent+3)/2) AS g2 FROM pr WHERE dist>=3 AND dist<=extent GROUP BY {unit})
    SELECT {unit}, support, {R('extent')} AS extent, nullif(n1,0) AS pairs1, nullif(n2,0) AS pairs2, {R('g1')} AS gamma1, {R('g2')} AS gamma2, {R('sill')} AS sill,
      CASE WHEN support<200 THEN 'inconclusive_insufficient_residual_support' WHEN extent<=3 THEN 'inconclusive_core_extent' WHEN NOT coalesce(n1>=200 AND n2>=200 AND sill>0, false) THEN 'inconclusive_insufficient_lag_support'
      WHEN g1<95e-2*sill AND g2<95e-2*sill THEN 'spatial_dependence_warning' ELSE 'no_warning_at_resolved_lags' END AS status FROM x LEFT JOIN y USING ({unit})"""


def dependence(s, d, unit):
    e = fit.scored_residuals(zoned(s, d), FOLDS, MIN_CALIBRATION).select("a", "k", "band", "r", "c", "e")
    x = st.two_bin_check(io.materialize(s, e, "residuals"), unit, 3.0)
    return x.select(*unit, "support", "pairs1", "pairs2", *r6c("extent", "gamma1", "gamma2", "sill"), "status")


@query("sp15_two_bin_check", two_bin_sql("a,k,band"))
def two_bin_check(s, d):
    return dependence(s, d, ["a", "k", "band"])


@query("sp15_two_bin_by_acquisition", two_bin_sql("a,band"))
def two_bin_by_acquisition(s, d):
    """The same over all holdout cores of an acquisition: a cell lies in one core at most."""
    return dependence(s, d, ["a", "band"])


@query("sp16_components", """WITH RECURSIVE m AS (SELECT r, c, r*2147483648+c AS id FROM zmask WHERE m=1), reach AS (SELECT r, c, id AS label FROM m UNION
    SELECT m.r, m.c, label FROM reach x JOIN m ON abs(m.r-x.r)<=1 AND abs(m.c-x.c)<=1 AND x.label<m.id)
    SELECT count(*) AS components, max(n) AS largest, sum(n)::BIGINT AS cells FROM (SELECT label, count(*) AS n FROM (SELECT r, c, min(label) AS label FROM reach GROUP BY r, c) GROUP BY label)""")
def components(s, d):
    lab = st.components(s, views.zero_mask(s, d).where("m = 1"))
    return lab.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum("n").alias("cells"))


@query("sp17_footprint_coverage", f"""SELECT scene_id, {R('greatest(least(x1,1500)-greatest(x0,0),0)::DOUBLE*greatest(least(y1,1200)-greatest(y0,0),0)/(1500e0*1200e0)')} AS coverage FROM scene""")
def footprint_coverage(s, d):
    from .joins import region_coverage
    return views.scene(s, d).select("scene_id", *rounded(coverage=region_coverage()))


@query("sp18_grid_identity", """SELECT a, array_to_string(list_filter([CASE WHEN e<>32648 THEN 'crs' END, CASE WHEN h<>h0 OR w<>w0 THEN 'shape' END, CASE WHEN abs(o-292230e0)>1e-9 THEN 'transform' END],
    lambda x: x IS NOT NULL), ',') AS failures FROM (SELECT px.a, max(r)+1 AS h, max(c)+1 AS w, 292230e0+min(c)*30 AS o FROM px GROUP BY px.a)
    JOIN (SELECT n_nationkey AS a, 32648+(n_regionkey=4)::INT AS e FROM nation) USING (a), (SELECT rmax+1 AS h0, cmax+1 AS w0 FROM ext)""")
def grid_identity(s, d):
    got = views.obs(s, d).groupBy("a").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), (F.min("c") * 30.0 + 292230.0).alias("o"))
    # the zone that each header names: region 4 lies in the next one
    header = views.table(s, d, "nation").select(C("n_nationkey").alias("a"), (F.lit(32648) + (C("n_regionkey") == 4).cast("int")).alias("epsg"))
    want = grid.extent(views.dem(s, d))
    j = got.join(header, "a").crossJoin(F.broadcast(want))
    cand = {"crs": C("epsg"), "shape": F.struct(C("h").alias("h"), C("w").alias("w")), "transform": F.array(F.lit(30.0), C("o"))}
    ref = {"crs": F.lit(32648), "shape": F.struct((C("_rmax") + 1).alias("h"), (C("_cmax") + 1).alias("w")), "transform": F.array(F.lit(30.0), F.lit(292230.0))}
    return j.select("a", text_list(grid.grid_failures(cand, ref, 1e-9)).alias("failures"))


def consumers(s, d):
    t = views.scene(s, d)
    m = {n: F.pmod("cents", F.lit(n)) for n in (37, 43, 5, 4)}
    reg = F.when(C("a") % 3 == 0, 0).when(C("a") % 3 == 1, 1).otherwise(3)
    x = t.select(C("scene_id").alias("consumer"), (C("a") % 3).cast("string").alias("role"), m[37].alias("r0"), m[43].alias("c0"),
                 (m[37] + 1 + m[5]).alias("r1"), (m[43] + 1 + m[4]).alias("c1"), reg.alias("reg"))
    registry = x.select("role", C("reg").cast("long").alias("radius")).distinct()  # one row per consumer role
    return ln.influence(ln.registered(x.drop("reg"), registry)), registry


def classes_of_change(s, d):
    old, new = views.dem(s, d), views.dem_v2(s, d)
    cons, _ = consumers(s, d)
    cons = cons.crossJoin(F.broadcast(grid.extent(new)))
    zero = F.lit(0)
    old_box = {"r0": zero, "c0": zero, "r1": C("_rmax") + 1, "c1": F.lit(46)}
    new_box = {"r0": zero, "c0": zero, "r1": C("_rmax") + 1, "c1": C("_cmax") + 1}
    return ln.change_classes(cons, old, new, old_box, new_box)


@query("sp19_change_class", f"SELECT consumer, radius::BIGINT AS radius, old_covers, new_covers, differing, {R('max_delta')} AS max_delta, insufficient, change_class FROM chg")
def change_class(s, d):
    return classes_of_change(s, d).select("consumer", "radius", "old_covers", "new_covers", "differing", *r6c("max_delta"), "insufficient", "change_class")


def graph(s, d):
    def node(p, c):
        return F.concat(F.lit(p), C(c).cast("string"))
    li = views.table(s, d, "lineitem").select(node("s", "l_suppkey").alias("src"), node("o", "l_orderkey").alias("dst")).distinct()
    o = views.table(s, d, "orders").select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"))
    c = views.table(s, d, "customer").select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"))
    return li.unionByName(o).unionByName(c)


def invalid_roots(s, d):
    x = classes_of_change(s, d).where("change_class <> 'artifact_only'")
    return x.select(F.concat(F.lit("s"), F.substring("consumer", 10, 20).cast("long").cast("string")).alias("node"))


@query("sp20_descendants", "SELECT node, path, depth FROM desc1")
def descendants(s, d):
    return ln.descendants(s, graph(s, d), invalid_roots(s, d))


def all_marks(s, d):
    g, inv = graph(s, d), io.materialize(s, invalid_roots(s, d), "roots")
    nodes = g.select(C("src").alias("node")).unionByName(g.select(C("dst").alias("node")))
    return ln.propagate(nodes, inv, ln.descendants(s, g, inv))


@query("sp21_invalidation_marks", "SELECT node, mark, path FROM marks")
def invalidation_marks(s, d):
    return all_marks(s, d)


@query("sp22_version_digest", f"""WITH w AS (SELECT consumer, d.r, d.c, d.z, v.z AS z2 FROM cons JOIN dem d ON d.r>=ir0 AND d.r<ir1 AND d.c>=ic0 AND d.c<ic1 JOIN demv2 v ON v.r=d.r AND v.c=d.c)
    SELECT x.consumer, x.dg AS old_digest, y.dg AS new_digest, x.dg<>y.dg AS stale, n AS cells FROM
    (SELECT consumer, {DIGEST} AS dg, count(*) AS n FROM (SELECT consumer, r::VARCHAR||'|'||c::VARCHAR||'|'||coalesce(round(z*100)::BIGINT::VARCHAR,'~') AS t FROM w) GROUP BY 1) x JOIN
    (SELECT consumer, {DIGEST} AS dg FROM (SELECT consumer, r::VARCHAR||'|'||c::VARCHAR||'|'||coalesce(round(z2*100)::BIGINT::VARCHAR,'~') AS t FROM w) GROUP BY 1) y USING (consumer)""")
def version_digest(s, d):
    cons, _ = consumers(s, d)
    a, b = ln.version_digests(cons, views.dem(s, d)), ln.version_digests(cons, views.dem_v2(s, d))
    j = a.withColumnRenamed("digest", "old_digest").join(b.select("consumer", C("digest").alias("new_digest")), "consumer")
    return j.select("consumer", "old_digest", "new_digest", (C("old_digest") != C("new_digest")).alias("stale"), "cells")


@query("sp23_unregistered_consumers", "SELECT l_returnflag AS role, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN (SELECT DISTINCT o_orderstatus FROM orders) GROUP BY 1")
def unregistered_consumers(s, d):
    reg = views.table(s, d, "orders").select(C("o_orderstatus").alias("role")).distinct()
    return ln.unregistered(views.table(s, d, "lineitem").select(C("l_returnflag").alias("role")), reg).groupBy("role").agg(F.count("*").alias("n"))


def versions_of_marks(s, d):
    """Version 1 of the marks is from before the propagation, version 2 from after it."""
    g, folder = graph(s, d), io.shared_dir(s, "versions")
    nodes = g.select(C("src").alias("node")).unionByName(g.select(C("dst").alias("node"))).distinct()
    return folder, ln.publish_marks(nodes.withColumn("mark", F.lit("valid")), folder, 1), ln.publish_marks(all_marks(s, d), folder, 2)


@query("sp24_rollback", "SELECT node, mark AS changed, 'valid' AS mark FROM marks")
def rollback(s, d):
    folder, before, _ = versions_of_marks(s, d)
    back = ln.rollback(s, folder, 1, before, 3)
    return ln.marks_of(s, folder, 2).withColumnRenamed("mark", "changed").join(back, "node")


@query("sp24_receipts", """SELECT v AS version, w AS receipt_of, n AS stored_rows, v=w OR same AS accepted FROM (SELECT count(*) AS n, count(*) FILTER (WHERE mark<>'valid')=0 AS same FROM marks),
    (VALUES (1),(2)) a(v), (VALUES (1),(2)) b(w)""")
def receipts(s, d):
    """Which receipt opens which version."""
    folder, *given = versions_of_marks(s, d)
    held = [ln.marks_of(s, folder, v).agg(F.lit(v).alias("version"), F.count("*").alias("stored_rows")) for v in (1, 2)]
    rows = [held[v - 1].select("version", F.lit(w).alias("receipt_of"), "stored_rows", F.lit(ln.agrees(s, folder, v, given[w - 1])).alias("accepted"))
            for v in (1, 2) for w in (1, 2)]
    return functools.reduce(DataFrame.unionByName, rows)


@query("sp25_affine_bounds", """SELECT scene_id, 292230e0+x0*30 AS bleft, 3473790e0-y1*30 AS bbottom, 292230e0+x1*30 AS bright, 3473790e0-y0*30 AS btop FROM scene""")
def affine_bounds(s, d):
    b = geo.affine_bounds([30.0, 0.0, 292230.0, 0.0, -30.0, 3473790.0], C("x0"), C("y0"), C("x1"), C("y1"))
    return views.scene(s, d).select("scene_id", *[b[k].alias(n) for k, n in (("left", "bleft"), ("bottom", "bbottom"), ("right", "bright"), ("top", "btop"))])
