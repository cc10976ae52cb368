"""Windows, curves and journal order."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import pixel
from ..operators import domains, fit, folds as fd, grid, journal as jr, models, risk
from ..sources import io, views
from ..sources.config import FOLDS, MIN_CALIBRATION
from .aggregates import units, zoned
from .common import C, long, r6c, rounded
from .duck import r6 as R
from .registry import query

KEYS = ["a", "k", "band"]
MIN_SCOPE, MIN_ACCEPT = 20, 5


@query("wn01_gradient", f"SELECT r, c, {R('dr')} AS dz_dr, {R('dc')} AS dz_dc FROM terrain")
def gradient(s, d):
    return views.terrain(s, d).select("r", "c", *r6c("dz_dr", "dz_dc"))


@query("wn02_slope_aspect", f"SELECT r, c, {R('slope')} AS slope, {R('aspect')} AS aspect FROM terrain")
def slope_aspect(s, d):
    return views.terrain(s, d).select("r", "c", *r6c("slope", "aspect"))


@query("wn03_curvature", f"SELECT r, c, {R('curvature')} AS curvature FROM terrain")
def curvature(s, d):
    return views.terrain(s, d).select("r", "c", *r6c("curvature"))


@query("wn04_hillshade", f"SELECT r, c, {R('hillshade')} AS hillshade FROM terrain")
def hillshade(s, d):
    return views.terrain(s, d).select("r", "c", *r6c("hillshade"))


@query("wn05_prefix_sums", """SELECT r, c, m, row_sum, (sum(row_sum) OVER (PARTITION BY c ORDER BY r))::BIGINT AS integral FROM
    (SELECT r, c, m, (sum(m) OVER (PARTITION BY r ORDER BY c))::BIGINT AS row_sum FROM zmask)""")
def prefix_sums(s, d):
    return grid.integral_image(views.zero_mask(s, d))


@query("wn06_last_next_set", """SELECT r, c, max(CASE WHEN m=1 THEN c END) OVER (PARTITION BY r ORDER BY c) AS last_set,
    min(CASE WHEN m=1 THEN c END) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_set FROM zmask""")
def last_next_set(s, d):
    return grid.last_next(views.zero_mask(s, d)).select("r", "c", "last_set", "next_set")


@query("wn07_same_day_mosaic", """SELECT strftime(day,'%Y-%m-%d') AS day, part, supplier, price FROM (SELECT l_shipdate::DATE AS day, l_partkey AS part, l_suppkey AS supplier,
    l_extendedprice AS price, row_number() OVER (PARTITION BY l_shipdate::DATE, l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn=1""")
def same_day_mosaic(s, d):
    # an ordered-struct min combines on the map side, unlike row_number
    first = F.min(F.struct("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("x")
    m = views.table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), C("l_partkey").alias("part")).agg(first)
    return m.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "part", C("x.l_suppkey").alias("supplier"), C("x.l_extendedprice").alias("price"))


@query("wn08_time_split", "SELECT a, rn AS position, n, split FROM split")
def time_split(s, d):
    return fd.time_split(views.acq(s, d), ["day", "a"]).select("a", long("position").alias("position"), "n", "split")


def scored(s, d):
    """Scored core cells and the unit table, each written once."""
    z = zoned(s, d)
    rows = io.derived(s, d, "residuals", lambda: fit.scored_residuals(z, FOLDS, MIN_CALIBRATION).select(*KEYS, "r", "c", "cos_i", "score", "e"))
    return rows, fit.core_accounting(z, FOLDS)


@query("wn09_risk_coverage_curve", f"""SELECT a, k, band, point, {R('score::DOUBLE')} AS score, accepted, {R('coverage')} AS coverage, {R('mae')} AS mae FROM pts WHERE scope='unit_all_scored'""")
def risk_coverage_curve(s, d):
    rows, core = scored(s, d)
    p = risk.exact_points(rows, KEYS, core.select("a", "k", C("core_land").alias("denominator")), ["a", "k"])
    return p.select(*KEYS, "point", "accepted", *r6c("score", "coverage", "mae"))


@query("wn10_fixed_coverage_curve", f"""WITH x AS MATERIALIZED (SELECT a,k,band,method,r,c,e,rel FROM main3), p AS (SELECT *, row_number() OVER (PARTITION BY a,k,band,method ORDER BY rel DESC, r, c) AS pos FROM x WHERE e IS NOT NULL),
    n AS (SELECT a,k,band,method,count(*) AS den,count(e) AS sup FROM x GROUP BY 1,2,3,4), t AS (SELECT *, (q*den+99)//100 AS need FROM n, range(1,101) r(q)),
    o AS (SELECT a,k,band,method,pos,sum(abs(e)) OVER (PARTITION BY a,k,band,method ORDER BY pos) AS s FROM p),
    m AS (SELECT t.a,t.k,t.band,t.method,q,s/need AS mae FROM t JOIN o ON o.a=t.a AND o.k=t.k AND o.band=t.band AND o.method=t.method AND pos=need WHERE need<=sup)
    SELECT t.a,t.k,t.band,t.method,t.q,den AS denominator,sup AS supported,{R('sup::DOUBLE/den')} AS maximum_coverage,CASE WHEN need<=sup THEN 'reachable' ELSE 'not_reachable' END AS status,
    CASE WHEN need<=sup THEN need ELSE 0 END AS selected,{R('CASE WHEN need<=sup THEN need::DOUBLE/den END')} AS actual_coverage,{R('mae')} AS mae FROM t LEFT JOIN m USING (a,k,band,method,q)""")
def fixed_coverage_curve(s, d):
    z = zoned(s, d)
    res = io.derived(s, d, "method_residuals", lambda: models.method_residuals(
        z, models.method_fits(z, FOLDS), FOLDS, models.MAIN_METHODS).select(*KEYS, "method", "r", "c", "e", "rel"))
    g = risk.coverage_curve(res, [*KEYS, "method"])
    return g.select(*KEYS, "method", "q", "denominator", "supported", "status", long("selected").alias("selected"), *r6c("maximum_coverage", "actual_coverage", "mae"))


@query("wn10_comparison_scope", f"""WITH n AS (SELECT a,k,band,method,count(*) AS den,count(e) AS sup FROM main3 GROUP BY 1,2,3,4), c AS (SELECT a,k,band,min(sup::DOUBLE/den) AS common FROM n GROUP BY 1,2,3)
    SELECT a,k,band,method,q,{R('common')} AS common_maximum,CASE WHEN (q*den+99)//100<=sup AND q/100e0<=common+1e-12 THEN 'common_reachable' ELSE 'extended_or_unreachable' END AS comparison_scope
    FROM n JOIN c USING (a,k,band), range(1,101) r(q)""")
def comparison_scope(s, d):
    z = zoned(s, d)
    res = io.derived(s, d, "method_residuals", lambda: models.method_residuals(
        z, models.method_fits(z, FOLDS), FOLDS, models.MAIN_METHODS).select(*KEYS, "method", "r", "c", "e", "rel"))
    g = risk.comparison_scope(io.materialize(s, risk.coverage_curve(res, [*KEYS, "method"]), "curve"), KEYS)
    return g.select(*KEYS, "method", "q", *r6c("common_maximum"), "comparison_scope")


@query("wn10_curve_quantiles", f"""WITH x AS MATERIALIZED (SELECT a,k,band,method,r,c,e,rel FROM main3), p AS (SELECT *, row_number() OVER (PARTITION BY a,k,band,method ORDER BY rel DESC, r, c) AS pos FROM x WHERE e IS NOT NULL),
    n AS (SELECT a,k,band,method,count(*) AS den,count(e) AS sup FROM x GROUP BY 1,2,3,4), t AS (SELECT *, (q*den+99)//100 AS need FROM n, range(1,101) r(q))
    SELECT t.a,t.k,t.band,t.method,q,count(*) AS selected,{R('quantile_cont(abs(e),0.5)')} AS median_abs,{R('quantile_cont(abs(e),0.9)')} AS p90_abs FROM t
    JOIN p ON p.a=t.a AND p.k=t.k AND p.band=t.band AND p.method=t.method AND pos<=need WHERE need<=sup GROUP BY 1,2,3,4,5""")
def curve_quantiles(s, d):
    z = zoned(s, d)
    res = io.derived(s, d, "method_residuals", lambda: models.method_residuals(
        z, models.method_fits(z, FOLDS), FOLDS, models.MAIN_METHODS).select(*KEYS, "method", "r", "c", "e", "rel"))
    g = risk.curve_quantiles(s, res, [*KEYS, "method"])
    return g.select(*KEYS, "method", "q", "selected", *r6c("median_abs", "p90_abs"))


@query("wn11_fixed_grid_map", f"""SELECT a, k, band, q, status, reason, point, {R('coverage')} AS coverage, {R('mae')} AS mae, {R('canonical')} AS canonical FROM gridr WHERE scope='unit_all_scored'""")
def fixed_grid_map(s, d):
    rows, core = scored(s, d)
    p = risk.exact_points(rows, KEYS, core.select("a", "k", C("core_land").alias("denominator")), ["a", "k"])
    g = risk.fixed_grid(p.where(C("accepted") >= MIN_ACCEPT), KEYS)
    return g.select(*KEYS, "q", "status", "reason", "point", *rounded(coverage="coverage", mae="mae", canonical="canonical_target"))


@query("wn12_staircase_area", f"SELECT a, k, band, {R('area')} AS area, {R('span')} AS span, {R('normalized')} AS normalized FROM aurc WHERE scope='unit_all_scored'")
def staircase_area(s, d):
    rows, core = scored(s, d)
    p = risk.exact_points(rows, KEYS, core.select("a", "k", C("core_land").alias("denominator")), ["a", "k"])
    return risk.staircase_area(p.where(C("accepted") >= MIN_ACCEPT), KEYS, F.floor(C("score") * 4096)).select(*KEYS, *r6c("area", "span", "normalized"))


@query("wn13_curve_shape", "SELECT a, k, band, reachable, shape FROM shape WHERE scope='unit_all_scored'")
def curve_shape(s, d):
    rows, core = scored(s, d)
    p = risk.exact_points(rows, KEYS, core.select("a", "k", C("core_land").alias("denominator")), ["a", "k"])
    return risk.curve_shape(risk.fixed_grid(p.where(C("accepted") >= MIN_ACCEPT), KEYS), KEYS, 1e-12, 1e-12)


def quartiles(s, d):
    z = zoned(s, d)
    cuts = risk.quartile_cuts(z.where("land"), ["a"], FOLDS)
    res = models.method_residuals(z, models.method_fits(z, FOLDS), FOLDS, models.MAIN_METHODS)
    return risk.quartile_metrics(res, cuts, KEYS, ["a", "k"])


@query("wn14_quartile_strata", f"SELECT a, k, band, def AS definition, stratum, method, n, {R('mae')} AS mae, {R('p90')} AS p90 FROM smet")
def quartile_strata(s, d):
    return quartiles(s, d).select(*KEYS, "definition", "stratum", "method", "n", *r6c("mae", "p90"))


@query("wn15_ranking_reversals", """WITH rk AS (SELECT a,k,band,def,stratum,min(n) AS n,string_agg(method,'>' ORDER BY mae,method) AS ranking,arg_min(method,(mae,method)) AS first,
      (list_sort(list(mae)))[1]<(list_sort(list(mae)))[2] AS strict FROM smet GROUP BY 1,2,3,4,5), g AS (SELECT * FROM rk WHERE stratum='global')
    SELECT *, reversed_strata>=2 OR (sufficient_strata>0 AND strict_wins<=1) AS sensitive FROM (SELECT r.a,r.k,r.band,r.def AS definition,g.ranking AS global_ranking,
      count(*) FILTER (WHERE r.n>=8) AS sufficient_strata,count(*) FILTER (WHERE r.n>=8 AND r.ranking<>g.ranking) AS reversed_strata,
      count(*) FILTER (WHERE r.n>=8 AND r.strict AND r.first=g.first) AS strict_wins FROM rk r JOIN g USING (a,k,band,def) WHERE r.stratum<>'global' GROUP BY 1,2,3,4,5)""")
def ranking_reversals(s, d):
    return risk.ranking_verdicts(io.materialize(s, quartiles(s, d), "strata"), KEYS, 8)


@query("wn16_domain_ranking", """SELECT d, qualified, rank, CASE WHEN rank<=5 THEN 'selected' ELSE 'reserve' END AS selection FROM (SELECT d, qualified,
    row_number() OVER (ORDER BY qualified DESC, strong DESC, d) AS rank FROM (SELECT d, count(*) FILTER (WHERE coverage>=3e-1) AS qualified, count(*) FILTER (WHERE coverage>=6e-1) AS strong FROM dday GROUP BY d)
    WHERE qualified>=10)""")
def domain_ranking(s, d):
    led = domains.opportunity_ledger(views.domain_day(s, d), 0.3, 0.6)
    adm = domains.admission(led, {"A2": C("qualified") >= 10})
    r = domains.rank_domains(adm, [F.desc("qualified"), F.desc("strong"), "d"], 5)
    return r.select("d", "qualified", long("rank").alias("rank"), "selection")


def scopes(s, d):
    rows, _ = scored(s, d)
    u = units(s, d).select(*KEYS, "split", "core_land", ((C("state") == "fitted") & (C("core_scored") > 0)).alias("unit_scored"))
    return risk.evaluate_scopes(rows, u, KEYS, MIN_SCOPE, 3, MIN_ACCEPT)


@query("wn17_curve_records", f"""SELECT a,k,band,scope,row_number() OVER (PARTITION BY a,k,band,scope ORDER BY q) AS record,kind,CASE WHEN q>0 THEN q END AS q,verdict,point,{R('coverage')} AS coverage,status FROM
    (SELECT a,k,band,scope,0 AS q,'scope_summary' AS kind,verdict,NULL AS point,NULL AS coverage,NULL AS status FROM scopeval UNION ALL
     SELECT g.a,g.k,g.band,g.scope,g.q,'fixed_grid',verdict,g.point,g.coverage,g.status FROM gridr g JOIN scopeval v USING (a,k,band,scope) WHERE v.gate='evaluated')""")
def curve_records(s, d):
    out = scopes(s, d)
    k = [*KEYS, "scope"]
    summary = io.materialize(s, out["summary"], "summary")
    head = summary.select(*k, F.lit(0).cast("long").alias("q"), F.lit("scope_summary").alias("kind"), "verdict", F.lit(None).cast("long").alias("point"),
                          F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("string").alias("status"))
    body = out["grid"].join(summary.where("gate = 'evaluated'").select(*k, "verdict"), k).select(
        *k, "q", F.lit("fixed_grid").alias("kind"), "verdict", "point", "coverage", "status")
    w = W.partitionBy(*k).orderBy("q")  # at most 21 rows per key
    return head.unionByName(body).select(*k, long(F.row_number().over(w)).alias("record"), "kind", F.when(C("q") > 0, C("q")).alias("q"), "verdict", "point",
                                         *r6c("coverage"), "status")


@query("wn18_canonical_order", """SELECT count(*) AS n, min(ord)=1 AND max(ord)=count(*) AND count(DISTINCT ord)=count(*) AS contiguous, count(*) FILTER (WHERE inv) AS inversions,
    count(*) FILTER (WHERE inv)=0 AS order_matches_time FROM (SELECT ord, coalesce((t, o_orderkey) >= lead((t, o_orderkey)) OVER (ORDER BY ord), false) AS inv FROM
    (SELECT o_orderkey, o_orderkey+1 AS ord, strftime(o_orderdate,'%Y-%m-%d') AS t FROM orders))""")
def canonical_order(s, d):
    o = views.table(s, d, "orders").select("o_orderkey", (C("o_orderkey") + 1).alias("ord"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))
    return jr.order_check(o, "ord", "t", "o_orderkey")


@query("wn19_next_untouched", """SELECT arg_min(c_custkey, c_custkey+1) AS next_item, min(c_custkey+1) AS next_order, count(*) AS untouched FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def next_untouched(s, d):
    items = views.table(s, d, "customer").select(C("c_custkey").alias("item"), (C("c_custkey") + 1).alias("ord"))
    return jr.next_untouched(items, views.table(s, d, "orders").select(C("o_custkey").alias("item")), "item", "ord")


@query("wn20_latest_state", """SELECT task_id, state, seq, events, CASE state WHEN 'READY' THEN 'submitted' WHEN 'RUNNING' THEN 'running' WHEN 'COMPLETED' THEN 'succeeded'
    WHEN 'FAILED' THEN 'failed' WHEN 'CANCELLED' THEN 'cancelled' ELSE 'unknown' END AS lifecycle, state IN ('READY','RUNNING') AS blocks FROM
    (SELECT task_id, arg_max(state, seq) AS state, max(seq) AS seq, count(*) AS events FROM journal GROUP BY task_id)""")
def latest_state(s, d):
    return jr.latest_state(views.journal(s, d))


@query("wn21_earlier_done", """SELECT task_id, ord, succeeded, earlier AS earlier_done, earlier AND NOT succeeded AS may_run FROM (SELECT *, coalesce(bool_and(succeeded) OVER (ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS earlier FROM (SELECT task_id, task_id+1 AS ord, bool_or(state='COMPLETED') AS succeeded FROM journal GROUP BY 1))""")
def earlier_done(s, d):
    j = views.journal(s, d)
    return jr.may_run(j.select("task_id").distinct().withColumn("ord", C("task_id") + 1), j)
