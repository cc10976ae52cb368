"""Model-level queries: holdout tables, experiments, verdicts, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, geometry as geo, masks, pixel
from ..functions.numeric import ratio
from ..operators import domains, fit, folds as fd, joins as jn, models, risk, support as sp
from ..sources import io, views
from ..sources.config import FOLDS, MIN_CALIBRATION
from .aggregates import ablation_pairs, ablation_units, units, zoned, zoned_sky
from .common import C, long, r6c, rounded, text_list
from .duck import r6 as R
from .registry import query
from .windows import KEYS, scopes


@query("md01_holdout_fit_score", f"""SELECT a, k, band, split, state, reason, n_cal, {R('alpha')} AS alpha, core_total, core_land, core_geometry, core_scored,
    core_land-core_scored AS core_unsupported, {R('coverage')} AS coverage, {R('bias')} AS bias, {R('mae')} AS mae, {R('p90')} AS p90_abs,
    CASE WHEN n_res IS NOT NULL THEN 'scored' WHEN alpha IS NULL THEN 'unsupported_calibration' ELSE 'no_supported_pixel_in_core' END AS outcome FROM unit""")
def holdout_fit_score(s, d):
    u = fit.holdout_units(views.px_table(s, d), fd.time_split(views.acq(s, d), ["day", "a"]), FOLDS, MIN_CALIBRATION)
    return u.select(*KEYS, "split", "state", "reason", long("n_cal").alias("n_cal"), "core_total", "core_land", "core_geometry", "core_scored",
                    (C("core_land") - C("core_scored")).alias("core_unsupported"), *rounded(alpha="alpha", coverage="coverage", bias="bias", mae="mae", p90_abs="p90_abs"),
                    F.when(C("count").isNotNull(), "scored").when(C("alpha").isNull(), "unsupported_calibration").otherwise("no_supported_pixel_in_core").alias("outcome"))


@query("md02_method_experiment", f"""SELECT band, method, count(*) AS units, {R('median(mae)')} AS median_mae, {R('median(cov)')} AS median_coverage, {R('median(alpha)')} AS median_alpha,
    count(*) FILTER (WHERE boundary_hit) AS boundary_hits FROM (SELECT f.*, mae, cov FROM mfit f JOIN (SELECT a,k,band,method,avg(abs(e)) AS mae,count(e)::DOUBLE/count(*) AS cov FROM mres GROUP BY 1,2,3,4) m
    USING (a,k,band,method)) GROUP BY band, method""")
def method_experiment(s, d):
    z = zoned(s, d)
    fits = io.materialize(s, models.method_fits(z, FOLDS), "fits")
    res = models.method_residuals(z, fits, FOLDS, models.METHODS)
    m = res.groupBy(*KEYS, "method").agg(F.avg(F.abs("e")).alias("mae"), ratio(F.count("e"), F.count("*")).alias("cov"))
    j = fits.join(m, [*KEYS, "method"])
    return j.groupBy("band", "method").agg(
        F.count("*").alias("units"), *rounded(median_mae=F.median("mae"), median_coverage=F.median("cov"), median_alpha=F.median("alpha")),
        F.count_if("boundary_hit").alias("boundary_hits"))


@query("md03_candidate_ablation", f"""SELECT a, k, band, split, candidate, state, reason, n, core_land, {R('CASE WHEN reason IS NULL THEN t1 END')} AS theta1, {R('CASE WHEN reason IS NULL THEN t2 END')} AS theta2,
    {R('mae')} AS mae, {R('bias')} AS bias, {R('p90')} AS p90_abs, {R('coverage')} AS coverage FROM abl""")
def candidate_ablation(s, d):
    u = models.ablation(zoned_sky(s, d), fd.time_split(views.acq(s, d), ["day", "a"]), FOLDS, MIN_CALIBRATION, 0.05)
    ok = C("reason").isNull()
    return u.select(*KEYS, "split", "candidate", "state", "reason", long("n").alias("n"), "core_land",
                    *rounded(theta1=F.when(ok, C("theta1")), theta2=F.when(ok, C("theta2")), mae="mae", bias="bias", p90_abs="p90_abs", coverage="coverage"))


@query("jn14_baseline_pairs", f"""SELECT candidate, split, count(*) AS pairs, count(*) FILTER (WHERE NOT comparable) AS excluded, {R('median(improvement)')} AS median_improvement FROM pairs GROUP BY 1, 2""")
def baseline_pairs(s, d):
    return ablation_pairs(s, d).groupBy("candidate", "split").agg(
        F.count("*").alias("pairs"), F.count_if(~C("comparable")).alias("excluded"), *rounded(median_improvement=F.median("improvement")))


@query("md04_selective_scopes", f"""SELECT a, k, band, scope, n_scored, {R('s_min')} AS s_min, {R('s_max')} AS s_max, gate, reason, verdict, {R('CASE WHEN reason IS NULL THEN area END')} AS area,
    {R('CASE WHEN reason IS NULL THEN normalized END')} AS normalized, CASE WHEN reason IS NULL THEN shape END AS shape FROM scopeval""")
def selective_scopes(s, d):
    return scopes(s, d)["summary"].select(*KEYS, "scope", "n_scored", "gate", "reason", "verdict", "shape", *r6c("s_min", "s_max", "area", "normalized"))


VERDICT_SQL = """(SELECT *, median_improvement>=5e-2 AS improvement_ok, folds_positive>=4 AS direction_ok, boundary_share<=1e-1 AS boundary_ok, max_condition<1e10 AS stability_ok FROM
    (SELECT candidate, count(*) AS train_units, median(improvement) AS median_improvement, avg((t1<0 OR t1>1)::INT::DOUBLE) AS boundary_share, max(cond) AS max_condition FROM train GROUP BY candidate)
    JOIN (SELECT candidate, count(*) FILTER (WHERE m>0) AS folds_positive, count(*) AS folds FROM (SELECT candidate, k, median(improvement) AS m FROM train GROUP BY 1,2) GROUP BY 1) USING (candidate))"""


STATE_SQL = f"""(SELECT *, CASE WHEN improvement_ok AND direction_ok AND boundary_ok AND stability_ok THEN 'qualified' ELSE 'unsupported_by_evidence' END AS terminal_state FROM {VERDICT_SQL})"""


@query("md05_verdict_rules", f"""SELECT candidate, train_units, {R('median_improvement')} AS median_improvement, folds_positive, folds, {R('boundary_share')} AS boundary_share, improvement_ok, direction_ok, boundary_ok,
    stability_ok, CASE WHEN improvement_ok AND direction_ok AND boundary_ok AND stability_ok THEN 'qualified' ELSE 'unsupported_by_evidence' END AS terminal_state,
    CASE WHEN NOT (improvement_ok AND direction_ok AND boundary_ok AND stability_ok) THEN 'improvement_below_threshold_on_heldout_core' END AS reason FROM {VERDICT_SQL}""")
def verdict_rules(s, d):
    return models.verdicts(ablation_pairs(s, d)).select(
        "candidate", "train_units", "folds_positive", "folds", "improvement_ok", "direction_ok", "boundary_ok", "stability_ok", "terminal_state", "reason",
        *r6c("median_improvement", "boundary_share"))


@query("md06_tie_rule", f"""SELECT 'C1,C1p' AS pair, {R('abs(x.m-y.m)')} AS gap, abs(x.m-y.m)<1e-2 AS tie, CASE WHEN abs(x.m-y.m)<1e-2 OR x.m>y.m THEN 'C1' ELSE 'C1p' END AS chosen FROM
    (SELECT median(improvement) AS m FROM train WHERE candidate='C1') x, (SELECT median(improvement) AS m FROM train WHERE candidate='C1p') y""")
def tie_rule(s, d):
    v = io.materialize(s, models.verdicts(ablation_pairs(s, d)), "verdicts")
    return models.tie_rule(v).select("pair", *r6c("gap"), "tie", "chosen")


SENSORS, WINDOW = ["L8", "L9"], ("1992-01-01", "2001-12-31")
#: Centre and footprint of a domain by arithmetic on its number; some lie near domain 0, some at the edge of the grid.
PLACE = """(SELECT n_nationkey AS d, CASE WHEN n_nationkey%8=1 THEN 103e0+n_nationkey/1e2 ELSE (n_nationkey*37+103)%360-180e0*(((n_nationkey*37+103)%360)//180) END AS lon,
    CASE WHEN n_nationkey%8=1 THEN 33e0 ELSE 33e0-(n_nationkey%6)*7e0 END AS lat, 3+(n_nationkey%5)*4 AS r0, CASE WHEN n_nationkey%6=5 THEN 0 ELSE 3+(n_nationkey%7)*5 END AS c0 FROM nation)"""
BUFFER, HEIGHT, BREADTH = 2, 5, 6


def scenes(s, d):
    """Orders of a domain's customers as scenes; in some domains every 13th number comes from another sensor."""
    o = views.table(s, d, "orders").join(views.table(s, d, "customer"), C("o_custkey") == C("c_custkey"))
    sensor = F.when((C("c_nationkey") % 9 == 4) & (C("o_orderkey") % 13 == 0), "L7").when(C("o_orderkey") % 2 == 0, "L8").otherwise("L9")
    return o.select(C("c_nationkey").alias("d"), F.to_date("o_orderdate").alias("day"), sensor.alias("sensor"))


def screening(s, d):
    """Per-domain measurements of the three screening stages."""
    led = domains.opportunity_ledger(views.domain_day(s, d), 0.3, 0.6)
    cls = domains.dominant_class(views.domain_class(s, d), ["BUILDING", "MACHINERY"])
    bal = views.table(s, d, "customer").groupBy(C("c_nationkey").alias("d")).agg(
        (F.max("c_acctbal") - F.min("c_acctbal")).alias("relief"), F.avg(F.round(C("c_acctbal") * 100)).alias("precip"))
    base = cls.where("d = 0").select(C("dominant").alias("base_class")).crossJoin(bal.where("d = 0").select(C("precip").alias("base_precip")))
    place = s.sql("SELECT * FROM " + PLACE.replace("FROM nation", "FROM {nation}").replace("//", " div "), nation=views.table(s, d, "nation"))
    boxes = place.select("d", "r0", "c0", (C("r0") + HEIGHT).alias("r1"), (C("c0") + BREADTH).alias("c1"))
    stages = [led, cls, domains.sensor_days(scenes(s, d), SENSORS, *WINDOW), domains.cover_share(boxes, views.dem(s, d).where("z IS NOT NULL").select("r", "c"), BUFFER),
              domains.separation_km(place, place.where("d = 0"))]
    for x in stages:
        bal = bal.join(x, "d", "left")
    return bal.crossJoin(F.broadcast(base))


def admitted(s, d):
    j = screening(s, d)
    climate, vegetation = F.abs(C("precip") - C("base_precip")) >= 20000, C("dominant") != C("base_class")
    return domains.admission(j, {
        "A1_sensor": C("foreign") == 0, "A2_acquisitions": C("qualified") >= 10, "A3_coverage": C("strong") >= 5, "A4_dem_cover": C("cover") >= 0.95, "A5_relief": C("relief") >= 8000,
        "A6_separation": C("separation_km") >= 200, "A6_break": climate | vegetation, "A7_human": C("human_share") <= 0.5})


SCREEN_SQL = f"""(SELECT *, coalesce(qualified>=10,false) AS a2, coalesce(strong>=5,false) AS a3, relief>=8000 AS a5, abs(precip-bp)>=20000 OR dominant<>bc AS a6, hs<=5e-1 AS a7,
    coalesce(strangers=0,false) AS a1, coalesce(covered*100>=95*{(HEIGHT + 2 * BUFFER) * (BREADTH + 2 * BUFFER)},false) AS a4, coalesce(km>=200,false) AS a6d FROM
    (SELECT c_nationkey AS d, max(c_acctbal)-min(c_acctbal) AS relief, avg(round(c_acctbal*100)) AS precip FROM customer GROUP BY 1)
    LEFT JOIN (SELECT d, count(*) FILTER (WHERE coverage>=3e-1) AS qualified, count(*) FILTER (WHERE coverage>=6e-1) AS strong FROM dday GROUP BY d) USING (d)
    LEFT JOIN (SELECT d, max(CASE WHEN rn=1 THEN class END) AS dominant, sum(CASE WHEN class IN ('BUILDING','MACHINERY') THEN n ELSE 0 END)::DOUBLE/sum(n)::DOUBLE AS hs FROM
      (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, class) AS rn FROM dclass) GROUP BY d) USING (d)
    LEFT JOIN (SELECT c_nationkey AS d, count(*) FILTER (WHERE o_orderdate::DATE NOT BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}' OR (c_nationkey%9=4 AND o_orderkey%13=0)) AS strangers
      FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1) USING (d)
    LEFT JOIN (SELECT x.d, count(*) AS covered FROM {PLACE} x JOIN dem ON r BETWEEN r0-{BUFFER} AND r0+{HEIGHT + BUFFER - 1} AND c BETWEEN c0-{BUFFER} AND c0+{BREADTH + BUFFER - 1} WHERE z IS NOT NULL GROUP BY 1) USING (d)
    LEFT JOIN (SELECT x.d, 2*6371.0088*asin(sqrt(pow(sin(radians(y.lat-x.lat)/2),2)+cos(radians(x.lat))*cos(radians(y.lat))*pow(sin(radians(y.lon-x.lon)/2),2))) AS km FROM {PLACE} x, {PLACE} y WHERE y.d=0) USING (d),
    (SELECT class AS bc FROM dclass WHERE d=0 ORDER BY n DESC, class LIMIT 1), (SELECT avg(round(c_acctbal*100)) AS bp FROM customer WHERE c_nationkey=0))"""
FAILED_SQL = """array_to_string(list_filter([CASE WHEN NOT a1 THEN 'A1_sensor' END, CASE WHEN NOT a2 THEN 'A2_acquisitions' END, CASE WHEN NOT a3 THEN 'A3_coverage' END, CASE WHEN NOT a4 THEN 'A4_dem_cover' END,
    CASE WHEN NOT a5 THEN 'A5_relief' END, CASE WHEN NOT a6d THEN 'A6_separation' END, CASE WHEN NOT a6 THEN 'A6_break' END, CASE WHEN NOT a7 THEN 'A7_human' END], lambda x: x IS NOT NULL), ',')"""


@query("md10_domain_screen", f"SELECT d, qualified, strong, dominant, {FAILED_SQL} AS failed, {FAILED_SQL}='' AS admitted FROM {SCREEN_SQL}")
def domain_screen(s, d):
    return admitted(s, d).select("d", "qualified", "strong", "dominant", "failed", "admitted")


@query("md11_admission_ledger", f"""WITH x AS (SELECT *, {FAILED_SQL} AS failed FROM {SCREEN_SQL}), n AS (SELECT count(*) FILTER (WHERE failed='') AS n FROM x),
    r AS (SELECT d, row_number() OVER (ORDER BY qualified DESC, strong DESC, d) AS rank FROM x WHERE failed='')
    SELECT d, failed='' AS admitted, failed AS reason_codes, rank, CASE WHEN rank<=5 THEN 'selected' WHEN rank>5 THEN 'reserve' ELSE 'rejected' END AS selection,
    CASE WHEN n>=3 THEN 'sufficient' ELSE 'insufficient_domains' END AS verdict FROM x LEFT JOIN r USING (d), n""")
def admission_ledger(s, d):
    adm = io.materialize(s, admitted(s, d).select("d", "qualified", "strong", "failed", "admitted"), "admission")
    rank = domains.rank_domains(adm, [F.desc("qualified"), F.desc("strong"), "d"], 5).select("d", long("rank").alias("rank"), "selection")
    n = adm.agg(F.count_if("admitted").alias("n"))
    return adm.join(rank, "d", "left").crossJoin(F.broadcast(n)).select(
        "d", "admitted", C("failed").alias("reason_codes"), "rank", F.coalesce("selection", F.lit("rejected")).alias("selection"),
        F.when(C("n") >= 3, "sufficient").otherwise("insufficient_domains").alias("verdict"))


@query("md12_requalification_gate", f"""SELECT a, {R('iqr')} AS iqr, {R('med')} AS median_iqr, CASE WHEN med<1e-1 THEN 'not_established' ELSE 'indeterminate_at_this_measurement_level' END AS g1,
    CASE WHEN anchors>0 THEN 'satisfied' ELSE 'not_satisfied' END AS g2, CASE WHEN operators>0 THEN 'satisfied' ELSE 'not_satisfied' END AS g3,
    CASE WHEN med>=1e-1 AND anchors>0 AND operators>0 THEN 'requalification_warranted' ELSE 'requalification_not_warranted' END AS verdict FROM (SELECT a, iqr, median(iqr) OVER () AS med FROM
    (SELECT a, quantile_cont(v_sky,0.75)-quantile_cont(v_sky,0.25) AS iqr FROM px JOIN vsky USING (r,c) WHERE land GROUP BY a)),
    (SELECT count(*) AS anchors FROM artifact WHERE role='ground_truth'), (SELECT count(*) AS operators FROM {STATE_SQL} WHERE terminal_state='qualified')""")
def requalification_gate(s, d):
    # G1: range of the input, which at this level can only refute; G2: references of the anchor class; G3: operators that qualified
    from ..operators.prefix import exact_quantiles
    q = exact_quantiles(views.px_sky(s, d).where("land"), ["a"], C("v_sky"), {"q1": .25, "q3": .75}, 1 / 4096).select("a", (C("q3") - C("q1")).alias("iqr"))
    q = io.materialize(s, q, "iqr")
    m = q.agg(F.median("iqr").alias("med"))
    anchors = views.artifact(s, d).agg(F.count_if(C("role") == "ground_truth").alias("anchors"))
    operators = models.verdicts(ablation_pairs(s, d)).agg(F.count_if(C("terminal_state") == "qualified").alias("operators"))
    return requalify(q.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(anchors)).crossJoin(F.broadcast(operators)))


def requalify(j):
    """Verdict from ``med``, ``anchors`` and ``operators``; all three gates must hold."""
    def gate(ok):
        return F.when(ok, "satisfied").otherwise("not_satisfied")
    a, o = C("anchors") > 0, C("operators") > 0
    return j.select(
        "a", *rounded(iqr="iqr", median_iqr="med"), F.when(C("med") < 0.1, "not_established").otherwise("indeterminate_at_this_measurement_level").alias("g1"),
        gate(a).alias("g2"), gate(o).alias("g3"),
        F.when((C("med") >= 0.1) & a & o, "requalification_warranted").otherwise("requalification_not_warranted").alias("verdict"))


@query("md13_member_states", """SELECT acq.a, coalesce(n,0) AS base_valid_land, CASE WHEN n>=500 THEN 'eligible_candidate' ELSE 'operation_scoped_unsupported' END AS state,
    CASE WHEN NOT coalesce(n>=500,false) THEN 'below_base_valid_land_minimum' END AS reason FROM acq LEFT JOIN (SELECT a, count(*) FILTER (WHERE land) AS n FROM px GROUP BY a) x ON acq.a=x.a""")
def member_states(s, d):
    n = views.px(s, d).groupBy("a").agg(F.count_if("land").alias("n"))
    j = views.acq(s, d).select("a").join(n, "a", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("a", C("n").alias("base_valid_land"), F.when(C("n") >= 500, "eligible_candidate").otherwise("operation_scoped_unsupported").alias("state"),
                    F.when(C("n") < 500, "below_base_valid_land_minimum").alias("reason"))


@query("md14_scene_preflight", f"""SELECT a, count(*) AS cells, count(*) FILTER (WHERE base) AS base, count(*) FILTER (WHERE land) AS land, count(*) FILTER (WHERE base AND water) AS water_excluded,
    count(*) FILTER (WHERE base AND cos_i<=0) AS shadow, count(*) FILTER (WHERE base AND cos_i>0 AND cos_i<=1e-1) AS near_zero, count(*) FILTER (WHERE base AND cos_i>1e-1) AS lit,
    count(*) FILTER (WHERE base AND cos_i IS NULL)=0 AS partition_ok, {R('(count(*) FILTER (WHERE base))::DOUBLE/count(*)')} AS base_share,
    count(*) FILTER (WHERE base AND (cos_i>1e-1)<>(mu>1.5e-1)) AS prior_difference FROM px GROUP BY a""")
def scene_preflight(s, d):
    x, b = C("cos_i"), C("base")
    g = views.px(s, d).groupBy("a").agg(
        F.count("*").alias("cells"), F.count_if(b).alias("base"), F.count_if("land").alias("land"), F.count_if(b & C("water")).alias("water_excluded"),
        F.count_if(b & (x <= 0)).alias("shadow"), F.count_if(b & (x > 0) & (x <= 0.1)).alias("near_zero"), F.count_if(b & (x > 0.1)).alias("lit"),
        F.count_if(b & ((x > 0.1) != (C("mu") > 0.15))).alias("prior_difference"))
    return g.withColumn("partition_ok", C("shadow") + C("near_zero") + C("lit") == C("base")).withColumn("base_share", rounded(v=ratio(C("base"), C("cells")))[0])
