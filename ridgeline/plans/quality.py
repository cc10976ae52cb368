"""Data-quality and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, geometry as geo, identity, masks
from ..functions.numeric import ratio
from ..operators import domains, fit, folds as fd, joins as jn, journal as jr, models, quality as q, risk, support as sp
from ..sources import io, views
from ..sources.config import FOLDS, MIN_CALIBRATION
from .aggregates import ablation_pairs, ablation_units, mask_causes, units, zoned
from .common import C, long, r6c, rounded, text_list
from .duck import r6 as R
from .modeling import FAILED_SQL, SCREEN_SQL, STATE_SQL, VERDICT_SQL, admitted
from .aggregates import CAUSE_SQL
from .joins import COV, region_coverage
from .pixels import DIGEST
from .registry import query
from .windows import MIN_SCOPE, scopes


def line(cid, bad):
    return f"SELECT '{cid}' AS check_id, ({bad})=0 AS passed, ({bad})::BIGINT AS bad"


@query("dq01_reconciliation_suite", " UNION ALL ".join([
    line("C1", "SELECT count(*) FROM ((SELECT a FROM acq EXCEPT SELECT a FROM obs) UNION ALL (SELECT a FROM obs EXCEPT SELECT a FROM acq))"),
    line("C2", "SELECT count(*) FROM (SELECT rn, (day,a) >= lead((day,a)) OVER (ORDER BY rn) AS inv FROM split) WHERE inv"),
    line("C3", "SELECT count(*) FROM obs, ext WHERE r<0 OR r>rmax OR c<0 OR c>cmax"),
    line("C4", "SELECT count(*) FROM documents WHERE text IS NULL OR text=''"),
    line("C5", "SELECT count(*) FROM obs WHERE v4 NOT IN (0,1) OR v5 NOT IN (0,1) OR (v4=0 AND dn4<>0) OR (v5=0 AND dn5<>0)"),
    line("C6", "SELECT count(*) FROM (SELECT a, count(*) FILTER (WHERE land) AS n FROM px GROUP BY a) WHERE n=0"),
    line("C7", "SELECT CASE WHEN count(*)=max(n) AND count(*) FILTER (WHERE split='train')=max(greatest(floor(n*6e-1),1)) THEN 0 ELSE 1 END FROM split"),
    line("C8", "SELECT count(*) FROM (SELECT task_id, count(*) FILTER (WHERE state='READY') AS x, count(*) FILTER (WHERE state='COMPLETED') AS y FROM journal GROUP BY 1) WHERE y>0 AND x=0"),
    line("C9", "SELECT count(*) FROM scene WHERE sun_az IS NULL OR sun_el IS NULL"),
    line("C10", f"SELECT count(*) FROM (SELECT {COV} AS cov FROM scene) WHERE cov<9e-1"),
    line("C11", "SELECT count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text)")]))
def reconciliation_suite(s, d):
    obs, acq, scene = views.obs(s, d), views.acq(s, d), views.scene(s, d)
    def order_ok():
        o = fd.time_split(acq, ["day", "a"])
        nxt = o.select((C("position") - 1).alias("position"), F.struct("day", "a").alias("nx"))
        return q.empty("C2", o.join(nxt, "position").where(F.struct("day", "a") >= C("nx")))
    def grid_ok():
        from ..operators import grid
        return q.rule("C3", obs.crossJoin(F.broadcast(grid.extent(views.dem(s, d)))), (C("r") < 0) | (C("r") > C("_rmax")) | (C("c") < 0) | (C("c") > C("_cmax")))
    def split_ok():
        sp_ = fd.time_split(acq, ["day", "a"]).agg(F.count("*").alias("m"), F.max("n").alias("n"), F.count_if(C("split") == "train").alias("tr"))
        return q.rule("C7", sp_, ~((C("m") == C("n")) & (C("tr") == F.greatest(F.floor(C("n") * 0.6), F.lit(1)))))
    docs = views.table(s, d, "documents").select(C("doc_id").alias("path"), "text", "n_chars")
    checks = [
        ("C1", "same acquisitions", lambda: q.same_ids("C1", acq, obs, "a")), ("C2", "order is time order", order_ok),
        ("C3", "cells lie on the grid", grid_ok), ("C4", "content to hash is present", lambda: q.rule("C4", docs, F.coalesce(F.length("text"), F.lit(0)) == 0)),
        ("C5", "masks are lossless", lambda: q.rule("C5", obs, ~C("v4").isin(0, 1) | ~C("v5").isin(0, 1) | ((C("v4") == 0) & (C("dn4") != 0)) | ((C("v5") == 0) & (C("dn5") != 0)))),
        ("C6", "eligible members have land", lambda: q.rule("C6", views.px(s, d).groupBy("a").agg(F.count_if("land").alias("n")), C("n") == 0)),
        ("C7", "split arithmetic", split_ok),
        ("C8", "journal chain", lambda: q.rule("C8", jn.task_lineage(views.journal(s, d)), (C("completed") > 0) & (C("ready") == 0))),
        ("C9", "sun geometry present", lambda: q.rule("C9", scene, C("sun_az").isNull() | C("sun_el").isNull())),
        ("C10", "footprint covers the region", lambda: q.rule("C10", scene, region_coverage() < 0.9)),
        ("C11", "content has its recorded length", lambda: q.rule("C11", docs, ~C("n_chars").eqNullSafe(F.length("text"))))]
    return q.suite(checks).select("check_id", "passed", "bad")


@query("dq02_mask_reconstruction", """SELECT a, band, count(*) FILTER (WHERE f=1) AS ones, count(*) FILTER (WHERE f=0) AS zeros, count(*) FILTER (WHERE f NOT IN (0,1)) AS bad_flags,
    count(*) FILTER (WHERE f=0 AND v<>0) AS bad_transfer FROM (SELECT a, 'B4' AS band, dn4 AS v, v4 AS f FROM obs UNION ALL SELECT a, 'B5', dn5, v5 FROM obs UNION ALL SELECT a, 'QA', qa, vqa FROM obs) GROUP BY 1, 2""")
def mask_reconstruction(s, d):
    return q.mask_reconstruction(views.obs(s, d).withColumn("qa", C("qa").cast("long")), {"B4": ("dn4", "v4"), "B5": ("dn5", "v5"), "QA": ("qa", "vqa")})


def core_distance():
    """Distance of a cell from the core of its fold, from the geometry and not from the role."""
    return geo.rect_distance(C("c").cast("double"), C("r").cast("double"), (C("k") * 10 - 10).cast("double"), F.lit(0.0), (C("k") * 10 - 6).cast("double"), F.lit(2e9))


@query("dq03_result_audit", " UNION ALL ".join([
    line("Y1", "SELECT CASE WHEN string_agg(DISTINCT candidate, ',' ORDER BY candidate)='C0,C1,C1p,C2a' AND count(DISTINCT k)=5 THEN 0 ELSE 1 END FROM abl"), line("Y2", "SELECT count(*) FROM abl WHERE candidate NOT IN ('C0','C1p','C1','C2a')"),
    line("Y3", f"SELECT count(*) FROM {STATE_SQL} WHERE terminal_state NOT IN ('qualified','unsupported_by_evidence','redundant_equivalent','non_identifiable','deferred_missing_required_input')"),
    line("Y4", f"SELECT count(*) FROM {STATE_SQL} WHERE terminal_state='qualified' AND NOT (improvement_ok AND direction_ok AND boundary_ok AND stability_ok)"),
    line("Y5", "SELECT count(*) FROM (SELECT candidate, count(*) FILTER (WHERE split='train' AND comparable AND improvement IS NOT NULL) AS n FROM pairs GROUP BY 1) LEFT JOIN (SELECT candidate, count(*) AS m FROM train GROUP BY 1) USING (candidate) WHERE n<>coalesce(m,0)"),
    line("Y6", "SELECT count(*) FROM abl WHERE state='unsupported' AND (reason IS NULL OR core_land IS NULL)"),
    line("Y7", "SELECT count(*) FROM role WHERE land AND lit AND role='domain' AND greatest((k-1)*10-c, c-(k*10-6), 0)<3"), line("Y8", "SELECT count(*) FROM pairs WHERE NOT comparable"), line("Y9", f"SELECT count(*) FROM {STATE_SQL} WHERE terminal_state IN ('identity_qualified','non_identifiable_equivalent','deferred_missing_anchor')"),
    line("Y10", "SELECT abs(count(*)-count(DISTINCT a)*count(DISTINCT k)*count(DISTINCT band)*count(DISTINCT candidate)) FROM abl"),
    line("Y11", "SELECT count(*) FROM (SELECT candidate, median((t1-alpha_base)/alpha_base) FILTER (WHERE alpha_base<>0) AS s FROM train GROUP BY 1) WHERE s IS NULL")]))
def result_audit(s, d):
    u = ablation_units(s, d)
    pairs = io.materialize(s, models.pair_with_baseline(u), "pairs")
    v = io.materialize(s, models.verdicts(pairs), "verdicts")
    # fixed names of two closed sets
    terminal = ["qualified", "unsupported_by_evidence", "redundant_equivalent", "non_identifiable", "deferred_missing_required_input"]
    identity_set = ["identity_qualified", "non_identifiable_equivalent", "deferred_missing_anchor"]
    config = F.concat_ws(";", F.array_join(F.array_sort(F.collect_set("candidate")), ","), F.count_distinct("k"))  # a small closed set
    frozen = F.sha2(F.lit(f"{','.join(sorted(models.CANDIDATES))};{len(FOLDS)}"), 256)
    all_ok = C("improvement_ok") & C("direction_ok") & C("boundary_ok") & C("stability_ok")
    n_train = pairs.groupBy("candidate").agg(F.count_if((C("split") == "train") & C("comparable") & C("improvement").isNotNull()).alias("n"))
    shape = u.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in ("a", "k", "band", "candidate")])
    z = zoned(s, d)
    used = fd.explode_roles(z.where("land AND lit"), FOLDS, (fd.DOMAIN,)).withColumn("gap", core_distance())
    checks = [
        ("Y1", "config hash", lambda: q.rule("Y1", u.agg(F.sha2(config, 256).alias("h")), C("h") != frozen)),
        ("Y2", "registered candidates only", lambda: q.rule("Y2", u, ~C("candidate").isin(*models.CANDIDATES))),
        ("Y3", "terminal closed set", lambda: q.rule("Y3", v, ~C("terminal_state").isin(*terminal))),
        ("Y4", "qualified holds all", lambda: q.rule("Y4", v, (C("terminal_state") == "qualified") & ~F.coalesce(all_ok, F.lit(False)))),
        ("Y5", "train units only", lambda: q.rule("Y5", v.join(n_train, "candidate"), C("train_units") != C("n"))),
        ("Y6", "unsupported keeps its reason", lambda: q.rule("Y6", u, (C("state") == "unsupported") & (C("reason").isNull() | C("core_land").isNull()))),
        ("Y7", "no leakage", lambda: q.rule("Y7", used, C("gap") < fit.BUFFER_CELLS)),
        ("Y8", "comparable coverage", lambda: q.rule("Y8", pairs, ~C("comparable"))),
        ("Y9", "closed sets apart", lambda: q.rule("Y9", v, C("terminal_state").isin(*identity_set))),
        ("Y10", "unit count", lambda: q.rule("Y10", shape, C("n") != C("n_a") * C("n_k") * C("n_band") * C("n_candidate"))),
        ("Y11", "shift reported", lambda: q.rule("Y11", v.where("train_units > 0"), C("median_alpha_shift").isNull()))]
    return q.suite(checks).select("check_id", "passed", "bad")


@query("dq04_domain_reconciliation", " UNION ALL ".join([
    line("R1", "SELECT count(*) FROM ((SELECT d FROM dday EXCEPT SELECT d FROM dclass) UNION ALL (SELECT d FROM dclass EXCEPT SELECT d FROM dday))"),
    line("R2", "SELECT count(*) FROM (SELECT d, count(DISTINCT CASE WHEN d%5<3 THEN 'train' WHEN d%5=3 THEN 'calibration' ELSE 'evaluation' END) AS n FROM dclass GROUP BY d) WHERE n<>1"),
    line("R3", "SELECT count(*) FROM (SELECT d, count(*) AS t, count(coverage) AS s, count(*) FILTER (WHERE coverage IS NULL) AS u, count(*) FILTER (WHERE coverage>=3e-1) AS f, count(*) FILTER (WHERE coverage<3e-1) AS j FROM dday GROUP BY d) WHERE s+u<>t OR f+j<>s"),
    line("R4", """SELECT count(*) FROM (SELECT d, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM refday f WHERE f.d=x.d AND abs(f.day-x.day)<=3)) AS n FROM (SELECT DISTINCT d, day FROM dday) x GROUP BY d) t
        JOIN (SELECT d, count(*) FILTER (WHERE gap<=3) AS m FROM (SELECT x.d, x.day, min(abs(f.day-x.day)) AS gap FROM (SELECT DISTINCT d, day FROM dday) x LEFT JOIN refday f ON f.d=x.d GROUP BY 1, 2) GROUP BY d) USING (d) WHERE n<>m"""), line("R5", "SELECT count(*) FROM (SELECT DISTINCT d FROM dclass WHERE d NOT IN (SELECT d FROM refday))"),
    line("R6", "SELECT count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text)"), line("R7", "SELECT count(*) FROM artifact WHERE role NOT IN ('ground_truth','reference_observation','proxy','unavailable')"),
    line("R8", "SELECT CASE WHEN count(*)>0 THEN 0 ELSE 1 END FROM refday"), line("R9", "SELECT count(*) FROM artifact WHERE role='ground_truth'"),
    line("R10", f"SELECT count(*) FROM (SELECT d, {FAILED_SQL} AS failed, (CASE WHEN NOT a1 OR NOT a3 OR NOT a4 OR NOT a6d OR NOT a7 THEN 1 ELSE 0 END) AS blocked FROM {SCREEN_SQL}) WHERE blocked=1 AND failed=''")]))
def domain_reconciliation(s, d):
    day, cls, ref = views.domain_day(s, d), views.domain_class(s, d), views.ref_day(s, d)
    led = domains.opportunity_ledger(day, 0.3, 0.6)
    role = F.when(C("d") % 5 < 3, "train").when(C("d") % 5 == 3, "calibration").otherwise("evaluation")
    m = jn.nearest_date(day, ref, "d")
    # the tight matches once more, as days that some reference reaches within three days either way
    reached = ref.select("d", F.explode(F.sequence(F.date_sub("day", 3), F.date_add("day", 3))).alias("day")).distinct()
    again = day.select("d", "day").distinct().join(reached, ["d", "day"]).groupBy("d").agg(F.count("*").alias("g"))
    tight = m.groupBy("d").agg(F.count_if(C("match") == "tight").alias("t")).join(again, "d", "left").na.fill(0)
    art = views.artifact(s, d)
    seen = cls.select("d").distinct()
    checks = [
        ("R1", "selection equals manifest", lambda: q.same_ids("R1", day, cls, "d")),
        ("R2", "one role per domain", lambda: q.rule("R2", cls.groupBy("d").agg((F.min(role) != F.max(role)).alias("several")), C("several"))),
        ("R3", "ledger closes", lambda: q.rule("R3", led, ~C("closes"))), ("R4", "matches agree", lambda: q.rule("R4", tight, C("t") != C("g"))),
        ("R5", "references for all domains", lambda: q.empty("R5", seen.join(ref.select("d").distinct(), "d", "left_anti"))),
        ("R6", "content has its recorded length", lambda: q.rule("R6", views.table(s, d, "documents"), ~C("n_chars").eqNullSafe(F.length("text")))),
        ("R7", "reference class closed", lambda: q.rule("R7", art, ~C("role").isin("ground_truth", "reference_observation", "proxy", "unavailable"))),
        ("R8", "a reference passed the audit", lambda: q.rule("R8", ref.agg(F.count("*").alias("n")), C("n") == 0)),
        ("R9", "no ground truth class", lambda: q.rule("R9", art, C("role") == "ground_truth")),
        ("R10", "blocked item stays blocked", lambda: q.rule("R10", admitted(s, d), C("admitted") & F.coalesce((C("strong") < 5) | (C("human_share") > 0.5) | (C("foreign") > 0) | (C("cover") < 0.95) | (C("separation_km") < 200), F.lit(True))))]
    return q.suite(checks).select("check_id", "passed", "bad")


UNIT_GATE = "CASE WHEN alpha IS NOT NULL AND core_scored>0 THEN 'scored' ELSE 'not_scored' END"
NONE = "SELECT 0"


@query("dq05_output_validator", " UNION ALL ".join([
    line("required_fields", NONE), line("unit_keys", "SELECT count(*) FROM (SELECT a,k,band FROM unit GROUP BY 1,2,3 HAVING count(*)>1)"),
    line("scope_keys", "SELECT count(*) FROM (SELECT a,k,band,scope FROM scopeval GROUP BY 1,2,3,4 HAVING count(*)>1)"),
    line("curve_keys", "SELECT count(*) FROM (SELECT a,k,band,scope,q FROM gridr GROUP BY 1,2,3,4,5 HAVING count(*)>1)"),
    line("unit_finite", "SELECT count(*) FROM unit WHERE isnan(coverage) OR isinf(coverage) OR isnan(mae) OR isinf(mae)"),
    line("unit_terminal", f"SELECT count(*) FROM unit WHERE {UNIT_GATE}='scored' AND reason IS NOT NULL"),
    line("unit_counts", "SELECT count(*) FROM unit WHERE NOT (core_scored<=core_land AND core_land<=core_total)"),
    line("unit_ratio", "SELECT count(*) FROM unit WHERE coverage IS DISTINCT FROM CASE WHEN core_land>0 THEN core_scored::DOUBLE/core_land END"),
    line("scope_finite", "SELECT count(*) FROM scopeval WHERE isnan(normalized) OR isinf(normalized)"),
    line("scope_closed_set", "SELECT count(*) FROM scopeval WHERE scope NOT IN ('unit_all_scored','mu_band_low','mu_band_mid','mu_band_high')"),
    line("verdict_owner", "SELECT count(*) FROM scopeval WHERE (gate='evaluated') <> (reason IS NULL AND verdict NOT LIKE 'not_evaluable%')"),
    line("scope_identities", "SELECT count(*) FROM unit LEFT JOIN (SELECT a,k,band,count(DISTINCT scope) AS n FROM scopeval GROUP BY 1,2,3) USING (a,k,band) WHERE n IS DISTINCT FROM 4"),
    line("scope_sum", "SELECT count(*) FROM (SELECT a,k,band,sum(n_scored) FILTER (WHERE scope='unit_all_scored') AS w,sum(n_scored) FILTER (WHERE scope<>'unit_all_scored') AS p FROM scopeval GROUP BY 1,2,3) WHERE w<>p"),
    line("unit_sum", "SELECT count(*) FROM unit JOIN scopeval USING (a,k,band) WHERE scope='unit_all_scored' AND alpha IS NOT NULL AND core_scored>0 AND n_scored<>core_scored"),
    line("curve_finite", "SELECT count(*) FROM gridr WHERE isnan(coverage) OR isinf(coverage) OR isnan(mae) OR isinf(mae)"),
    line("curve_ratio", "SELECT count(*) FROM gridr JOIN unit u USING (a,k,band) WHERE accepted IS NOT NULL AND gridr.coverage IS DISTINCT FROM accepted::DOUBLE/u.core_land"),
    line("curve_sequence", "SELECT count(*) FROM (SELECT a,k,band,scope,count(*) AS n,min(q) AS lo,max(q) AS hi FROM gridr GROUP BY 1,2,3,4) WHERE n<>20 OR lo<>1 OR hi<>20"),
    line("curve_identities", "SELECT count(*) FROM (SELECT DISTINCT a,k,band,scope FROM gridr) g FULL JOIN scopeval v USING (a,k,band,scope) WHERE v.gate IS NULL"),
    line("aggregate_counts", NONE)]))
def output_validator(s, d):
    """Unit, scope, curve and verdict tables of the selective experiment against each other."""
    out = scopes(s, d)
    sm = io.materialize(s, out["summary"], "summary")
    scored = (C("state") == "fitted") & (C("core_scored") > 0)
    category = F.when(scored, "scored").when(C("state") == "fitted", q.UNIT_TERMINALS[1]).otherwise(q.UNIT_TERMINALS[0])
    u = units(s, d).select("a", "k", "band", F.when(scored, "scored").otherwise("not_scored").alias("gate"), category.alias("category"), "reason", "core_total", "core_land", "core_scored", "coverage", "mae")
    told = sm.groupBy("band", "scope", "verdict").agg(F.count("*").alias("n"))
    support = ["unit_gate_not_scored", "zero_base_valid_land_denominator", "zero_scored_denominator", f"N_scored_below_{MIN_SCOPE}"]
    degenerate = ["score_range_at_or_below_tau_score", "unique_proxy_values_below_3", "admissible_exact_points_below_3", "canonical_reachable_grid_points_below_3", "AURC_nonpositive_span"]
    owner = {**{r: risk.V_SUPPORT for r in support}, **{r: risk.V_DEGENERATE for r in degenerate}}
    required = {"units": u.columns, "scopes": ["a", "k", "band", "scope", "n_scored", "gate", "verdict", "reason", "shape", "normalized"],
                "curve": ["a", "k", "band", "scope", "q", "status", "point", "accepted", "coverage", "mae"], "aggregate": told.columns}
    return q.validate_tables(u, sm, io.materialize(s, out["grid"], "grid"), told, ["a", "k", "band"], risk.SCOPES, risk.SHAPE_VERDICT, owner, required)


@query("dq06_leakage_check", """SELECT a, k, count(*) FILTER (WHERE greatest((k-1)*10-c, c-(k*10-6), 0) < 3) AS violations, count(*) AS used FROM role WHERE land AND lit AND role='domain' GROUP BY a, k""")
def leakage_check(s, d):
    z = fd.explode_roles(fd.with_zone(views.px(s, d), FOLDS, fit.BUFFER_CELLS), FOLDS, (fd.DOMAIN,))
    core = core_distance()
    # the role is recomputed from the geometry of the fold, not taken from the label
    return q.leakage(z.withColumn("role", F.when(core < fit.BUFFER_CELLS, fd.BUFFER).otherwise(fd.DOMAIN)), C("land") & C("lit"))


#: Registry fields of a customer by arithmetic on its key; most rules have records that break them.
REG = """(SELECT *, CASE WHEN cls='not_applicable' THEN CASE WHEN id%35=5 THEN 'identity_qualified' END ELSE CASE id%5 WHEN 0 THEN 'identity_qualified' WHEN 1 THEN 'identity_qualified_with_fixed_gauge'
      WHEN 2 THEN 'non_identifiable_equivalent' WHEN 3 THEN 'excluded_class_or_path_violation' ELSE 'deferred_missing_anchor' END END AS disp,
    CASE WHEN cls='not_applicable' OR id%89=0 OR id%5>1 THEN NULL WHEN id%4=1 THEN 'profile' WHEN id%4=2 THEN 'global' ELSE 'local' END AS scope,
    CASE WHEN id%5=2 THEN id+1 END AS partner, CASE WHEN id%5=3 AND id%50<>3 THEN id-1 END AS watch, id%5=1 OR id%53=0 AS fixed, id%41<>0 AS ruled, id%67<>0 AS bound
  FROM (SELECT c_custkey AS id, CASE WHEN c_custkey%97=0 THEN 'support_mask' WHEN c_custkey%6=0 THEN 'G' WHEN c_custkey%6=1 THEN 'X_t' WHEN c_custkey%6=2 THEN 'Z_t' WHEN c_custkey%6=3 THEN 'N_t'
    WHEN c_custkey%6=4 THEN 'E' ELSE 'not_applicable' END AS cls, c_name AS name FROM customer))"""
ASIDE = "cls='not_applicable'"


@query("dq07_registry_rules", " UNION ALL ".join([
    line("I1_unique", f"SELECT count(*) FROM (SELECT id FROM {REG} GROUP BY id HAVING count(*)>1)"),
    line("I1_class", f"SELECT count(*) FROM {REG} WHERE cls='support_mask'"),
    line("I1_disposition", f"SELECT count(*) FROM {REG} WHERE NOT {ASIDE} AND disp IS NULL"),
    line("I2_no_gradient_for_E", f"SELECT count(*) FROM {REG} WHERE cls='E' AND (id%46=4 OR id%38=4)"),
    line("I3_not_applicable", f"SELECT count(*) FROM {REG} WHERE {ASIDE} AND (disp IS NOT NULL OR id%77=5 OR id%30=5)"),
    line("I4_scope", f"SELECT count(*) FROM {REG} WHERE NOT {ASIDE} AND id%5<2 AND scope IS NULL"),
    line("I5_global_proof", f"SELECT count(*) FROM {REG} WHERE NOT {ASIDE} AND scope='global' AND (id%22=0 OR id%58=0)"),
    line("I6_partner", f"SELECT count(*) FROM {REG} x LEFT JOIN {REG} y ON x.partner=y.id WHERE x.cls<>'not_applicable' AND x.disp='non_identifiable_equivalent' AND y.watch IS DISTINCT FROM x.id"),
    line("I7_fixed_gauge", f"SELECT count(*) FROM {REG} WHERE NOT {ASIDE} AND fixed AND (id%5<>1 OR NOT ruled)"),
    line("I8_bound_hash", f"SELECT (SELECT count(*) FROM {REG} WHERE NOT {ASIDE} AND (NOT bound OR id%61=0)) + (SELECT count(*) FROM supplier WHERE s_suppkey%7=0)"),
    line("D1_disposition", "SELECT count(*) FROM supplier WHERE s_suppkey%13=0"), line("D2_no_class", "SELECT count(*) FROM supplier WHERE s_suppkey%17=0"),
    line("D3_distinct", "SELECT count(*) FROM supplier WHERE s_suppkey%11=0")]))
def registry_rules(s, d):
    """A registry of JSON records over customers, deferred ones over suppliers, bound to their names."""
    r = s.sql("SELECT * FROM " + REG.replace("FROM customer", "FROM {customer}"), customer=views.table(s, d, "customer"))
    i = C("id")
    text = lambda x: x.cast("string")
    sha = F.when(i % 61 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("name", 256))
    aside = C("cls") == "not_applicable"
    doc = F.struct(
        text(i).alias("object_id"), C("cls").alias("identity_class"), C("disp").alias("disposition"), C("scope").alias("evidence_scope"), text(C("partner")).alias("equivalence_partner"),
        F.when(C("watch").isNotNull(), F.struct(text(C("watch")).alias("object_id"))).alias("equivalence_watch"),
        F.when(C("cls") == "E", F.array_compact(F.array(F.when(i % 46 != 4, q.FORBIDDEN_FOR_E[0]), F.when(i % 38 != 4, q.FORBIDDEN_FOR_E[1])))).alias("forbidden_paths"),
        F.when(aside & (i % 77 != 5), "no quantity of the graph").alias("not_applicable_reason"), F.when(aside & (i % 30 == 5), "later").alias("quality_phase"),
        F.when(C("scope") == "global", F.when(i % 22 == 0, "multi_start").otherwise("analytic_proof")).alias("global_justification_kind"),
        F.when((C("scope") == "global") & (i % 58 != 0), "shown in closed form").alias("evidence_scope_justification"),
        F.struct(C("fixed").alias("fixed"), F.when(C("ruled"), "unit sum").alias("rule")).alias("gauge"),
        F.when(C("bound"), F.struct(C("name").alias("relative_path"), sha.alias("sha256"))).alias("source_binding"))
    k = C("s_suppkey")
    late = F.struct(
        C("s_name").alias("object_id"), F.when(k % 13 == 0, "identity_qualified").otherwise("deferred_missing_anchor").alias("disposition"), F.when(k % 17 == 0, "G").alias("identity_class"),
        F.when(k % 11 != 0, F.array(F.lit("differs in its anchor"))).alias("distinctness_assertions"),
        F.struct(C("s_name").alias("relative_path"), F.when(k % 7 == 0, F.lit("x")).otherwise(F.sha2("s_name", 256)).alias("sha256")).alias("source_binding"))
    sup = views.table(s, d, "supplier")
    sources = r.select(C("name").alias("path")).union(sup.select("s_name")).distinct().withColumn("sha256", F.sha2("path", 256))
    return q.registry_rules(r.select(F.to_json(doc).alias("doc")), sup.select(F.to_json(late).alias("doc")), sources)


@query("dq08_disposition_ledger", f"""SELECT o_orderpriority AS disposition, count(*) AS n, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'admitted' ELSE 'blocked' END AS side, {DIGEST} AS members
    FROM (SELECT *, o_orderkey::VARCHAR AS t FROM orders) GROUP BY 1""")
def disposition_ledger(s, d):
    o = views.table(s, d, "orders").select(C("o_orderpriority").alias("disposition"), "o_orderkey")
    return q.disposition_ledger(o, "disposition", ["1-URGENT", "2-HIGH"], identity.set_digest(identity.row_text(C("o_orderkey"))))


@query("dq08_equivalence_pairs", """SELECT least(s_nationkey, c_nationkey) AS first_id, greatest(s_nationkey, c_nationkey) AS second_id, count(*) AS relations FROM lineitem JOIN supplier ON l_suppkey=s_suppkey
    JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE s_nationkey<>c_nationkey GROUP BY 1, 2""")
def equivalence_pairs(s, d):
    t = {n: views.table(s, d, n) for n in ("lineitem", "supplier", "orders", "customer")}
    j = (t["lineitem"].join(t["supplier"], C("l_suppkey") == C("s_suppkey")).join(t["orders"], C("l_orderkey") == C("o_orderkey"))
         .join(t["customer"], C("o_custkey") == C("c_custkey")).where("s_nationkey <> c_nationkey"))
    p = F.array_sort(F.array("s_nationkey", "c_nationkey"))
    return j.groupBy(p[0].alias("first_id"), p[1].alias("second_id")).agg(F.count("*").alias("relations"))


#: Equivalent objects (every fifth customer) point in pairs, in rings of three, into a ring or nowhere.
OBJ = """(SELECT c_custkey AS object_id, CASE WHEN c_custkey%97=0 THEN 'qualified' ELSE CASE c_custkey%5 WHEN 0 THEN 'identity_qualified' WHEN 1 THEN 'identity_qualified_with_fixed_gauge'
      WHEN 2 THEN 'non_identifiable_equivalent' WHEN 3 THEN 'excluded_class_or_path_violation' ELSE 'deferred_missing_anchor' END END AS disposition,
    CASE WHEN c_custkey%5=2 AND c_custkey%97<>0 THEN c_custkey+CASE c_custkey%35 WHEN 2 THEN 5 WHEN 7 THEN -5 WHEN 12 THEN 5 WHEN 17 THEN 5 WHEN 22 THEN -10 WHEN 27 THEN -5 ELSE 1000000000 END END AS partner FROM customer)"""
CAND = """(SELECT s_suppkey AS id, CASE WHEN s_suppkey%19=0 THEN 'undecided' WHEN s_suppkey%3=0 THEN 'equivalent_by_construction' ELSE 'qualified' END AS terminal_state, s_suppkey%4<>0 AS run,
    CASE WHEN s_suppkey%5=0 THEN s_suppkey-1 END AS constrains, CASE WHEN s_suppkey%35=0 OR s_suppkey%5<>0 THEN s_name END AS parameter,
    CASE WHEN s_suppkey%3=0 THEN s_suppkey*5+2 END AS mirrors, CASE WHEN s_suppkey%3=0 THEN s_suppkey*5+CASE WHEN s_suppkey%7=0 THEN 7 ELSE -3 END END AS partner FROM supplier)"""
GATE = """(SELECT o_orderstatus AS terminal_state, CASE WHEN o_orderkey%113=0 THEN NULL ELSE floor(o_totalprice)::BIGINT END AS distance, o_orderstatus<>'P' AS curvature, 150000 AS threshold,
    floor(o_totalprice)::BIGINT+o_custkey%10-1 AS buffer, o_orderkey%2=0 AS first_over, (o_orderkey%2<>0)<>(o_orderkey%17=0) AS second_over FROM orders)"""
CLOSED = ["O", "F", "P", "qualified", "equivalent_by_construction"]
MAPPING = {"qualified": "identity_qualified", "equivalent_by_construction": "non_identifiable_equivalent"}
S75 = "(" + ",".join(f"'{x}'" for x in q.DISPOSITIONS) + ")"
TWIN = f"(SELECT x.*, y.partner AS theirs, y.disposition AS settled FROM {CAND} x JOIN {OBJ} y ON x.mirrors=y.object_id)"


@query("dq09_cross_table_rules", f"""WITH RECURSIVE walk AS (SELECT object_id AS home, partner AS place FROM {OBJ} WHERE partner IS NOT NULL UNION
    SELECT home, n.partner FROM walk JOIN {OBJ} n ON n.object_id=place WHERE place<>home AND n.partner IS NOT NULL) """ + " UNION ALL ".join([
    line("X1", "SELECT count(*) FROM ((SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer))"),
    line("X2", f"SELECT count(*) FROM (SELECT terminal_state FROM {CAND} UNION ALL SELECT terminal_state FROM {GATE}) WHERE terminal_state NOT IN ('O','F','P','qualified','equivalent_by_construction')"),
    line("X3", f"SELECT count(*) FROM {OBJ} WHERE disposition NOT IN {S75}"),
    line("X4_partner_known", f"SELECT count(*) FROM {OBJ} x WHERE disposition='non_identifiable_equivalent' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey=x.partner)"),
    line("X4_partner_returns", f"SELECT count(*) FROM {OBJ} x WHERE disposition='non_identifiable_equivalent' AND NOT EXISTS (SELECT 1 FROM walk WHERE home=x.object_id AND place=home)"),
    line("X4_same_partner", f"SELECT count(*) FROM {TWIN} WHERE partner IS DISTINCT FROM theirs"),
    line("X4_mapped_state", f"SELECT count(*) FROM {TWIN} WHERE CASE terminal_state WHEN 'qualified' THEN 'identity_qualified' WHEN 'equivalent_by_construction' THEN 'non_identifiable_equivalent' END IS DISTINCT FROM settled"),
    line("X5", f"SELECT count(*) FROM {CAND} WHERE constrains IS NOT NULL AND parameter IS NOT NULL"),
    line("X6", f"SELECT count(*) FROM (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey%4<>0 OR l_suppkey%31=0) x FULL JOIN (SELECT id FROM {CAND} WHERE run) y USING (id) WHERE x.id IS NULL OR y.id IS NULL"),
    line("X7", f"SELECT count(*) FROM {GATE} WHERE distance IS NULL OR (distance>threshold AND NOT curvature) OR buffer<distance"),
    line("X8", f"SELECT count(*) FROM {GATE} WHERE first_over=second_over"),
    line("X9", "SELECT count(*) FROM labels WHERE toxic=1 OR doc_id%50=0"),
    line("X10", "SELECT count(*) FROM documents WHERE regexp_matches(text, '(TODO|TBD|FIXME|<[A-Z_]+>)')"),
    line("X11", """SELECT count(*) FROM (SELECT item_id%30 AS path, sha256(text) AS h FROM benchmark UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id>=25) b
        LEFT JOIN (SELECT doc_id, max(sha256(text)) AS now FROM documents GROUP BY 1) x ON b.path=x.doc_id WHERE now IS DISTINCT FROM h""")]))
def cross_table_rules(s, d):
    """Customers as registry, suppliers as candidates, orders as gates, labels as declarations, documents as bound texts."""
    t = {n: views.table(s, d, n) for n in ("supplier", "customer", "orders", "lineitem", "labels", "documents", "benchmark")}
    registry = s.sql("SELECT * FROM " + OBJ.replace("FROM customer", "FROM {customer}"), customer=t["customer"])
    candidates = s.sql("SELECT * FROM " + CAND.replace("FROM supplier", "FROM {supplier}"), supplier=t["supplier"])
    candidates = candidates.withColumn("new_parameters", F.array_compact(F.array("parameter")))
    k, over = C("o_orderkey"), F.floor("o_totalprice")
    sway = lambda up: F.concat(F.when(up, q.OVER).otherwise(q.UNDER), F.lit(" v_sky"))
    gates = t["orders"].select(
        C("o_orderstatus").alias("terminal_state"), F.when(k % 113 != 0, over).alias("distance"), (C("o_orderstatus") != "P").alias("curvature"), F.lit(150000).alias("threshold"),
        (over + C("o_custkey") % 10 - 1).alias("buffer"), sway(k % 2 == 0).alias("truncation_effect"), sway((k % 2 != 0) != (k % 17 == 0)).alias("flat_effect"))
    declared = t["labels"].select(F.when(C("toxic") == 1, "BLIND").otherwise(q.NOT_BLIND).alias("status"), F.when(C("doc_id") % 50 == 0, "unseen").otherwise(q.EXPLORATORY).alias("exposure"))
    sequence = t["lineitem"].where("l_suppkey % 4 <> 0 OR l_suppkey % 31 = 0").select(C("l_suppkey").alias("id"))
    sha = F.sha2("text", 256)
    bound = t["benchmark"].select((C("item_id") % 30).alias("path"), sha.alias("recorded")).unionByName(
        t["documents"].where("doc_id >= 25").select(C("doc_id").alias("path"), sha.alias("recorded")))
    return q.cross_rules(s, registry, t["orders"].select(C("o_custkey").alias("object_id")), candidates, sequence, gates, declared, t["documents"], bound,
                         t["documents"].select(C("doc_id").alias("path"), sha.alias("current")), CLOSED, MAPPING)


PAGE_SQL = "(SELECT page_id, regexp_replace(url,'^https?://[^/]+/','') AS relative_path, split_part(url,':',1) AS scheme, page_id//10 AS batch FROM pages)"


@query("dq10_manifest_drift", " UNION ALL ".join([
    line("entry_count", f"SELECT abs(count(*)-1000) FROM {PAGE_SQL}"),
    line("gapless_positions", f"SELECT max(page_id)-min(page_id)+1-count(DISTINCT page_id)+count(*)-count(DISTINCT page_id) FROM {PAGE_SQL}"),
    line("unique_page_id", f"SELECT count(*)-count(DISTINCT page_id) FROM {PAGE_SQL}"), line("unique_relative_path", f"SELECT count(*)-count(DISTINCT relative_path) FROM {PAGE_SQL}"),
    line("frozen_scheme", f"SELECT count(*) FROM {PAGE_SQL} WHERE scheme IS DISTINCT FROM 'https'"),
    line("relative_paths", f"SELECT count(*) FROM {PAGE_SQL} WHERE coalesce(relative_path LIKE '/%' OR contains(relative_path,'..'), true)"),
    line("canonical_order", f"SELECT count(*) FROM {PAGE_SQL} x JOIN {PAGE_SQL} y ON y.page_id=x.page_id+1 WHERE (x.batch, x.relative_path) > (y.batch, y.relative_path)")]))
def manifest_drift(s, d):
    p = views.table(s, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]+/", "").alias("relative_path"), F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"), F.expr("page_id div 10").alias("batch"))
    return q.manifest_drift(p, "page_id", ["batch", "relative_path"], ["page_id", "relative_path"], {"scheme": "https"}, 1000, "relative_path")


@query("dq11_scene_completeness", """SELECT scene_id, CASE WHEN cloud IS NOT NULL AND sun_az IS NOT NULL AND sun_el IS NOT NULL THEN 'exportable' ELSE 'cataloged' END AS state,
    array_to_string(list_filter([CASE WHEN cloud IS NULL THEN 'CLOUD_COVER' END, CASE WHEN sun_az IS NULL THEN 'SUN_AZIMUTH' END, CASE WHEN sun_el IS NULL THEN 'SUN_ELEVATION' END],
    lambda x: x IS NOT NULL), ',') AS missing FROM scene""")
def scene_completeness(s, d):
    miss = arrays.failed_names({"CLOUD_COVER": C("cloud").isNotNull(), "SUN_AZIMUTH": C("sun_az").isNotNull(), "SUN_ELEVATION": C("sun_el").isNotNull()})
    return views.scene(s, d).select("scene_id", F.when(F.size(miss) == 0, "exportable").otherwise("cataloged").alias("state"), text_list(miss).alias("missing"))


@query("dq12_summary_validation", " UNION ALL ".join([
    line("no_null_count", "SELECT count(*) FROM labels WHERE quality IS NULL OR toxic IS NULL"), line("known_id", "SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    line("complete_set", "SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"), line("one_row_each", "SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*)>1)")]))
def summary_validation(s, d):
    lab, doc = views.table(s, d, "labels"), views.table(s, d, "documents").select("doc_id")
    return q.union_all([q.rule("no_null_count", lab, C("quality").isNull() | C("toxic").isNull()), q.empty("known_id", lab.join(doc, "doc_id", "left_anti")),
                        q.empty("complete_set", doc.join(lab, "doc_id", "left_anti")), q.unique_keys("one_row_each", lab, ["doc_id"])])


KNOWN = ["Supplier#000000003", "Supplier#000000007", "Supplier#999999999"]


@query("dq13_known_members", f"""SELECT k AS scene_id, CASE WHEN s.scene_id IS NULL THEN 'not_recovered' ELSE 'recovered' END AS status, strftime(day,'%Y-%m-%d') AS day, {R('cov')} AS coverage FROM
    (SELECT unnest({KNOWN}) AS k) LEFT JOIN (SELECT *, {COV} AS cov FROM scene) s ON k=s.scene_id""")
def known_members(s, d):
    named = s.createDataFrame([(k,) for k in KNOWN], "scene_id string")  # a named list, three rows
    cat = views.scene(s, d).select("scene_id", F.date_format("day", "yyyy-MM-dd").alias("day"), region_coverage().alias("cov"))
    j = named.join(cat, "scene_id", "left")
    return j.select("scene_id", F.when(C("day").isNull(), "not_recovered").otherwise("recovered").alias("status"), "day", *rounded(coverage="cov"))


@query("dq14_criterion_receipts", f"""SELECT candidate, criterion, {R('measured')} AS measured, passed FROM (SELECT candidate, 'median_relative_improvement' AS criterion, median_improvement AS measured, improvement_ok AS passed FROM {VERDICT_SQL}
    UNION ALL SELECT candidate, 'fold_direction_consistency', folds_positive, direction_ok FROM {VERDICT_SQL} UNION ALL SELECT candidate, 'parameter_boundary_hits', boundary_share, boundary_ok FROM {VERDICT_SQL}
    UNION ALL SELECT candidate, 'numerical_stability', max_condition, stability_ok FROM {VERDICT_SQL})""")
def criterion_receipts(s, d):
    v = io.materialize(s, models.verdicts(ablation_pairs(s, d)), "verdicts")
    r = q.receipts(v, ["candidate"], {
        "median_relative_improvement": (C("median_improvement"), C("improvement_ok"), "median over train units at least 0.05"),
        "fold_direction_consistency": (C("folds_positive"), C("direction_ok"), "positive in at least four folds"),
        "parameter_boundary_hits": (C("boundary_share"), C("boundary_ok"), "share outside [0, 1] at most 0.10"),
        "numerical_stability": (C("max_condition"), C("stability_ok"), "condition number below 1e10")})
    return r.select("candidate", "criterion", *r6c("measured"), "passed")


@query("dq15_source_mask_summary", f"""SELECT primary_cause, count(*) AS acquisitions, bool_and(z=0) AS all_valid FROM {CAUSE_SQL} GROUP BY 1""")
def source_mask_summary(s, d):
    return mask_causes(s, d).groupBy("primary_cause").agg(F.count("*").alias("acquisitions"), F.bool_and(C("z") == 0).alias("all_valid"))


@query("dq16_upstream_binding", """SELECT binding, count(*) AS n FROM (SELECT i.path, CASE WHEN count(*)>1 THEN 'bound_twice' WHEN max(x.h) IS NULL THEN 'missing' WHEN max(x.h)<>max(i.h) THEN 'drifted' ELSE 'intact' END AS binding
    FROM (SELECT item_id%30 AS path, sha256(text) AS h FROM benchmark UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id>=25) i
    LEFT JOIN (SELECT doc_id, sha256(text) AS h FROM documents) x ON i.path=x.doc_id GROUP BY 1) GROUP BY 1""")
def upstream_binding(s, d):
    """Benchmark items bind low paths (some twice), documents bind themselves from 25 on."""
    doc = views.table(s, d, "documents")
    b = views.table(s, d, "benchmark").select((C("item_id") % 30).alias("path"), F.sha2("text", 256).alias("recorded"))
    b = b.unionByName(doc.where("doc_id >= 25").select(C("doc_id").alias("path"), F.sha2("text", 256).alias("recorded")))
    return q.binding_check(b, doc.select(C("doc_id").alias("path"), F.sha2("text", 256).alias("current"))).groupBy("binding").agg(F.count("*").alias("n"))


@query("dq17_missing_metadata", """SELECT missing, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN p_name IS NULL OR p_name='' THEN 'p_name' END, CASE WHEN z IS NULL THEN 'z' END,
    CASE WHEN p_type IS NULL THEN 'p_type' END], lambda x: x IS NOT NULL), ',') AS missing FROM (SELECT part.*, CASE WHEN p_size<>50 THEN 1 END AS z FROM part)) GROUP BY 1""")
def missing_metadata(s, d):
    p = views.table(s, d, "part").withColumn("z", F.when(C("p_size") != 50, 1))
    miss = arrays.failed_names({"p_name": C("p_name") != "", "z": C("z").isNotNull(), "p_type": C("p_type").isNotNull()})
    return p.groupBy(text_list(miss).alias("missing")).agg(F.count("*").alias("n"))


@query("dq18_versioned_universe", """SELECT 'left' AS change, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'joined', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def versioned_universe(s, d):
    v = q.version_difference(views.table(s, d, "documents"), views.table(s, d, "labels"), "doc_id")
    g = v.agg(F.count_if(C("change") == "left").alias("left"), F.count_if(C("change") == "joined").alias("joined"))
    rows = F.array(*[F.struct(F.lit(n).alias("change"), C(n).alias("n")) for n in ("left", "joined")])
    return g.select(F.explode(rows).alias("x")).select("x.*")
