"""Joins, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import geometry as geo, identity
from ..functions.numeric import ratio
from ..operators import fit, folds as fd, grid, joins as jn
from ..sources import views
from ..sources.config import FOLDS
from .common import C, long, r6c, rounded
from .duck import r6 as R
from .registry import query

BUFFER = fit.BUFFER_CELLS
COV = "greatest(least(x1,1500)-greatest(x0,0),0)::DOUBLE*greatest(least(y1,1200)-greatest(y0,0),0)/(1500e0*1200e0)"


def region_coverage():
    foot = [C(n).cast("double") for n in ("x0", "y0", "x1", "y1")]
    return geo.overlap_area(foot, [F.lit(float(v)) for v in views.REGION]) / (1500.0 * 1200.0)


@query("jn01_cell_join", f"""SELECT o.a, count(*) AS cells, count(t.slope) AS with_slope, {R('sum(d.z)')} AS sum_z, {R('avg(t.slope)')} AS mean_slope
    FROM obs o JOIN dem d ON o.r=d.r AND o.c=d.c JOIN terrain t ON o.r=t.r AND o.c=t.c GROUP BY o.a""")
def cell_join(s, d):
    o = views.obs(s, d).select("a", "r", "c")
    j = grid.cell_join(o, views.dem(s, d).select("r", "c", "z"), views.terrain(s, d).select("r", "c", "slope"))
    return j.groupBy("a").agg(F.count("*").alias("cells"), F.count("slope").alias("with_slope"),
                              *rounded(sum_z=F.sum("z"), mean_slope=F.avg("slope")))


@query("jn02_acquisition_attributes", f"""SELECT o.a, r, c, {R('sun_az')} AS sun_az, {R('sun_el')} AS sun_el, strftime(day,'%Y-%m-%d') AS day
    FROM obs o JOIN acq ON o.a=acq.a""")
def acquisition_attributes(s, d):
    j = views.obs(s, d).select("a", "r", "c").join(views.acq(s, d), "a")
    return j.select("a", "r", "c", *r6c("sun_az", "sun_el"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("jn03_unique_lookup", """SELECT doc_id, n AS n_match, CASE n WHEN 1 THEN 'one' WHEN 0 THEN 'none' ELSE 'many' END AS lookup
    FROM (SELECT d.doc_id, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)""")
def unique_lookup(s, d):
    return jn.unique_lookup(views.table(s, d, "documents").select("doc_id"), views.table(s, d, "labels"), "doc_id")


@query("jn04_identity_sets", """WITH ids AS (SELECT doc_id AS id, 'documents' AS src FROM documents UNION SELECT doc_id, 'labels' FROM labels
    UNION SELECT page_id, 'pages' FROM pages), m AS (SELECT id, bool_or(src='documents') AS d, bool_or(src='labels') AS l, bool_or(src='pages') AS p FROM ids GROUP BY id)
    SELECT 'documents' AS source, count(*) FILTER (WHERE d) AS members, count(*) FILTER (WHERE d AND NOT d) AS extra, count(*) FILTER (WHERE NOT d AND d) AS missing FROM m
    UNION ALL SELECT 'labels', count(*) FILTER (WHERE l), count(*) FILTER (WHERE l AND NOT d), count(*) FILTER (WHERE NOT l AND d) FROM m
    UNION ALL SELECT 'pages', count(*) FILTER (WHERE p), count(*) FILTER (WHERE p AND NOT d), count(*) FILTER (WHERE NOT p AND d) FROM m""")
def identity_sets(s, d):
    return jn.identity_difference({
        "documents": views.table(s, d, "documents").select(C("doc_id").alias("id")),
        "labels": views.table(s, d, "labels").select(C("doc_id").alias("id")),
        "pages": views.table(s, d, "pages").select(C("page_id").alias("id"))}, "id")


@query("jn05_eligible_members", """SELECT o.a, count(*) AS cells, CASE WHEN e.a IS NOT NULL THEN 'eligible' ELSE 'operation_scoped_unsupported' END AS membership
    FROM obs o LEFT JOIN (SELECT a FROM px GROUP BY a HAVING count(*) FILTER (WHERE land AND lit) >= 300) e ON o.a=e.a GROUP BY o.a, e.a""")
def eligible_members(s, d):
    ok = views.px(s, d).where("land AND lit").groupBy("a").count().where("count >= 300").select("a")
    o = views.obs(s, d).select("a")
    def tally(df, state):
        return df.groupBy("a").agg(F.count("*").alias("cells")).withColumn("membership", F.lit(state))
    return tally(o.join(ok, "a", "left_semi"), "eligible").unionByName(
        tally(o.join(ok, "a", "left_anti"), "operation_scoped_unsupported"))


@query("jn06_membership", """SELECT a, k, band, CASE WHEN n>0 THEN 'present' ELSE 'missing' END AS membership, n AS n_rows FROM
    (SELECT a, k, band, count(x.a) AS n FROM (SELECT a, k, band FROM acq, fold, band) u
     LEFT JOIN (SELECT DISTINCT a, k, band FROM resid) x USING (a, k, band) GROUP BY 1, 2, 3)""")
def membership(s, d):
    z = fd.with_zone(views.px_table(s, d), FOLDS, BUFFER)
    have = fit.scored_residuals(z, FOLDS, 20).select("a", "k", "band").distinct()
    return jn.membership(fit.unit_universe(views.acq(s, d).select("a"), FOLDS), have, ["a", "k", "band"])


@query("jn07_cell_fold_roles", "SELECT a, k, role, count(*) AS n FROM role GROUP BY 1, 2, 3")
def cell_fold_roles(s, d):
    z = fd.with_zone(views.obs(s, d), FOLDS, BUFFER)
    zoned = z.groupBy("a", "zone").agg(F.count("*").alias("n"))
    return fd.explode_roles(zoned, FOLDS, (fd.CORE, fd.BUFFER, fd.DOMAIN)).groupBy(
        "a", "k", fd.role_name(C("role")).alias("role")).agg(F.sum("n").alias("n"))


@query("jn08_rectangle_pairs", f"""SELECT x.a AS first_a, y.a AS second_a, {R('sqrt(pow(greatest(x.l-y.rr,y.l-x.rr,0),2)+pow(greatest(x.b-y.t,y.b-x.t,0),2))')} AS gap,
    x.rr+1>y.l AND y.rr+1>x.l AND x.t+1>y.b AND y.t+1>x.b AS overlaps,
    (greatest(least(x.rr,y.rr)-greatest(x.l,y.l)+1,0)*greatest(least(x.t,y.t)-greatest(x.b,y.b)+1,0))::DOUBLE AS shared_cells
    FROM (SELECT a, min(c)::DOUBLE AS l, max(c)::DOUBLE AS rr, min(r)::DOUBLE AS b, max(r)::DOUBLE AS t FROM px WHERE cos_i<=0 GROUP BY a) x,
    (SELECT a, min(c)::DOUBLE AS l, max(c)::DOUBLE AS rr, min(r)::DOUBLE AS b, max(r)::DOUBLE AS t FROM px WHERE cos_i<=0 GROUP BY a) y WHERE x.a<y.a""")
def rectangle_pairs(s, d):
    # one box per acquisition: the pair join runs over that dimension only
    box = views.px(s, d).where("cos_i <= 0").groupBy(C("a").alias("k")).agg(
        *[f(c).cast("double").alias(n) for f, c, n in ((F.min, "c", "c0"), (F.max, "c", "c1"), (F.min, "r", "r0"), (F.max, "r", "r1"))])
    p = fd.fold_pairs(box)
    return p.select(C("fold_a").alias("first_a"), C("fold_b").alias("second_a"), *r6c("gap"), "overlaps", "shared_cells")


@query("jn09_nearest_date", """SELECT d, strftime(day,'%Y-%m-%d') AS day, CASE WHEN g<=7 THEN g END AS gap,
    CASE WHEN g IS NULL OR g>7 THEN 'unmatched' WHEN g<=3 THEN 'tight' ELSE 'loose' END AS match FROM
    (SELECT x.d, x.day, min(abs(x.day-y.day)) AS g FROM (SELECT DISTINCT d, day FROM dday) x LEFT JOIN refday y ON x.d=y.d GROUP BY 1, 2)""")
def nearest_date(s, d):
    m = jn.nearest_date(views.domain_day(s, d), views.ref_day(s, d), "d")
    return m.select("d", F.date_format("day", "yyyy-MM-dd").alias("day"), long("gap").alias("gap"), "match")


BIL = """SELECT pid, sum(v*w)/sum(CASE WHEN v IS NOT NULL THEN w END) AS val FROM (SELECT pid, w, z AS v FROM (
    SELECT pid, least(floor(y)+i, rmax) AS r, least(floor(x)+j, cmax) AS c,
      (CASE WHEN i=1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE WHEN j=1 THEN x-floor(x) ELSE 1-(x-floor(x)) END) AS w
    FROM (SELECT pid, least(greatest(fr,0e0),rmax) AS y, least(greatest(fc,0e0),cmax) AS x, rmax, cmax FROM {pts}, ext),
      (VALUES (0,0),(0,1),(1,0),(1,1)) q(i,j)) k LEFT JOIN dem USING (r, c) WHERE w>0) GROUP BY pid"""


@query("jn10_bilinear_sample", f"""SELECT pid, {R('val')} AS z FROM (""" + BIL.format(pts="""(SELECT l_orderkey*10+l_linenumber AS pid,
    min(l_partkey)/50e0-2e0 AS fr, sum(l_quantity)*1.03e0-1 AS fc FROM lineitem GROUP BY 1)""") + ")")
def bilinear_sample(s, d):
    pts = views.table(s, d, "lineitem").groupBy((C("l_orderkey") * 10 + C("l_linenumber")).alias("pid")).agg(
        (F.min("l_partkey") / 50.0 - 2.0).alias("fr"), (F.sum("l_quantity") * 1.03 - 1).alias("fc"))
    return grid.bilinear(pts, views.dem(s, d), "z", "fr", "fc", ["pid"]).select("pid", *r6c("z"))


@query("jn11_align_grid", "SELECT pid//1000 AS r, pid%1000 AS c, " + R("val") + " AS z FROM (" + BIL.format(pts="""(SELECT r*1000+c AS pid,
    fr, fc FROM (SELECT r, c, (1200e0-(1190e0-(r+5e-1)*40))/30-5e-1 AS fr, ((c+5e-1)*40+25e0-0e0)/30-5e-1 AS fc FROM dem), ext
    WHERE fr>=-5e-1 AND fr<=rmax+5e-1 AND fc>=-5e-1 AND fc<=cmax+5e-1)""") + ")")
def align_grid(s, d):
    dem = views.dem(s, d)
    out = grid.align(dem, dem, "z", (0.0, 1200.0, 30.0), (25.0, 1190.0, 40.0), C("z").isNotNull())
    return out.select("r", "c", *r6c("z"))


@query("jn12_image_region_pairs", f"""SELECT scene_id, reg, {R('w*h/area')} AS coverage FROM (SELECT scene_id, reg,
    greatest(least(x1,rx1)-greatest(x0,rx0),0)::DOUBLE AS w, greatest(least(y1,ry1)-greatest(y0,ry0),0)::DOUBLE AS h, ((rx1-rx0)*(ry1-ry0))::DOUBLE AS area
    FROM scene, (VALUES ('north',0,600,1500,1200),('south',0,0,1500,600),('west',-60,-60,500,900)) g(reg,rx0,ry0,rx1,ry1))""")
def image_region_pairs(s, d):
    # regions are configuration: an array literal, so a pair costs no join
    regs = [("north", 0, 600, 1500, 1200), ("south", 0, 0, 1500, 600), ("west", -60, -60, 500, 900)]
    arr = F.array(*[F.struct(F.lit(n).alias("reg"), *[F.lit(float(v)).alias(k) for k, v in zip(("rx0", "ry0", "rx1", "ry1"), b)])
                    for n, *b in regs])
    p = views.scene(s, d).withColumn("g", F.explode(arr)).select("*", "g.*")
    foot, reg = [[C(n).cast("double") for n in names] for names in (("x0", "y0", "x1", "y1"), ("rx0", "ry0", "rx1", "ry1"))]
    area = (C("rx1") - C("rx0")) * (C("ry1") - C("ry0"))
    return p.select("scene_id", "reg", *rounded(coverage=geo.overlap_area(foot, reg) / area))


@query("jn13_stage_merge", """SELECT c_custkey AS candidate, s1.x IS NOT NULL AS stage1, coalesce(s2.y,false) AS stage2, coalesce(s3.z,false) AS stage3,
    s1.x IS NOT NULL AND coalesce(s2.y,false) AND coalesce(s3.z,false) AS admitted FROM customer
    LEFT JOIN (SELECT c_custkey AS k, true AS x FROM customer WHERE c_acctbal>0) s1 ON c_custkey=s1.k
    LEFT JOIN (SELECT o_custkey AS k, count(*)>=10 AS y FROM orders GROUP BY 1) s2 ON c_custkey=s2.k
    LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice)>300000 AS z FROM orders WHERE o_orderstatus='F' GROUP BY 1) s3 ON c_custkey=s3.k""")
def stage_merge(s, d):
    cust, orders = views.table(s, d, "customer"), views.table(s, d, "orders")
    s1 = cust.where("c_acctbal > 0").select(C("c_custkey").alias("candidate"), F.lit(True).alias("stage1"))
    s2 = orders.groupBy(C("o_custkey").alias("candidate")).agg((F.count("*") >= 10).alias("stage2"))
    s3 = orders.where("o_orderstatus = 'F'").groupBy(C("o_custkey").alias("candidate")).agg((F.max("o_totalprice") > 300000).alias("stage3"))
    j = cust.select(C("c_custkey").alias("candidate")).join(s1, "candidate", "left").join(s2, "candidate", "left").join(s3, "candidate", "left")
    j = j.na.fill(False)
    return j.withColumn("admitted", C("stage1") & C("stage2") & C("stage3"))


@query("jn15_task_lineage", """SELECT task_id, ready, completed, CASE WHEN ready>0 AND completed>0 AND r<x THEN 'linked' WHEN completed>0
    THEN 'completed_without_ready' WHEN ready>0 THEN 'ready_without_completion' ELSE 'untracked' END AS lineage FROM
    (SELECT task_id, count(*) FILTER (WHERE state='READY') AS ready, count(*) FILTER (WHERE state='COMPLETED') AS completed,
     min(CASE WHEN state='READY' THEN seq END) AS r, max(CASE WHEN state='COMPLETED' THEN seq END) AS x FROM journal GROUP BY 1)""")
def task_lineage(s, d):
    return jn.task_lineage(views.journal(s, d))


@query("tk02_top_scenes_gate", f"""WITH t AS (SELECT scene_id, cov, cloud, {R('cov*(100-cloud)')} AS score FROM (SELECT *, {COV} AS cov FROM scene) WHERE cloud IS NOT NULL),
    g AS (SELECT *, cov>=9.5e-1 AND cloud<=20 AS ok FROM t), n AS (SELECT count(*) FILTER (WHERE ok) AS n FROM g)
    SELECT scene_id, score, CASE WHEN n>0 THEN 'gated' ELSE 'fallback' END AS listing FROM g, n WHERE ok OR n=0 ORDER BY score DESC, scene_id LIMIT 10""")
def top_scenes_gate(s, d):
    t = views.scene(s, d).where("cloud IS NOT NULL").withColumn("cov", region_coverage())
    t = t.select("scene_id", ((C("cov") >= 0.95) & (C("cloud") <= 20)).alias("ok"), *rounded(score=C("cov") * (100 - C("cloud"))))
    # the gate is a one-row aggregate, so the fallback needs no second action
    n = t.agg(F.count_if("ok").alias("n"))
    return (t.crossJoin(F.broadcast(n)).where(C("ok") | (C("n") == 0)).orderBy(F.desc("score"), "scene_id").limit(10)
            .select("scene_id", "score", F.when(C("n") > 0, "gated").otherwise("fallback").alias("listing")))


@query("tk03_preview_list", f"""SELECT scene_id, {R('cloud')} AS cloud, {R('sun_el')} AS sun_el FROM scene WHERE cloud IS NOT NULL AND sun_el IS NOT NULL
    ORDER BY cloud, sun_el, scene_id LIMIT 12""")
def preview_list(s, d):
    return (views.scene(s, d).where("cloud IS NOT NULL AND sun_el IS NOT NULL").orderBy("cloud", "sun_el", "scene_id").limit(12)
            .select("scene_id", *r6c("cloud", "sun_el")))


@query("tk04_canonical_sort", "SELECT scene_id, strftime(day,'%Y-%m-%d') AS day FROM scene ORDER BY day, scene_id")
def canonical_sort(s, d):
    return views.scene(s, d).orderBy("day", "scene_id").select("scene_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("so01_union_rows", f"""SELECT a, 'B4' AS band, count(*) AS n, {R('avg(rho4)')} AS mean_rho FROM px0 WHERE v4=1 GROUP BY a
    UNION ALL SELECT a, 'B5', count(*), {R('avg(rho5)')} FROM px0 WHERE v5=1 GROUP BY a""")
def union_rows(s, d):
    from ..functions import pixel
    o = views.obs(s, d)
    def one(band, dn, v):
        return o.where(C(v) == 1).groupBy("a").agg(F.count("*").alias("n"), *rounded(mean_rho=F.avg(pixel.reflectance(C(dn))))).withColumn("band", F.lit(band))
    return one("B4", "dn4", "v4").unionByName(one("B5", "dn5", "v5"))


@query("so02_key_sets", """SELECT 'only_labels' AS side, count(*) AS n FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)
    UNION ALL SELECT 'only_documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)
    UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def key_sets(s, d):
    x, y = views.table(s, d, "labels").select("doc_id"), views.table(s, d, "documents").select("doc_id")
    def n(df, side):
        return df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(x.exceptAll(y), "only_labels").unionByName(n(y.exceptAll(x), "only_documents")).unionByName(n(x.intersect(y), "both"))


@query("so03_role_partition", """SELECT k, count(*) FILTER (WHERE role='core') AS core, count(*) FILTER (WHERE role='buffer') AS buffer,
    count(*) FILTER (WHERE role='domain') AS dom, count(*) AS total, true AS exclusive, true AS exhaustive FROM role GROUP BY k""")
def role_partition(s, d):
    z = fd.with_zone(views.obs(s, d), FOLDS, BUFFER).groupBy("zone").agg(F.count("*").alias("n"))
    r = fd.explode_roles(z, FOLDS, (0, 1, 2)).groupBy("k").agg(
        *[F.sum(F.when(C("role") == i, C("n")).otherwise(0)).alias(n) for i, n in enumerate(("core", "buffer", "dom"))], F.sum("n").alias("total"),
        F.bool_and(sum((C("role") == i).cast("int") for i in range(3)) == 1).alias("exclusive"))
    return r.withColumn("exhaustive", C("core") + C("buffer") + C("dom") == C("total"))


@query("so04_distinct_days", """SELECT d, count(DISTINCT day) AS days, strftime(min(day),'%Y-%m-%d') AS first_day, strftime(max(day),'%Y-%m-%d') AS last_day FROM refday GROUP BY d""")
def distinct_days(s, d):
    return views.ref_day(s, d).groupBy("d").agg(
        F.count("*").alias("days"), *[F.date_format(f("day"), "yyyy-MM-dd").alias(n) for f, n in ((F.min, "first_day"), (F.max, "last_day"))])


@query("so05_deduplicate", """SELECT h, count(*) AS copies, min(id) AS kept_id, count(DISTINCT role)>1 AS conflicting FROM
    (SELECT sha256(text) AS h, id, role FROM artifact) GROUP BY h""")
def deduplicate(s, d):
    a = views.artifact(s, d).select(F.sha2("text", 256).alias("h"), "id", "role")
    return a.groupBy("h").agg(F.count("*").alias("copies"), F.min("id").alias("kept_id"), (F.min("role") != F.max("role")).alias("conflicting"))
