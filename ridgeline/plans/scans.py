"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo, masks, pixel
from ..functions.numeric import ratio
from ..sources import io, views
from .common import C, long, r6c, rounded
from .duck import r6 as R
from .registry import query


@query("src01_pixel_scan", f"""SELECT 'dem' AS layer, max(c)+1 AS width, max(r)+1 AS height, count(*) AS cells, count(z) AS valid,
    {R('min(z)')} AS low, {R('max(z)')} AS high, 3473790e0-30e0*(max(r)+1) AS bottom, 292230e0+30e0*(max(c)+1) AS bright FROM dem""")
def pixel_scan(s, d):
    g = views.dem(s, d).agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"), F.count("*").alias("cells"),
                            F.count("z").alias("valid"), *rounded(low=F.min("z"), high=F.max("z")))
    return g.select(F.lit("dem").alias("layer"), "*", (F.lit(3473790.0) - C("height") * 30.0).alias("bottom"),
                    (C("width") * 30.0 + 292230.0).alias("bright"))


@query("src02_stack_scan", """SELECT a, count(*) AS cells, sum(dn4)::BIGINT AS dn4, sum(dn5)::BIGINT AS dn5, sum(qa)::BIGINT AS qa,
    sum(v4)::BIGINT AS v4, sum(v5)::BIGINT AS v5, sum(vqa)::BIGINT AS vqa FROM obs GROUP BY a""")
def stack_scan(s, d):
    stack = io.same_columns(views.obs(s, d), io.OBSERVATION)
    return stack.groupBy("a").agg(F.count("*").alias("cells"), *[F.sum(b).alias(b) for b in ("dn4", "dn5", "qa", "v4", "v5", "vqa")])


@query("src03_catalogue_scan", f"""SELECT scene_id, strftime(day,'%Y-%m-%d') AS day, {R('cov')} AS coverage FROM (SELECT *,
    greatest(least(x1,1500)-greatest(x0,0),0)::DOUBLE*greatest(least(y1,1200)-greatest(y0,0),0)/(1500e0*1200e0) AS cov FROM scene)
    WHERE day >= DATE '2014-01-01' AND day < DATE '2023-01-01' AND wrs_path=130 AND wrs_row IN (36,38) AND cov>=9e-1""")
def catalogue_scan(s, d):
    foot = [C(n).cast("double") for n in ("x0", "y0", "x1", "y1")]
    reg = [F.lit(float(v)) for v in views.REGION]
    cat = views.scene(s, d).where("day >= '2014-01-01' AND day < '2023-01-01' AND wrs_path = 130 AND wrs_row IN (36, 38)")
    cat = cat.withColumn("coverage", geo.overlap_area(foot, reg) / (1500.0 * 1200.0)).where("coverage >= 0.9")
    return cat.select("scene_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *r6c("coverage")).orderBy("day", "scene_id")


@query("src04_registry_scan", """SELECT scene_id, 'B4' AS band, x0 AS offset_value FROM scene UNION ALL SELECT scene_id, 'B5', y0 FROM scene""")
def registry_scan(s, d):
    member = F.array(F.struct(F.lit("B4").alias("band"), C("x0").alias("offset")), F.struct(F.lit("B5").alias("band"), C("y0").alias("offset")))
    text = views.scene(s, d).select(F.to_json(F.struct("scene_id", member.alias("members"))).alias("t"))
    reg = text.select(F.from_json("t", io.REGISTRY).alias("x")).select("x.scene_id", F.explode("x.members").alias("m"))
    return reg.select("scene_id", "m.band", C("m.offset").alias("offset_value"))


@query("src05_scene_metadata", f"SELECT scene_id, {R('cloud')} AS cloud, {R('sun_az')} AS sun_az, {R('sun_el')} AS sun_el FROM scene")
def scene_metadata(s, d):
    line = F.concat_ws(",", "scene_id", *[F.coalesce(C(c).cast("string"), F.lit("n/a")) for c in ("cloud", "sun_az", "sun_el")])
    rows = views.scene(s, d).select(F.from_csv(line, io.SCENE_CSV).alias("x")).select("x.*")
    return rows.select("scene_id", *rounded(**{c: F.expr(f"try_cast({c} AS double)") for c in ("cloud", "sun_az", "sun_el")}))


@query("src06_journal_scan", """SELECT count(*) AS lines, count(*) FILTER (WHERE event_type<>'error') AS accepted,
    count(*) FILTER (WHERE event_type='error') AS rejected, max(CASE WHEN event_type<>'error' THEN event_id END) AS last_seq FROM events""")
def journal_scan(s, d):
    e = views.table(s, d, "events")
    body = F.to_json(F.struct(C("event_id").alias("seq"), "event_type"))
    line = F.when(C("event_type") == "error", F.lit("not json")).otherwise(body)  # a broken writer
    schema = "seq long, event_type string, corrupt string"
    j = e.select(F.from_json(line, schema, {"columnNameOfCorruptRecord": "corrupt", "mode": "PERMISSIVE"}).alias("x")).select("x.*")
    return j.agg(F.count("*").alias("lines"), F.count_if(C("corrupt").isNull()).alias("accepted"),
                 F.count_if(C("corrupt").isNotNull()).alias("rejected"), F.max("seq").alias("last_seq"))


@query("src07_locate_band", """SELECT token, count(p_name) AS matches, CASE WHEN count(p_name)=1 THEN 'one' WHEN count(p_name)=0 THEN 'none'
    ELSE 'many' END AS located FROM (SELECT unnest(['small ring','widget','SR_B9']) AS token) LEFT JOIN (SELECT DISTINCT p_name FROM part)
    ON contains(p_name, token) GROUP BY token""")
def locate_band(s, d):
    return io.band_matches(views.table(s, d, "part"), "p_name", ["small ring", "widget", "SR_B9"])


@query("snk01_coded_float", f"SELECT r, c, {R('CASE WHEN slope IS NULL THEN -9999e0 ELSE slope::FLOAT::DOUBLE END')} AS slope FROM terrain")
def coded_float(s, d):
    t = views.terrain(s, d)
    return t.select("r", "c", *rounded(slope=masks.coded_float(C("slope"), C("slope").isNotNull()).cast("double")))


@query("snk02_canonical_mask", """SELECT a, r, c, base::INT AS base_valid, (CASE WHEN vqa=1 THEN water::INT ELSE 255 END)::INT AS water,
    (CASE WHEN base THEN (cos_i<=0)::INT ELSE 255 END)::INT AS shadow, (CASE WHEN base THEN (cos_i>0 AND cos_i<=1e-1)::INT ELSE 255 END)::INT AS near_zero,
    (CASE WHEN base THEN (cos_i>1e-1)::INT ELSE 255 END)::INT AS lit FROM px""")
def canonical_mask(s, d):
    p, x = views.px(s, d), C("cos_i")
    def band(mask, support):
        return masks.coded_mask(mask, support).cast("int")
    return p.select("a", "r", "c", C("base").cast("int").alias("base_valid"), band(C("water"), C("vqa") == 1).alias("water"),
                    band(x <= 0, C("base")).alias("shadow"), band((x > 0) & (x <= 0.1), C("base")).alias("near_zero"),
                    band(x > 0.1, C("base")).alias("lit"))


@query("snk03_new_table_only", "SELECT a, count(*) AS cells, sum(dn4)::BIGINT AS dn4 FROM obs GROUP BY a")
def new_table_only(s, d):
    path = io.shared_dir(s, "observation")
    io.write_observations(views.obs(s, d), path)  # a second call with this path is an error
    return s.read.parquet(path).groupBy("a").agg(F.count("*").alias("cells"), F.sum("dn4").alias("dn4"))


@query("snk04_append_journal", "SELECT state, count(*) AS n, max(seq) AS last_seq FROM journal GROUP BY state")
def append_journal(s, d):
    path = io.shared_dir(s, "journal")
    j = views.journal(s, d).select("seq", "state")
    first = C("state").isin("READY", "RUNNING")
    io.append_journal(j.where(first), path)
    io.append_journal(j.where(~first), path)
    return s.read.schema("seq long, state string").json(path).groupBy("state").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("snk05_validate_publish", """SELECT a, count(*) AS cells, count(*) FILTER (WHERE land) AS land FROM px GROUP BY a""")
def validate_publish(s, d):
    px = views.px(s, d)
    tables = {"ledger": px.groupBy("a").agg(F.count("*").alias("cells"), F.count_if("land").alias("land")),
              "cell": px.select("a", "r", "c", "land")}

    def validate(t):
        n = t["cell"].groupBy("a").agg(F.count("*").alias("n"))
        j = t["ledger"].join(n, "a", "full_outer")
        return j.agg(F.bool_and(F.coalesce(C("cells") == C("n"), F.lit(False))).alias("passed")).select(F.lit("P1").alias("check_id"), "passed")

    target = io.shared_dir(s, "published")
    io.publish(s, tables, target, validate)
    return s.read.parquet(f"{target}/ledger")
