"""Scalar and per-cell functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, geometry as geo, identity, masks, pixel
from ..sources import views
from .common import C, long, r6c, rounded
from .duck import WEIGHT, r6 as R
from .registry import query

BOXES = [(0, 0, 5, 20), (10, 3, 14, 30), (20, 0, 24, 9)]
BOX_SQL = "(VALUES " + ", ".join(f"({i}, {a}e0, {b}e0, {c}e0, {e}e0)" for i, (a, b, c, e) in enumerate(BOXES)) + ") t(box, l, b, rr, t)"


def boxes():
    return F.explode(F.array(*[F.struct(F.lit(i).alias("box"), *[F.lit(float(v)).alias(n) for n, v in zip("lbrt", b)])
                               for i, b in enumerate(BOXES)]))


@query("fn01_scale_offset", f"SELECT a, r, c, {R('rho4')} AS rho4, {R('rho5')} AS rho5 FROM px0")
def scale_offset(s, d):
    return views.obs(s, d).select("a", "r", "c", *rounded(
        rho4=pixel.reflectance(C("dn4")), rho5=pixel.reflectance(C("dn5"))))


@query("fn02_ndvi", f"""SELECT a, r, c, CASE WHEN v BETWEEN -1 AND 1 THEN {R('v')} END AS ndvi FROM
    (SELECT a, r, c, CASE WHEN abs(rho5+rho4)>5e-2 THEN (rho5-rho4)/(rho5+rho4) END AS v FROM px0)""")
def ndvi(s, d):
    v = pixel.ndvi(pixel.reflectance(C("dn4")), pixel.reflectance(C("dn5")), 0.05)
    return views.obs(s, d).select("a", "r", "c", *rounded(ndvi=v))


@query("fn03_brightness", f"SELECT a, r, c, {R('(rho4+rho5)/2')} AS brightness FROM px0")
def brightness(s, d):
    b = pixel.brightness(pixel.reflectance(C("dn4")), pixel.reflectance(C("dn5")))
    return views.obs(s, d).select("a", "r", "c", *rounded(brightness=b))


@query("fn04_cos_incidence", f"SELECT a, r, c, {R('cos_i')} AS cos_i FROM px")
def cos_incidence(s, d):
    return views.px(s, d).select("a", "r", "c", *r6c("cos_i"))


@query("fn05_direct_factor", f"SELECT a, r, c, {R('mu')} AS mu FROM px WHERE cos_i IS NOT NULL")
def direct_factor(s, d):
    return views.px(s, d).where("cos_i IS NOT NULL").select("a", "r", "c", *r6c("mu"))


@query("fn06_hard_response", f"""SELECT a, count(*) AS valid, count(*) FILTER (WHERE cos_i<=0) AS shadow,
    count(*) FILTER (WHERE NOT cos_i>1e-1) AS not_correctable, {R('avg(3e-1*mu)')} AS mean_observed,
    {R('max(CASE WHEN cos_i>1e-1 THEN abs(3e-1*mu/cos_i-3e-1) END)')} AS max_inverse_error
    FROM px WHERE cos_i IS NOT NULL GROUP BY a""")
def hard_response(s, d):
    x = C("cos_i")
    obs = pixel.hard_response(0.3, x)
    return views.px(s, d).where(x.isNotNull()).groupBy("a").agg(
        F.count("*").alias("valid"), F.count_if(x <= 0).alias("shadow"), F.count_if(~(x > 0.1)).alias("not_correctable"),
        *rounded(mean_observed=F.avg(obs), max_inverse_error=F.max(F.abs(pixel.corrected(obs, x) - 0.3))))


@query("fn07_soft_response", f"""SELECT a, r, c,
    {R('3e-1*(greatest(50e0*cos_i,0e0)+ln(1e0+exp(-abs(50e0*cos_i))))/50e0')} AS soft FROM px WHERE cos_i IS NOT NULL""")
def soft_response(s, d):
    return views.px(s, d).where("cos_i IS NOT NULL").select(
        "a", "r", "c", *rounded(soft=pixel.soft_response(0.3, C("cos_i"), 50.0)))


@query("fn08_support_weight", "SELECT a, r, c, " + ", ".join(
    f"{R(WEIGHT.format(k=k))} AS w{k}" for k in (15, 30, 60)) + " FROM px WHERE cos_i IS NOT NULL")
def support_weight(s, d):
    return views.px(s, d).where("cos_i IS NOT NULL").select("a", "r", "c", *rounded(
        **{f"w{k}": pixel.support_weight(C("cos_i"), float(k)) for k in (15, 30, 60)}))


@query("fn09_risk_score", f"""SELECT a, r, c, {R('((1::FLOAT-cos_i::FLOAT)::FLOAT)::DOUBLE')} AS score FROM px WHERE cos_i IS NOT NULL""")
def risk_score(s, d):
    return views.px(s, d).where("cos_i IS NOT NULL").select(
        "a", "r", "c", *rounded(score=pixel.risk_score(C("cos_i")).cast("double")))


@query("fn10_cell_centres", """SELECT r, c, 292230e0+(c+5e-1)*30 AS x, 3473790e0-(r+5e-1)*30 AS y,
    292230e0+30e0*(c+5e-1)+0e0*(r+5e-1) AS ax, 3473790e0+0e0*(c+5e-1)-30e0*(r+5e-1) AS ay FROM dem""")
def cell_centres(s, d):
    x, y = geo.cell_centre(C("r"), C("c"), 292230.0, 3473790.0, 30.0)
    ax, ay = geo.affine_point([30.0, 0.0, 292230.0, 0.0, -30.0, 3473790.0], C("c") + 0.5, C("r") + 0.5)
    return views.dem(s, d).select("r", "c", x.alias("x"), y.alias("y"), ax.alias("ax"), ay.alias("ay"))


@query("fn11_rect_distance", f"""SELECT r, c, box, {R('sqrt(dx*dx+dy*dy)')} AS dist FROM (SELECT r, c, box,
    greatest(l-c, c-rr, 0e0) AS dx, greatest(b-r, r-t, 0e0) AS dy FROM dem, {BOX_SQL})""")
def rect_distance(s, d):
    p = views.dem(s, d).select(C("r").alias("row"), C("c").alias("col"), boxes().alias("x")).select("row", "col", "x.*")
    g = geo.rect_distance(C("col").cast("double"), C("row").cast("double"), C("l"), C("b"), C("r"), C("t"))
    return p.select(C("row").alias("r"), C("col").alias("c"), "box", *rounded(dist=g))


@query("fn12_rect_relations", f"""SELECT scene_id, {R('sqrt(dx*dx+dy*dy)')} AS gap, x1>0 AND 1500>x0 AND y1>0 AND 1200>y0 AS overlaps,
    x0<=0+1e-9 AND y0<=0+1e-9 AND x1>=1500-1e-9 AND y1>=1200-1e-9 AS contains FROM (SELECT *,
    greatest(x0-1500, 0-x1, 0)::DOUBLE AS dx, greatest(y0-1200, 0-y1, 0)::DOUBLE AS dy FROM scene)""")
def rect_relations(s, d):
    foot = [C(n).cast("double") for n in ("x0", "y0", "x1", "y1")]
    reg = [F.lit(float(v)) for v in views.REGION]
    return views.scene(s, d).select(
        "scene_id", *rounded(gap=geo.rect_gap(foot, reg)),
        geo.half_open_overlap(foot, reg).alias("overlaps"), geo.rect_contains(foot, reg).alias("contains"))


@query("fn13_great_circle", f"""SELECT scene_id, {R('2*6371.0088e0*asin(sqrt(pow(sin((p2-p1)/2),2)+cos(p1)*cos(p2)*pow(sin(dl/2),2)))')} AS km
    FROM (SELECT scene_id, radians(lat) AS p1, radians(31.3e0) AS p2, radians(103.9e0-lon) AS dl FROM
    (SELECT scene_id, (cents%36000)/1e2-180 AS lon, (cents%17000)/1e2-85 AS lat FROM scene))""")
def great_circle(s, d):
    lon, lat = F.pmod("cents", F.lit(36000)) / 100.0 - 180, F.pmod("cents", F.lit(17000)) / 100.0 - 85
    return views.scene(s, d).select("scene_id", *rounded(km=geo.great_circle_km(lon, lat, F.lit(103.9), F.lit(31.3))))


@query("fn14_utm_zone", """SELECT scene_id, ((CASE WHEN lat>=0 THEN 32600 ELSE 32700 END)+floor((lon+180)/6)+1)::BIGINT AS epsg FROM
    (SELECT scene_id, (cents%36000)/1e2-180 AS lon, (cents%17000)/1e2-85 AS lat FROM scene)""")
def utm_zone(s, d):
    lon, lat = F.pmod("cents", F.lit(36000)) / 100.0 - 180, F.pmod("cents", F.lit(17000)) / 100.0 - 85
    return views.scene(s, d).select("scene_id", long(geo.utm_epsg(lon, lat)).alias("epsg"))


@query("fn15_snapped_box", """SELECT scene_id, l AS bleft, b AS bbottom, l+19500e0 AS bright, b+22560e0 AS btop FROM (SELECT scene_id,
    floor((cents*7e-1-9750e0)/30)*30 AS l, floor((cents*3e-1-11280e0)/30)*30 AS b FROM scene)""")
def snapped_box(s, d):
    b = geo.snapped_box(C("cents") * 0.7, C("cents") * 0.3, 19500.0, 22560.0)
    return views.scene(s, d).select("scene_id", *[
        v.cast("double").alias(n) for v, n in zip(b, ("bleft", "bbottom", "bright", "btop"))])


@query("fn16_cell_window", """SELECT scene_id, greatest(floor((1200-y1)/30e0),0)::BIGINT AS r0, least(ceil((1200-y0)/30e0),40)::BIGINT AS r1,
    greatest(floor(x0/30e0),0)::BIGINT AS c0, least(ceil(x1/30e0),50)::BIGINT AS c1,
    x0-90>=0-1e-9 AND y0-90>=0-1e-9 AND x1+90<=1500+1e-9 AND y1+90<=1200+1e-9 AS grid_covers_influence FROM scene""")
def cell_window(s, d):
    foot = [C(n).cast("double") for n in ("x0", "y0", "x1", "y1")]
    w = geo.cell_window(foot, 0.0, 1200.0, 30.0, 40, 50)
    grid_box = [F.lit(float(v)) for v in views.REGION]
    return views.scene(s, d).select(
        "scene_id", *[long(v).alias(n) for n, v in w.items()],
        geo.rect_contains(grid_box, geo.influence_box(foot, F.lit(90.0))).alias("grid_covers_influence"))


@query("fn17_scene_keys", """SELECT scene_id, strftime(day, '%Y-%m-%d')||'T00:00:00.000Z|'||scene_id AS sort_key,
    strftime(day, '%Y-%m-%d') AS acquired FROM scene""")
def scene_keys(s, d):
    day = F.date_format("day", "yyyy-MM-dd")
    return views.scene(s, d).select("scene_id", F.concat_ws("|", F.concat(day, F.lit("T00:00:00.000Z")), "scene_id").alias("sort_key"),
                                    day.alias("acquired"))


@query("fn18_curvature_drop", f"SELECT r, c, {R('(r*30e0)*(r*30e0)/(2*6371000e0)')} AS drop_m FROM dem")
def curvature_drop(s, d):
    return views.dem(s, d).select("r", "c", *rounded(drop_m=pixel.curvature_drop(C("r") * 30.0)))


@query("fn19_relative_improvement", f"""SELECT id, {R('CASE WHEN base>0 THEN (base-cand)/base END')} AS improvement FROM
    (SELECT l_orderkey*10+l_linenumber AS id, sum(l_discount) AS base, sum(l_tax) AS cand FROM lineitem GROUP BY 1)""")
def relative_improvement(s, d):
    g = views.table(s, d, "lineitem").groupBy((C("l_orderkey") * 10 + C("l_linenumber")).alias("id")).agg(
        F.sum("l_discount").alias("base"), F.sum("l_tax").alias("cand"))
    return g.select("id", *rounded(improvement=pixel.relative_improvement(C("base"), C("cand"))))


@query("fn20_lifecycle_state", """SELECT state, CASE state WHEN 'READY' THEN 'submitted' WHEN 'RUNNING' THEN 'running'
    WHEN 'COMPLETED' THEN 'succeeded' WHEN 'FAILED' THEN 'failed' WHEN 'CANCELLED' THEN 'cancelled' END AS lifecycle,
    count(*) AS n FROM journal GROUP BY 1, 2""")
def lifecycle_state(s, d):
    return views.journal(s, d).groupBy("state", pixel.lifecycle(C("state")).alias("lifecycle")).agg(F.count("*").alias("n"))


@query("fn21_json_walk", """SELECT key, count(*) AS leaves, min(v)::BIGINT AS low, max(v)::BIGINT AS high,
    count(*) FILTER (WHERE v IS NULL) AS not_numeric FROM
    (SELECT k AS key, try_cast(json_extract_string(props, '$.'||k) AS DOUBLE) AS v FROM (SELECT props, unnest(json_keys(props)) AS k FROM events))
    GROUP BY key""")
def json_walk(s, d):
    # string leaves of a JSON object, one row per leaf
    leaves = views.table(s, d, "events").select(F.explode(F.from_json("props", "map<string,string>")))
    v = F.try_to_number(C("value"), F.lit("999999999")).cast("double")
    return leaves.groupBy("key").agg(F.count("*").alias("leaves"), long(F.min(v)).alias("low"), long(F.max(v)).alias("high"),
                                     F.count_if(v.isNull()).alias("not_numeric"))


@query("fn22_circular_error", f"""SELECT scene_id, {R('abs(x-360*floor(x/360)-180)')} AS err FROM
    (SELECT scene_id, sun_az-(cents%720)/2e0+180 AS x FROM scene WHERE sun_az IS NOT NULL)""")
def circular_error(s, d):
    return views.scene(s, d).where("sun_az IS NOT NULL").select(
        "scene_id", *rounded(err=pixel.circular_error(C("sun_az"), F.pmod("cents", F.lit(720)) / 2.0)))


DIGEST = ("sha256(count(t)::VARCHAR||':'||coalesce(sum(('0x'||substr(md5(t),1,15))::BIGINT::HUGEINT),0)::VARCHAR||':'||"
          "coalesce(sum(('0x'||substr(md5(t),16,15))::BIGINT::HUGEINT),0)::VARCHAR)")


@query("fn23_content_identity", f"""SELECT role, count(DISTINCT h) AS distinct_texts, {DIGEST} AS role_digest FROM
    (SELECT role, sha256(text) AS h, id::VARCHAR||'|'||sha256(text) AS t FROM artifact) GROUP BY role""")
def content_identity(s, d):
    a = views.artifact(s, d).select("role", F.sha2("text", 256).alias("h"), "id")
    t = identity.row_text(C("id"), C("h"))
    # distinct first, so a role with a third of the rows is still counted in parallel
    n = a.select("role", "h").distinct().groupBy("role").agg(F.count("*").alias("distinct_texts"))
    return a.groupBy("role").agg(identity.set_digest(t).alias("role_digest")).join(n, "role")


@query("fn24_closeness", """SELECT scene_id, abs(w-1500)/greatest(1500,1e-12)<=1.5e-1 AS width_close, abs(w-1500)<=1e-6 AS width_equal
    FROM (SELECT scene_id, (x1-x0)::DOUBLE AS w FROM scene)""")
def closeness(s, d):
    w = (C("x1") - C("x0")).cast("double")
    return views.scene(s, d).select("scene_id", geo.resolution_close(w, F.lit(1500.0)).alias("width_close"),
                                    geo.pair_close(w, F.lit(1500.0)).alias("width_equal"))
