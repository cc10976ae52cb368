"""Arrays and records, model callables, identifiability and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, geometry as geo, identity, pixel
from ..functions.numeric import ratio
from ..operators import fit, folds as fd, identify as idn, journal as jr, models, quality as q, skyview
from ..sources import io, views
from ..sources.config import FOLDS, MIN_CALIBRATION
from ..streaming import journal as sj, tasks as stm
from .aggregates import units, zoned
from .common import C, long, r6c, rounded, text_list
from .duck import r6 as R
from .registry import query
from .quality import line


@query("ar01_sequences", f"""SELECT a, q, {R('q/20e0')} AS target, ((q*n+19)//20)::BIGINT AS need, {R('(q-1)*(mx/20e0)')} AS edge FROM (SELECT a, count(*) AS n, max(mu) AS mx FROM px WHERE land GROUP BY a), range(1,21) t(q)""")
def sequences(s, d):
    g = views.px(s, d).where("land").groupBy("a").agg(F.count("*").alias("n"), F.max("mu").alias("mx"))
    x = g.select("a", "n", "mx", F.posexplode(arrays.grid_targets(20)).alias("i", "target"))
    qn = C("i") + 1
    return x.select("a", long(qn).alias("q"), *rounded(target="target", edge=C("i") * (C("mx") / 20)), long(F.ceil(qn * C("n") / F.lit(20).cast("decimal(10,0)"))).alias("need"))


@query("ar02_failed_checks", """SELECT r, c, array_to_string(list_filter([CASE WHEN z IS NULL THEN 'has_value' END, CASE WHEN NOT coalesce(slope<40,false) THEN 'slope_below_40' END,
    CASE WHEN NOT coalesce(hillshade>50,false) THEN 'bright' END], lambda x: x IS NOT NULL), ',') AS failed FROM terrain""")
def failed_checks(s, d):
    t = views.terrain(s, d)
    return t.select("r", "c", text_list(arrays.failed_names({"has_value": C("z").isNotNull(), "slope_below_40": C("slope") < 40, "bright": C("hillshade") > 50})).alias("failed"))


@query("ar03_class_map", f"""SELECT d, sum(n)::BIGINT AS total, arg_max(class, (n, class)) AS top, {R("(sum(n) FILTER (WHERE class IN ('BUILDING','MACHINERY')))::DOUBLE/sum(n)")} AS share FROM dclass GROUP BY d""")
def class_map(s, d):
    g = views.domain_class(s, d).groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("m"))  # a short class list
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, v: a + v)
    part = F.aggregate(F.map_values(F.map_filter("m", lambda k, v: k.isin("BUILDING", "MACHINERY"))), F.lit(0).cast("long"), lambda a, v: a + v)
    best = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("class"))))
    return g.select("d", total.alias("total"), best["class"].alias("top"), *rounded(share=F.when(part > 0, ratio(part, total))))


@query("ar04_best_method", f"""SELECT a, k, band, arg_min(method, (objective, method)) AS best, {R('min(objective)')} AS objective FROM mfit WHERE method<>'hard_mask' GROUP BY 1, 2, 3""")
def best_method(s, d):
    f = models.method_fits(zoned(s, d), FOLDS).where(C("method") != "hard_mask")
    g = f.groupBy("a", "k", "band").agg(F.array_min(F.collect_list(arrays.argmin_struct(C("objective"), method=C("method")))).alias("x"))  # four per unit
    return g.select("a", "k", "band", C("x.method").alias("best"), *rounded(objective="x.objective"))


@query("ar05_ordered_id_hash", """SELECT count(*) AS members, sha256('['||string_agg(a::VARCHAR, ',' ORDER BY a)||']') AS digest FROM acq""")
def ordered_id_hash(s, d):
    return views.acq(s, d).agg(F.count("*").alias("members"), identity.ordered_digest(C("a")).alias("digest"))


@query("ar06_nested_record", f"""SELECT a, k, band, n_cal AS n, core_scored AS scored, CASE WHEN alpha IS NULL THEN reason END AS receipt, alpha IS NULL AS has_receipt, {R('mae')} AS mae FROM unit""")
def nested_record(s, d):
    u = units(s, d)
    rec = F.struct(F.struct(C("n_cal").alias("n"), C("core_scored").alias("scored")).alias("counts"),
                   F.when(C("alpha").isNull(), F.struct(C("reason").alias("reason"), F.lit(False).alias("default_written"))).alias("receipt"),
                   F.struct("mae", "bias").alias("metrics"))
    x = u.select("a", "k", "band", rec.alias("u"))
    return x.select("a", "k", "band", long("u.counts.n").alias("n"), C("u.counts.scored").alias("scored"), C("u.receipt.reason").alias("receipt"),
                    C("u.receipt").isNotNull().alias("has_receipt"), *rounded(mae="u.metrics.mae"))


LINEAR = idn.Model(["p1", "p2", "p3"], lambda t: [C("x1"), C("x2"), C("x3")], lambda t: C("x1") * t[0] + C("x2") * t[1] + C("x3") * t[2])
PRODUCT = idn.Model(["p", "q"], lambda t: [C("x1") * t[1], C("x1") * t[0]], lambda t: C("x1") * (t[0] * t[1]), ["x1"])
STARTS = [[0.8, 0.5], [0.3, 1.2], [1.5, 0.2]]


@query("ud01_model_callables", f"SELECT label, count(*) AS n, {R('sqrt(sum(pow(x1*5e-1+x2*-2e-1+x3*1e-1-y,2)))')} AS misfit FROM mrow GROUP BY label")
def model_callables(s, d):
    e = LINEAR.predict([0.5, -0.2, 0.1]) - C("y")
    return views.model_rows(s, d).groupBy("label").agg(F.count("*").alias("n"), *rounded(misfit=F.sqrt(F.sum(e * e))))


# candidate id -> design columns
DESIGN_COLUMNS = {"C0": lambda mu, v: [mu], "C1p": lambda mu, v: [mu, F.lit(1.0)], "C1": lambda mu, v: [mu, v], "C2a": lambda mu, v: [mu, 1 - v]}


@query("ud02_design_columns", f"""SELECT label, candidate, {R('sum(u)')} AS first_sum, {R('sum(w)')} AS second_sum FROM (SELECT label, candidate, x1 AS u, CASE candidate WHEN 'C1p' THEN 1e0 WHEN 'C1' THEN x2
    WHEN 'C2a' THEN 1-x2 END AS w FROM mrow, (SELECT unnest(['C0','C1p','C1','C2a']) AS candidate)) GROUP BY 1, 2""")
def design_columns(s, d):
    rows = F.array(*[F.struct(F.lit(cid).alias("candidate"), F.array(*fn(C("x1"), C("x2"))).alias("x")) for cid, fn in DESIGN_COLUMNS.items()])
    x = views.model_rows(s, d).select("label", F.explode(rows).alias("m")).select("label", "m.*")
    return x.groupBy("label", "candidate").agg(*rounded(first_sum=F.sum(F.get("x", F.lit(0))), second_sum=F.sum(F.get("x", F.lit(1)))))


@query("ud03_check_callables", " UNION ALL ".join([line("price_positive", "SELECT count(*) FROM orders WHERE NOT o_totalprice>0"),
    line("customer_known", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"), line("key_unique", "SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*)>1)")]))
def check_callables(s, d):
    o, c = views.table(s, d, "orders"), views.table(s, d, "customer")
    checks = [("price_positive", "price above zero", lambda: q.rule("price_positive", o, ~(C("o_totalprice") > 0))),
              ("customer_known", "customer exists", lambda: q.empty("customer_known", o.join(c, C("o_custkey") == C("c_custkey"), "left_anti"))),
              ("key_unique", "one row per key", lambda: q.unique_keys("key_unique", o, ["o_orderkey"]))]
    return q.suite(checks).select("check_id", "passed", "bad")


@query("ud04_grouped_numpy", f"""SELECT pr AS r, pc AS c, {R('avg(1e0/(1e0+t*t))')} AS v_sky FROM (SELECT pr, pc, az, greatest(max((zz-z0-dist*dist/(2*6371000e0))/dist),0e0) AS t FROM sightz GROUP BY pr,pc,az) GROUP BY pr, pc""")
def grouped_numpy(s, d):
    v = skyview.sky_view(views.dem(s, d), "zf", views.RES, 8, 150.0, curvature=True, tile=32)
    return v.select("r", "c", *r6c("v_sky"))


# the third column is the sum of the others, so the Gram matrix of the first two and the residual of the third settle rank and null direction
RANK_SQL = """(SELECT label, count(*) AS rows, (CASE WHEN sum(x1*x1)*sum(x2*x2)-pow(sum(x1*x2),2)>1e-12*pow(sum(x1*x1)+sum(x2*x2),2) THEN 2 ELSE 1 END
    + CASE WHEN sum(pow(x1+x2-x3,2))>1e-18 THEN 1 ELSE 0 END)::INT AS rank, sum(pow(x1+x2-x3,2)) AS rest FROM mrow GROUP BY label)"""


@query("md07_numerical_rank", f"""SELECT label, rows, CASE WHEN rows<3 THEN 'insufficient_data' ELSE 'ok' END AS status, rank, rank<3 AS ill_conditioned,
    CASE WHEN rank=2 THEN '[0.57735, 0.57735, -0.57735]' END AS null_direction FROM {RANK_SQL}""")
def numerical_rank(s, d):
    sp = idn.spectrum(views.model_rows(s, d), ["label"], ["x1", "x2", "x3"])
    return sp.select("label", "rows", "status", "rank", (C("condition").isNull() | (C("condition") > 1e10)).alias("ill_conditioned"),
                     F.transform("null_direction", lambda v: F.round(v, 6)).cast("string").alias("null_direction"))


@query("md08_column_sensitivity", f"""SELECT label, param, {R('norm')} AS norm, norm=0 AS dead, {R('norm*1e-4')} AS step_change FROM (SELECT label, 'p1' AS param, sqrt(sum(x1*x1)) AS norm FROM mrow GROUP BY label
    UNION ALL SELECT label, 'p2', sqrt(sum(x2*x2)) FROM mrow GROUP BY label UNION ALL SELECT label, 'p3', sqrt(sum(x3*x3)) FROM mrow GROUP BY label)""")
def column_sensitivity(s, d):
    x = idn.sensitivity(views.model_rows(s, d), ["label"], ["x1", "x2", "x3"], LINEAR.params)
    return x.select("label", "param", *r6c("norm"), "dead", *r6c("step_change"))


@query("md08_null_step", f"SELECT label, sqrt(rest/3)*1e-4<1e-12 AS unchanged FROM {RANK_SQL} WHERE rank=2")
def null_step(s, d):
    m = views.model_rows(s, d)
    sp = io.materialize(s, idn.spectrum(m, ["label"], ["x1", "x2", "x3"]), "spectrum")
    return idn.null_step(m, sp, ["label"], ["x1", "x2", "x3"]).select("label", (C("null_change") < 1e-12).alias("unchanged"))


@query("md09_multistart", """SELECT count(*) AS starts, min(rank)=max(rank) AS rank_consistent, min(rank) AS min_rank, max(rank) AS max_rank, count(DISTINCT (round(p/n,6), round(q/n,6)))<=1 AS null_direction_stable
    FROM (SELECT p, q, sqrt(p*p+q*q) AS n, CASE WHEN s>0 THEN 1 ELSE 0 END::INT AS rank FROM (SELECT sum(x1*x1) AS s FROM mrow), (VALUES (8e-1,5e-1),(3e-1,1.2e0),(1.5e0,2e-1)) t(p, q))""")
def multistart(s, d):
    j = idn.jacobian_rows(views.model_rows(s, d), PRODUCT, STARTS)
    return idn.multistart(idn.spectrum(j, ["start"], ["j0", "j1"]))


@query("md09_equivalence", f"SELECT label, 3 AS declared, rank AS effective_dof, 3-rank AS deficiency, CASE WHEN rank=2 THEN 'p1+p2+p3' END AS bound_group FROM {RANK_SQL}")
def equivalence(s, d):
    return idn.equivalence(idn.spectrum(views.model_rows(s, d), ["label"], ["x1", "x2", "x3"]), ["label"], LINEAR.params)


@query("st01_journal_quarantine", """SELECT 'accepted' AS side, count(*) AS n FROM events WHERE event_type<>'error' UNION ALL SELECT 'corrupt', count(*) FROM events WHERE event_type='error'""")
def journal_quarantine(s, d):
    base = io.shared_dir(s, "quarantine")
    e = sj.read_events(s, d)
    # a writer that breaks its error lines
    text = F.when(C("event_type") == "error", F.concat(F.lit("{"), C("props"))).otherwise(F.to_json(F.struct(C("event_id").alias("seq"), "event_type")))
    lines = e.select(F.from_json(text, "seq long, event_type string, corrupt string", {"columnNameOfCorruptRecord": "corrupt", "mode": "PERMISSIVE"}).alias("x")).select("x.*")
    sj.quarantine(lines, f"{base}/good", f"{base}/bad", f"{base}/checkpoint")
    def n(folder, side):
        return s.read.parquet(f"{base}/{folder}").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n("good", "accepted").unionByName(n("bad", "corrupt"))


@query("st02_latest_state_stream", """SELECT task_id, state, seq, events, CASE state WHEN 'READY' THEN 'submitted' WHEN 'RUNNING' THEN 'running' WHEN 'COMPLETED' THEN 'succeeded'
    WHEN 'FAILED' THEN 'failed' WHEN 'CANCELLED' THEN 'cancelled' ELSE 'unknown' END AS lifecycle, state IN ('READY','RUNNING') AS blocks FROM
    (SELECT task_id, arg_max(state, seq) AS state, max(seq) AS seq, count(*) AS events FROM journal GROUP BY task_id)""")
def latest_state_stream(s, d):
    base = io.shared_dir(s, "latest")
    sj.latest_state_stream(sj.as_journal(sj.read_events(s, d)), f"{base}/out", f"{base}/checkpoint")
    return sj.read_latest(s, f"{base}/out")


@query("st03_duplicate_events", "SELECT task_id, attempt, 1::BIGINT AS kept FROM journal GROUP BY 1, 2")
def duplicate_events(s, d):
    base = io.shared_dir(s, "unique")
    out = sj.first_submissions(sj.as_journal(sj.read_events(s, d)), "3650 days")
    sj.run_once(out.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out").groupBy("task_id", "attempt").agg(F.count("*").alias("kept"))


@query("st03_duplicate_events_batch", "SELECT task_id, attempt, min(seq) AS kept_seq, count(*)-1 AS dropped FROM journal GROUP BY 1, 2")
def duplicate_events_batch(s, d):
    return jr.first_per_attempt(views.journal(s, d))


RETRY_SQL = """SELECT task_id, first_final, b IS NOT NULL AS has_second, 0::BIGINT AS unknown_events, CASE WHEN b IS NULL THEN 'no_retry' WHEN first_final='FAILED' AND b>a THEN 'retry_ok' ELSE 'retry_violation' END AS verdict
    FROM (SELECT task_id, arg_max(state, seq) FILTER (WHERE attempt=1) AS first_final, max(seq) FILTER (WHERE attempt=1) AS a, min(seq) FILTER (WHERE attempt=2) AS b FROM journal GROUP BY 1)"""


@query("st04_retry_rule_stream", RETRY_SQL)
def retry_rule_stream(s, d):
    base = io.shared_dir(s, "retry")
    sj.retry_stream(sj.as_journal(sj.read_events(s, d)), f"{base}/out", f"{base}/checkpoint")
    return sj.newest(s, f"{base}/out", "task_id")


@query("st04_retry_rule", RETRY_SQL)
def retry_rule(s, d):
    return jr.retry_rule(views.journal(s, d))


LIFE_SQL = """SELECT j.*, r.first_final, r.has_second, r.unknown_events, r.verdict FROM (SELECT task_id, CASE WHEN epoch_ms(max(ts))+43200000 < (SELECT epoch_ms(max(ts))-3600000 FROM events) THEN 'final' ELSE 'open' END AS kind,
    arg_max(state, seq) AS state, max(seq) AS seq, count(*) AS events FROM (SELECT j.*, e.ts FROM journal j JOIN events e ON e.event_id=j.seq) GROUP BY task_id) j JOIN (%s) r USING (task_id)"""


@query("st04_task_life_stream", LIFE_SQL % RETRY_SQL)
def task_life_stream(s, d):
    """Latest state and retry verdict by one state that forgets a task half a day after its last event."""
    base = io.shared_dir(s, "life")
    stm.task_life_stream(sj.as_journal(sj.read_events(s, d)), f"{base}/out", f"{base}/checkpoint", "1 hour", 0.5)
    return stm.read_life(s, f"{base}/out")
