"""Sources, sinks, journals, streams and quality rules with a negative control each."""

import datetime
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import domains, journal as jr, quality as q, support as sp
from ridgeline.sources import io
from ridgeline.streaming import journal as sj, tasks as stm


def test_refuse_overwrite_and_band_order(spark, folder):
    df = spark.createDataFrame([(1, 0, 0, 5, 6, 64, 1, 1, 1)], io.OBSERVATION)
    io.write_new(df, f"{folder}/t")
    assert io.read_observations(spark, f"{folder}/t").count() == 1
    with pytest.raises(Exception, match="exists"):
        io.write_new(df, f"{folder}/t")
    with pytest.raises(ValueError, match="band order"):
        io.same_columns(df.select("a", "r", "c", "dn5", "dn4", "qa", "v4", "v5", "vqa"), io.OBSERVATION)


def test_registry_csv_and_journal(spark, folder):
    with open(f"{folder}/r.json", "w") as f:
        json.dump([{"scene_id": "s", "members": [{"band": "B4", "offset": 1}, {"band": "B5", "offset": 2}]}], f, indent=1)
    assert io.read_registry(spark, f"{folder}/r.json").count() == 2
    with open(f"{folder}/s.csv", "w") as f:
        f.write("scene_id,cloud,sun_az,sun_el\ns1,12.5,n/a,30\n")
    r = io.read_scene_csv(spark, f"{folder}/s.csv").first()
    assert (r["cloud"], r["sun_az"], r["sun_el"]) == (12.5, None, 30.0)
    os.mkdir(f"{folder}/j")
    with open(f"{folder}/j/a.json", "w") as f:
        f.write('{"seq": 1, "task_id": "t", "state": "READY"}\n\nnot json\n')
    j = io.read_journal(spark, f"{folder}/j").cache()
    assert j.where("corrupt IS NULL").count() == 1 and j.where("corrupt IS NOT NULL").count() == 1
    io.append_journal(spark.createDataFrame([(2, "t")], "seq long, task_id string"), f"{folder}/k")
    io.append_journal(spark.createDataFrame([(3, "t")], "seq long, task_id string"), f"{folder}/k")
    assert io.read_journal(spark, f"{folder}/k").count() == 2


def test_inputs_are_located_by_name(spark, folder):
    for n in ("x_SR_B4.tif", "x_SR_B5.tif", "y_SR_B5.tif"):
        with open(f"{folder}/{n}", "w") as f:
            f.write("x")  # Spark skips empty files
    m = {r["token"]: r["located"] for r in io.band_matches(io.input_files(spark, folder, "*.tif"), "path", ["SR_B4", "SR_B5", "SR_B6"]).collect()}
    assert m == {"SR_B4": "one", "SR_B5": "many", "SR_B6": "none"}


def test_publish_is_all_or_nothing(spark, folder):
    t = {"a": spark.range(3).toDF("id"), "b": spark.range(3).toDF("id")}
    ok = lambda staged: q.same_ids("P1", staged["a"], staged["b"], "id")
    io.publish(spark, t, f"{folder}/good", ok)
    assert spark.read.parquet(f"{folder}/good/b").count() == 3
    with pytest.raises(ValueError, match="P1"):
        io.publish(spark, {**t, "b": spark.range(2).toDF("id")}, f"{folder}/bad", ok)
    assert not os.path.exists(f"{folder}/bad")


def passed(df):
    return {r["check_id"]: (r["passed"], r["bad"]) for r in df.collect()}


def test_rules_catch_a_forged_row(spark):
    ok = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    bad = ok.unionByName(spark.createDataFrame([(2, None)], "id int, c string"))
    assert passed(q.unique_keys("K", ok, ["id"]))["K"] == (True, 0) and passed(q.unique_keys("K", bad, ["id"]))["K"] == (False, 1)
    assert passed(q.rule("C", ok, ~F.col("c").isin("a", "b")))["C"][0] and passed(q.rule("C", bad, ~F.col("c").isin("a", "b")))["C"] == (False, 1)
    assert passed(q.rules(bad, {"x": F.col("id") > 5, "y": F.col("c").isNull()})) == {"x": (True, 0), "y": (False, 1)}
    assert passed(q.same_ids("I", ok, bad, "id"))["I"][0] and passed(q.same_ids("I", ok, spark.createDataFrame([(9,)], "id int"), "id"))["I"] == (False, 3)


def test_partner_must_point_back(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 1), (5, 9), (6, None)], "id int, partner int")
    assert sorted(r["id"] for r in q.symmetric_partners(df, "id", "partner").collect()) == [3, 4, 5]


def test_bindings_and_versions(spark):
    b = spark.createDataFrame([("p", "h"), ("q", "h"), ("r", "h"), ("s", "h"), ("s", "h")], "path string, recorded string")
    cur = spark.createDataFrame([("p", "h"), ("q", "x"), ("s", "h")], "path string, current string")
    assert {r["path"]: r["binding"] for r in q.binding_check(b, cur).collect()} == {"p": "intact", "q": "drifted", "r": "missing", "s": "bound_twice"}
    v = q.version_difference(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int"), "id")
    assert {r["id"]: r["change"] for r in v.collect()} == {1: "left", 3: "joined"}


def test_masked_zero_and_real_zero_differ(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (1, 7)], "a int, v int")
    raw, flag = q.split_masked(F.col("v"))
    o = df.select("a", raw.alias("v"), flag.alias("f"))
    m = q.mask_reconstruction(o, {"B4": ("v", "f")}).first()
    assert (m["ones"], m["zeros"], m["bad_flags"], m["bad_transfer"]) == (2, 1, 0, 0)
    broken = o.withColumn("v", F.when(F.col("f") == 0, 9).otherwise(F.col("v")))
    assert q.mask_reconstruction(broken, {"B4": ("v", "f")}).first()["bad_transfer"] == 1


def test_ledgers_close(spark):
    rows = [(1, True, True, True, True, False, True, 0.5), (1, False, False, False, True, False, False, 0.5), (1, True, True, True, True, True, True, -0.1), (1, True, False, True, False, False, False, None)]
    px = spark.createDataFrame(rows, "a int, msource boolean, clear boolean, inrange boolean, tvalid boolean, water boolean, base boolean, cos_i double")
    px = px.withColumns({"land": F.col("base") & ~F.col("water"), "lit": F.coalesce(F.col("cos_i") > 0.1, F.lit(False))})
    grid = spark.createDataFrame([(1, 4), (2, 7)], "a int, grid_cells long")  # nothing was observed in 2
    led, fall = ({r["a"]: r for r in f(px, ["a"], grid).collect()} for f in (sp.loss_ledger, sp.waterfall))
    assert led[1]["closes"] and (led[1]["passive"], led[1]["active"], led[1]["several_kinds"]) == (1, 1, 1)
    assert fall[1]["closes"] and (fall[1]["calibration"], fall[1]["water"], fall[1]["total"]) == (1, 1, 4)
    wider = spark.createDataFrame([(1, 10)], "a int, grid_cells long")
    led[3], fall[3] = sp.loss_ledger(px, ["a"], wider).first(), sp.waterfall(px, ["a"], wider).first()
    assert [(led[k]["passive"], led[k]["active"], led[k]["not_base"], led[k]["closes"]) for k in (2, 3)] == [(7, 0, 7, True), (7, 1, 8, True)]
    assert [(fall[k]["total"], fall[k]["passive"], fall[k]["closes"]) for k in (2, 3)] == [(7, 7, True), (10, 7, True)]
    assert sp.support_record(px, ["a"], wider).first()["cells"] == 10


def test_cells_never_observed_count(spark):
    px = spark.createDataFrame([(0, 0, True, True, True)], "r long, c long, msource boolean, clear boolean, land boolean")
    cells = spark.createDataFrame([(0, 0), (0, 1)], "r long, c long")
    got = {(r["r"], r["c"]): (r["seen"], r["supported"]) for r in sp.cell_support(px, cells).collect()}
    assert got == {(0, 0): (1, 1), (0, 1): (0, 0)}


def test_identities_can_fail(spark):
    df = spark.createDataFrame([(10, 8, 4, 2, 0.8, 0.5, 0.25, 0.5), (10, 8, 4, 2, 0.7, 0.5, 0.25, 0.5), (10, 8, 4, 2, 0.8, 0.5, 0.3, 0.5), (10, 8, 9, 2, 0.8, 1.125, 0.25, 2 / 9)],
                               "t long, b long, s long, a long, ev double, sc double, se double, ac double")
    v = sp.identity_rules(*[F.col(c) for c in ("t", "b", "s", "a", "ev", "sc", "se", "ac")])
    got = df.select(v["identities_hold"].alias("i"), v["ordered"].alias("o")).collect()
    assert [r["i"] for r in got] == [True, False, False, True] and [r["o"] for r in got] == [True, True, True, False]


def test_cause_precedence(spark):
    rows = [(0, 0, 0, 0), (5, 0, 5, 5), (5, 2, 5, 0), (5, 2, 1, 5), (5, 2, 1, 1)]
    df = spark.createDataFrame(rows, "z int, n int, e int, q int")
    got = [r[0] for r in df.select(sp.cause(F.col("z"), F.col("n"), F.col("e"), F.col("q"))[0]).collect()]
    assert got == ["no_mask_zero", "target_grid_reprojection_introduced", "edge_only", "qa_explained", "source_native_missing"]


def test_coverage_reasons(spark):
    df = spark.createDataFrame([(10, 8, 4, 2), (10, 0, 0, 0), (10, 5, 0, 0)], "t long, b long, s long, a long")
    v = sp.coverage_identities(*[F.col(c) for c in "tbsa"])
    r = df.select(*[x.alias(n) for n, x in v.items()]).collect()
    assert [x["reason"] for x in r] == [None, "zero_base_valid_land_denominator", "zero_scored_denominator"] and all(x["identities_hold"] for x in r)
    assert (r[0]["evidence"], r[0]["scoring"], r[0]["selective"], r[0]["acceptance"]) == (0.8, 0.5, 0.25, 0.5) and r[2]["acceptance"] is None


def test_order_and_run_rules(spark):
    it = spark.createDataFrame([(1, "2020", "a"), (2, "2021", "b"), (3, "2021", "c")], "ord int, t string, k string")
    good = jr.order_check(it, "ord", "t", "k").first()
    assert good["contiguous"] and good["order_matches_time"]
    swap = it.withColumn("ord", F.when(F.col("ord") == 1, 2).when(F.col("ord") == 2, 1).otherwise(4))
    bad = jr.order_check(swap, "ord", "t", "k").first()
    assert not bad["contiguous"] and not bad["order_matches_time"]
    j = spark.createDataFrame([(1, "COMPLETED"), (3, "COMPLETED")], "task_id int, state string")
    run = {r["task_id"]: r["may_run"] for r in jr.may_run(spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "task_id int, ord int"), j).collect()}
    assert run == {1: False, 2: True, 3: False, 4: False}


def test_retry_cases(spark):
    rows = [(1, 1, 1, "READY"), (2, 1, 1, "FAILED"), (3, 1, 2, "READY"), (4, 2, 1, "RUNNING"), (5, 2, 2, "READY"), (6, 3, 1, "FAILED"), (7, 4, 1, "FAILED"), (8, 4, 2, "ODD")]
    j = spark.createDataFrame(rows, "seq long, task_id long, attempt long, state string")
    assert {r["task_id"]: r["verdict"] for r in jr.retry_rule(j).collect()} == {1: "retry_ok", 2: "retry_violation", 3: "no_retry", 4: "blocked_unknown"}


def test_streams_equal_their_batch_twins(spark, folder):
    rows = [(i, f"2024-01-0{1 + i // 4} 00:00:00", i % 3, ["signup", "error", "view", "purchase"][i % 4], 1.0, "{}") for i in range(24)]
    ev = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    ev = ev.select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    for i in range(3):  # three files arrive one by one
        ev.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = lambda: sj.as_journal(spark.readStream.schema(sj.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in"))
    batch = sj.as_journal(ev)
    sj.latest_state_stream(stream(), f"{folder}/latest", f"{folder}/c1")
    assert sorted(sj.read_latest(spark, f"{folder}/latest").collect()) == sorted(jr.latest_state(batch).collect())
    sj.retry_stream(stream(), f"{folder}/retry", f"{folder}/c2")
    assert sorted(sj.newest(spark, f"{folder}/retry", "task_id").collect()) == sorted(jr.retry_rule(batch).select("task_id", "first_final", "has_second", "unknown_events", "verdict").collect())


def test_task_life_expires_and_keeps_late_events_apart(spark, folder):
    schema = "seq long, ts timestamp, task_id long, state string, attempt long"
    at = lambda day: datetime.datetime(2024, 1, day)
    batches = [
        [(1, at(1), 1, "FAILED", 1), (2, at(1), 2, "RUNNING", 1), (3, at(2), 1, "READY", 2)],
        [(4, at(4), 3, "ODD", 1), (5, at(4), 3, "READY", 2), (None, at(4), 3, "READY", 2), (6, None, 3, "READY", 2)],
        [(7, at(1), 1, "CANCELLED", 1), (8, at(20), 4, "READY", 1)],  # 7 is older than the watermark; day 20 ends tasks 1 to 3
        [(9, at(5), 2, "COMPLETED", 1), (10, at(20), 2, "READY", 1)]]  # 9 is late, 10 starts task 2 anew
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        j = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        stm.task_life_stream(j, f"{folder}/out", f"{folder}/c", "1 day", 7)
    assert "providerClass" not in str(spark.conf.get(stm.PROVIDER, ""))
    got = {r["task_id"]: (r["kind"], r["state"], r["events"], r["verdict"]) for r in stm.read_life(spark, f"{folder}/out").collect()}
    assert got == {1: ("final", "READY", 2, "retry_ok"), 2: ("open", "READY", 1, "no_retry"), 3: ("final", "READY", 2, "blocked_unknown"), 4: ("open", "READY", 1, "no_retry")}
    assert sorted((r["task_id"], r["seq"]) for r in stm.read_late(spark, f"{folder}/out").collect()) == [(1, 7), (2, 9)]
    every = spark.read.parquet(f"{folder}/out").where("kind = 'final'")
    assert sorted(r["task_id"] for r in every.collect()) == [1, 2, 3]
    held = spark.read.format("statestore").option("stateVarName", "task").load(f"{folder}/c")
    assert sorted(r[0] for r in held.select("key.task_id").collect()) == [2, 4]


def test_stream_quarantine(spark, folder):
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.json", "w") as f:
        f.write('{"seq": 1, "state": "READY"}\nbroken\n{"seq": 2, "state": "FAILED"}\n')
    sj.quarantine(sj.read_lines(spark, f"{folder}/in"), f"{folder}/good", f"{folder}/bad", f"{folder}/c")
    assert spark.read.parquet(f"{folder}/good").count() == 2 and spark.read.parquet(f"{folder}/bad").first()["corrupt"] == "broken"


def test_domain_rules(spark):
    led = spark.createDataFrame([(1, 12, 3), (2, 5, 9), (3, 12, 7)], "d int, qualified int, strong int")
    adm = domains.admission(led, {"A2": F.col("qualified") >= 10, "A3": F.col("strong") >= 5})
    got = {r["d"]: r["failed"] for r in adm.collect()}
    assert got == {1: "A3", 2: "A2", 3: ""}
    assert [r["d"] for r in domains.rank_domains(adm, [F.desc("qualified")], 1).collect()] == [3]


def test_sensor_days_names_foreign_scenes(spark):
    import datetime as dt
    inside, after = dt.date(2014, 5, 1), dt.date(2025, 1, 1)
    rows = [(1, inside, "L8"), (1, dt.date(2013, 1, 1), "L9"), (2, inside, "L7"), (3, after, "L8"), (4, None, "L8"), (5, inside, None), (6, dt.date(2024, 12, 31), "L9"), (6, inside, "L7")]
    got = domains.sensor_days(spark.createDataFrame(rows, "d int, day date, sensor string"), ["L8", "L9"], "2013-01-01", "2024-12-31")
    assert {r["d"]: (r["scenes"], r["foreign"]) for r in got.collect()} == {1: (2, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (1, 1), 6: (2, 1)}


def test_cover_share_counts_exact_edges(spark):
    import random
    rnd = random.Random(3)
    cells = {(r, c) for r in range(60) for c in range(45) if rnd.random() < 0.97}
    boxes = [(1, 20, 20, 30, 31), (2, 0, 0, 60, 45), (3, 2, 2, 12, 12), (4, 50, 40, 64, 50), (5, 100, 100, 110, 110), (6, 10, 10, 10, 15), (7, 8, 8, 40, 40), (8, 16, 16, 17, 17)]
    frames = spark.createDataFrame(boxes, "d int, r0 int, c0 int, r1 int, c1 int"), spark.createDataFrame(sorted(cells), "r int, c int")
    for buffer, block in ((0, 8), (4, 8), (3, 64), (2, 1)):
        want = {}
        for d, r0, c0, r1, c1 in boxes:
            # a box without cells stays empty unless the buffer opens it
            rs, cs = range(r0 - buffer, r1 + buffer), range(c0 - buffer, c1 + buffer)
            n = sum((r, c) in cells for r in rs for c in cs)
            want[d] = (len(rs) * len(cs), n, n / (len(rs) * len(cs)) if len(rs) * len(cs) else None)
        assert {r["d"]: (r["places"], r["covered"], r["cover"]) for r in domains.cover_share(*frames, buffer, block).collect()} == want


def test_domains_that_fail_one_rule_only(spark):
    place = spark.createDataFrame([(0, 103.0, 33.0), (1, 103.5, 33.0), (2, 10.0, 46.0), (3, None, 1.0)], "d int, lon double, lat double")
    km = {r["d"]: r["separation_km"] for r in domains.separation_km(place, place.where("d = 0")).collect()}
    assert km[0] == 0 and abs(km[1] - 46.63) < 0.01 and km[2] > 7000 and km[3] is None
    assert [r["separation_km"] for r in domains.separation_km(place, place.where("d = 9")).collect()] == [None] * 4
    rows = [("all", 0, 0.9995, 300.0), ("sensor", 1, 1.0, 300.0), ("cover", 0, 0.998, 300.0), ("near", 0, 1.0, 199.9), ("unknown", None, None, None)]
    adm = domains.admission(spark.createDataFrame(rows, "d string, foreign int, cover double, km double"),
                            {"A1": F.col("foreign") == 0, "A4": F.col("cover") >= 0.999, "A6": F.col("km") >= 200})
    assert {r["d"]: r["failed"] for r in adm.collect()} == {"all": "", "sensor": "A1", "cover": "A4", "near": "A6", "unknown": "A1,A4,A6"}


GOOD_RECORDS = [
    {"object_id": "g", "identity_class": "G", "disposition": "identity_qualified", "evidence_scope": "local", "source_binding": {"relative_path": "p", "sha256": "1"}},
    {"object_id": "e", "identity_class": "E", "disposition": "excluded_class_or_path_violation", "forbidden_paths": ["可拟合量", "梯度落点"], "source_binding": {"relative_path": "p", "sha256": "1"}},
    {"object_id": "w", "identity_class": "Z_t", "disposition": "identity_qualified", "evidence_scope": "global", "global_justification_kind": "analytic_proof",
     "evidence_scope_justification": "closed form", "source_binding": {"relative_path": "p", "sha256": "1"}},
    {"object_id": "a", "identity_class": "X_t", "disposition": "non_identifiable_equivalent", "equivalence_partner": "b", "source_binding": {"relative_path": "p", "sha256": "1"}},
    {"object_id": "b", "identity_class": "X_t", "disposition": "non_identifiable_equivalent", "equivalence_partner": "a", "source_binding": {"relative_path": "p", "sha256": "1"}},
    {"object_id": "c", "identity_class": "N_t", "disposition": "identity_qualified_with_fixed_gauge", "evidence_scope": "profile", "gauge": {"fixed": True, "rule": "sum"},
     "equivalence_watch": {"object_id": "a"}, "source_binding": {"relative_path": "p", "sha256": "1"}},
    {"object_id": "n", "identity_class": "not_applicable", "not_applicable_reason": "a factor", "architecture_factor": "f", "quality_phase": "pre_inference"}]
GOOD_DEFERRED = [{"object_id": "d", "disposition": "deferred_missing_anchor", "distinctness_assertions": ["x"]},
                 {"object_id": "d2", "disposition": "deferred_missing_anchor", "distinctness_assertions": ["x"], "source_binding": {"relative_path": "gone", "sha256": "9"}}]
BROKEN = [  # rule, number of the record (or -1: deferred), fields to set, fields to drop
    ("I1_class", 0, {"identity_class": "sensor_quality"}, []), ("I1_disposition", 0, {"disposition": "maybe"}, []), ("I1_unique", 0, {"object_id": "e"}, []),
    ("I2_no_gradient_for_E", 1, {"forbidden_paths": ["可拟合量"]}, []), ("I3_not_applicable", 6, {"evidence_scope": None}, []), ("I3_not_applicable", 6, {}, ["not_applicable_reason"]),
    ("I3_not_applicable", 6, {"quality_phase": "later"}, []), ("I3_not_applicable", 6, {}, ["quality_phase"]), ("I4_scope", 0, {"evidence_scope": "regional"}, []),
    ("I5_global_proof", 2, {"global_justification_kind": "multi_start"}, []), ("I5_global_proof", 2, {}, ["evidence_scope_justification"]),
    ("I6_partner", 3, {}, ["equivalence_partner"]), ("I6_partner", 3, {"equivalence_partner": "zz"}, []), ("I6_partner", 3, {"equivalence_partner": "g"}, []),
    ("I7_fixed_gauge", 5, {"gauge": {"fixed": True}}, []), ("I7_fixed_gauge", 0, {"gauge": {"fixed": True, "rule": "r"}}, []),
    ("I8_bound_hash", 0, {"source_binding": {"relative_path": "p", "sha256": "2"}}, []), ("I8_bound_hash", 0, {}, ["source_binding"]),
    ("D1_disposition", -1, {"disposition": "identity_qualified"}, []), ("D2_no_class", -1, {"identity_class": None}, []), ("D3_distinct", -1, {"distinctness_assertions": []}, []),
    ("I8_bound_hash", -1, {"source_binding": {"relative_path": "p", "sha256": "2"}}, [])]


def outcome(spark, records, deferred):
    docs = [spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in x], "doc string") for x in (records, deferred)]
    return {r["check_id"] for r in q.registry_rules(*docs, spark.createDataFrame([("p", "1")], "path string, sha256 string")).collect() if not r["passed"]}


def test_registry_rules_pass_and_fail(spark):
    assert outcome(spark, GOOD_RECORDS, GOOD_DEFERRED) == set()
    for rule, at, change, gone in BROKEN:
        records, deferred = [dict(r) for r in GOOD_RECORDS], [dict(r) for r in GOOD_DEFERRED]
        rec = deferred[0] if at < 0 else records[at]
        rec.update(change)
        for k in gone:
            rec.pop(k)
        assert rule in outcome(spark, records, deferred), (rule, change, gone)


def test_manifest_drift_sees_order_and_constants(spark):
    rows = [(i, f"2020-01-{1 + i:02d}", f"id{i}", 100 + i, "v1", f"f/{i}.tif") for i in range(20)]
    schema = "pos long, day string, id string, seed long, version string, path string"

    def run(data, **more):
        args = {"position": "pos", "order": ["day", "id"], "unique": ["id", "seed"], "constants": {"version": "v1"}, "count": 20, "paths": "path", **more}
        return {r["check_id"] for r in q.manifest_drift(spark.createDataFrame(data, schema), **args).collect() if not r["passed"]}

    def digest(df):
        return df.agg(q.order_digest("pos", ["day", "id", "id", "seed"])).first()[0]
    frozen = digest(spark.createDataFrame(rows, schema))
    assert run(rows, digest=frozen) == set() and digest(spark.createDataFrame(rows[::-1], schema).repartition(7)) == frozen
    swapped = [*rows[:4], (4, *rows[5][1:]), (5, *rows[4][1:]), *rows[6:]]
    assert run(swapped, digest=frozen) == {"canonical_order", "ordered_digest"}
    assert run(rows[:-1]) == {"entry_count"} and run(rows[:5] + rows[6:]) == {"entry_count", "gapless_positions"}
    assert run([*rows[:-1], (19, "2020-01-20", "id3", 119, "v1", "f/x.tif")]) == {"unique_id"}
    assert run([*rows[:-1], (19, "2020-01-20", "id19", 101, None, "/f.tif")]) == {"unique_seed", "frozen_version", "relative_paths"}
    assert run([*rows[:-1], (19, "2020-01-20", "id19", 119, "v1", "../f.tif")]) == {"relative_paths"}


def test_binding_check_names_every_state(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("d", "1")], "path string, recorded string")
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, current string")
    assert {r["path"]: r["binding"] for r in q.binding_check(b, c).collect()} == {"a": "intact", "b": "drifted", "c": "missing", "d": "bound_twice"}


CROSS = {  # a state of all tables that breaks no rule
    "registry": [("mu", "identity_qualified", None), ("a", "non_identifiable_equivalent", "b"), ("b", "non_identifiable_equivalent", "a")],
    "used": [("mu",), ("a",), ("b",), ("b",)],
    "candidates": [(1, "qualified", True, None, ["mu"], None, None), (2, "twin", True, 1, [], "a", "b"), (3, None, False, 1, None, None, None), (4, "twin", False, None, ["x"], "unregistered", "q")],
    "order": [(2,), (1,), (1,)],
    "gates": [("qualified", 10000, True, 5000, 10000, "高估 v", "低估 v"), (None, 5000, False, 5000, 6000, "低估", "高估")],
    "declarations": [("NOT_BLIND", "post_result_exploratory")],
    "texts": [("frozen",), (None,)],
    "bindings": [("p", "1"), ("p", "1")],
    "current": [("p", "1"), ("q", "2")]}
CROSS_SCHEMA = {
    "registry": "object_id string, disposition string, partner string", "used": "object_id string",
    "candidates": "id int, terminal_state string, run boolean, constrains int, new_parameters array<string>, mirrors string, partner string", "order": "id int",
    "gates": "terminal_state string, distance long, curvature boolean, threshold long, buffer long, truncation_effect string, flat_effect string",
    "declarations": "status string, exposure string", "texts": "text string", "bindings": "path string, recorded string", "current": "path string, current string"}
G0, C1, TWIN = CROSS["gates"][0], CROSS["candidates"][1], "non_identifiable_equivalent"
CROSS_BROKEN = [  # rules that one more row breaks, table, the row
    (["X1"], "used", ("new",)), (["X1"], "registry", ("idle", "identity_qualified", None)), (["X2"], "candidates", (9, "settled", False, None, ["mu"], None, None)),
    (["X2"], "gates", ("open", *G0[1:])), (["X3", "X1"], "registry", ("r3", "qualified", None)),
    (["X4_partner_known", "X4_partner_returns", "X1"], "registry", ("lost", TWIN, "zz")), (["X4_partner_known", "X4_partner_returns", "X1"], "registry", ("none", TWIN, None)),
    (["X4_partner_returns", "X1"], "registry", ("tail", TWIN, "a")), (["X4_partner_returns", "X1"], "registry", ("end", TWIN, "mu")),
    (["X4_same_partner"], "candidates", (*C1[:2], False, *C1[3:6], "mu")), (["X4_same_partner"], "candidates", (*C1[:2], False, *C1[3:6], None)),
    (["X4_mapped_state"], "candidates", (5, "qualified", False, *C1[3:])), (["X4_mapped_state"], "candidates", (6, None, False, *C1[3:])),
    (["X5"], "candidates", (7, None, False, 1, ["k"], None, None)), (["X6"], "order", (3,)), (["X6"], "candidates", (8, None, True, None, None, None, None)),
    (["X7"], "gates", (*G0[:2], False, *G0[3:])), (["X7"], "gates", (*G0[:2], None, *G0[3:])), (["X7"], "gates", (*G0[:4], 9999, *G0[5:])),
    (["X7"], "gates", (*G0[:4], None, *G0[5:])), (["X7"], "gates", ("qualified", None, *G0[2:])),
    (["X8"], "gates", (*G0[:5], "高估", "高估")), (["X8"], "gates", (*G0[:5], None, "低估")),
    (["X9"], "declarations", ("BLIND", "post_result_exploratory")), (["X9"], "declarations", ("NOT_BLIND", None)), (["X10"], "texts", ("sha256: <HASH>",)),
    (["X11"], "bindings", ("q", "1")), (["X11"], "bindings", ("gone", "1"))]


def cross(spark, data, **more):
    frames = {n: spark.createDataFrame(rows, CROSS_SCHEMA[n]) for n, rows in data.items()}
    mapping = {"qualified": "identity_qualified", "twin": TWIN}
    got = q.cross_rules(spark, **frames, closed=["qualified", "twin"], mapping=mapping, **more).collect()
    assert all(r["passed"] == (r["bad"] == 0) for r in got) and len(got) == 14
    return {r["check_id"]: r["bad"] for r in got if r["bad"]}


def test_cross_rules_pass_and_fail(spark):
    assert cross(spark, CROSS) == {}
    # every broken row counts once under each rule it breaks and under no other
    assert cross(spark, {n: rows + [x for _, t, x in CROSS_BROKEN if t == n] for n, rows in CROSS.items()}) == Counter(r for rules, _, _ in CROSS_BROKEN for r in rules)


def test_cross_rules_before_freezing_and_on_empty_tables(spark):
    early = {**CROSS, "gates": [("qualified", None, *G0[2:])], "texts": [("TODO",)]}
    assert cross(spark, early) == {"X7": 1, "X10": 1} and cross(spark, early, freeze=False) == {}
    assert cross(spark, {n: [] for n in CROSS}) == {}


def test_nodes_on_a_cycle(spark):
    import random
    rnd = random.Random(5)
    links = {i: rnd.choice([None, rnd.randrange(420), i + 1, i + 1]) for i in range(400)}
    links.update({i: i + 1 for i in range(500, 564)} | {564: 500} | {i: 500 for i in range(600, 700)} | {700: 700})

    def returns(i):
        at, seen = links.get(i), set()
        while at is not None and at not in seen and at != i:
            seen.add(at)
            at = links.get(at)
        return at == i
    got = q.on_a_cycle(spark, spark.createDataFrame(list(links.items()), "id int, next int"), "id", "next")
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i in links if returns(i))


SCOPE_NAMES = ["all", "low", "high"]
TABLES = {  # unit 1 is scored and has curves, unit 2 is not
    "units": [(1, "scored", "scored", None, 20, 10, 8, 0.8), (2, "not_scored", "unsupported_calibration", "few", 20, 0, 0, None)],
    "scopes": [(1, "all", 8, "evaluated", "good", None, "up", 0.1), (1, "low", 5, "evaluated", "bad", None, "down", 0.2), (1, "high", 3, "not_evaluable", "thin", "few", None, None),
               *[(2, n, 0, "not_evaluable", "thin", "few", None, None) for n in SCOPE_NAMES]],
    "curve": [(1, n, i, m, m / 10 if m else None) for n in ("all", "low") for i, m in ((1, 3), (2, None), (3, 5))],
    "aggregate": [("all", "good", 1), ("low", "bad", 1), ("all", "thin", 1), ("low", "thin", 1), ("high", "thin", 2)]}
TABLES_SCHEMA = {
    "units": "k int, gate string, category string, reason string, core_total long, core_land long, core_scored long, coverage double",
    "scopes": "k int, scope string, n_scored long, gate string, verdict string, reason string, shape string, area double",
    "curve": "k int, scope string, q long, accepted long, coverage double", "aggregate": "scope string, verdict string, n long"}
U0, S0, S2, P0 = TABLES["units"][0], TABLES["scopes"][0], TABLES["scopes"][2], TABLES["curve"][0]
TABLES_BROKEN = [  # rules that break, table, row to replace (or None: one more; -1: last left out), the row
    ("unit_keys", "units", 1, U0), ("unit_keys", "units", 1, (None, *TABLES["units"][1][1:])), ("unit_finite unit_ratio", "units", 0, (*U0[:7], float("nan"))),
    ("unit_terminal", "units", 0, (1, "scored", "scored", "few", *U0[4:])), ("unit_terminal", "units", 1, (2, "not_scored", "scored", "few", 20, 0, 0, None)), ("unit_terminal", "units", 1, (2, None, "scored", None, 20, 0, 0, None)),
    ("unit_counts", "units", 0, (*U0[:4], 9, 10, 8, 0.8)), ("unit_ratio", "units", 0, (*U0[:7], 0.8000001)), ("unit_ratio", "units", 1, (*TABLES["units"][1][:7], 0.0)), ("unit_sum unit_ratio", "units", 0, (*U0[:6], 7, 0.8)),
    ("scope_keys", "scopes", 1, S0), ("scope_finite", "scopes", 0, (*S0[:7], float("inf"))), ("scope_closed_set", "scopes", 2, (1, "middle", *S2[2:])),
    ("verdict_owner", "scopes", 0, (*S0[:4], "bad", *S0[5:])), ("verdict_owner", "scopes", 0, (*S0[:5], "few", *S0[6:])), ("verdict_owner", "scopes", 2, (*S2[:5], "unknown", None, None)),
    ("verdict_owner", "scopes", 2, (*S2[:6], "up", None)), ("scope_identities", "scopes", -1, None), ("scope_identities", "units", -1, None),
    ("scope_sum unit_sum", "scopes", 0, (1, "all", 7, *S0[3:])), ("scope_sum", "scopes", 2, (1, "high", 2, *S2[3:])), ("curve_finite curve_ratio", "curve", 0, (*P0[:4], float("nan"))),
    ("curve_ratio", "curve", 0, (*P0[:4], 0.31)), ("curve_ratio", "curve", 0, (*P0[:4], None)), ("curve_sequence", "curve", 1, (1, "all", 4, None, None)),
    ("curve_sequence curve_keys", "curve", 1, (1, "all", 1, None, None)), ("curve_sequence", "curve", 0, (1, "all", 0, 3, 0.3)), ("curve_sequence", "curve", 0, (1, "all", None, 3, 0.3)),
    ("curve_identities", "curve", None, (2, "none", 1, None, None)), ("aggregate_counts", "aggregate", 0, ("all", "good", 2)), ("aggregate_counts", "aggregate", -1, None), ("aggregate_counts", "aggregate", None, ("all", "fine", 1))]


def tables_outcome(spark, data, required=None):
    frames = {n: spark.createDataFrame(rows, TABLES_SCHEMA[n]) for n, rows in data.items()}
    got = q.validate_tables(**frames, keys=["k"], names=SCOPE_NAMES, verdict_of={"up": "good", "down": "bad"}, owner_of={"few": "thin"}, required=required)
    return {r["check_id"] for r in got.collect() if not r["passed"]}


def test_validate_tables_pass_and_fail(spark):
    columns = {n: [x.split()[0] for x in s.split(", ")] for n, s in TABLES_SCHEMA.items()}
    assert tables_outcome(spark, TABLES, columns) == set() and tables_outcome(spark, {n: [] for n in TABLES}, columns) == set()
    assert tables_outcome(spark, TABLES, {**columns, "curve": ["q", "point"]}) == {"required_fields"}
    runs = []  # cases of different tables that break different rules share a run
    for rules, table, at, row in TABLES_BROKEN:
        rows = list(TABLES[table])
        if at == -1:
            rows.pop()
        elif at is None:
            rows.append(row)
        else:
            rows[at] = row
        want = set(rules.split())
        run = next((r for r in runs if table not in r[1] and not want & r[0]), None)
        if run is None:
            run = (set(), {})
            runs.append(run)
        run[0].update(want)
        run[1][table] = rows
    for want, tables in runs:
        assert want <= tables_outcome(spark, {**TABLES, **tables}), (want, tables)
