"""Data-quality checks: each is a DataFrame of (check_id, passed, bad), bad = rows that break the rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import identity
from ..functions.numeric import ratio
from ..sources import io
from . import folds as fd
from .prefix import union_all


def rule(check_id: str, rows: DataFrame, broken: Column) -> DataFrame:
    """Count the rows of a table that break a rule; a null outcome counts as broken."""
    return rows.agg(F.count_if(F.coalesce(broken, F.lit(True))).alias("bad")).select(
        F.lit(check_id).alias("check_id"), (F.col("bad") == 0).alias("passed"), "bad")


def empty(check_id: str, rows: DataFrame) -> DataFrame:
    """A set that has to be empty."""
    return rule(check_id, rows, F.lit(True))


def rules(rows: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """Several rules over one table in one pass."""
    g = rows.agg(*[F.count_if(F.coalesce(b, F.lit(True))).alias(n) for n, b in broken.items()])
    out = F.array(*[F.struct(F.lit(n).alias("check_id"), (F.col(n) == 0).alias("passed"), F.col(n).alias("bad")) for n in broken])
    return g.select(F.explode(out).alias("x")).select("x.*")


def unique_keys(check_id: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or occur more than once."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return rule(check_id, n, (F.col("n") > 1) | missing)


def same_ids(check_id: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Symmetric difference of two id sets."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return empty(check_id, x.join(y, key, "left_anti").unionByName(y.join(x, key, "left_anti")))


def suite(checks: list[tuple[str, str, Callable[[], DataFrame]]]) -> DataFrame:
    """Run a list of (id, text, check) and put the outcomes in one table."""
    return union_all([fn().withColumn("rule", F.lit(text)) for _, text, fn in checks])


def leakage(px: DataFrame, used: Column) -> DataFrame:
    """Used calibration cells per acquisition and fold that lie in the core or buffer of that fold."""
    return px.where(used).groupBy("a", "k").agg(F.count_if(F.col("role") != fd.DOMAIN).alias("violations"), F.count("*").alias("used"))


def mask_reconstruction(obs: DataFrame, bands: dict[str, tuple[str, str]]) -> DataFrame:
    """Per acquisition and band: flag values outside 0/1, and raw values kept where the flag is 0."""
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(v).alias("raw"), F.col(f).alias("flag")) for b, (v, f) in bands.items()])
    x = obs.select("a", F.explode(rows).alias("x")).select("a", "x.*")
    return x.groupBy("a", "band").agg(
        F.count_if(F.col("flag") == 1).alias("ones"), F.count_if(F.col("flag") == 0).alias("zeros"),
        F.count_if(~F.col("flag").isin(0, 1)).alias("bad_flags"), F.count_if((F.col("flag") == 0) & (F.col("raw") != 0)).alias("bad_transfer"))


def split_masked(value: Column) -> tuple[Column, Column]:
    """Write side of a masked value: 0 in its place and a 0/1 flag column."""
    return F.coalesce(value, F.lit(0)), value.isNotNull().cast("int")


def binding_check(bindings: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded hash per path against the current one; missing and repeated paths are named."""
    n = bindings.groupBy("path").agg(F.count("*").alias("n"), F.min("recorded").alias("recorded"))
    j = n.join(current, "path", "left")
    state = (F.when(F.col("n") > 1, "bound_twice").when(F.col("current").isNull(), "missing")
             .when(F.col("current") != F.col("recorded"), "drifted").otherwise("intact"))
    return j.select("path", state.alias("binding"))


def version_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Members that joined or left between two versions of a universe."""
    o, n = old.select(key).withColumn("_o", F.lit(True)), new.select(key).withColumn("_n", F.lit(True))
    j = o.join(n, key, "full_outer").where(F.col("_o").isNull() | F.col("_n").isNull())
    return j.select(key, F.when(F.col("_o").isNull(), "joined").otherwise("left").alias("change"))


def receipts(verdicts: DataFrame, id_cols: list[str], criteria: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """One row per verdict and criterion: measured value, outcome and the rule text."""
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), m.cast("double").alias("measured"), p.alias("passed"), F.lit(t).alias("rule"))
                     for n, (m, p, t) in criteria.items()])
    return verdicts.select(*id_cols, F.explode(rows).alias("x")).select(*id_cols, "x.*")


def disposition_ledger(rows: DataFrame, col: str, admitted: list[str], digest: Column) -> DataFrame:
    """Counts per disposition with an admitted / blocked side; members as a digest, not a list."""
    return rows.groupBy(col).agg(F.count("*").alias("n"), digest.alias("members")).withColumn(
        "side", F.when(F.col(col).isin(*admitted), "admitted").otherwise("blocked"))


def symmetric_partners(rows: DataFrame, key: str, partner: str) -> DataFrame:
    """Entries whose partner does not point back (or does not exist)."""
    back = rows.select(F.col(key).alias(partner), F.col(partner).alias("_back"), F.lit(True).alias("_known"))
    j = rows.where(F.col(partner).isNotNull()).join(back, partner, "left")
    return j.where(F.col("_known").isNull() | ~F.col("_back").eqNullSafe(F.col(key))).select(key, partner)


# Fixed names of the identity registry's closed sets.
IDENTITY_CLASSES = ["G", "X_t", "Z_t", "N_t", "E", "not_applicable"]
DISPOSITIONS = ["identity_qualified", "identity_qualified_with_fixed_gauge", "non_identifiable_equivalent",
                "excluded_class_or_path_violation", "deferred_missing_anchor"]
EVIDENCE_SCOPES = ["local", "profile", "global"]
JUSTIFICATION_KINDS = ["analytic_proof", "structural_argument", "domain_covering_evidence"]
QUALITY_PHASES = ["pre_inference", "post_inference"]
FORBIDDEN_FOR_E = ["可拟合量", "梯度落点"]


def registry_rules(entries: DataFrame, deferred: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules I1-I8 and D1-D3 of a registry of nested records: (check_id, passed, bad), bad = records that break the rule.

    ``entries`` and ``deferred`` have a column ``doc`` with one JSON object a row; ``sources`` has path and sha256 of what
    records are bound to. Which fields a record must or must not carry depends on its class and outcome; a field counts as carried
    even if null. Partners and bound hashes are equi-joins, so a registry of any size is checked by two shuffles.
    """
    def text(path: str) -> Column:
        return F.get_json_object("doc", f"$.{path}")

    def carried(name: str) -> Column:
        return F.coalesce(F.array_contains(F.json_object_keys("doc"), name), F.lit(False))

    def outside(c: Column, names: list[str]) -> Column:
        return ~F.coalesce(c.isin(*names), F.lit(False))
    e = entries.select("doc", text("object_id").alias("id"), text("identity_class").alias("cls"), text("disposition").alias("disp"),
                       text("evidence_scope").alias("scope"), text("equivalence_partner").alias("partner"),
                       F.coalesce(text("equivalence_watch.object_id"), F.lit("")).alias("watch"),
                       text("source_binding.relative_path").alias("path"), text("source_binding.sha256").alias("sha"))
    aside = F.coalesce(F.col("cls") == "not_applicable", F.lit(False))
    qualified = ~aside & F.coalesce(F.col("disp").isin(*DISPOSITIONS[:2]), F.lit(False))
    worldwide = qualified & F.coalesce(F.col("scope") == "global", F.lit(False))
    fixed = ~aside & F.coalesce(text("gauge.fixed") == "true", F.lit(False))
    phase = text("quality_phase")
    factor = F.coalesce(~text("architecture_factor").isin("", "false", "0", "[]", "{}"), F.lit(False))
    lacks = [~F.contains(F.coalesce(text("forbidden_paths"), F.lit("")), F.lit(t)) for t in FORBIDDEN_FOR_E]
    one = rules(e, {
        "I1_class": outside(F.col("cls"), IDENTITY_CLASSES),
        "I1_disposition": ~aside & outside(F.col("disp"), DISPOSITIONS),
        "I2_no_gradient_for_E": F.coalesce(F.col("cls") == "E", F.lit(False)) & (lacks[0] | lacks[1]),
        "I3_not_applicable": aside & (carried("disposition") | carried("evidence_scope") | ~carried("not_applicable_reason")
                                      | (phase.isNotNull() & outside(phase, QUALITY_PHASES)) | (factor & phase.isNull())),
        "I4_scope": qualified & outside(F.col("scope"), EVIDENCE_SCOPES),
        "I5_global_proof": worldwide & (outside(text("global_justification_kind"), JUSTIFICATION_KINDS)
                                        | (F.coalesce(text("evidence_scope_justification"), F.lit("")) == "")),
        "I7_fixed_gauge": fixed & (outside(F.col("disp"), DISPOSITIONS[1:2]) | (F.coalesce(text("gauge.rule"), F.lit("")) == ""))})
    back = e.groupBy(F.col("id").alias("partner")).agg(F.collect_set(F.coalesce("partner", F.lit(""))).alias("_p"), F.collect_set("watch").alias("_w"))
    twin = e.where(~aside & (F.col("disp") == DISPOSITIONS[2])).join(back, "partner", "left")
    linked = F.coalesce(F.array_contains("_p", F.col("id")) | F.array_contains("_w", F.col("id")), F.lit(False))
    d = deferred.select("doc", text("disposition").alias("disp"), text("source_binding.relative_path").alias("path"), text("source_binding.sha256").alias("sha"))
    late = rules(d, {"D1_disposition": outside(F.col("disp"), DISPOSITIONS[4:]), "D2_no_class": carried("identity_class"),
                     "D3_distinct": F.coalesce(text("distinctness_assertions"), F.lit("[]")).isin("[]", "", "{}")})
    now = sources.groupBy("path").agg(F.max("sha256").alias("_now"))
    bound = e.where(~aside).select("path", "sha", F.lit(True).alias("_must")).unionByName(d.where("path IS NOT NULL").select("path", "sha", F.lit(False).alias("_must")))
    drift = bound.join(now, "path", "left")
    broken = F.when(F.col("_now").isNull(), F.col("_must")).otherwise(~F.col("sha").eqNullSafe(F.col("_now")))
    return union_all([unique_keys("I1_unique", e, ["id"]), one, rule("I6_partner", twin, ~linked), rule("I8_bound_hash", drift, broken), late])


def manifest_drift(rows: DataFrame, position: str, order: list[str], unique: list[str], constants: dict[str, str], count: int,
                   paths: str | None = None, digest: str | None = None) -> DataFrame:
    """Drift of a manifest from what was frozen: (check_id, passed, bad).

    Number of entries; positions gapless from the first; canonical ``order`` of neighbours (an equi-join on the next position, no sort);
    unique columns (ids, seeds); columns equal to frozen ``constants``; relative paths; and with ``digest`` the ordered digest
    of (position, order, unique columns): sums of hashes that carry the position, so partitions combine in any way while two swapped rows show.
    """
    p = F.col(position)
    g = rows.agg(F.count("*").alias("n"), F.count_distinct(p).alias("np"), F.coalesce(F.max(p) - F.min(p) + 1, F.lit(0)).alias("span"),
                 *[(F.count("*") - F.count_distinct(c)).alias(f"u_{c}") for c in unique],
                 *[F.count_if(~F.col(c).cast("string").eqNullSafe(F.lit(v))).alias(f"k_{c}") for c, v in constants.items()],
                 *([F.count_if(F.coalesce(F.col(paths).startswith("/") | F.col(paths).contains(".."), F.lit(True))).alias("paths")] if paths else []),
                 *([order_digest(position, [*order, *unique]).alias("digest")] if digest else []))
    bad = {"entry_count": F.abs(F.col("n") - count), "gapless_positions": F.col("span") - F.col("np") + F.col("n") - F.col("np"),
           **{f"unique_{c}": F.col(f"u_{c}") for c in unique}, **{f"frozen_{c}": F.col(f"k_{c}") for c in constants},
           **({"relative_paths": F.col("paths")} if paths else {}), **({"ordered_digest": (F.col("digest") != digest).cast("long")} if digest else {})}
    out = F.array(*[F.struct(F.lit(n).alias("check_id"), (b == 0).alias("passed"), b.cast("long").alias("bad")) for n, b in bad.items()])
    one = g.select(F.explode(out).alias("x")).select("x.*")
    nxt = rows.select((p - 1).alias(position), F.struct(*[F.col(c) for c in order]).alias("_next"))
    pairs = rows.select(p, F.struct(*[F.col(c) for c in order]).alias("_here")).join(nxt, position)
    return one.unionByName(rule("canonical_order", pairs, F.col("_here") > F.col("_next")))


def order_digest(position: str, columns: list[str]) -> Column:
    """Aggregate digest of rows and their places."""
    return identity.set_digest(identity.row_text(F.col(position), *[F.col(c) for c in columns]))


def on_a_cycle(spark: SparkSession, links: DataFrame, node: str, to: str) -> DataFrame:
    """Nodes from which following ``to`` leads back to them, in a column ``node``; of a repeated node the least link counts.

    Each round drops the nodes that no link leads to and doubles the length of the links, so the number of rounds grows with
    the logarithm of the longest way into a cycle. It ends when nothing drops: every node is then reached by exactly one other.
    Every table is joined on ids that are unique on the side looked up, also where very many nodes name one partner.
    """
    known = links.where(F.col(node).isNotNull() & F.col(to).isNotNull())
    jump = io.materialize(spark, known.groupBy(F.col(node).alias("x")).agg(F.min(to).alias("y")), "cycle-links")
    while True:
        kept = io.materialize(spark, jump.join(jump.select(F.col("y").alias("x")).distinct(), "x", "left_semi"), "cycle-kept")
        if kept.count() == jump.count():
            return kept.select(F.col("x").alias(node))
        twice = kept.join(kept.select(F.col("x").alias("y"), F.col("y").alias("_z")), "y")
        jump = io.materialize(spark, twice.select("x", F.col("_z").alias("y")), "cycle-links")


# Fixed words and states of the cross-table rules.
PLACEHOLDER = "(TODO|TBD|FIXME|<[A-Z_]+>)"
OVER, UNDER = "高估", "低估"
NOT_BLIND, EXPLORATORY = "NOT_BLIND", "post_result_exploratory"


def cross_rules(spark: SparkSession, registry: DataFrame, used: DataFrame, candidates: DataFrame, order: DataFrame, gates: DataFrame,
                declarations: DataFrame, texts: DataFrame, bindings: DataFrame, current: DataFrame, closed: list[str], mapping: dict[str, str],
                freeze: bool = True) -> DataFrame:
    """Rules X1-X11 between the tables of an experiment: (check_id, passed, bad), bad = rows that break the rule.

    ``registry``: object_id, disposition, partner. ``used``: object_id of every parameter that a candidate uses.
    ``candidates``: id, terminal_state, run, constrains (model it restricts, or null), new_parameters (array), mirrors (its object in
    the registry, or null), partner. ``order``: id of the run sequence. ``gates``: terminal_state, distance, curvature, threshold,
    buffer, truncation_effect, flat_effect. ``declarations``: status, exposure. ``texts``: text. ``bindings``: path, recorded.
    ``current``: path, current. ``closed`` and ``mapping`` (candidate state to disposition) are configuration.
    ``freeze`` also refuses open settings (X7) and placeholders (X10). X4 has four parts: the partner of an equivalent object is
    known, following partners leads back, a candidate names the partner its object has, and its state maps to its object's disposition.
    Null states, null texts and candidates whose object is not registered break nothing; of a repeated object the least row counts.
    """
    def given(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    def outside(c: str, names: list[str]) -> Column:
        return given(c) & ~F.col(c).isin(*names)
    states = candidates.select("terminal_state").unionByName(gates.select("terminal_state"))
    one = registry.groupBy("object_id").agg(F.min(F.struct("disposition", "partner")).alias("_o")).select("object_id", "_o.*")
    twins = one.where(F.col("disposition") == DISPOSITIONS[2])
    ids = one.select(F.col("object_id").alias("partner"), F.lit(True).alias("_known")).where("partner IS NOT NULL")
    lost = twins.join(ids, "partner", "left")
    back = on_a_cycle(spark, one, "object_id", "partner")
    twin = candidates.join(one.select(F.col("object_id").alias("mirrors"), F.col("partner").alias("_partner"), F.col("disposition").alias("_disposition")), "mirrors")
    expect = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("terminal_state")] if mapping else F.lit(None).cast("string")
    far, open_ = F.col("distance"), F.col("distance").isNull()
    flat = ~F.coalesce(F.col("curvature"), F.lit(False)) & F.coalesce(far > F.col("threshold"), F.lit(False))
    narrow = F.coalesce(F.col("buffer") < far, F.lit(True))
    over, under = ({e: F.coalesce(F.contains(e, F.lit(w)), F.lit(False)) for e in ("truncation_effect", "flat_effect")} for w in (OVER, UNDER))
    opposite = (over["truncation_effect"] & under["flat_effect"]) | (under["truncation_effect"] & over["flat_effect"])
    now = current.groupBy("path").agg(F.max("current").alias("current"))
    bound = bindings.join(now, "path", "left")
    return union_all([
        same_ids("X1", registry, used, "object_id"), rule("X2", states, outside("terminal_state", closed)),
        rule("X3", registry, outside("disposition", DISPOSITIONS)), rule("X4_partner_known", lost, F.col("_known").isNull()),
        empty("X4_partner_returns", twins.join(back, "object_id", "left_anti")),
        rules(twin, {"X4_same_partner": ~F.col("partner").eqNullSafe(F.col("_partner")),
                     "X4_mapped_state": expect.isNull() | ~expect.eqNullSafe(F.col("_disposition"))}),
        rule("X5", candidates, F.col("constrains").isNotNull() & (F.coalesce(F.size("new_parameters"), F.lit(0)) > 0)),
        same_ids("X6", order, candidates.where("run"), "id"),
        rules(gates, {"X7": F.when(open_, F.lit(freeze)).otherwise(flat | narrow), "X8": ~opposite}),
        rule("X9", declarations, ~F.col("status").eqNullSafe(F.lit(NOT_BLIND)) | ~F.col("exposure").eqNullSafe(F.lit(EXPLORATORY))),
        rule("X10", texts, F.lit(freeze) & F.coalesce(F.col("text").rlike(PLACEHOLDER), F.lit(False))),
        rule("X11", bound, ~F.coalesce(F.col("current") == F.col("recorded"), F.lit(False)))])


def required_fields(check_id: str, tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """Required columns that a table lacks; a name found twice counts as lacking, since it cannot be read."""
    lacking = sum(tables[n].columns.count(c) != 1 for n, names in required.items() for c in names)
    return next(iter(tables.values())).limit(0).agg(F.lit(lacking).cast("long").alias("bad")).select(
        F.lit(check_id).alias("check_id"), (F.col("bad") == 0).alias("passed"), "bad")


def not_finite(rows: DataFrame) -> Column:
    """A row with a NaN or an infinity in any floating column; nulls are allowed."""
    bad = F.lit(False)
    for c, kind in rows.dtypes:
        if kind in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return bad


UNIT_TERMINALS = ["unsupported_calibration", "not_scored_no_supported_pixel"]  # fixed values


def validate_tables(units: DataFrame, scopes: DataFrame, curve: DataFrame, aggregate: DataFrame, keys: list[str], names: list[str],
                    verdict_of: dict[str, str], owner_of: dict[str, str], required: dict[str, list[str]] | None = None) -> DataFrame:
    """Rules between the tables of one experiment before they are published: (check_id, passed, bad).

    ``units`` (one row per key: gate, category, reason, core_total, core_land, core_scored, coverage), ``scopes`` (key and scope: n_scored,
    gate, verdict, reason, shape), ``curve`` (key, scope, q: accepted, coverage) and ``aggregate`` (any columns of key and scope, verdict, n:
    how many scopes have a verdict). The first of the closed list ``names`` is the scope that the others divide. ``verdict_of`` a curve
    shape and ``owner_of`` a reason are configuration. A stored ratio has to equal the quotient of the counts it stands for, and
    those counts come from the other table; an index has to run from 1 without a gap or a repeat in every group.
    Keys a table lacks are found from both sides. An empty set of tables breaks no rule. ``required`` names the columns of ``units``, ``scopes``, ``curve`` and ``aggregate`` and is
    checked alone when a column is lacking, since the other rules could not be read.
    """
    tables = {"units": units, "scopes": scopes, "curve": curve, "aggregate": aggregate}
    fields = required_fields("required_fields", tables, required or {})
    if any(tables[n].columns.count(c) != 1 for n, cs in (required or {}).items() for c in cs):
        return fields
    k, c = [*keys, "scope"], F.col

    def among(x: Column, table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]
    scored, plain = c("gate") == "scored", c("gate") == "not_scored"
    terminal = F.when(scored, (c("category") == "scored") & c("reason").isNull()).when(plain, c("category").isin(*UNIT_TERMINALS))
    unit_rules = rules(units, {
        "unit_finite": not_finite(units), "unit_terminal": ~F.coalesce(terminal, F.lit(False)),
        "unit_counts": ~F.coalesce((c("core_scored") >= 0) & (c("core_scored") <= c("core_land")) & (c("core_land") <= c("core_total")), F.lit(False)),
        "unit_ratio": ~c("coverage").eqNullSafe(ratio(c("core_scored"), c("core_land")))})
    settled = F.when(c("gate") == "evaluated", c("reason").isNull() & (among(c("shape"), verdict_of) == c("verdict"))).when(
        c("gate") == "not_evaluable", c("shape").isNull() & (among(c("reason"), owner_of) == c("verdict")))
    scope_rules = rules(scopes, {"scope_finite": not_finite(scopes), "scope_closed_set": ~F.coalesce(c("scope").isin(*names), F.lit(False)),
                                 "verdict_owner": ~F.coalesce(settled, F.lit(False))})
    per = scopes.groupBy(*keys).agg(F.sum(F.when(c("scope") == names[0], c("n_scored"))).alias("_whole"), F.sum(F.when(c("scope") != names[0], c("n_scored"))).alias("_parts"),
                                    F.count("*").alias("_scopes"), F.count_distinct("scope").alias("_distinct"))
    j = units.select(*keys, c("core_scored").alias("_scored"), (c("gate") == "scored").alias("_on"), F.lit(True).alias("_unit")).join(per, keys, "full_outer")
    sums = rules(j, {"scope_identities": c("_unit").isNull() | ~c("_scopes").eqNullSafe(F.lit(len(names))) | ~c("_distinct").eqNullSafe(F.lit(len(names))),
                     "scope_sum": ~c("_whole").eqNullSafe(c("_parts")), "unit_sum": c("_on") & ~c("_whole").eqNullSafe(c("_scored"))})
    based = curve.join(units.select(*keys, c("core_land").alias("_base")), keys, "left")
    quotient = c("accepted").isNotNull() & ~(F.coalesce(c("_base") > 0, F.lit(False)) & c("coverage").eqNullSafe(ratio(c("accepted"), c("_base"))))
    sequence = curve.groupBy(*k).agg(F.count("*").alias("n"), F.count_distinct("q").alias("nd"), F.min("q").alias("lo"), F.max("q").alias("hi"))
    drawn = sequence.join(scopes.select(*k, (c("gate") == "evaluated").alias("_drawn")), k, "full_outer")
    by = [x for x in aggregate.columns if x in k]
    told = aggregate.groupBy(*by, "verdict").agg(F.sum("n").alias("_told"))
    found = scopes.groupBy(*by, "verdict").agg(F.count("*").alias("_found"))
    return union_all([
        fields, unique_keys("unit_keys", units, keys), unique_keys("scope_keys", scopes, k), unique_keys("curve_keys", curve, [*k, "q"]), unit_rules, scope_rules, sums,
        rules(based, {"curve_finite": not_finite(curve), "curve_ratio": quotient}),
        rule("curve_sequence", sequence, (c("lo") != 1) | (c("hi") != c("n")) | (c("nd") != c("n"))),
        rule("curve_identities", drawn, c("_drawn").isNull() | (c("_drawn") & c("n").isNull())),
        rule("aggregate_counts", told.join(found, [*by, "verdict"], "full_outer"), ~c("_told").eqNullSafe(c("_found")))])
