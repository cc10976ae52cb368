"""Merkle manifest of a dataset: one tree a source, a tree of their roots above, proofs by checkpoint and recompute.

Nodes are hashes of runs of three. Only every ``LEVELS``-th level is written; such a
node is made from the aligned subtree of up to 3^LEVELS nodes below it, so the unit of
work is a subtree, never a source. Proofs go from the top down: each subtree takes the
proof of its top from the level above, computes its inner nodes again from its stored
nodes, hands out their siblings, and forgets them.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import common

C = F.col
LEVELS = 5
SPAN = 3**LEVELS
PATH = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def field(c: Column) -> Column:
    """`-` for null, else length in bytes, `:`, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def level_up(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i:i + 3]).encode()).hexdigest() for i in range(0, len(nodes), 3)]


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (g, hash, ...) with pos, from 0 within g by ``order`` (nulls first), and m, the size of g.

    Rows are dealt by ranges of (g, order), so a large group lies in many partitions; a row's place is its place in
    the partition plus the sizes of the earlier partitions of its group. Equal rows are spread too.
    """
    salted = nodes.withColumn("_t", F.monotonically_increasing_id())
    keys = ["g", *order, "_t"]
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_t").withColumn("_u", F.monotonically_increasing_id())
    dealt = common.written(dealt, "merkle-order")
    part = F.shiftright("_u", 33).alias("_p")
    sizes = dealt.groupBy("g", part).agg(F.min("_u").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("g").orderBy("_p")  # as many rows a group as there are partitions at most
    starts = sizes.select(C("g").alias("_g"), C("_p").alias("_q"), "_first", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                          F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    here = dealt.withColumn("_p", part)
    out = here.join(starts, C("g").eqNullSafe(C("_g")) & (C("_p") == C("_q")))
    return out.withColumn("pos", C("_start") + C("_u") - C("_first")).drop("_u", "_p", "_q", "_g", "_first", "_start")


def blocks(nodes: DataFrame, keep: list[str] = []) -> DataFrame:
    """One row an aligned subtree: g, b, m, and its stored nodes in order as ``x`` (pos, hash and ``keep``)."""
    packed = F.struct("pos", "hash", *keep)
    return nodes.groupBy("g", F.floor(C("pos") / SPAN).cast("long").alias("b")).agg(F.max("m").alias("m"), F.sort_array(F.collect_list(packed)).alias("x"))


@F.pandas_udf(T.StringType())
def subtree_top(hashes: pd.Series, whole: pd.Series) -> pd.Series:
    """Top of each aligned subtree: up to one node where it is the whole tree, else exactly ``LEVELS`` levels up."""
    out = []
    for h, w in zip(hashes, whole, strict=True):
        h, k = list(h), 0
        while len(h) > 1 if w else k < LEVELS:
            h, k = level_up(h), k + 1
        out.append(h[0])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(PATH))
def inner_proofs(hashes: pd.Series, whole: pd.Series) -> pd.Series:
    """For every stored node of a subtree its siblings, level by level, up to the subtree's top. The inner nodes live here only."""
    out = []
    for h, w in zip(hashes, whole, strict=True):
        levels = [list(h)]
        while len(levels[-1]) > 1 if w else len(levels) <= LEVELS:
            levels.append(level_up(levels[-1]))
        paths = []
        for i in range(len(h)):
            path = []
            for nodes in levels[:-1]:
                at = i % 3
                run = nodes[i - at:i - at + 3]
                path.append({"before": "".join(run[:at]), "after": "".join(run[at + 1:])})
                i //= 3
            paths.append(path)
        out.append(paths)
    return pd.Series(out, dtype=object)


def hashes_of(x: Column) -> Column:
    return F.transform(x, lambda e: e["hash"])


def forest(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels (g, pos, m, hash) of the trees of all groups, the leaves' first, and the tops (g, hash)."""
    levels, tops = [leaves], None
    while True:
        low = blocks(levels[-1].select("g", "pos", "m", "hash"))
        up = common.written(low.select("g", C("b").alias("pos"), F.ceil(C("m") / SPAN).cast("long").alias("m"), subtree_top(hashes_of(C("x")), C("m") <= SPAN).alias("hash")), name)
        done = up.where("m = 1").select("g", "hash")
        tops = done if tops is None else tops.union(done)
        rest = up.where("m > 1")
        if not rest.limit(1).count():
            return levels, tops
        levels.append(rest)


def proofs(levels: list[DataFrame], tops: DataFrame, keep: list[str], name: str) -> DataFrame:
    """(g, pos, path, top, ``keep``) of every leaf. ``tops``: g, path and top of each tree's top, to which its own proof leads on."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        b = blocks(levels[k], keep if k == 0 else []).withColumn("whole", C("m") <= SPAN)
        roots = tops.select("g", F.lit(0).cast("long").alias("pos"), F.lit(True).alias("whole"), "path", "top")
        lead = roots if above is None else roots.union(above.select("g", "pos", F.lit(False), "path", "top"))
        lead = lead.select(C("g").alias("_g"), C("pos").alias("_b"), C("whole").alias("_whole"), C("path").alias("_path"), "top")
        b = b.join(lead, C("g").eqNullSafe(C("_g")) & (C("b") == C("_b")) & (C("whole") == C("_whole")))
        own = b.select("g", "_path", "top", F.explode(F.arrays_zip(C("x"), inner_proofs(hashes_of(C("x")), C("whole")).alias("p"))).alias("e"))
        above = own.select("g", C("e.x.pos").alias("pos"), F.concat(C("e.p"), C("_path")).alias("path"), "top", *[C(f"e.x.{c}").alias(c) for c in (["hash", *keep] if k == 0 else [])])
        if k:
            above = common.written(above, name)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def manifest(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """Every leaf with pos, path (siblings up to the root), subroot and root.

    ``leaves``: g (the source, string), id, hash and the columns ``keep``. Leaves of a source ascend by (id, hash), nulls
    first; equal leaves are told apart by their place only. A null source is a source of its own. An empty table has no root and gives no rows.
    """
    base = common.written(placed(common.written(leaves.select("g", "id", "hash", *keep), "merkle-leaves"), ["id", "hash"]), "merkle-leaves")
    levels, subroots = forest(base, "merkle-nodes")
    named = common.written(placed(subroots.select(F.lit(0).alias("g"), C("g").alias("source"), "hash"), ["source"]), "merkle-roots")
    top_levels, top = forest(named, "merkle-tops")
    root = top.first()
    end = F.lit(root["hash"] if root else None).cast("string")
    start = top.select("g", F.array().cast(PATH).alias("path"), F.lit("").alias("top"))
    over = proofs(top_levels, start, ["source"], "merkle-over")
    over = over.select(C("source").alias("g"), "path", C("hash").alias("top"))
    out = proofs(levels, over, ["id", *keep], "merkle-paths")
    return out.withColumnRenamed("top", "subroot").withColumn("root", end)


def op13_merkle(docs: DataFrame) -> DataFrame:
    """A null doc_id has no decimal digits, so its row is not tampered with."""
    parts = lambda text: leaf_hash(C("doc_id"), C("source"), C("lang"), C("n_chars"), text)
    odd = F.coalesce(F.crc32(C("doc_id").cast("string").cast("binary")) % 2 != 0, F.lit(True))
    changed = ~odd & C("text").contains("\n")
    src = docs.select(C("source").cast("string").alias("g"), C("doc_id").alias("id"), parts(C("text")).alias("hash"),
                      F.when(changed, parts(F.replace(C("text"), F.lit("\n"), F.lit("")))).alias("tampered"))
    out = manifest(src, ["tampered"])
    fold = folded(F.coalesce("tampered", "hash"), C("path"))
    done = out.select(C("id").alias("doc_id"), C("hash").alias("leaf"), "subroot", "root", proof_digest(C("path")).alias("proof_sha256"), fold.alias("folded_root"))
    return done.withColumn("verified", C("folded_root") == C("root"))
