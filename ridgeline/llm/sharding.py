"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row numbers follow the order of a content key (id and text), so they depend on
neither file layout nor partitioning. A Feistel network over ``a x b`` cells,
the smallest near-square that holds all rows, permutes them; a number that
leaves ``[0, n)`` walks on until it is back. Shard and slot are the remainder
and the quotient of the permuted number, so shard sizes differ by one at most
and slots have no gaps (law ``rows``).
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

PRIME = 2**31 - 1
ROUNDS = 6


def constants(seed: int) -> list[tuple[int, int, int]]:
    draw = random.Random(seed)
    return [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square with at least n cells; fewer than sqrt(n) + 1 cells stay unused."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """Permute a long within ``[0, a * b)``. The rounds fold over an array of constants, so the expression stays small."""
    a, b = sides(n)
    keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("left"), *[F.lit(v).cast("long").alias(k) for k, v in zip("mcd", key, strict=True)])
                     for i, key in enumerate(constants(seed))])

    def mixed(v: Column, k: Column) -> Column:
        y = (v * k["m"] + k["c"]) % PRIME
        return (y * y + k["d"]) % PRIME

    def step(s: Column, k: Column) -> Column:
        return F.struct(F.when(k["left"], (s["l"] + mixed(s["r"], k)) % a).otherwise(s["l"]).alias("l"),
                        F.when(k["left"], s["r"]).otherwise((s["r"] + mixed(s["l"], k)) % b).alias("r"))

    r = F.call_function("div", x, F.lit(a).cast("long"))
    return F.aggregate(keys, F.struct((x % a).alias("l"), r.alias("r")), step, lambda s: s["r"] * a + s["l"])


def walk_depth(spark: SparkSession, n: int, seed: int) -> int:
    """Longest walk outside ``[0, n)``, measured on all cells outside (fewer than sqrt(n) + 1), so the unrolled walk is exact.

    The cells still outside after a step are among those before it. Once their number stays, what
    is left runs in closed cycles, which no walk from inside enters.
    """
    a, b = sides(n)
    out, depth, left = spark.range(n, a * b).withColumnRenamed("id", "x"), 0, a * b - n
    while left:
        out = out.select(feistel(F.col("x"), n, seed).alias("x")).where(F.col("x") >= n)
        before, left = left, out.count()
        if left == before:
            break
        depth += 1
    return depth


def permute(spark: SparkSession, x: Column, n: int, seed: int) -> Column:
    """Image of row number ``x`` of ``[0, n)`` in ``[0, n)``."""
    out, depth = feistel(x, n, seed), walk_depth(spark, n, seed)
    if not depth:
        return out
    steps = F.array(*[F.lit(i) for i in range(depth)])
    return F.aggregate(steps, out, lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, seed)))


REPEATS = 10_000


def expanded(rows: DataFrame, first: Column, repeats: int = REPEATS) -> DataFrame:
    """Each of ``rows`` (_row, _n) as often as ``_n`` says, with row numbers ``_x`` from ``first`` on.

    No array holds more than ``repeats`` numbers: a row with more copies is dealt in blocks over all tasks, then expanded.
    """
    few = rows.where(F.col("_n") <= repeats).select("_row", first.alias("_x"), "_n")
    many = rows.where(F.col("_n") > repeats).select("_row", first.alias("_x"), "_n", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {repeats}"))).alias("_at"))
    start = F.col("_at") * repeats
    many = many.select("_row", (F.col("_x") + start).alias("_x"), F.least(F.col("_n") - start, F.lit(repeats)).alias("_n")).repartition("_x")
    return few.union(many).select("_row", F.explode(F.sequence(F.col("_x"), F.col("_x") + F.col("_n") - 1)).alias("_x"))


def shuffle_shards(rows: DataFrame, key: Column, n_shards: int = 40, seed: int = 1, bucket_rows: int = 50_000) -> DataFrame:
    """All columns of ``rows`` plus ``shard`` int and ``slot`` long; columns of these names are replaced.

    ``key`` is a 32-digit hex column of ``rows``. Rows are numbered within
    prefixes of the key, a prefix holding about ``bucket_rows`` rows whatever
    the size, and prefix totals give the offsets. Equal rows are
    interchangeable: they travel as one row with a count and are expanded at the
    end, so a row repeated a billion times loads no task before that. Rows with one key
    and different content follow a hash of all columns. Any column may be null;
    an empty table gives an empty result.
    """
    spark = rows.sparkSession
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    packed = rows.select(key.alias("_k"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    fine = common.written(packed.groupBy(F.substring("_k", 1, 5).alias("_b")).agg(F.count("*").alias("_c")), "shard-sizes")
    n = fine.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    digits = 1
    while 16**digits * bucket_rows < n:
        digits += 1
    if digits > 5:
        fine = packed.groupBy(F.substring("_k", 1, digits).alias("_b")).agg(F.count("*").alias("_c"))
    sizes = fine.groupBy(F.substring("_b", 1, digits).alias("_b")).agg(F.sum("_c").alias("_c"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = common.written(sizes.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o")), "shard-offsets")
    groups = packed.groupBy("_k", F.xxhash64("_row").alias("_t")).agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
    groups = groups.withColumn("_b", F.substring("_k", 1, digits))
    earlier = W.partitionBy("_b").orderBy("_k", "_t").rowsBetween(W.unboundedPreceding, -1)
    starts = groups.withColumn("_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(offsets, "_b")
    first = F.col("_s") + F.col("_o")
    numbered = expanded(starts, first)
    out = numbered.withColumn("_x", permute(spark, F.col("_x"), n, seed)) if n else numbered
    return out.select(*[F.col("_row").getField(c).alias(c) for c in cols],
                      (F.col("_x") % n_shards).cast("int").alias("shard"), F.expr(f"_x div {n_shards}").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 1) -> DataFrame:
    """Documents with all their columns, ``shard`` and ``slot``. Null ids and texts have keys of their own."""
    return shuffle_shards(docs, common.content_key(F.col("doc_id"), F.col("text")), n_shards, seed)


def op8_sharding(docs: DataFrame, n_shards: int = 40, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. Null text: 16 bytes, crc of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       common.content_key(F.col("doc_id"), F.col("text")).alias("k"))
    out = shuffle_shards(common.written(thin, "shard-rows"), F.col("k"), n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
