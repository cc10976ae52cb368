"""Running sums, ranks and exact quantiles that survive a hot key.

A window partitioned by the unit alone puts a whole unit into one task. These
helpers cut each unit into value buckets first: windows run inside a bucket,
and the totals of the earlier buckets are added as an offset. The offset table
has one row per (unit, bucket), so only it is ordered per unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources import io


def running_sums(
    df: DataFrame, keys: list[str], order: list, bucket: Column, sums: dict[str, Column],
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` along ``order`` within ``keys``.

    ``bucket`` must grow with the order. ``totals`` adds sums over the whole
    key. Both branches read the same columns, so Spark reuses one exchange.
    """
    totals = totals or {}
    b = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    run = b.withColumns({name: F.sum(value).over(inside) for name, value in sums.items()})
    per_bucket = b.groupBy(*keys, "_bucket").agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()], *[F.sum(v).alias(f"_w_{n}") for n, v in totals.items()])
    offset = per_bucket.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_w_{n}").over(whole).alias(n) for n in totals])
    out = run.join(offset, [*keys, "_bucket"])
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop(
        "_bucket", *[f"_o_{n}" for n in sums])


def value_profile(
    df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], width: float,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact quantiles and sums per key from one pass over the rows.

    Gives ``rows`` (all), ``valid`` (value not null), ``total`` (sum of the
    value), one column per quantile (linear interpolation over valid rows) and
    the sums in ``extra``. Equal values are counted together before the
    shuffle, so ties cost one row; ``width`` is the bucket width in units of
    the value and should cut its expected range into some thousands of buckets.
    """
    extra = extra or {}
    v, n = F.col("_v"), F.col("_n")
    counted = (df.select(*keys, value.cast("double").alias("_v"), *[c.alias(x) for x, c in extra.items()])
               .groupBy(*keys, "_v").agg(F.count("*").alias("_n"), *[F.sum(x).alias(f"_x_{x}") for x in extra]))
    run = running_sums(
        counted, keys, [v.asc_nulls_last()], F.coalesce(F.floor(v / width), F.lit(2 ** 62)), {"_cum": n},
        {"_rows": n, "_valid": F.when(v.isNotNull(), n).otherwise(0), "_total": v * n,
         **{f"_e_{x}": F.col(f"_x_{x}") for x in extra}})

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - n <= rank) & (rank < F.col("_cum")), v))

    aggs = [F.max("_rows").alias("rows"), F.max("_valid").alias("valid"), F.max("_total").alias("total"),
            *[F.max(f"_e_{x}").alias(x) for x in extra]]
    for name, p in probs.items():
        pos = (F.col("_valid") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    out = run.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "rows", "valid", "total", *extra, *[
        (F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * F.col(f"_f_{x}")).alias(x) for x in probs])


def split_value(v: Column) -> tuple[Column, Column]:
    """A value as a multiple of 2^-30, whose sums are exact, and the rest; so equal values have equal totals in any order."""
    high = F.rint(v * 2.0**30) / 2.0**30
    return high, v - high


def sums_profile(df: DataFrame, keys: list[str], value: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """``two_pass_profile`` without quantiles: one pass, and a task keeps one row per key."""
    high, rest = split_value(value.cast("double"))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(value).alias("valid"), (F.sum(high) + F.sum(rest)).alias("total"),
                                 *[F.sum(c).alias(x) for x, c in (extra or {}).items()])


def two_pass_profile(
    df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], width: float,
    extra: dict[str, Column] | None = None, coarse: int = 16,
) -> DataFrame:
    """``value_profile`` for rows that are cheap to read twice and the same each time.

    The first pass only counts and sums per bucket of ``coarse`` widths, which tells the buckets that the
    quantiles lie in; the second opens those alone. So most values are neither kept by a task nor shuffled.
    Totals come from ``split_value``.
    """
    extra, spark = extra or {}, df.sparkSession
    b, n, k = F.col("_b"), F.col("_n"), [*keys, "_b"]
    rows = df.select(*keys, value.cast("double").alias("_v"), *[c.alias(f"_x_{x}") for x, c in extra.items()])
    rows = rows.withColumn("_b", F.floor(F.col("_v") / (coarse * width)))
    high, rest = split_value(F.col("_v"))
    hist = rows.groupBy(*k).agg(F.count("*").alias("_n"), F.sum(high).alias("_t"), F.sum(rest).alias("_l"), *[F.sum(f"_x_{x}").alias(f"_x_{x}") for x in extra])
    hist = io.materialize(spark, hist, "histogram")
    unit = hist.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(b.isNotNull(), n)), F.lit(0)).alias("valid"), (F.sum("_t") + F.sum("_l")).alias("total"),
                                   *[F.sum(f"_x_{x}").alias(x) for x in extra])
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))  # buckets of a key, not its rows
    pos = {x: (F.col("valid") - 1) * F.lit(float(p)) for x, p in probs.items()}
    ranks = [F.struct(F.lit(f"_{side}_{x}").alias("name"), f(v).alias("rank")) for x, v in pos.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    ask = hist.where(b.isNotNull()).select(*k, "_n", upto.alias("_to")).join(unit.select(*keys, "valid"), keys).withColumn("_w", F.explode(F.array(*ranks)))
    ask = ask.withColumn("_at", F.col("_w.rank") - F.col("_to") + n).where((F.col("_at") >= 0) & (F.col("_at") < n)).select(*k, F.col("_w.name").alias("name"), "_at")
    ask = io.materialize(spark, ask, "ranks")
    picked = rows.select(*k, "_v").join(ask.select(*k).distinct(), k).groupBy(*k, "_v").agg(F.count("*").alias("_n"))
    run = running_sums(picked, k, ["_v"], F.floor(F.col("_v") / width), {"_cum": n})
    hit = run.join(ask, k).where((F.col("_cum") - n <= F.col("_at")) & (F.col("_at") < F.col("_cum")))
    got = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == f"_{side}_{x}", F.col("_v"))).alias(f"_{side}_{x}") for x in probs for side in ("lo", "hi")])
    return unit.join(got, keys, "left").select(*keys, "rows", "valid", "total", *extra, *[
        (F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * (v - F.floor(v))).alias(x) for x, v in pos.items()])


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], width: float) -> DataFrame:
    """Quantile columns of ``value_profile``, one row per key that has a value."""
    return value_profile(df, keys, value, probs, width).where("valid > 0").select(*keys, *probs)


def average_ranks(df: DataFrame, value: str, width: float, out: str) -> DataFrame:
    """Average rank of each row by ``value`` over the whole table."""
    counted = df.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(1))
    run = running_sums(counted, ["_all"], [value], F.floor(F.col(value) / width), {"_cum": F.col("_n")})
    ranks = run.select(value, (F.col("_cum") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
