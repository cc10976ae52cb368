"""Content identity of rows and of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_text(*cols: Column) -> Column:
    """Canonical text of a row: columns joined by '|', null as '~'."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])


def row_sha256(*cols: Column) -> Column:
    return F.sha2(row_text(*cols), 256)


def _lane(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("decimal(38,0)")


def set_digest(text: Column) -> Column:
    """Aggregate digest of a set of rows, whatever its size and order.

    Every row adds two 60-bit lanes of its md5, so partial sums combine on the
    map side and no group is ever held in one place; the row text must carry
    its own position (for example row and column) when order matters.
    """
    return F.sha2(
        F.concat_ws(
            ":", F.count(text).cast("string"),
            F.coalesce(F.sum(_lane(text, 1)), F.lit(0).cast("decimal(38,0)")).cast("string"),
            F.coalesce(F.sum(_lane(text, 16)), F.lit(0).cast("decimal(38,0)")).cast("string"),
        ), 256)


def ordered_digest(ids: Column) -> Column:
    """Digest of a sorted id list; only for dimension-sized lists (acquisitions, domains)."""
    return F.sha2(F.to_json(F.sort_array(F.collect_list(ids))), 256)


def same_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b, equal?"""
    only_a = a.exceptAll(b).agg(F.count("*").alias("only_first"))
    only_b = b.exceptAll(a).agg(F.count("*").alias("only_second"))
    return only_a.crossJoin(only_b).withColumn(
        "identical", (F.col("only_first") == 0) & (F.col("only_second") == 0))
