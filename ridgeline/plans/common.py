"""Shared shortcuts of the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import r6

C = F.col


def rounded(**cols) -> list[Column]:
    """Named six-digit columns; a value may be a column name or a Column."""
    return [r6(C(v) if isinstance(v, str) else v).alias(k) for k, v in cols.items()]


def r6c(*names: str) -> list[Column]:
    return [r6(C(n)).alias(n) for n in names]


def long(x) -> Column:
    return (C(x) if isinstance(x, str) else x).cast("long")


def text_list(x: Column) -> Column:
    return F.array_join(x, ",")


def cells_of(df: DataFrame, *cols) -> DataFrame:
    return df.select("a", "r", "c", *cols)
