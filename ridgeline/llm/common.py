"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import io

#: Fixed pattern of the contracts: runs of anything but blank, tab, line breaks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python at most ``rows`` texts at a time: long texts would make the usual batches of 10,000 too large for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: ends lineage, survives lost executors."""
    return io.materialize(df.sparkSession, df, name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive expression to a lambda variable, so that nested lambdas do not compute it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits that depend on the id and the text only, evenly spread whatever the ids look like."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5(text), F.lit("-"))))
