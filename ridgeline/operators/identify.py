"""Identifiability of a model from its Jacobian: rank, spectrum, null direction, sensitivity.

A model is a set of callables from parameter values to Columns, so a Jacobian
is a table of rows. Rank needs singular values down to 1e-10 of the largest,
which a Gram matrix cannot resolve; rows are therefore reduced by QR inside
each task (a few numbers per group), and only those triangles are combined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RTOL = 1e-10


@dataclass(frozen=True)
class Model:
    """Parameter names, Jacobian columns at a point, optional prediction, known conditions."""

    params: list[str]
    jacobian: Callable[[list[float]], list[Column]]
    predict: Callable[[list[float]], Column] | None = None
    conditions: list[str] = field(default_factory=list)


def jacobian_rows(df: DataFrame, model: Model, starts: list[list[float]]) -> DataFrame:
    """One row per observation and start, with the Jacobian in ``j0..jn``."""
    rows = F.array(*[F.struct(F.lit(i).alias("start"), *[c.cast("double").alias(f"j{n}") for n, c in enumerate(model.jacobian(t))])
                     for i, t in enumerate(starts)])
    return df.withColumn("_j", F.explode(rows)).select("*", "_j.*").drop("_j")


def triangles(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per task and group the R factor of its rows, plus the row count; a group may span all tasks."""
    n = len(cols)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys]
                       + ["_rows long", "_r array<double>"])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False):
                block = g[cols].to_numpy(dtype="float64")
                count, r = held.get(key, (0, np.empty((0, n))))
                held[key] = (count + len(block), np.linalg.qr(np.vstack([r, block]), mode="r"))
        out = [(*key, count, r.ravel().tolist()) for key, (count, r) in held.items()]
        yield pd.DataFrame(out, columns=[*keys, "_rows", "_r"])

    return df.select(*keys, *cols).mapInPandas(reduce, schema)


def spectrum(df: DataFrame, keys: list[str], cols: list[str], rtol: float = RTOL) -> DataFrame:
    """Rank, condition number, singular values and null direction per key."""
    n = len(cols)
    tri = triangles(df, keys, cols)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tri.schema.fields if f.name in keys)
    schema = f"{key_schema}, rows long, status string, rank int, condition double, singular array<double>, null_direction array<double>"

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = int(pdf["_rows"].sum())
        m = np.vstack([np.asarray(r, dtype="float64").reshape(-1, n) for r in pdf["_r"]])
        head = [pdf[k].iloc[0] for k in keys]
        if rows < n:
            return pd.DataFrame([(*head, rows, "insufficient_data", None, None, None, None)], columns=columns)
        sv = np.zeros(n)
        _, found, vt = np.linalg.svd(np.vstack([m, np.zeros((max(n - len(m), 0), n))]), full_matrices=False)
        sv[:len(found)] = found
        rank = int((sv > max(rows, n) * sv[0] * rtol).sum()) if sv[0] > 0 else 0
        if n == 1:
            return pd.DataFrame([(*head, rows, "not_applicable", rank, 1.0, sv.tolist(), None)], columns=columns)
        null = None
        if sv[-1] <= sv[0] * rtol:
            size = np.abs(vt[-1])
            null = vt[-1] * np.sign(vt[-1][np.flatnonzero(size >= size.max() - 1e-9)[0]])  # the first of equal components is positive
        cond = float(sv[0] / sv[-1]) if sv[-1] > 0 else None
        return pd.DataFrame([(*head, rows, "ok", rank, cond, sv.tolist(), None if null is None else null.tolist())], columns=columns)

    columns = [*keys, "rows", "status", "rank", "condition", "singular", "null_direction"]
    return tri.groupBy(*keys).applyInPandas(combine, schema)


def sensitivity(df: DataFrame, keys: list[str], cols: list[str], params: list[str], eps: float = 1e-4) -> DataFrame:
    """Column norm per parameter, dead parameters, and the change of a linear prediction for one step."""
    norm = [F.sqrt(F.sum(F.col(c) * F.col(c))).alias(p) for c, p in zip(cols, params)]
    g = df.groupBy(*keys).agg(*norm)
    rows = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("norm"), (F.col(p) == 0).alias("dead"), (F.col(p) * eps).alias("step_change")) for p in params])
    return g.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def null_step(df: DataFrame, spec: DataFrame, keys: list[str], cols: list[str], eps: float = 1e-4) -> DataFrame:
    """Prediction change along the null direction of each key (one small row per key joins the data)."""
    d = spec.where(F.col("null_direction").isNotNull()).select(*keys, "null_direction")
    move = sum((F.col(c) * F.col("null_direction")[i] for i, c in enumerate(cols)), F.lit(0.0))
    return df.join(d, keys).groupBy(*keys).agg((F.sqrt(F.sum(move * move)) * eps).alias("null_change"))


def multistart(spec: DataFrame) -> DataFrame:
    """Do rank and null direction agree over the starts? (starts are few)"""
    d = F.transform("null_direction", lambda v: F.round(F.abs(v), 6))
    return spec.agg(F.count("*").alias("starts"), (F.min("rank") == F.max("rank")).alias("rank_consistent"),
                    F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"), (F.count_distinct(d) <= 1).alias("null_direction_stable"))


def equivalence(spec: DataFrame, keys: list[str], params: list[str], tol: float = 1e-8) -> DataFrame:
    """Parameters bound together by the null direction, and the degrees of freedom in use."""
    names = F.array(*[F.lit(p) for p in params])
    bound = F.filter(F.zip_with(names, "null_direction", lambda p, v: F.when(F.abs(v) > tol, p)), lambda p: p.isNotNull())
    return spec.select(*keys, F.lit(len(params)).alias("declared"), F.col("rank").alias("effective_dof"),
                       (F.lit(len(params)) - F.col("rank")).alias("deficiency"), F.array_join(bound, "+").alias("bound_group"))
