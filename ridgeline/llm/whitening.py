"""Whitening of embeddings: exact sums and a centred covariance from the cluster, its leading eigenvectors here, projection by broadcast.

Entries become integers, so sums are exact and centring happens before anything is
multiplied. Every partition adds up its own outer products; only sums of one row and
column meet in a shuffle. The matrix that reaches the driver has the size of the dimension
squared (``most_dimensions`` is checked), whatever the number of vectors. There:
Householder reflections to tridiagonal form, eigenvalues by bisection on Sturm counts,
eigenvectors by inverse iteration, orthogonalised again within clusters, reflected back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

C = F.col
EPS = np.finfo(float).eps


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors of the tridiagonal form of a symmetric matrix."""
    a, n, reflectors = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        v = x / size if size > 0 else x
        b = a[k + 1:, k + 1:]
        p = b @ v
        w = p - (v @ p) * v
        b -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm count: eigenvalues of the tridiagonal matrix less than each x."""
    below = np.zeros(len(x), dtype=int)
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a vanishing pivot counts as negative here and in the next step
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, each bisected until its interval has no inner point."""
    n = len(d)
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    span = max(np.max(np.abs(d) + reach), np.finfo(float).tiny)
    tiny = EPS * EPS * span
    low, high = np.full(k, np.min(d - reach) - EPS * span * n), np.full(k, np.max(d + reach) + EPS * span * n)
    index = n - 1 - np.arange(k)
    while True:
        mid = low + (high - low) / 2
        open_ = (mid > low) & (mid < high) & (high - low > EPS / 4 * span * 1e-3)
        if not open_.any():
            return mid
        above = count_below(d, e, mid, tiny) <= index
        low, high = np.where(open_ & above, mid, low), np.where(open_ & ~above, mid, high)


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; vanishing pivots become tiny."""
    n = len(d)
    u0, u1, u2, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low = e[i]
        if abs(u0[i]) >= abs(low):
            m = low / (u0[i] if abs(u0[i]) > tiny else tiny)
            u0[i + 1] -= m * u1[i]
            x[i + 1] -= m * x[i]
        else:
            m = u0[i] / low
            u0[i], u1[i], u0[i + 1], u2[i] = low, u0[i + 1], u1[i] - m * u0[i + 1], u1[i + 1]
            u1[i + 1] = -m * u1[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
    for i in range(n - 1, -1, -1):
        x[i] -= (u1[i] * x[i + 1] if i + 1 < n else 0) + (u2[i] * x[i + 2] if i + 2 < n else 0)
        x[i] /= u0[i] if abs(u0[i]) > tiny else tiny
        if abs(x[i]) > 1e200:
            x *= 1e-200
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns. Values closer than a thousandth of the norm form a cluster, orthogonalised at each step."""
    n, draw = len(d), np.random.default_rng(3)
    span = max(np.abs(d).max(), np.abs(e).max() if len(e) else 0, np.finfo(float).tiny)
    out, first, shift = np.empty((n, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * span:
            first = j
        shift = min(value, shift - 4 * EPS * span) if j > first else value  # no two solves with one matrix
        x = draw.standard_normal(n)
        for _ in range(5):
            x = solve_shifted(d, e, shift, x / np.linalg.norm(x), EPS * span)
            for _ in range(2):
                for q in range(first, j):
                    x -= (out[:, q] @ x) * out[:, q]
                x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k greatest eigenvalues of a covariance and their unit vectors as rows; the largest entry of a vector is positive.

    Directions without spread (eigenvalue below 1e-12 of the greatest) can't be scaled to one and are left out.
    """
    scale = np.abs(v).max(initial=0.0)
    if not scale > 0:
        return np.empty(0), np.empty((0, len(v)))
    d, e, reflectors = householder(v / scale)
    values = leading_values(d, e, min(k, len(v)))
    values = values[values > 1e-12 * values[0]]
    x = leading_vectors(d, e, values)
    for at in range(len(reflectors) - 1, -1, -1):
        r = reflectors[at]
        x[at + 1:] -= 2 * np.outer(r, r @ x[at + 1:])
    x *= np.sign(x[np.abs(x).argmax(axis=0), range(x.shape[1])])
    return values * scale, x.T.copy()


@dataclass(frozen=True)
class Whitening:
    """What was fitted: number of vectors, exact sums, eigenvalues (falling), components as rows, total variance."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with all columns and ``_x``, the integer entries floor(64 c) + 1000000.

    Left out: null and empty vectors, null, NaN or infinite entries, entries over 2^46 in size (no exact
    integer arithmetic), and vectors of another length than most have (the longer one of ties).
    """
    c = C(f"`{vector}`").cast("array<double>")
    fine = vectors.where(C(f"`{vector}`").isNotNull() & (F.size(c) > 0)).where(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= 2.0**46)))
    length = fine.groupBy(F.size(c).alias("_d")).count().agg(F.max(F.struct("count", "_d"))["_d"]).first()[0]
    if length is None:
        return vectors.select("*", F.array().cast("array<long>").alias("_x")).limit(0)
    return fine.where(F.size(c) == length).select("*", F.transform(c, lambda e: F.floor(e * 64) + 1_000_000).alias("_x"))


def totals(table: DataFrame, column: str, kind: str) -> tuple[int, list]:
    """Number of rows and sum of every entry of an array column, added up within partitions first."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = 0, None
        for b in batches:
            if len(b):
                x = np.stack(b[column].to_numpy()).sum(axis=0)
                n, s = n + len(b), x if s is None else s + x
        if n:
            yield pd.DataFrame({"i": np.arange(len(s)), "n": n, "s": s})
    own = table.select(column).mapInPandas(add, f"i int, n long, s {kind}")
    rows = own.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # one row a dimension
    return (rows[0].n, [r.s for r in rows]) if rows else (0, [])


def centred_products(table: DataFrame, column: str, n: int, sums: list) -> np.ndarray:
    """Covariance (divisor n), centred before multiplying: a whole part of the mean is taken off exactly, the rest as a double."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    base, dims = np.array(whole), len(sums)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = None
        for b in batches:
            if len(b):
                y = (np.stack(b[column].to_numpy()) - base) - rest
                v = y.T @ y if v is None else v + y.T @ y
        if v is not None:
            i, j = np.triu_indices(dims)
            for at in range(0, len(i), 10_000):
                part = slice(at, at + 10_000)
                yield pd.DataFrame({"i": i[part], "j": j[part], "v": v[i[part], j[part]]})
    cells = table.select(column).mapInPandas(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((dims, dims))
    for r in cells.toLocalIterator():  # the upper half of a matrix of the dimension
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def fit(rows: DataFrame, components: int = 32, most_dimensions: int = 4096) -> Whitening:
    """Fit on all of ``rows`` (column ``_x`` of ``usable``). More dimensions than ``most_dimensions`` are refused."""
    n, sums = totals(rows, "_x", "long")
    if len(sums) > most_dimensions:
        raise ValueError(f"{len(sums)} dimensions; the covariance of over {most_dimensions} does not fit the driver")
    v = centred_products(rows, "_x", n, sums) if n else np.zeros((0, 0))
    values, axes = leading_components(v, components)
    return Whitening(n, sums, values, axes, float(np.trace(v)))


def project(rows: DataFrame, w: Whitening) -> DataFrame:
    """``rows`` without ``_x`` but with deviation (squared distance from the mean times n^2, exact; null beyond a long) and whitened (array).

    Components and mean go to every task: 8 bytes times (components + 2) times dimensions, bounded by ``fit``.
    """
    spark = rows.sparkSession
    base = np.array([s // w.n for s in w.sums])
    left = np.array([s - b * w.n for s, b in zip(w.sums, base.tolist(), strict=True)])
    shared = spark.sparkContext.broadcast((base, left, w.n, w.components / np.sqrt(w.values)[:, None]))

    @F.pandas_udf("deviation long, whitened array<double>")
    def apply(x: pd.Series) -> pd.DataFrame:
        base, left, n, axes = shared.value
        y = np.stack(x.to_numpy()) - base
        reach = n * (int(np.abs(y).max()) + 1)
        z = (y if reach * reach * len(base) < 2**63 else y.astype(object)) * n - left
        squares = (z * z).sum(axis=1)
        white = (y - left / n) @ axes.T
        fits = [int(s) if s < 2**63 else None for s in squares.tolist()]
        return pd.DataFrame({"deviation": pd.Series(fits, dtype="Int64"), "whitened": list(white)})
    own = [c for c in rows.columns if c not in ("_x", "deviation", "whitened")]
    got = rows.select(*[C(f"`{c}`") for c in own], apply("_x").alias("_w"))
    return got.select(*[C(f"`{c}`") for c in own], C("_w.deviation").alias("deviation"), C("_w.whitened").alias("whitened"))


def identity_error(table: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from a pass over these rows."""
    n, sums = totals(table, "whitened", "double")
    return float(np.abs(centred_products(table, "whitened", n, sums) - np.eye(len(sums))).max()) if n else 0.0


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 32) -> tuple[DataFrame, Whitening]:
    """Usable rows of ``vectors`` with deviation and whitened, written to the shared folder, and the fit.

    Repeated rows count and stay; equal vectors give equal results; an empty table, or one without any spread, gives no rows.
    """
    common.bound_batches(vectors.sparkSession, 4000)
    rows = common.written(usable(vectors, vector), "whiten-rows")
    w = fit(rows, components)
    if not len(w.values):
        return rows.drop("_x").select("*", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0), w
    return common.written(project(rows, w), "whitened"), w


def op12_whitening(vectors: DataFrame) -> DataFrame:
    table, w = whiten(vectors.select("vec_id", "embedding"))
    error = identity_error(table)
    explained = F.array(*[F.lit(float(v / w.trace)) for v in w.values]).cast("array<double>")
    each = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (C("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, C("at")).alias("explained"), F.lit(error).alias("identity_error"))
