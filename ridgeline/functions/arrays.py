"""Array, map and struct expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def failed_names(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold (null counts as failed)."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()
    ]))


def growing_distances(limit: float, res: float) -> list[float]:
    """Search distances: step res up to 1 km, 2 res up to 5 km, then 4 res."""
    near = int(1000 // res) + 1
    near_end = near * res
    middle = int((5000 - near_end) // (2 * res)) + 1
    middle_end = near_end + middle * 2 * res
    far = max(int((limit - middle_end) // (4 * res)), 0)
    steps = [i * res for i in range(1, near + 1)]
    steps += [near_end + i * 2 * res for i in range(1, middle + 1)]
    steps += [middle_end + i * 4 * res for i in range(1, far + 1)]
    return [s for s in steps if s <= limit]


def azimuths(n: int) -> Column:
    """n equal azimuth steps in radians."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * (2 * 3.141592653589793 / n))


def bin_edges(low: float, high: float, bins: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: i * ((high - low) / bins) + low)


def grid_targets(n: int = 20) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k / n)


def argmin_struct(objective: Column, **fields: Column) -> Column:
    return F.struct(objective.alias("objective"), *[v.alias(k) for k, v in fields.items()])
