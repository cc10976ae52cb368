"""Axis-aligned geometry on the grid and on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MEAN_RADIUS_KM = 6371.0088


def _max(*xs) -> Column:
    return F.greatest(*[x if isinstance(x, Column) else F.lit(x) for x in xs])


def cell_centre(r: Column, c: Column, left, top, res) -> tuple[Column, Column]:
    return (c + 0.5) * res + left, F.lit(top) - (r + 0.5) * res


def affine_point(t: list[float], col: Column, row: Column) -> tuple[Column, Column]:
    """x, y of (col, row) under the affine (a, b, c, d, e, f)."""
    a, b, c, d, e, f = t
    return col * a + row * b + c, col * d + row * e + f


def affine_bounds(t: list[float], c0: Column, r0: Column, c1: Column, r1: Column) -> dict[str, Column]:
    corners = [affine_point(t, col, row) for col in (c0, c1) for row in (r0, r1)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return {"left": F.least(*xs), "right": F.greatest(*xs), "bottom": F.least(*ys), "top": F.greatest(*ys)}


def rect_distance(x, y, left, bottom, right, top) -> Column:
    """Distance from a point to a box, 0 inside."""
    return F.hypot(_max(left - x, x - right, 0.0), _max(bottom - y, y - top, 0.0))


def rect_gap(a: list[Column], b: list[Column]) -> Column:
    """Smallest distance of two boxes (left, bottom, right, top); 0 when they touch."""
    return F.hypot(_max(a[0] - b[2], b[0] - a[2], 0.0), _max(a[1] - b[3], b[1] - a[3], 0.0))


def half_open_overlap(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two half-open boxes (lo1, lo2, hi1, hi2)."""
    return (a[2] > b[0]) & (b[2] > a[0]) & (a[3] > b[1]) & (b[3] > a[1])


def rect_contains(outer: list[Column], inner: list[Column], tol: float = 1e-9) -> Column:
    return (
        (inner[0] >= outer[0] - tol) & (inner[1] >= outer[1] - tol)
        & (inner[2] <= outer[2] + tol) & (inner[3] <= outer[3] + tol)
    )


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return _max(w, 0.0) * _max(h, 0.0)


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * MEAN_RADIUS_KM)


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1


def snapped_box(cx: Column, cy: Column, width: float, height: float, step: float = 30.0) -> list[Column]:
    left = F.floor((cx - width / 2) / step) * step
    bottom = F.floor((cy - height / 2) / step) * step
    return [left, bottom, left + width, bottom + height]


def cell_window(box: list[Column], left, top, res, height, width) -> dict[str, Column]:
    """Row and column range covering a world box, clipped to the grid (half open)."""
    return {
        "r0": F.greatest(F.floor((F.lit(top) - box[3]) / res), F.lit(0)),
        "r1": F.least(F.ceil((F.lit(top) - box[1]) / res), F.lit(height)),
        "c0": F.greatest(F.floor((box[0] - left) / res), F.lit(0)),
        "c1": F.least(F.ceil((box[2] - left) / res), F.lit(width)),
    }


def influence_box(box: list[Column], radius: Column) -> list[Column]:
    return [box[0] - radius, box[1] - radius, box[2] + radius, box[3] + radius]


def resolution_close(a: Column, b: Column, tol: float = 0.15) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12)) <= tol


def pair_close(a: Column, b: Column, tol: float = 1e-6) -> Column:
    return F.abs(a - b) <= tol
