"""Per-cell physics: reflectance, indices, illumination and responses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clip

# Fixed values of the product and of the forward model.
DN_SCALE, DN_OFFSET = 2.75e-5, -0.2
EARTH_RADIUS_M = 6371000.0
TASK_STATES = {
    "READY": "submitted",
    "RUNNING": "running",
    "COMPLETED": "succeeded",
    "FAILED": "failed",
    "CANCELLED": "cancelled",
}


def reflectance(dn: Column) -> Column:
    return dn * DN_SCALE + DN_OFFSET


def ndvi(b4: Column, b5: Column, eps: float = 1e-12, bounded: bool = True) -> Column:
    """(b5-b4)/(b5+b4), null when the denominator is too small or, if bounded, the result leaves [-1, 1]."""
    den = b5 + b4
    value = F.when(F.abs(den) > eps, (b5 - b4) / den)
    return F.when(value.between(-1, 1), value) if bounded else value


def brightness(b4: Column, b5: Column) -> Column:
    return (b4 + b5) / 2


def cos_incidence(slope: Column, aspect: Column, sun_az: Column, sun_el: Column) -> Column:
    """Solar incidence cosine, stored as float32 and read back as double."""
    s, z = F.radians(slope), F.radians(F.lit(90.0) - sun_el)
    value = F.cos(s) * F.cos(z) + F.sin(s) * F.sin(z) * F.cos(F.radians(sun_az - aspect))
    return value.cast("float").cast("double")


def direct_factor(cos_i: Column) -> Column:
    return F.when(cos_i.isNotNull(), F.greatest(cos_i, F.lit(0.0)))


def hard_response(albedo, cos_i: Column) -> Column:
    return direct_factor(cos_i) * albedo


def corrected(observed: Column, cos_i: Column, threshold: float = 0.1) -> Column:
    return F.when(cos_i > threshold, observed / cos_i)


def soft_response(albedo, cos_i: Column, k: float = 50.0) -> Column:
    """albedo * softplus(k x) / k in a form that cannot overflow."""
    kx = cos_i * k
    return (F.greatest(kx, F.lit(0.0)) + F.log1p(F.exp(-F.abs(kx)))) / k * albedo


def support_weight(cos_i: Column, k: float = 30.0, tau: float = 0.1) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip((cos_i - tau) * k, -700.0, 700.0)))


def risk_score(cos_i: Column) -> Column:
    """float32(1) - float32(cos_i)."""
    return (F.lit(1).cast("float") - cos_i.cast("float")).cast("float")


def curvature_drop(distance: Column) -> Column:
    return distance * distance / (2 * EARTH_RADIUS_M)


def relative_improvement(base: Column, candidate: Column) -> Column:
    return F.when(base > 0, (base - candidate) / base)


def lifecycle(task_state: Column) -> Column:
    """Lifecycle name of a task state; null marks an unknown state."""
    pairs = [F.lit(x) for kv in TASK_STATES.items() for x in kv]
    return F.create_map(*pairs)[task_state]


def circular_error(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360)) - 180)
