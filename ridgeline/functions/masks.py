"""Validity masks and partitions of a cell (predicates over columns)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import flag

# Fixed values of the observation product: reflectance range, QA bit layout,
# illumination thresholds and the names of the five strata.
RHO_MIN, RHO_MAX = -0.05, 1.0
QA_CLEAR_BITS = 0b111111
QA_BITS = ["fill", "dilated_cloud", "cirrus", "cloud", "cloud_shadow", "snow"]
QA_WATER_BIT = 7
LIT_THRESHOLD = 0.1
MASK_OUTSIDE = 255
FLOAT_NODATA = -9999.0
STRATA = ["self_shadow", "near_zero", "mu_band_low", "mu_band_mid", "mu_band_high"]


def valid_value(v: Column, nodata: float | None = None) -> Column:
    """Finite and not the nodata code; a NaN nodata code is covered by isnan."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    if nodata is not None and nodata == nodata:
        ok = ok & (v != nodata)
    return flag(ok)


def in_range(rho: Column) -> Column:
    return flag(rho.between(RHO_MIN, RHO_MAX))


def qa_clear(qa: Column) -> Column:
    return flag(qa.bitwiseAND(QA_CLEAR_BITS) == 0)


def qa_flag(qa: Column, bit: int) -> Column:
    return flag(F.getbit(qa, F.lit(bit)) == 1)


def water(qa: Column) -> Column:
    return qa_flag(qa, QA_WATER_BIT)


def source_valid(*valid_bands: Column) -> Column:
    out = flag(valid_bands[0] == 1)
    for v in valid_bands[1:]:
        out = out & flag(v == 1)
    return out


def all_present(*layers: Column) -> Column:
    """Terrain validity: every layer has a value."""
    out = layers[0].isNotNull()
    for v in layers[1:]:
        out = out & v.isNotNull()
    return out


def lit(cos_i: Column) -> Column:
    return flag(cos_i > LIT_THRESHOLD)


def illumination_class(cos_i: Column) -> Column:
    """shadow <= 0 < near_zero <= 0.1 < lit; null outside support."""
    return (
        F.when(cos_i <= 0, "shadow")
        .when(cos_i <= LIT_THRESHOLD, "near_zero")
        .when(cos_i > LIT_THRESHOLD, "lit")
    )


def stratum(cos_i: Column, strict: bool = True) -> Column:
    """Five exclusive strata over [-1, 1]; a value outside stops the job."""
    outside = F.raise_error(F.lit("cos_i outside [-1, 1]")).cast("string") if strict else F.lit(None)
    return (
        F.when(cos_i.isNull(), F.lit(None).cast("string"))
        .when((cos_i < -1) | (cos_i > 1), outside)
        .when(cos_i <= 0, STRATA[0])
        .when(cos_i <= 0.1, STRATA[1])
        .when(cos_i <= 0.4, STRATA[2])
        .when(cos_i <= 0.7, STRATA[3])
        .otherwise(STRATA[4])
    )


def coded_mask(mask: Column, support: Column) -> Column:
    """0/1 inside support, 255 outside."""
    return F.when(support, mask.cast("short")).otherwise(F.lit(MASK_OUTSIDE).cast("short"))


def coded_float(v: Column, valid: Column) -> Column:
    """float32 value, -9999 outside the valid cells."""
    return F.when(valid, v).otherwise(F.lit(FLOAT_NODATA)).cast("float")
