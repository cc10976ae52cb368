"""Configuration used with the fixture views: folds, limits, candidate models."""

from __future__ import annotations

# Five column stripes as fold cores; rows are unbounded.
FOLDS = [{"k": k, "r0": 0, "c0": 10 * k - 10, "r1": 2_000_000_000, "c1": 10 * k - 6} for k in range(1, 6)]
MIN_CALIBRATION = 20
