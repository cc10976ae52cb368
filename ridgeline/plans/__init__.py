"""Registered queries: name -> (Spark plan, DuckDB SQL)."""
from .registry import QUERIES, ORACLES  # noqa: F401
from . import scans, filters, pixels, joins, aggregates, windows, modeling, spatial, quality, misc  # noqa: F401
