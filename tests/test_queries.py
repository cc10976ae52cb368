"""Registered queries against DuckDB on the smallest data.

A subset runs by default; RIDGELINE_ALL=1 runs every query.
"""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

DATA = "/root/testdata/sf0.001"
QUICK = ["flt01_valid_value_mask", "flt08_base_valid_land", "fn04_cos_incidence", "fn23_content_identity", "jn09_nearest_date", "jn11_align_grid",
         "ag01_band_statistics", "ag03_percentiles", "ag13_support_waterfall", "ag27_dominant_class", "wn02_slope_aspect", "wn05_prefix_sums", "wn21_earlier_done",
         "md01_holdout_fit_score", "sp01_sky_view", "sp05_checkerboard", "sp19_change_class", "dq07_registry_rules", "st04_retry_rule", "so05_deduplicate"]
ROWS = {"src": 7, "snk": 5, "flt": 16, "fn": 24, "jn": 15, "ag": 38, "wn": 21, "tk": 4, "so": 5, "sp": 25, "md": 14, "ar": 6, "dq": 18, "st": 4, "ud": 4}


def test_every_inventory_row_has_a_query():
    have = {m[1] for m in (re.match(r"([a-z]+\d\d)_", n) for n in entry.queries()) if m}
    want = {f"{p}{i:02d}" for p, n in ROWS.items() for i in range(1, n + 1)}
    assert want - have == set()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("RIDGELINE_ALL") else QUICK)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    result, _ = compare(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name])
    assert result == "ok"
