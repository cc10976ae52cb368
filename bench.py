"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
Each query is planned and run once to the noop sink; one small query warms the JVM first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "wn02_slope_aspect", "flt08_base_valid_land", "ag12_cell_support", "ag13_support_waterfall", "ag20_weighted_inversion",
    "jn09_nearest_date", "jn10_bilinear_sample", "md01_holdout_fit_score", "md02_method_experiment", "md03_candidate_ablation",
    "md04_selective_scopes", "wn09_risk_coverage_curve", "wn14_quartile_strata", "sp01_sky_view", "sp10_candidate_record",
    "sp16_components", "sp21_invalidation_marks", "sp22_version_digest", "dq01_reconciliation_suite", "st02_latest_state_stream",
]


def main() -> None:
    from pyspark.sql import SparkSession

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from ridgeline.plans import QUERIES
    from ridgeline.sources import io

    io.REUSE = False  # every query builds what it needs

    QUERIES["wn04_hillshade"](spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        t = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(d).removeprefix("sf"), "spark": spark.version,
                      "cores": spark.sparkContext.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                      "driver_memory": "16g"}))
    spark.stop()


if __name__ == "__main__":
    main()
