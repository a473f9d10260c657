"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (timed runs per query, default 3; the median is reported).
Each query runs once to warm up, then BENCH_RUNS times; every run re-reads
the parquet input (caches are cleared before each run).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from routecraft.catalog import REGISTRY  # noqa: E402
from routecraft.session import local_session  # noqa: E402

HEADLINE = ["features_30d", "features_all", "plan_2x2", "plan_2xn", "plan_summary", "feature_asof",
            "rolling_features_30d", "resolve_asof", "batch_optimize_sql", "feature_recompute_asof", "plan_mx1",
            "scenario_default_name", "route_costs_dedup"]


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus, app_name="routecraft-bench")
    timings, rows = {}, {}
    for name in HEADLINE:
        samples = []
        for i in range(runs + 1):
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            REGISTRY[name](spark, data_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 3)
        rows[name] = REGISTRY[name](spark, data_dir).count()
    sf = re.search(r"sf([0-9.]+)", data_dir)
    print(json.dumps({
        "metric": "sum_of_median_warm_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "sf": float(sf.group(1)) if sf else None,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
