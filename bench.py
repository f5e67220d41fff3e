"""Times the headline queries: prints one JSON line. Warm: one run first, then the median of ``BENCH_RUNS``."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera import catalog

QUERIES = ["rel_pricing_summary", "tpch_q1", "tpch_q2", "tpch_q3", "tpch_q4", "tpch_q5", "tpch_q6", "tpch_q7", "tpch_q8", "tpch_q9", "tpch_q10", "tpch_q11", "tpch_q12", "tpch_q13", "tpch_q14", "tpch_q15", "tpch_q16", "tpch_q17", "tpch_q18", "tpch_q19", "tpch_q20", "tpch_q21", "tpch_q22"]
QUERIES += ["nexmark_q0", "nexmark_q7", "nexmark_q9", "nexmark_q15", "log_distinct_users", "rel_cube", "rewrite_lazy_grouping_sets", "rel_multi_distinct", "win_running_sum", "win_top_k_per_group", "rewrite_unbounded_window", "rewrite_as_of_join", "rewrite_range_join", "rel_either_join", "rel_any_join", "rel_bloom_filtered_join", "rel_range_sort"]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    known, times = catalog.queries(), {}
    for name in QUERIES:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "total of median warm seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
