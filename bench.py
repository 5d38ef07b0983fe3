"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and how wide."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera.plans import catalog

HEADLINES = {
    "q1": "tpch_q1", "q3": "tpch_q3", "q6": "tpch_q6", "q14": "tpch_q14", "group_stats": "agg_stddev_pop", "point": "point_read",
    "curvature": "curvature", "curvature_by": "curvature_by", "anomalies": "anomalies", "group_outliers": "group_outliers", "vector_topk": "vector_topk_cosine", "pullback": "join_chain",
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name, key in HEADLINES.items():
        runs = []
        for _ in range(4):  # the first warms up
            start = time.perf_counter()
            queries[key](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline queries, median of 3 after a warm-up, summed", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
