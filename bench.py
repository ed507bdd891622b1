"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from chainlake.plans import catalogue

HEADLINE = (
    "transition_matrix_global", "transition_matrix_conditional", "higher_order_probs", "critical_patterns", "time_window_matrices", "frequent_subsequences", "change_points_kl",
    "trajectory_features", "conditional_insights_l1_tv_fro_w1", "quick_significance", "cluster_profile", "davies_bouldin", "bootstrap_matrix_ci", "kruskal_h",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Not timed: starts the executor threads and the code generator.
    catalogue.QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
