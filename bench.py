"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up at the same size and then as often as `REPEATS`; its best time counts.
Results go to Spark's no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from attestor import registry

REPEATS = 2
HEADLINE = [
    "J-01_relations", "J-02_delta_relations", "P-05_gate_verdicts", "R-01_adjudicated", "R-06_all_objections", "A-01_dedup", "A-03_clusters_min2",
    "A-06_coverage_stats", "J-03_candidate_pairs", "W-03_hybrid", "W-04_adaptive_ladder", "T-01_cosine_topk", "T-02_bm25_topk", "W-08_history",
    "F-02_parse_quantity", "F-21_parse_period", "A-12_repeated_edge_lines", "F-11_verify_value",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS + 1):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
