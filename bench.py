"""Headline timings: prints one JSON line. Reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from sparkcollide.plans import load_all
from sparkcollide.plans.registry import QUERIES

HEADLINE = [
    "AGG01_weighted_cutflow_n4", "AGG01_weighted_cutflow_n8", "ARR02_best_reconstruction_n8", "ARR02_best_reconstruction_n4", "UDF02_reconstruct_udf_n4",
    "AGG03_histogram_1d", "AGG09_histogram_sumw2", "ML04_threshold_scan", "WIN03_running_efficiency", "INF07_perturbativity_grid",
    "AGG17_score_points", "AGG21_source_weight_stats", "AGG23_reweight_events", "AGG29_lhe_event_check", "FLT13_isolation_veto", "AGG32_momentum_tensor", "INF16_marginalise_4d",
    "TOP01_order_particles_pt", "WIN04_auc", "ML01_stratified_split", "ML05_evaluate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    timings = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run also writes shared inputs and warms the JIT
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(min(runs), 3)
        print(f"{name}: first {runs[0]:.2f}s best {min(runs):.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
