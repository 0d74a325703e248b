"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds by query (second of two runs)."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINES = os.environ.get("BENCH_ONLY", "").split() or (
    "search_projection fts_bm25_topk fts_batch exact_then_fts token_estimate stable_ids dedup_content_hash run_length_collapse context_lines "
    "narrowest_container interval_overlap graph_edges graph_traverse_limited tier_resolution override_self_join candidate_merge score_pivot_rank "
    "confidence role_caps prefix_budget greedy_budget change_detection affected_facts cascade run_log metrics"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from quarry.plans.catalog import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
