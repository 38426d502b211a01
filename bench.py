"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from tagloom.queries import QUERIES
from tagloom.session import local_session

HEADLINE = [
    "curate_split", "p1_curate", "p1_curate_report", "p2_prepare", "p5_catalogue_items",
    "w2_dedup_first", "w3_cap_per_group", "w3_cap_per_group_large", "w5_ordered_distinct", "w8_early_stop",
    "s1_stratified_split", "s2_balanced_resample", "s3_random_split_exact", "s4_draw_recipes",
    "v3_relevance_gate", "m2_score", "m3_route", "m4_evaluate", "a2_class_weights", "a7_epoch_metrics",
    "a8_stage_report", "j1_bucket_catalogue", "j2_lookup_default", "j3_pending", "t5_harvest_urls",
    "t6_drop_blocked", "src5_ingest_pages",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    # start the JVM's and Python's workers before the clock runs
    QUERIES["m2_score"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
