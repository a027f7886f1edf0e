"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "bm25_topk", "dense_topk", "hybrid_search", "retrieval_metrics", "chunk_fanout", "reviews_top5", "stratified_slice",
    "latency_quantiles", "return_eligibility", "return_request_first_wins", "apply_command_log", "items_multiset_check",
    "evidence_rows", "contradictions", "freshness_status", "task_progress", "process_audit", "grade_reward",
    "run_summary_rollup", "progress_gate", "structure_split", "rejection_waterfall", "usage_per_simulation",
    "prefix_sizes", "action_envelopes", "tumbling_calls", "sessions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfmark-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from shelfmark.plans import registry

    spark.range(1000).selectExpr("sum(id)").collect()  # session start-up is not part of any query
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
