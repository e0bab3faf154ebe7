"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads. Every query
starts from the base tables: derived tables of earlier queries are forgotten first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retailspark.registry import catalog, core  # noqa: E402
from retailspark.plans.skew import forget_hot_keys  # noqa: E402
from retailspark.session import build_session  # noqa: E402

HEADLINE = (
    "clean_articles", "user_totals", "user_features", "item_features_rich", "segment_top_items", "candidate_train",
    "purchase_sequence", "sample_negatives", "ranking_train", "top_k_similar", "session_state_batch",
    "generate_candidates", "metadata_popularity_recs", "evaluate_popularity", "bootstrap_ci",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.checkpoint.dir": shared,
           "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "1m"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    times = {}
    for name in HEADLINE:
        if os.path.isdir(small):
            catalog.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        core.forget_shared()
        forget_hot_keys()
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
