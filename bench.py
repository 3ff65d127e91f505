"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full into a no-op sink. One small query runs first, so that the first
timing does not include starting the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "noise_uniform", "noise_asymmetric", "estimate_transition", "standard_scale", "stratified_split", "kfold_assign",
    "confusion_matrix", "metrics_all", "aum_score", "cl_confident_joint", "cl_issues", "knn_cosine", "knn_both",
    "neighbour_vote_quality", "counterexample_nearest", "detection_metrics", "results_table", "rank_by_slice",
    "anomaly_speedup", "series_window_size",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    from labelq.catalog.registry import load
    from labelq.session import local_session

    queries, _ = load()
    spark = local_session("bench", cpus)
    queries["class_prior"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in keys:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
