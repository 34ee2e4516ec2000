"""Runs the headline queries and prints one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "nearest_tier_summary", "nearest_with_window_means", "offset_asof_90_360", "sessions_global", "sessions_keyed", "interval_contamination",
    "ranked_merge", "crosstab_margins", "describe_exact", "robust_scale_by_group", "loo_robust_z", "auroc_rank", "bootstrap_ci",
    "radius_pairs", "epsilon_clusters", "center_ring_contrast", "cone_contrast", "threshold_search",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from matchbook.session import local_session

    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus, "bench", "8g")
        spark.sparkContext.setLogLevel("ERROR")
        from matchbook.plans import QUERIES

        QUERIES[HEADLINES[0]](spark, folder).write.format("noop").mode("overwrite").save()  # compiles what all share
        took = {}
        for name in HEADLINES:
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
