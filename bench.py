"""Bench: wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query is forced to completion with the ``noop``
warm-up run and is then timed over $BENCH_RUNS (default 3) warm runs; the
median is reported.  ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from valuelens.plans.registry import all_queries  # noqa: E402
from valuelens.session import local_session  # noqa: E402

HEADLINE = [
    "category_impact",
    "category_impact_multi",
    "correlation_matrix",
    "typical_values",
    "dataset_profile",
    "clean_numeric",
    "derived_ratios",
    "outlier_fence",
    "encode_target",
    "linear_cv",
    "segment_models",
    "undervalued",
    "overvalued",
    "privacy_mask",
    "train_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="valuelens-bench")
    registry = all_queries()
    names = [n for n in HEADLINE if n in registry]
    if os.environ.get("BENCH_ALL"):
        names = list(registry)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for n in names:
        try:
            registry[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            samples = []
            for _ in range(runs):
                t0 = time.perf_counter()
                registry[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                samples.append(time.perf_counter() - t0)
            samples.sort()
            times[n] = round(samples[len(samples) // 2], 3)
            print(f"bench {n}: {times[n]}s", file=sys.stderr, flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"bench {n} failed: {e!r}"[:300], file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
