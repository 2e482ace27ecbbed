"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "panel_shape",
    "merge_barcodes",
    "set_aside",
    "duplicate_audit",
    "placeholder_signature",
    "weekly_view",
    "product_aggregates",
    "movement",
    "features",
    "retailer_profile",
    "pareto",
    "category_decomposition",
    "promo_drift",
    "robust_scale",
    "kmeans_fit",
    "scan_k",
    "stability",
    "silhouette",
    "pair_regression",
    "all_subcategory_links",
]


def main() -> None:
    from shelfwise.plans.queries import QUERIES
    from shelfwise.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    QUERIES["panel_shape"](spark, sf_dir).collect()  # starts the JVM and the Python workers
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
