"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from faultline.registry.queries import queries
from faultline.session import local_session

# Kernels that read the large tables, one per family of operators.
HEADLINE = [
    "ks_two_sample",
    "mutual_info_rank",
    "describe_by_class",
    "pearson_matrix",
    "cost_curve_items",
    "density_by_class",
    "engineer_histograms",
    "wasserstein_to_ref",
    "ks_top_features",
    "killer_bins",
    "corr_with_reference",
    "stratified_kfold",
    "robust_scale",
    "contingency",
    "chisq_ci",
    "age_adjusted_logit",
    "hybrid_graph",
    "node_roles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registered, times = queries(), {}
    # Start the JVM and the Python workers before the clock.
    registered["pearson_matrix"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
