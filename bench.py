"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from tableprep.session import local_session  # noqa: E402

HEADLINE = [
    "describe_numeric", "table_health", "duplicate_rows", "nunique", "categorical_summary", "correlation_matrix",
    "impute_median", "fill_forward", "impute_knn", "outlier_iqr_cap", "scale_standard", "scale_robust", "encode_label",
    "encode_target", "quantile_bins", "reduce_pca", "balance_undersample", "merge_outer", "merge_multi_key",
    "fuzzy_best_match", "chart_box", "chart_kde", "chart_pairplot", "preset_smart_clean", "preset_api",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "tableprep-bench", partitions=max(int(cpus) if cpus.isdigit() else 8, 1))
    for name in ("scale_minmax", "correlation_matrix"):  # warm-up: code generation and Python workers
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every value is computed, none is sent to the driver
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
