"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores,
BENCH_QUERIES (optional) a comma-separated choice of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foldwright.catalog import QUERIES  # noqa: E402
from foldwright.session import local_session  # noqa: E402

HEADLINE = (
    "ridge_cross_validation",
    "ridge_alpha_grid",
    "validate_line_cls",
    "traits_line_reg",
    "traits_event_skew",
    "outer_folds_stratified",
    "outer_folds_regression",
    "inner_folds_all_outer",
    "nested_fractions_line",
    "stratified_subset_events",
    "scale_standard",
    "scale_robust",
    "scale_quantile_normal",
    "encode_onehot_with_rare",
    "encode_target_crossfitted",
    "fold_parameters_standard",
    "fold_parameters_robust",
    "preprocess_full_line",
    "select_mutual_information",
    "metric_roc_auc_binary",
    "metric_panel_per_fold",
    "calibration_ece_binary",
    "interval_coverage_width",
    "test_paired_wilcoxon",
    "test_friedman",
    "knn_neighbours",
    "study_leaderboard",
    "study_comparisons",
    "study_efficiency",
    "sweep_grid_gated",
    "sampled_trials",
    "stream_incremental_traits",
    "model_logistic",
    "model_hist_gb",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for starting the JVM and the Python workers, not for a query.
    spark.range(1000).mapInArrow(lambda batches: batches, "id long").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
