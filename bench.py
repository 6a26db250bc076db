"""Times the headline queries and prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.  Every
query's whole result is written to Spark's no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s3_member_library", "p1_ratios", "p25_value_index", "j1_reference_anti_join", "j3_reference_position", "j6_weight_grid_auc",
    "a2_oof_target_encoding", "a4_frequency_encoding", "a5_pair_encoding", "a11_describe", "a14_psi", "a17_reference_cdf",
    "a21_kernel_log_ratio", "a22_strong_pairs", "a25_exact_auc", "a27_feature_auc", "a29_granularity", "d1_average_rank",
    "d3_stratified_folds", "u4_keep_first", "b1_rank_average", "b2_blend_weight_search", "e1_fill_and_scale",
    "e5_feature_matrix", "m1_kfold_oof", "m4_logistic_meta", "m8_model_imputation",
]


def main() -> None:
    from tabweave.plans import registry
    from tabweave.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["p2_null_skipping_sum"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
