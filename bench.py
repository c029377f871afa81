"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of threads. Each
query is built and run once into a sink that discards the rows, after one
warm-up query that takes the start of the JVM out of the figures.

The model queries are run with ``BENCH_TREES`` trees, 10 by default as in
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "stats_by_phase", "stats_by_area", "stats_by_sponsor_class", "stats_by_status",
    "search_trials", "search_array_member", "trial_details", "compare_groups", "top_sponsors",
    "chart_phase", "chart_area", "chart_enrollment", "chart_volume", "chart_sponsor",
    "chart_duration", "normalize_core", "normalize_dates", "normalize_arrays", "page_source",
    "upsert_result", "upsert_counts", "insert_absent", "conv_list", "conv_titles", "conv_upsert",
    "chart_payloads", "tool_usage", "features_matrix", "split_members", "fold_sizes",
    "metrics_overall", "class_report", "auc", "calibration", "accuracy_by_phase",
    "accuracy_by_area", "benchmark_filtered", "latest_metrics", "alarm_periods", "over_limit",
    "request_series", "synthetic_trials", "stream_ingest", "stream_alarms", "gbt_scores",
    "shap_importance",
)
TREES = ("gbt_scores", "shap_importance")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    from cohortlens.operators.model import Boosting
    from cohortlens.plans import catalog
    from cohortlens.plans.catalog import QUERIES
    from cohortlens.session import get_session

    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    trees = int(os.environ.get("BENCH_TREES", 10))
    catalog.BOOSTING = Boosting(trees=trees)
    QUERIES["stats_by_phase"](spark, sf_dir).collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        shown = f"{name}_{trees}_trees" if name in TREES else name
        seconds[shown] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(shown, seconds[shown], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
