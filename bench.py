"""Seconds per headline query on one machine; prints one JSON line.

Each query runs once to warm up; then the median of three runs counts, or one run if it takes over four seconds. The
``users_*`` and ``daily_orders_*`` queries have more than a thousand series at sf0.1 and grow with the tables.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from kilohour.queries import QUERIES
from kilohour.session import local_session

HEADLINE = (
    "c1_segments", "c2_select_windows", "f1_training_features", "w4_segment_rolling", "a2_pivot_measures",
    "a3_quality_report", "a5_regional_weather", "j7_latest_forecast", "w9_prior_residual_window", "d1_rule_detection",
    "d2_residual_events", "e1_ensemble", "e3_alert_deduplication", "j8_interval_match", "m5_baseline_evaluation",
    "a11_metric_slices", "b1_dispatch_inputs", "a19_dispatch_kpis", "o5_latest_horizon",
    "s13_keyed_upsert", "w16_keep_last", "a32_score_distribution", "daily_orders_segments",
    "users_gap_hours", "users_segment_lags", "d4_planted_outliers", "m7_fit_quality",
)


def timed(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores, "bench", **{"spark.ui.showConsoleProgress": "false"})
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)  # warm-up
        runs = [timed(spark, name, sf_dir)]
        while len(runs) < repeats and runs[0] < 4:
            runs.append(timed(spark, name, sf_dir))
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
