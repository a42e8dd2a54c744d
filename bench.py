"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_RUNS (default 3) warm runs per query, of which the median counts.
BENCH_QUERIES may name other queries, separated by commas, or `all`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldpulse.plans.catalog import QUERIES  # noqa: E402
from fieldpulse.session import get_session  # noqa: E402

HEADLINE = [
    "c1_sensor_aggregation", "c2_aggregation_summary", "c3_anomaly_report", "c4_top_devices", "c6_telemetry_count",
    "c7_telemetry_stats", "c8_fleet_stats", "c11_experiment_summary", "c14_latency_histogram", "d1_device_health",
    "d2_recent_health", "d3_new_firmware", "d6_config_merge", "d9_telemetry_admission", "e1_moving_average",
    "e2_sliding_device_stats", "e3_latest_node_report", "e4_rate_limit", "e5_smoothed_latency",
    "e6_counter_increase_1h", "e8_rollout_replay", "h1_trend_regression", "h2_feature_vectors", "h3_training_matrix",
    "h4_ordered_split", "h6_flagged_errors", "h8_isolation_forest_scores", "h9_reconstruction_error",
    "h11_placement_ranking", "j1_device_snapshot", "a5_message_decode", "a7_batch_ingest", "b9_long_metrics",
    "i1_ingest", "i2_persist", "i3_stateful_features", "i4_ingest_rate_5m",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
