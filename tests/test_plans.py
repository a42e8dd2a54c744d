"""Plans: what reaches the scan, what is shuffled, what must not appear."""

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import filters, hot_keys, lifecycle, placement, trend, windows
from fieldpulse.plans.catalog import QUERIES
from fieldpulse.sources import sample_views as V

LAZY_WITHOUT_ACTIONS = [
    "c1_sensor_aggregation", "c2_aggregation_summary", "c3_anomaly_report", "c5_anomaly_summary", "c8_fleet_stats",
    "c11_experiment_summary", "c14_latency_histogram", "d1_device_health", "d2_recent_health", "d3_new_firmware", "d5_approval_merge",
    "d6_config_merge", "d7_alert_inhibition", "d8_stream_backlog", "d9_telemetry_admission", "e1_moving_average", "e2_sliding_device_stats",
    "e3_latest_node_report", "e4_rate_limit", "e6_counter_increase_1h", "e7_quantile_of_rate", "e8_canary_replay", "h1_trend_regression",
    "h6_flagged_errors", "h11_placement_ranking", "j1_judged_events", "j1_device_snapshot", "j1_field_snapshot", "j4_event_emission", "j2_provisioning_requests", "j5_activity_status",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY_WITHOUT_ACTIONS)
def test_no_products_and_no_python(spark, folder, name):
    text = plan(QUERIES[name].run(spark, folder))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text, operator


def test_time_and_equality_filters_reach_the_scan(spark, folder):
    df = filters.time_range(V.telemetry(spark, folder), "2024-01-05", "2024-01-06")
    text = plan(filters.apply_filters(df, metric="click").select("device_id"))
    assert "GreaterThanOrEqual(ts" in text and "EqualTo(event_type,click)" in text
    assert "ReadSchema: struct<ts:timestamp,user_id:bigint,event_type:string>" in text


def test_reports_read_their_table_once(spark, folder):
    for name in ("c1_sensor_aggregation", "c2_aggregation_summary", "c3_anomaly_report", "c7_telemetry_stats", "c14_latency_histogram", "h1_trend_regression"):
        assert plan(QUERIES[name].run(spark, folder)).count("FileScan") == 1, name


def test_only_needed_columns_are_read(spark, folder):
    text = plan(QUERIES["c1_sensor_aggregation"].run(spark, folder))
    assert "ReadSchema: struct<ts:timestamp,user_id:bigint,value:double>" in text


def test_change_log_is_folded_by_hash(spark, folder):
    """Only the few events that hold a field's last write meet a sort aggregation."""
    judged = V.device_changes(spark, folder).withColumn("reject_reason", F.when(F.col("event_id") % 10 == 0, "no"))
    text = plan(lifecycle.device_snapshot(judged))
    assert text.count("HashAggregate") == 2 and text.count("SortAggregate") == 2
    assert "SortAggregate" not in text.split("Join", 1)[1]


def test_top_reports_keep_sort_and_limit_together(spark, folder):
    for name in ("a12_newest", "a13_incremental_tail", "c4_top_devices", "f4_newest_sample", "b7_telemetry_listing"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name].run(spark, folder)), name


def test_series_windows_are_cut_by_time(spark, folder):
    text = plan(trend.moving_average_points(V.telemetry(spark, folder)))
    assert "hashpartitioning(device_type" in text and "bucket" in text.split("Window", 1)[1]


def test_hot_keys_get_slots_and_others_none(spark, folder):
    telemetry = V.telemetry(spark, folder)
    plain, any_hot = hot_keys.with_slots(telemetry, ["device_id"], ["ts", "id"])
    assert not any_hot and plain.filter("_slot <> 0").isEmpty()
    cut, any_hot = hot_keys.with_slots(telemetry, ["device_id"], ["ts", "id"], 60)
    assert any_hot
    sizes = cut.groupBy("device_id", "_slot").count().agg({"count": "max"}).first()[0]
    assert sizes <= 60


def test_whole_partition_windows_are_bounded(spark, folder):
    """Rate limits number the requests per client and window, never per client alone."""
    text = plan(windows.rate_limit(V.requests(spark, folder)))
    assert "hashpartitioning(client_id" in text and "window" in text


def test_nodes_reach_tasks_by_key(spark, folder):
    text = plan(placement.place_tasks(V.tasks(spark, folder), V.node_reports(spark, folder), V.AS_OF))
    assert "requesting_node_id" in text and "Subquery" in text


def test_telemetry_counts_use_hash_aggregation(spark, folder):
    for name in ("c1_sensor_aggregation", "c7_telemetry_stats", "c14_latency_histogram", "h1_trend_regression"):
        assert "SortAggregate" not in plan(QUERIES[name].run(spark, folder)), name


def test_slots_are_separated_even_after_a_join_on_the_key(spark, folder):
    """Input partitioned by device must not keep all slots of a hot device together."""
    telemetry = V.telemetry(spark, folder)
    by_device = telemetry.repartition("device_id")
    cut, _ = hot_keys.with_slots(by_device, ["device_id"], ["ts", "id"], 60)
    assert "hashpartitioning(device_id" in plan(cut) and "_slot" in plan(cut).split("Exchange", 1)[1].split("\n", 1)[0]
