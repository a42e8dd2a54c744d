"""The batch jobs by name and parameters."""

import pytest

from support import as_dicts
from fieldpulse.plans.jobs import run_job
from fieldpulse.session import scratch_path
from fieldpulse.sources import sample_views as V


@pytest.fixture(scope="module", autouse=True)
def tables(spark, folder):
    V.telemetry(spark, folder).createOrReplaceTempView("telemetry_readings")
    V.alerts(spark, folder).createOrReplaceTempView("alerts")


def test_unknown_job(spark):
    with pytest.raises(ValueError):
        run_job(spark, "something_else")


def test_paths_and_views_are_both_sources(spark, folder):
    path = scratch_path(spark, "telemetry")
    V.telemetry(spark, folder).write.parquet(path)
    by_path, by_view = (as_dicts(run_job(spark, "sensor_aggregation", p).rows) for p in ({"table_name": path}, {}))
    assert by_path == by_view


def test_summary_belongs_to_the_filtered_rows(spark):
    params = {"start_time": "2024-01-05", "end_time": "2024-01-06", "device_type": "smart_meter"}
    result = run_job(spark, "sensor_aggregation", params)
    rows, summary = as_dicts(result.rows), as_dicts(result.summary)[0]
    assert summary["total_rows"] == sum(r["count"] for r in rows)
    assert summary["aggregated_rows"] == len(rows) and summary["unique_types"] == 1


def test_health_defaults_to_now(spark):
    rows = as_dicts(run_job(spark, "device_health").rows)
    # all sample readings are far in the past, so silence alone costs 50 points
    assert rows and all(r["health_score"] <= 50 for r in rows)
    scores = [(r["health_score"], r["device_id"]) for r in rows]
    assert scores == sorted(scores)


def test_csv_of_a_job(spark):
    path = scratch_path(spark, "csv")
    result = run_job(spark, "anomaly_report", {"top_n": 3})
    result.to_csv(path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["device_id", "anomaly_count", "device_type"] and back.count() == 3


def test_trend_strongest_first(spark):
    rows = as_dicts(run_job(spark, "trend_analysis", {"device_type": "smart_meter"}).rows)
    slopes = [abs(r["slope"]) for r in rows]
    assert len(rows) == 5 and slopes == sorted(slopes, reverse=True)
