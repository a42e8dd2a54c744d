"""The four batch analytics jobs, composed from the operators.

A job takes a session and a dict of parameters and returns lazy result tables; a
parameter that is absent filters nothing. Save results with `sources.sinks`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fieldpulse.operators import aggregates, health, trend
from fieldpulse.operators.decode import long_metrics
from fieldpulse.operators.filters import apply_filters, cast_timestamp, time_range
from fieldpulse.sources.sinks import export_csv

TELEMETRY_TABLE = "telemetry_readings"
ALERTS_TABLE = "alerts"


@dataclass(frozen=True)
class JobResult:
    """`rows` is the main table, `summary` one row or a small table, `details` further tables by name."""

    rows: DataFrame
    summary: DataFrame
    details: Mapping[str, DataFrame] = field(default_factory=dict)

    def to_csv(self, path: str) -> None:
        export_csv(self.rows, path, self.summary)


def read_source(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or temporary view, or a Parquet path."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return cast_timestamp(df)


def read_metrics(spark: SparkSession, name: str) -> DataFrame:
    """Long metrics; stored readings with a JSON payload are unfolded into them."""
    df = read_source(spark, name)
    return df if "value" in df.columns else long_metrics(df)


def _in_range(df: DataFrame, params: Mapping[str, Any], *equal: str) -> DataFrame:
    df = time_range(df, params.get("start_time"), params.get("end_time"))
    return apply_filters(df, **{name: params.get(name) for name in equal})


def sensor_aggregation(spark: SparkSession, params: Mapping[str, Any]) -> JobResult:
    """start_time, end_time, device_type, granularity (hour or day), table_name"""
    df = _in_range(read_metrics(spark, params.get("table_name", TELEMETRY_TABLE)), params, "device_type")
    granularity = params.get("granularity", "hour")
    return JobResult(aggregates.sensor_aggregation(df, granularity), aggregates.aggregation_summary(df, granularity))


def anomaly_report(spark: SparkSession, params: Mapping[str, Any]) -> JobResult:
    """start_time, end_time, device_type, severity, top_n, table_name"""
    df = _in_range(read_source(spark, params.get("table_name", ALERTS_TABLE)), params, "device_type", "severity")
    return JobResult(aggregates.top_devices(df, params.get("top_n", 10)), aggregates.anomaly_report(df))


def device_health(spark: SparkSession, params: Mapping[str, Any]) -> JobResult:
    """start_time, end_time, device_type, as_of (default now, UTC), telemetry_table, anomaly_table"""
    as_of = params.get("as_of") or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    rows = health.device_health(
        read_source(spark, params.get("telemetry_table", TELEMETRY_TABLE)),
        read_source(spark, params.get("anomaly_table", ALERTS_TABLE)),
        as_of, params.get("start_time"), params.get("end_time"), params.get("device_type"),
    )
    return JobResult(rows, health.health_summary(rows))


def trend_analysis(spark: SparkSession, params: Mapping[str, Any]) -> JobResult:
    """start_time, end_time, device_type, metric, window_size (hours, 24), table_name

    The moving average per second is in `details["moving_average"]`.
    """
    df = _in_range(read_metrics(spark, params.get("table_name", TELEMETRY_TABLE)), params, "device_type", "metric")
    rows = trend.linear_trends(df)
    points = trend.moving_average_points(df, params.get("window_size", 24))
    return JobResult(rows, trend.trend_summary(rows), {"moving_average": points})


JOBS: dict[str, Callable[[SparkSession, Mapping[str, Any]], JobResult]] = {
    "sensor_aggregation": sensor_aggregation,
    "anomaly_report": anomaly_report,
    "device_health": device_health,
    "trend_analysis": trend_analysis,
}


def run_job(spark: SparkSession, job_type: str, params: Mapping[str, Any] | None = None) -> JobResult:
    if job_type not in JOBS:
        raise ValueError(f"unknown job type {job_type!r}; known: {sorted(JOBS)}")
    return JOBS[job_type](spark, params or {})
