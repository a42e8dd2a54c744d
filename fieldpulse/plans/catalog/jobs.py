"""The batch jobs as a user runs them: by job type, with parameters, over named tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.plans.catalog.oracle_views import LONG_FLAT
from fieldpulse.plans.catalog.registry import query
from fieldpulse.plans.catalog.reports import HEALTH, TRENDS
from fieldpulse.plans.jobs import run_job
from fieldpulse.sources import sample_views as V

RANGE = {"start_time": "2024-01-05T00:00:00", "end_time": "2024-01-20T12:00:00"}
IN_RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"


def views(spark, folder) -> None:
    V.telemetry(spark, folder).createOrReplaceTempView("telemetry_readings")
    V.alerts(spark, folder).createOrReplaceTempView("alerts")


@query("job_sensor_aggregation", f"""
    SELECT date_trunc('day', ts)::TIMESTAMP AS period, device_type,
           CAST(sum(value) AS DOUBLE) / count(value) AS avg_value, CAST(min(value) AS DOUBLE) AS min_value,
           CAST(max(value) AS DOUBLE) AS max_value, count(value) AS count,
           round(stddev_samp(CAST(value AS DOUBLE)), 6) AS stddev_value
    FROM telemetry WHERE {IN_RANGE} AND device_type = 'gps_tracker' GROUP BY 1, 2""")
def sensor_aggregation(spark, folder):
    views(spark, folder)
    result = run_job(spark, "sensor_aggregation", {**RANGE, "device_type": "gps_tracker", "granularity": "day"})
    return result.rows.withColumn("stddev_value", F.round("stddev_value", 6))


@query("job_sensor_aggregation_from_payloads", f"""
    SELECT date_trunc('hour', ts)::TIMESTAMP AS period, device_type, count(value) AS count, min(value) AS min_value, max(value) AS max_value
    FROM ({LONG_FLAT}) GROUP BY 1, 2""")
def sensor_aggregation_from_payloads(spark, folder):
    V.readings(spark, folder).createOrReplaceTempView("payload_readings")
    result = run_job(spark, "sensor_aggregation", {"table_name": "payload_readings"})
    return result.rows.select("period", "device_type", "count", "min_value", "max_value")


@query("job_anomaly_report", f"""
    SELECT device_id, count(*) AS anomaly_count, min(device_type) AS device_type FROM alerts
    WHERE {IN_RANGE} AND severity = 'critical' GROUP BY device_id ORDER BY anomaly_count DESC, device_id LIMIT 5""")
def anomaly_report(spark, folder):
    views(spark, folder)
    return run_job(spark, "anomaly_report", {**RANGE, "severity": "critical", "top_n": 5}).rows


@query("job_anomaly_report_summary", f"""
    WITH a AS (SELECT * FROM alerts WHERE {IN_RANGE} AND severity = 'critical')
    SELECT 'total' AS category, NULL AS key, count(*) AS count FROM a
    UNION ALL SELECT 'device_type', device_type, count(*) FROM a GROUP BY device_type
    UNION ALL SELECT 'severity', severity, count(*) FROM a GROUP BY severity
    UNION ALL SELECT 'hour_of_day', CAST(hour(ts) AS VARCHAR), count(*) FROM a GROUP BY hour(ts)""")
def anomaly_report_summary(spark, folder):
    views(spark, folder)
    return run_job(spark, "anomaly_report", {**RANGE, "severity": "critical"}).summary


@query("job_device_health", "SELECT * FROM health", {"health": HEALTH})
def device_health(spark, folder):
    views(spark, folder)
    return run_job(spark, "device_health", {"as_of": V.AS_OF}).rows


@query("job_trend_analysis", "SELECT * FROM trends WHERE metric = 'purchase'", {"trends": TRENDS})
def trend_analysis(spark, folder):
    views(spark, folder)
    return run_job(spark, "trend_analysis", {"metric": "purchase"}).rows


@query("job_trend_moving_average", """
    SELECT DISTINCT device_type, metric, CAST(floor(epoch(ts)) AS BIGINT) AS second,
           CAST(sum(value) OVER w AS DOUBLE) / count(value) OVER w AS moving_avg
    FROM telemetry
    WINDOW w AS (PARTITION BY device_type, metric ORDER BY CAST(floor(epoch(ts)) AS BIGINT)
                 RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)""")
def trend_moving_average(spark, folder):
    views(spark, folder)
    return run_job(spark, "trend_analysis", {"window_size": 6}).details["moving_average"]
