"""Grouped reports, health scores and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.operators import aggregates as G, health, trend
from fieldpulse.plans.catalog.oracle_views import AS_OF
from fieldpulse.plans.catalog.registry import query
from fieldpulse.schemas import INFERENCE_BUCKETS, PROCESSING_BUCKETS
from fieldpulse.sources import sample_views as V


def sensor_sql(unit: str) -> str:
    return f"""
    SELECT date_trunc('{unit}', ts)::TIMESTAMP AS period, device_type,
           CAST(sum(value) AS DOUBLE) / count(value) AS avg_value, CAST(min(value) AS DOUBLE) AS min_value,
           CAST(max(value) AS DOUBLE) AS max_value, count(value) AS count,
           round(stddev_samp(CAST(value AS DOUBLE)), 6) AS stddev_value
    FROM telemetry GROUP BY 1, 2"""


@query("c1_sensor_aggregation", sensor_sql("hour"))
def c1(spark, folder):
    out = G.sensor_aggregation(V.telemetry(spark, folder), "hour")
    return out.withColumn("stddev_value", F.round("stddev_value", 6))


@query("c1_sensor_aggregation_daily", sensor_sql("day"))
def c1_daily(spark, folder):
    out = G.sensor_aggregation(V.telemetry(spark, folder), "day")
    return out.withColumn("stddev_value", F.round("stddev_value", 6))


@query("c2_aggregation_summary", """
    SELECT count(*) AS total_rows,
           (SELECT count(*) FROM (SELECT DISTINCT date_trunc('hour', ts), device_type FROM telemetry)) AS aggregated_rows,
           count(DISTINCT device_id) AS unique_devices, count(DISTINCT device_type) AS unique_types,
           'hour' AS granularity FROM telemetry""")
def c2(spark, folder):
    return G.aggregation_summary(V.telemetry(spark, folder), "hour")


@query("c3_anomaly_report", """
    SELECT 'total' AS category, NULL AS key, count(*) AS count FROM alerts
    UNION ALL SELECT 'device_type', device_type, count(*) FROM alerts GROUP BY device_type
    UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY severity
    UNION ALL SELECT 'hour_of_day', CAST(hour(ts) AS VARCHAR), count(*) FROM alerts GROUP BY hour(ts)""")
def c3(spark, folder):
    return G.anomaly_report(V.alerts(spark, folder))


@query("c4_top_devices", """
    SELECT device_id, count(*) AS anomaly_count, min(device_type) AS device_type FROM alerts
    GROUP BY device_id ORDER BY anomaly_count DESC, device_id LIMIT 10""")
def c4(spark, folder):
    return G.top_devices(V.alerts(spark, folder))


@query("c5_anomaly_summary", """
    WITH a AS (SELECT * FROM alerts WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20')
    SELECT 'total' AS category, NULL AS key, count(*) AS count FROM a
    UNION ALL SELECT 'device_type', device_type, count(*) FROM a GROUP BY device_type
    UNION ALL SELECT 'severity', severity, count(*) FROM a GROUP BY severity""")
def c5(spark, folder):
    return G.anomaly_summary(V.alerts(spark, folder), V.AS_OF, "2024-01-10", "2024-01-20")


@query("c5_anomaly_summary_last_day", f"""
    WITH a AS (SELECT * FROM alerts WHERE ts >= {AS_OF} - INTERVAL 24 HOUR AND ts <= {AS_OF})
    SELECT 'total' AS category, NULL AS key, count(*) AS count FROM a
    UNION ALL SELECT 'device_type', device_type, count(*) FROM a GROUP BY device_type
    UNION ALL SELECT 'severity', severity, count(*) FROM a GROUP BY severity""")
def c5_last_day(spark, folder):
    return G.anomaly_summary(V.alerts(spark, folder), V.AS_OF)


def count_sql(table: str, column: str, where: str) -> str:
    return f"""
    WITH top AS (SELECT {column}, count(*) AS count FROM {table} WHERE {where}
                 GROUP BY 1 ORDER BY count DESC, 1 LIMIT 100)
    SELECT *, (SELECT CAST(sum(count) AS BIGINT) FROM top) AS total FROM top"""


WEEK = f"ts >= {AS_OF} - INTERVAL 7 DAY AND ts <= {AS_OF}"


@query("c6_telemetry_count", count_sql("telemetry", "device_id", WEEK + " AND device_type = 'smart_meter'"))
def c6_telemetry(spark, folder):
    return G.count_query(V.telemetry(spark, folder), V.alerts(spark, folder), "telemetry_count", V.AS_OF,
                         group_by="device_id", device_type="smart_meter")


@query("c6_anomaly_count", count_sql("alerts", "device_type", WEEK))
def c6_anomaly(spark, folder):
    return G.count_query(V.telemetry(spark, folder), V.alerts(spark, folder), "anomaly_count", V.AS_OF)


@query("c7_telemetry_stats", """
    SELECT device_type, count(*) AS readings, min(ts) AS earliest, max(ts) AS latest, 0 AS is_total FROM telemetry GROUP BY 1
    UNION ALL SELECT NULL, count(*), min(ts), max(ts), 1 FROM telemetry""")
def c7(spark, folder):
    return G.telemetry_stats(V.telemetry(spark, folder))


@query("c8_fleet_stats", """
    SELECT 'total' AS category, NULL AS key, count(*) AS count FROM devices
    UNION ALL SELECT 'device_type', device_type, count(*) FROM devices GROUP BY device_type
    UNION ALL SELECT 'status', status, count(*) FROM devices GROUP BY status""")
def c8(spark, folder):
    return G.fleet_stats(V.devices(spark, folder))


ORIGIN = trend.ORIGIN
TRENDS = f"""
    SELECT device_type, metric,
           CASE WHEN slope IS NULL OR n < 2 THEN 'stable'
                WHEN abs(slope * 3600) / greatest(abs(mean), 1e-10) < 0.01 THEN 'stable'
                WHEN slope > 0 THEN 'upward' ELSE 'downward' END AS trend_direction,
           round(coalesce(slope, 0.0), 8) AS slope,
           round(mean - coalesce(slope, 0.0) * (mean_x + {ORIGIN}), 4) AS intercept,
           round(CASE WHEN slope IS NULL OR syy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, r2)) END, 4) AS r_squared,
           round(mean, 4) AS avg_value, min_value, max_value, data_points
    FROM (SELECT device_type, metric, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy,
                 avg(x) AS mean_x, CAST(sum(value) AS DOUBLE) / count(value) AS mean, count(y) AS n,
                 min(y) AS min_value, max(y) AS max_value, count(*) AS data_points
          FROM (SELECT *, CAST(value AS DOUBLE) AS y, CAST(floor(epoch(ts)) - {ORIGIN} AS DOUBLE) AS x FROM telemetry)
          GROUP BY 1, 2)"""


@query("h1_trend_regression", "SELECT * FROM trends", {"trends": TRENDS})
def h1(spark, folder):
    return trend.linear_trends(V.telemetry(spark, folder))


@query("f1_strongest_trend", "SELECT device_type, metric, slope FROM trends ORDER BY abs(slope) DESC, device_type, metric",
       {"trends": TRENDS})
def f1(spark, folder):
    return trend.linear_trends(V.telemetry(spark, folder)).select("device_type", "metric", "slope")


@query("c9_trend_summary", """
    SELECT count(*) AS total_trends, count(*) FILTER (trend_direction = 'upward') AS upward_count,
           count(*) FILTER (trend_direction = 'downward') AS downward_count,
           count(*) FILTER (trend_direction = 'stable') AS stable_count FROM trends""", {"trends": TRENDS})
def c9(spark, folder):
    return trend.trend_summary(trend.linear_trends(V.telemetry(spark, folder)))


HEALTH = f"""
    SELECT device_id, device_type,
           round(greatest(0.0, 100.0 - rate * 50.0 - pen), 1) AS health_score, round(rate, 4) AS anomaly_rate,
           last_seen, total_readings, anomaly_count
    FROM (SELECT *, least(anomaly_count / total_readings, 1.0::DOUBLE) AS rate,
                 least((epoch({AS_OF}) - floor(epoch(last_seen))) / 3600.0, 50.0::DOUBLE) AS pen
          FROM (SELECT t.*, coalesce(a.n, 0) AS anomaly_count
                FROM (SELECT device_id, min(device_type) AS device_type, count(*) AS total_readings, max(ts) AS last_seen
                      FROM telemetry GROUP BY 1) t
                LEFT JOIN (SELECT device_id, count(*) AS n FROM alerts GROUP BY 1) a USING (device_id)))"""


@query("d1_device_health", "SELECT * FROM health", {"health": HEALTH})
def d1(spark, folder):
    return health.device_health(V.telemetry(spark, folder), V.alerts(spark, folder), V.AS_OF)


@query("f2_worst_devices", "SELECT device_id, health_score FROM health ORDER BY health_score, device_id", {"health": HEALTH})
def f2(spark, folder):
    scores = health.device_health(V.telemetry(spark, folder), V.alerts(spark, folder), V.AS_OF)
    return scores.select("device_id", "health_score")


@query("c10_health_summary", """
    SELECT count(*) AS total_devices,
           round(CAST(sum(CAST(health_score AS DECIMAL(12,1))) AS DOUBLE) / count(*), 1) AS avg_health_score,
           count(*) FILTER (health_score >= 80) AS healthy_count,
           count(*) FILTER (health_score >= 50 AND health_score < 80) AS degraded_count,
           count(*) FILTER (health_score < 50) AS critical_count FROM health""", {"health": HEALTH})
def c10(spark, folder):
    return health.health_summary(health.device_health(V.telemetry(spark, folder), V.alerts(spark, folder), V.AS_OF))


@query("d2_recent_health", f"""
    SELECT device_id, coalesce(t.device_type, 'unknown') AS device_type, coalesce(a.n, 0) AS anomaly_count,
           coalesce(t.n, 0) AS total_readings,
           round(CASE WHEN coalesce(t.n, 0) > 0 THEN greatest(0.0, 1.0 - coalesce(a.n, 0) / t.n)
                      WHEN coalesce(a.n, 0) = 0 THEN 1.0 ELSE 0.0 END, 4) AS health_score
    FROM (SELECT device_id, min(device_type) AS device_type, count(*) AS n FROM telemetry
          WHERE ts >= {AS_OF} - INTERVAL 24 HOUR GROUP BY 1) t
    FULL JOIN (SELECT device_id, count(*) AS n FROM alerts
               WHERE ts >= {AS_OF} - INTERVAL 24 HOUR GROUP BY 1) a USING (device_id)""")
def d2(spark, folder):
    return health.recent_health(V.telemetry(spark, folder), V.alerts(spark, folder), V.AS_OF)


@query("c11_experiment_summary", """
    SELECT job_id, CAST(min(value) FILTER (metric_name = 'train_loss') AS DOUBLE) AS best_train_loss,
           CAST(min(value) FILTER (metric_name = 'val_loss') AS DOUBLE) AS best_val_loss,
           count(DISTINCT epoch) AS total_epochs, max(ts) AS last_logged_at
    FROM experiment_metrics GROUP BY job_id""")
def c11(spark, folder):
    return G.experiment_summary(V.experiment_metrics(spark, folder))


@query("c12_inference_stats", """
    SELECT count(*) AS inference_count, round(CAST(sum(latency_ms) AS DOUBLE) / count(*), 3) AS avg_latency_ms,
           count(*) FILTER (is_anomaly) AS anomaly_count FROM inference_results""")
def c12(spark, folder):
    return G.inference_stats(V.inference_results(spark, folder))


@query("c13_received_by_type_and_protocol", """
    SELECT 'telemetry_received_total' AS metric, device_type, protocol, count(*) AS value
    FROM (SELECT device_type, CASE WHEN metric IN ('click', 'view') THEN 'mqtt' ELSE 'http' END AS protocol FROM telemetry)
    GROUP BY 2, 3""")
def c13_received(spark, folder):
    protocol = F.when(F.col("metric").isin("click", "view"), "mqtt").otherwise("http")
    df = V.telemetry(spark, folder).withColumn("protocol", protocol)
    return G.labelled_counter(df, "telemetry_received_total", ["device_type", "protocol"])


@query("c13_published_by_stream", """
    SELECT 'stream_messages_published_total' AS metric, stream, count(*) AS value
    FROM (SELECT 'raw_telemetry' AS stream FROM telemetry UNION ALL SELECT 'alerts' FROM alerts) GROUP BY 2""")
def c13_published(spark, folder):
    published = V.telemetry(spark, folder).select(F.lit("raw_telemetry").alias("stream")).unionAll(
        V.alerts(spark, folder).select(F.lit("alerts").alias("stream"))
    )
    return G.labelled_counter(published, "stream_messages_published_total", ["stream"])


@query("c13_consumed_by_stream_and_group", """
    SELECT 'stream_messages_consumed_total' AS metric, stream, consumer_group, count(*) AS value
    FROM acknowledgements GROUP BY 2, 3""")
def c13_consumed(spark, folder):
    return G.labelled_counter(V.acknowledgements(spark, folder), "stream_messages_consumed_total", ["stream", "consumer_group"])


@query("c13_anomalies_by_type_and_severity", """
    SELECT 'anomalies_detected_total' AS metric, device_type, severity, count(*) AS value FROM alerts GROUP BY 2, 3""")
def c13_anomalies(spark, folder):
    return G.labelled_counter(V.alerts(spark, folder), "anomalies_detected_total", ["device_type", "severity"])


def histogram_sql(table: str, labels: str, value: str, buckets) -> str:
    bounds = ", ".join(f"({b}::DOUBLE)" for b in buckets) + ", ('inf'::DOUBLE)"
    return f"""
    SELECT {labels}, le, count(*) FILTER ({value} <= le) AS cumulative, round(sum({value}), 6) AS sum, count({value}) AS total
    FROM {table}, (VALUES {bounds}) b(le) GROUP BY ALL"""


@query("c14_latency_histogram", histogram_sql("observed", "device_type, metric", "seconds", PROCESSING_BUCKETS),
       {"observed": "SELECT device_type, metric, CAST(value AS DOUBLE) / 200 AS seconds FROM telemetry"})
def c14(spark, folder):
    df = V.telemetry(spark, folder).withColumn("seconds", F.col("value").cast("double") / 200)
    out = G.latency_histogram(df, ["device_type", "metric"], "seconds", PROCESSING_BUCKETS)
    return out.withColumn("sum", F.round("sum", 6))


@query("c14_inference_histogram", histogram_sql("observed", "device_type", "seconds", INFERENCE_BUCKETS),
       {"observed": "SELECT device_type, CAST(latency_ms AS DOUBLE) / 1000 AS seconds FROM inference_results"})
def c14_inference(spark, folder):
    df = V.inference_results(spark, folder).withColumn("seconds", F.col("latency_ms").cast("double") / 1000)
    out = G.latency_histogram(df, ["device_type"], "seconds", INFERENCE_BUCKETS)
    return out.withColumn("sum", F.round("sum", 6))


@query("c15_active_devices", """
    SELECT device_type, count(*) AS active_devices, 0 AS is_total FROM devices WHERE status = 'active' GROUP BY 1
    UNION ALL SELECT NULL, count(*), 1 FROM devices WHERE status = 'active'""")
def c15(spark, folder):
    return G.active_devices(V.devices(spark, folder))


NORMAL_PATH = """'/' || array_to_string([CASE WHEN len(s) > 20 OR (regexp_matches(s, '[0-9]') AND contains(s, '-'))
    THEN ':id' ELSE s END for s in string_split(trim(path, '/'), '/')], '/')"""


@query("c16_http_requests", f"""
    SELECT 'http_requests_total' AS metric, method, {NORMAL_PATH} AS path, status_code, count(*) AS value
    FROM requests GROUP BY ALL""")
def c16(spark, folder):
    return G.http_metrics(V.requests(spark, folder))[0]


@query("c16_http_latency", histogram_sql("observed", "method, path", "latency_seconds",
                                         (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)),
       {"observed": f"SELECT method, {NORMAL_PATH} AS path, latency_seconds FROM requests"})
def c16_latency(spark, folder):
    return G.http_metrics(V.requests(spark, folder))[1].withColumn("sum", F.round("sum", 6))


FIRING = """
    SELECT id, ts, severity, 'value_of_' || CAST(device_id AS VARCHAR) AS alertname, device_type AS service FROM alerts"""


def firing(spark, folder):
    return V.alerts(spark, folder).select(
        "id", "ts", "severity",
        F.concat(F.lit("value_of_"), F.col("device_id").cast("string")).alias("alertname"),
        F.col("device_type").alias("service"),
    )


@query("c18_alert_groups", """
    SELECT alertname, service, count(*) AS count, min(ts) AS first_at, max(ts) AS last_at FROM firing GROUP BY 1, 2""",
       {"firing": FIRING})
def c18(spark, folder):
    return G.alert_groups(firing(spark, folder))


MOVING_AVERAGE = """
    SELECT id, device_type, metric, ts, CAST(value AS DOUBLE) AS value,
           CAST(sum(value) OVER w AS DOUBLE) / count(value) OVER w AS moving_avg
    FROM telemetry
    WINDOW w AS (PARTITION BY device_type, metric ORDER BY CAST(floor(epoch(ts)) AS BIGINT)
                 RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"""


@query("e1_moving_average", MOVING_AVERAGE.format(seconds=24 * 3600))
def e1(spark, folder):
    return trend.moving_average(V.telemetry(spark, folder).select("id", "device_type", "metric", "ts", "value"))


@query("e1_moving_average_1h", MOVING_AVERAGE.format(seconds=3600))
def e1_hour(spark, folder):
    return trend.moving_average(V.telemetry(spark, folder).select("id", "device_type", "metric", "ts", "value"), hours=1)
