"""Scans, sinks, decoding, filters and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.operators import decode, filters
from fieldpulse.operators.aggregates import sensor_aggregation
from fieldpulse.plans.catalog.oracle_views import AS_OF as SQL_AS_OF, INGEST_VIEWS, LONG_FLAT, nested_numbers
from fieldpulse.plans.catalog.registry import query
from fieldpulse.session import scratch_path
from fieldpulse.sources import sample_views as V, sinks, tables

TELEMETRY_ROWS = "SELECT id, device_id, device_type, metric, CAST(value AS DOUBLE) AS value, ts FROM telemetry"


@query("a1_table_scan", "SELECT * FROM events")
def a1(spark, folder):
    return tables.read_table(spark, f"{folder}/events.parquet", V.SCHEMAS["events"])


@query("a2_query_scan", """
    SELECT device_type, metric, count(*) AS n, CAST(max(value) AS DOUBLE) AS max_value
    FROM telemetry WHERE value >= 10 AND ts >= TIMESTAMP '2024-01-05' GROUP BY device_type, metric""")
def a2(spark, folder):
    return tables.read_query(
        spark,
        "SELECT device_type, metric, count(*) AS n, max(value) AS max_value FROM {telemetry} "
        "WHERE value >= 10 AND ts >= TIMESTAMP '2024-01-05' GROUP BY device_type, metric",
        {"telemetry": V.telemetry(spark, folder)},
    )


@query("a3_table_sink", TELEMETRY_ROWS)
def a3(spark, folder):
    path = scratch_path(spark, "readings")
    sinks.write_readings(V.telemetry(spark, folder), path, "error")
    return spark.read.parquet(path).select("id", "device_id", "device_type", "metric", "value", "ts")


@query("a4_csv_export", """
    SELECT date_trunc('hour', ts) AS period, device_type, count(value) AS count,
           CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value
    FROM telemetry GROUP BY 1, 2""")
def a4(spark, folder):
    path = scratch_path(spark, "export")
    report = sensor_aggregation(V.telemetry(spark, folder)).select("period", "device_type", "count", "min_value", "max_value")
    sinks.export_csv(report, path)
    columns = "period timestamp, device_type string, count bigint, min_value double, max_value double"
    return spark.read.option("header", True).schema(columns).csv(path)


@query("a5_message_decode", """
    SELECT id, device_id, device_type, ts, payload, decode_error FROM checked""", INGEST_VIEWS)
def a5(spark, folder):
    return decode.decode_messages(V.messages(spark, folder)).select(
        "id", "device_id", "device_type", "ts", "payload", "decode_error"
    )


@query("a6_log_entries", """
    SELECT id, CAST(device_id AS VARCHAR) AS device_id,
           CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
           '{"payload":' || payload || '}' AS entry, ts, CAST(json(payload) AS VARCHAR) AS payload
    FROM readings""")
def a6(spark, folder):
    readings = V.readings(spark, folder).withColumn("metadata", F.lit("{}"))
    entries = decode.to_log_entries(readings).withColumn("entry", F.col("payload"))
    back = decode.from_log_entries(entries, keep=["timestamp", "entry"])
    return back.select("id", "timestamp", "entry", "device_id", "ts", "payload")


@query("a7_batch_ingest", """
    SELECT count(*) FILTER (coalesce(decode_error, rule) IS NULL) AS accepted,
           count(*) FILTER (coalesce(decode_error, rule) IS NOT NULL) AS rejected FROM checked""", INGEST_VIEWS)
def a7(spark, folder):
    counts = sinks.ingest_batch(decode.ingest(V.messages(spark, folder)), scratch_path(spark, "ingest"))
    return spark.createDataFrame([counts], "accepted bigint, rejected bigint")


@query("a7_ingest_errors", """
    SELECT id, coalesce(decode_error, rule) AS reject_reason FROM checked WHERE coalesce(decode_error, rule) IS NOT NULL""", INGEST_VIEWS)
def a7_errors(spark, folder):
    rejected = scratch_path(spark, "rejected")
    sinks.ingest_batch(decode.ingest(V.messages(spark, folder)), scratch_path(spark, "ingest"), rejected_path=rejected)
    return spark.read.parquet(rejected).select("id", "reject_reason")


@query("a11_bad_record_split", """
    SELECT id, coalesce(decode_error, rule) IS NULL AS good, coalesce(decode_error, rule) AS reject_reason
    FROM checked""", INGEST_VIEWS)
def a11(spark, folder):
    checked = decode.ingest(V.messages(spark, folder)).select("id", "reject_reason")
    good, bad = sinks.write_split(checked, scratch_path(spark, "split"))
    return good.select("id", F.lit(True).alias("good"), F.lit(None).cast("string").alias("reject_reason")).unionAll(
        bad.select("id", F.lit(False).alias("good"), "reject_reason")
    )


@query("a12_newest", f"{TELEMETRY_ROWS} ORDER BY ts DESC, id DESC LIMIT 20")
def a12(spark, folder):
    return tables.newest(V.telemetry(spark, folder).drop("payload"))


@query("a13_incremental_tail", f"{TELEMETRY_ROWS} WHERE id > 400 ORDER BY id LIMIT 50")
def a13(spark, folder):
    return tables.after_cursor(V.telemetry(spark, folder).drop("payload"), 400)


@query("a14_retention_trim", f"{TELEMETRY_ROWS} WHERE id > (SELECT max(id) - 4321 FROM telemetry)")
def a14(spark, folder):
    return tables.keep_newest(V.telemetry(spark, folder).drop("payload"), 4321)


@query("a15_stream_length", """
    SELECT 'raw_telemetry' AS stream, count(*) AS length FROM telemetry
    UNION ALL SELECT 'alerts', count(*) FROM alerts""")
def a15(spark, folder):
    return tables.stream_lengths({"raw_telemetry": V.telemetry(spark, folder), "alerts": V.alerts(spark, folder)})


@query("a16_pending_entries", """
    SELECT d.* FROM deliveries d LEFT JOIN acknowledgements a USING (stream, consumer_group, id)
    WHERE a.id IS NULL""")
def a16(spark, folder):
    return tables.pending_entries(V.deliveries(spark, folder), V.acknowledgements(spark, folder))


@query("b1_time_range", f"{TELEMETRY_ROWS} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'")
def b1(spark, folder):
    return filters.time_range(V.telemetry(spark, folder).drop("payload"), "2024-01-05T00:00:00", "2024-01-09 12:00:00")


@query("b2_equality_filters", f"{TELEMETRY_ROWS} WHERE device_type = 'smart_meter' AND metric = 'click'")
def b2(spark, folder):
    return filters.apply_filters(
        V.telemetry(spark, folder).drop("payload"), device_type="smart_meter", device_id=None, metric="click"
    )


@query("b3_relative_window", f"""
    {TELEMETRY_ROWS} WHERE ts >= {SQL_AS_OF} - INTERVAL 24 HOUR AND ts <= {SQL_AS_OF}""")
def b3(spark, folder):
    return filters.last_hours(V.telemetry(spark, folder).drop("payload"), V.AS_OF, 24)


@query("b4_timestamp_cast", "SELECT id, ts FROM readings")
def b4(spark, folder):
    text = V.readings(spark, folder).select("id", F.col("ts").cast("string").alias("ts"))
    return filters.cast_timestamp(text)


@query("b5_point_lookup", "SELECT id, name, device_type, status, last_seen_at FROM devices WHERE id = 7")
def b5(spark, folder):
    return filters.point_lookup(V.devices(spark, folder), 7)


@query("b6_validation", "SELECT id, rule AS reject_reason FROM checked", INGEST_VIEWS)
def b6(spark, folder):
    return decode.validate(decode.decode_messages(V.messages(spark, folder)), F.col("arrived_at")).select("id", "reject_reason")


@query("b7_telemetry_listing", """
    SELECT id, device_id, ts, (SELECT count(*) FROM telemetry WHERE device_type = 'gps_tracker') AS total
    FROM telemetry WHERE device_type = 'gps_tracker' ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 50""")
def b7_telemetry(spark, folder):
    df = filters.apply_filters(V.telemetry(spark, folder), device_type="gps_tracker").select("id", "device_id", "ts")
    return filters.listing(df, [F.desc("ts"), F.desc("id")], 100, 50)


@query("b7_device_listing", """
    SELECT id, name, last_seen_at, (SELECT count(*) FROM devices) AS total FROM devices
    ORDER BY last_seen_at DESC NULLS LAST, id LIMIT 200 OFFSET 20""")
def b7_devices(spark, folder):
    df = V.devices(spark, folder).select("id", "name", "last_seen_at")
    return filters.listing(df, [F.desc_nulls_last("last_seen_at"), F.asc("id")], 200, 20)


@query("b7_model_listing", """
    SELECT id, name, version, (SELECT count(*) FROM ml_models WHERE is_active) AS total FROM ml_models WHERE is_active
    ORDER BY created_at DESC, id DESC LIMIT 100""")
def b7_models(spark, folder):
    df = filters.active_only(V.ml_models(spark, folder)).select("id", "name", "version", "created_at")
    return filters.listing(df, [F.desc("created_at"), F.desc("id")], 100).drop("created_at")


@query("b7_firmware_listing", """
    SELECT firmware_id, version, (SELECT count(*) FROM firmware_versions WHERE device_type = 'smart_meter') AS total
    FROM firmware_versions WHERE device_type = 'smart_meter' ORDER BY firmware_id DESC LIMIT 50""")
def b7_firmware(spark, folder):
    df = filters.apply_filters(V.firmware_versions(spark, folder), device_type="smart_meter").select("firmware_id", "version")
    return filters.listing(df, [F.desc("firmware_id")], 50)


@query("b8_active_models", "SELECT * FROM ml_models WHERE is_active")
def b8(spark, folder):
    return filters.active_only(V.ml_models(spark, folder))


@query("b9_long_metrics", LONG_FLAT)
def b9(spark, folder):
    return decode.long_metrics(V.readings(spark, folder))


@query("b9_long_metrics_nested", f"""
    SELECT id, CAST(p - 1 AS INTEGER) AS position, v AS value
    FROM (SELECT id, unnest(vals) AS v, generate_subscripts(vals, 1) AS p
          FROM (SELECT id, {nested_numbers()} AS vals FROM readings))""")
def b9_nested(spark, folder):
    return decode.long_metrics(V.readings(spark, folder), nested=True).select("id", "position", "value")


@query("b10_response_projection", """
    SELECT id AS reading_id, device_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, payload FROM readings""")
def b10(spark, folder):
    return filters.response(
        V.readings(spark, folder),
        {"id": "reading_id", "device_id": "device_id", "ts": "timestamp", "payload": "payload"}, ["ts"],
    )
