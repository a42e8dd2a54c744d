"""Streaming jobs run to the end of the given log, then read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldpulse.functions.scalar import alert_severity
from fieldpulse.operators import aggregates as G, detect, features
from fieldpulse.operators.decode import decode_messages, to_log_entries
from fieldpulse.operators.windows import latest_per_key
from fieldpulse.plans.catalog.oracle_views import INGEST_VIEWS
from fieldpulse.plans.catalog.ordered import VECTOR_VIEWS
from fieldpulse.plans.catalog.registry import query
from fieldpulse.plans.catalog.scans import TELEMETRY_ROWS
from fieldpulse.schemas import CONSUMER_GROUPS
from fieldpulse.session import materialize, scratch_path
from fieldpulse.sources import dated, sample_views as V, tables
from fieldpulse.streaming import batches, feed, jobs, lateness, stateful

READING_COLUMNS = "id bigint, device_id string, device_type string, ts timestamp, payload string"
READING_ROWS = "SELECT id, CAST(device_id AS VARCHAR) AS device_id, device_type, ts, payload FROM readings"


FEW_BUCKETS = 64  # groups of the sample's 1,500 devices


def finish(started) -> None:
    started.awaitTermination()


def read_batches(spark, path):
    return spark.read.parquet(path)


@query("a8_stream_append", TELEMETRY_ROWS)
def a8(spark, folder):
    path = scratch_path(spark, "stream")
    stream = V.telemetry_stream(spark, folder).drop("payload")
    finish(jobs.append_job(stream, path, scratch_path(spark, "checkpoint"), "ts", available_now=True))
    return read_batches(spark, path).drop("batch_id", "date")


def dated_telemetry(spark, folder, name):
    """The telemetry log, written by day and batch."""
    path = scratch_path(spark, name)
    stream = V.telemetry_stream(spark, folder).drop("payload")
    finish(jobs.append_job(stream, path, scratch_path(spark, "checkpoint"), "ts", available_now=True))
    return path


@query("a8_gathered_days", TELEMETRY_ROWS)
def a8_gathered(spark, folder):
    batches = read_batches(spark, dated_telemetry(spark, folder, "stream"))
    gathered = scratch_path(spark, "gathered")
    jobs.compact_days(batches, gathered, "2024-01-02", "2024-01-20")
    return dated.with_gathered(batches, read_batches(spark, gathered)).drop("date")


@query("a14_dated_retention", f"""
    SELECT * FROM ({TELEMETRY_ROWS}) QUALIFY row_number() OVER (ORDER BY ts DESC, id DESC) <= 4321""")
def a14_dated(spark, folder):
    log = read_batches(spark, dated_telemetry(spark, folder, "stream"))
    return dated.keep_newest_days(log, 4321).drop("batch_id", "date")


@query("a15_day_lengths", """
    SELECT 'raw_telemetry' AS stream, CAST(ts AS DATE) AS date, count(*) AS length FROM telemetry GROUP BY ALL""")
def a15_days(spark, folder):
    return dated.day_lengths({"raw_telemetry": read_batches(spark, dated_telemetry(spark, folder, "stream"))})


@query("a9_consumer_groups", """
    SELECT g AS consumer_group, count(*) AS entries, min(id) AS first_id, max(id) AS last_id
    FROM telemetry, (VALUES ('ml_inference'), ('data_persistence'), ('alert_handler')) v(g) GROUP BY g""")
def a9(spark, folder):
    running = []
    for group in CONSUMER_GROUPS:
        path = scratch_path(spark, group)
        entries = V.telemetry_stream(spark, folder, 1).select("id", F.lit(group).alias("consumer_group"))
        running.append((path, jobs.append_job(entries, path, scratch_path(spark, "checkpoint"), available_now=True)))
    read = []
    for path, job in running:
        finish(job)
        read.append(read_batches(spark, path))
    return reduce(DataFrame.unionByName, read).groupBy("consumer_group").agg(
        F.count(F.lit(1)).alias("entries"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("a10_micro_batch_flush", READING_ROWS)
def a10(spark, folder):
    """Every batch is flushed twice, as after a crash between writing and confirming."""
    path = scratch_path(spark, "flush")
    readings = V.readings_of(V.telemetry_stream(spark, folder, 1)).withColumn("device_id", F.col("device_id").cast("string"))

    def flush_twice(df, n):
        batches.write_batch(df, path, n, flush_rows=batches.FLUSH_ROWS)
        batches.write_batch(df, path, n, flush_rows=batches.FLUSH_ROWS)

    finish(batches.start(readings, flush_twice, scratch_path(spark, "checkpoint"), available_now=True))
    return read_batches(spark, path).drop("batch_id")


@query("i1_ingest", """
    SELECT id, device_id, ts, payload, coalesce(decode_error, rule) AS reject_reason FROM checked""", INGEST_VIEWS)
def i1(spark, folder):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "quarantine")
    messages = V.messages_of(V.readings_of(V.telemetry_stream(spark, folder)))
    finish(jobs.ingest_job(messages, good, bad, scratch_path(spark, "checkpoint"), available_now=True))
    accepted = read_batches(spark, good).select("id", "device_id", "ts", "payload", F.lit(None).cast("string").alias("reject_reason"))
    return accepted.unionByName(read_batches(spark, bad).select("id", "device_id", "ts", "payload", "reject_reason"))


@query("i2_persist", READING_ROWS.replace("payload FROM", "CAST(json(payload) AS VARCHAR) AS payload FROM"))
def i2(spark, folder):
    path = scratch_path(spark, "persisted")
    readings = V.readings_of(V.telemetry_stream(spark, folder)).withColumn("metadata", F.lit("{}"))
    finish(jobs.persist_job(to_log_entries(readings), path, scratch_path(spark, "checkpoint"), available_now=True))
    return read_batches(spark, path).select("id", "device_id", "device_type", "ts", "payload")


@query("i3_stateful_scoring")
def i3(spark, folder):
    history = features.feature_vectors(V.readings(spark, folder)).select("id", "features")
    forest = detect.train_forest(materialize(history, "vectors"))
    results, alerts = scratch_path(spark, "results"), scratch_path(spark, "alerts")
    vectors = stateful.stateful_features(V.readings_of(V.telemetry_stream(spark, folder)), buckets=FEW_BUCKETS)
    finish(jobs.scoring_job(vectors, forest, results, alerts, scratch_path(spark, "checkpoint"), available_now=True))
    # severity follows from the score, so the alerts need not be joined back
    return read_batches(spark, results).select(
        "id", "device_id", "features", "anomaly_score", alert_severity(F.col("anomaly_score")).alias("severity")
    )


@query("i3_stateful_features", "SELECT id, " + ", ".join(f"round(f[{i + 1}], 6) AS f{i}" for i in range(8)) + " FROM vectors",
       VECTOR_VIEWS)
def i3_features(spark, folder):
    path = scratch_path(spark, "vectors")
    vectors = stateful.stateful_features(V.readings_of(V.telemetry_stream(spark, folder)), buckets=FEW_BUCKETS)
    finish(jobs.append_job(vectors, path, scratch_path(spark, "checkpoint"), available_now=True))
    return read_batches(spark, path).select(
        "id", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(8)]
    )


def window_sql(width: str, where: str = "true") -> str:
    return f"""
    SELECT time_bucket(INTERVAL '{width}', ts) AS window_start, time_bucket(INTERVAL '{width}', ts) + INTERVAL '{width}' AS window_end,
           device_type, count(*) AS count FROM telemetry WHERE {where} GROUP BY ALL"""


@query("i4_ingest_rate_5m", window_sql("5 minutes"))
def i4_ingest(spark, folder):
    path, late = scratch_path(spark, "windows"), scratch_path(spark, "late")
    stream = V.telemetry_stream(spark, folder)
    finish(jobs.window_count_job(stream, "5 minutes", path, late, scratch_path(spark, "checkpoint"), ["device_type"], available_now=True))
    return jobs.final_windows(read_batches(spark, path), ["device_type"])


@query("i4_anomaly_rate_1h", window_sql("1 hour", "metric = 'error'"))
def i4_anomaly(spark, folder):
    path, late = scratch_path(spark, "windows"), scratch_path(spark, "late")
    stream = V.telemetry_stream(spark, folder).filter(F.col("metric") == "error")
    finish(jobs.window_count_job(stream, "1 hour", path, late, scratch_path(spark, "checkpoint"), ["device_type"], available_now=True))
    return jobs.final_windows(read_batches(spark, path), ["device_type"])


@query("i5_late_and_early", """
    SELECT CASE WHEN ts < arrived_at - INTERVAL 24 HOUR THEN 'late' WHEN ts > arrived_at + INTERVAL 5 MINUTE THEN 'early'
                ELSE 'on_time' END AS arrival, id FROM checked WHERE decode_error IS NULL""", INGEST_VIEWS)
def i5(spark, folder):
    path = scratch_path(spark, "arrival")
    decoded = decode_messages(V.messages_of(V.readings_of(V.telemetry_stream(spark, folder)))).filter("decode_error IS NULL")
    classed = decoded.select(jobs.arrival_class().alias("arrival"), "id")
    finish(jobs.append_job(classed, path, scratch_path(spark, "checkpoint"), available_now=True))
    return read_batches(spark, path).drop("batch_id")


@query("i6_redelivery", READING_ROWS)
def i6(spark, folder):
    """Every reading is delivered twice with a new id; its content decides."""
    path = scratch_path(spark, "unique")
    readings = V.readings_of(V.telemetry_stream(spark, folder)).withColumn("device_id", F.col("device_id").cast("string"))
    twice = readings.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    log, late = scratch_path(spark, "on-time"), scratch_path(spark, "late")
    finish(lateness.on_time_log_job(twice, log, late, scratch_path(spark, "checkpoint"), available_now=True))
    unique = jobs.without_redelivery(lateness.on_time_stream(spark, log, READING_COLUMNS)).drop("content_id")
    finish(jobs.append_job(unique, path, scratch_path(spark, "checkpoint"), available_now=True))
    return read_batches(spark, path).drop("batch_id")


@query("i7_live_feed", """
    SELECT 'reading' AS kind, id, ts, (SELECT count(*) FROM telemetry) AS stream_length, (SELECT count(*) FROM alerts) AS alert_count
    FROM (SELECT * FROM telemetry WHERE id > 700 ORDER BY id LIMIT 50)
    UNION ALL
    SELECT 'alert', id, ts, (SELECT count(*) FROM telemetry), (SELECT count(*) FROM alerts)
    FROM (SELECT * FROM alerts WHERE id > 500 ORDER BY id LIMIT 50)""")
def i7(spark, folder):
    return tables.live_feed(V.telemetry(spark, folder), V.alerts(spark, folder), 700, 500)


@query("i7_feed_stream", """
    SELECT 'reading' AS kind, id, ts, (SELECT count(*) FROM telemetry) AS reading_length, (SELECT count(*) FROM alerts) AS alert_length FROM telemetry
    UNION ALL SELECT 'alert', id, ts, (SELECT count(*) FROM telemetry), (SELECT count(*) FROM alerts) FROM alerts""")
def i7_stream(spark, folder):
    telemetry = V.telemetry_stream(spark, folder)
    streams = {"reading": telemetry, "alert": telemetry.filter(F.col("metric") == "error")}
    paths = {kind: scratch_path(spark, f"feed-{kind}") for kind in streams}
    running = [feed.feed_job(stream, paths[kind], scratch_path(spark, "checkpoint"), available_now=True) for kind, stream in streams.items()]
    for started in running:
        finish(started)
    return feed.poll_feed(spark, paths, "id bigint, ts timestamp")[0]


@query("i8_liveness", """
    SELECT CAST(device_id AS VARCHAR) AS node_id,
           CASE WHEN silent > 2 * 43200000 THEN 'dead' WHEN silent > 43200000 THEN 'suspect' ELSE 'alive' END AS status
    FROM (SELECT device_id, (SELECT max(epoch_ms(ts)) FROM telemetry) - max(epoch_ms(ts)) AS silent FROM telemetry GROUP BY 1)""")
def i8(spark, folder):
    path = scratch_path(spark, "liveness")
    beats = V.telemetry_stream(spark, folder).select(F.col("device_id").alias("node_id"), "ts")
    log, late = scratch_path(spark, "on-time"), scratch_path(spark, "late")
    finish(lateness.on_time_log_job(beats, log, late, scratch_path(spark, "checkpoint"), lateness="0 seconds", available_now=True))
    beats = lateness.on_time_stream(spark, log, "node_id bigint, ts timestamp")
    changes = stateful.liveness_changes(beats, timeout_seconds=12 * 3600, event_time=True, lateness="0 seconds")
    finish(jobs.append_job(changes, path, scratch_path(spark, "checkpoint"), available_now=True))
    return latest_per_key(read_batches(spark, path), ["node_id"], ["batch_id", "changed_at_ms"]).select("node_id", "status")


@query("i9_throughput", """
    SELECT time_bucket(INTERVAL '2 seconds', ts) AS window_start, round(count(*) / 2, 1) AS readings_per_second
    FROM telemetry GROUP BY 1""")
def i9(spark, folder):
    path, late = scratch_path(spark, "throughput"), scratch_path(spark, "late")
    stream = V.telemetry_stream(spark, folder)
    finish(jobs.window_count_job(stream, "2 seconds", path, late, scratch_path(spark, "checkpoint"), available_now=True))
    return G.rate_of(jobs.final_windows(read_batches(spark, path)), 2)
