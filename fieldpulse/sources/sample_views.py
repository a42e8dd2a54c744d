"""The fleet's tables expressed over the given sample tables.

Every view covers its whole source table. The schemas given to the reader make
`ts` a TIMESTAMP at the scan (the files hold naive UTC times), so that time
filters stay pushable and no cast stands between a filter and the column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldpulse.schemas import CONSUMER_GROUPS, DEVICE_STATUSES, DEVICE_TYPES, NODE_STATUSES, PROCESSING_BUCKETS, RAW_TELEMETRY
from fieldpulse.sources.tables import read_log, read_table, spread

AS_OF = "2024-01-31 00:00:00"
MONEY = "decimal(12,2)"

SCHEMAS = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def device_type_of(key: Column) -> Column:
    return pick(DEVICE_TYPES, key % 5)


def device_uuid(key: Column) -> Column:
    h = F.md5(key.cast("string"))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def money(column: str) -> Column:
    return F.col(column).cast(MONEY)


def telemetry_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("device_id"),
        device_type_of(F.col("user_id")).alias("device_type"),
        F.col("event_type").alias("metric"),
        money("value").alias("value"),
        "ts",
        F.col("props").alias("payload"),
    )


def telemetry(spark, folder) -> DataFrame:
    return telemetry_of(table(spark, folder, "events"))


def telemetry_stream(spark, folder, max_files: int | None = None) -> DataFrame:
    # a pattern, because the table may be one file or a folder of files
    return telemetry_of(read_log(spark, f"{folder}/events.parquet*", SCHEMAS["events"], max_files))


def alerts(spark, folder) -> DataFrame:
    value = F.col("value")
    return telemetry(spark, folder).filter(F.col("metric") == "error").select(
        "id", "device_id", "device_type", "ts", "value",
        F.when(value >= 50, "critical").when(value >= 20, "warning").otherwise("info").alias("severity"),
        F.least(value.cast("double") / 100, F.lit(1.0)).alias("anomaly_score"),
    )


def devices(spark, folder) -> DataFrame:
    seen = telemetry(spark, folder).groupBy("device_id").agg(F.max("ts").alias("last_seen_at"))
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .join(seen, key == F.col("device_id"), "left")
        .select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            device_type_of(key).alias("device_type"),
            pick(DEVICE_STATUSES[:5], F.floor(key / 5) % 5).alias("status"),
            "last_seen_at",
        )
    )


def readings_of(t: DataFrame) -> DataFrame:
    """Telemetry as one JSON payload per reading: mixed types, nested, empty and number-free ones."""
    key = F.col("id")
    k = F.get_json_object("payload", "$.k")
    full = F.concat(
        F.lit('{"'), F.col("metric"), F.lit('":'), F.col("value").cast("string"),
        F.lit(',"k":'), k, F.lit(',"unit":"u","anomaly":'),
        F.when(F.col("metric") == "error", "true").otherwise("false"),
        F.when(key % 4 == 0, F.concat(F.lit(',"nested":{"z":'), k, F.lit(',"a":0.5,"t":"x"}'))).otherwise(""),
        F.when(key % 6 == 0, ',"note":"3.5"').otherwise(""),
        F.lit("}"),
    )
    payload = F.when(key % 17 == 3, "{}").when(key % 17 == 5, '{"unit":"u"}').otherwise(full)
    return t.select("id", "device_id", "device_type", "ts", payload.alias("payload"))


def readings(spark, folder) -> DataFrame:
    return readings_of(spread(telemetry(spark, folder)))


def messages_of(r: DataFrame) -> DataFrame:
    """Raw messages with the defects a real feed has: missing keys, bad JSON, late and early times."""
    key = F.col("id")
    r = r.withColumn("_uuid", device_uuid(F.col("device_id")))
    uuid, case = F.col("_uuid"), key % 20
    quoted = lambda name, v: F.concat(F.lit(f'"{name}":"'), v, F.lit('"'))
    stamp = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(case == 8, "+00:00").otherwise("")
    )
    parts = [
        F.when(~case.isin(0, 1), quoted("device_id", F.when(case == 6, "not-a-uuid").otherwise(uuid))),
        F.when(case != 4, quoted("device_type", F.col("device_type"))),
        F.when(case != 5, quoted("timestamp", stamp)),
        F.when(case == 2, F.concat(F.lit('"temperature":'), F.col("device_id").cast("string"),
                                   F.lit(',"humidity":'), (key % 100).cast("string")))
         .when(case == 9, '"payload":12')
         .when(case == 7, '"payload":{}')
         .otherwise(F.concat(F.lit('"payload":'), F.col("payload"))),
        F.lit('"metadata":{"firmware_version":"1.0.0"}'),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(case == 3, "").otherwise("}"))
    late = (
        F.when(key % 23 == 7, F.expr("INTERVAL '25' HOUR"))
        .when(key % 23 == 11, F.expr("INTERVAL '-10' MINUTE"))
        .otherwise(F.expr("INTERVAL '1' SECOND"))
    )
    return r.select(
        "id",
        F.when(case == 1, "devices/telemetry")
         .otherwise(F.concat(F.lit("devices/"), uuid, F.lit("/telemetry"))).alias("topic"),
        body.alias("body"),
        (F.col("ts") + late).alias("arrived_at"),
    )


def messages(spark, folder) -> DataFrame:
    return messages_of(readings(spark, folder))


def device_events(spark, folder) -> DataFrame:
    """Lifecycle log: created, updated (to some status) and decommission requests."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("device_id"),
        F.when(F.col("o_orderstatus") == "F", "created").when(F.col("o_orderstatus") == "O", "updated")
         .otherwise("decommissioned").alias("event_type"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 11 == 5), "decommissioned")
         .when(F.col("o_orderstatus") == "O",
               pick(("provisioned", "active", "active", "inactive"), F.col("o_orderkey") % 4)).alias("status"),
        F.concat(F.lit("fw-"), (F.col("o_orderkey") % 9).cast("string")).alias("firmware"),
        F.col("o_orderdate").alias("ts"),
    )


def device_changes(spark, folder) -> DataFrame:
    """The lifecycle log with all fields; an update names only some of them."""
    key, new = F.col("event_id"), F.col("event_type") == "created"
    changed = lambda every, value: F.when((F.col("event_type") == "updated") & (key % every == 0), value)
    at_first = lambda value, later: F.when(new, value).otherwise(later)
    return device_events(spark, folder).select(
        "event_id", "device_id", "event_type",
        F.when(key % 13 != 1, F.col("status")).alias("status"),
        F.when(new | (key % 3 == 1), F.col("firmware")).alias("firmware"),
        at_first(F.concat(F.lit("device-"), F.col("device_id").cast("string")), changed(5, F.concat(F.lit("renamed-"), (key % 50).cast("string")))).alias("name"),
        at_first(F.lit("smart_meter"), changed(7, F.concat(F.lit("type-"), (key % 4).cast("string")))).alias("device_type"),
        at_first(F.lit("{}"), changed(2, F.concat(F.lit('{"zone":"z'), (key % 6).cast("string"), F.lit('"}')))).alias("metadata"),
        "ts",
    )


def node_reports(spark, folder) -> DataFrame:
    """One current report per node, some of them stale."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("node_id"),
        (key * 37 % 100).cast("double").alias("cpu"),
        (key * 53 % 100).cast("double").alias("mem"),
        (key * 17 % 120).cast("double").alias("latency_ms"),
        F.timestamp_seconds(F.unix_seconds(as_of()) - key % 45).alias("last_reported"),
    )


def node_report_log(spark, folder) -> DataFrame:
    """Many reports per node, in time order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("node_id"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("cpu"),
        money("l_extendedprice").alias("mem"),
    )


def tasks(spark, folder) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("task_id"),
        F.floor(money("o_totalprice") * 100).cast("bigint").alias("input_size_bytes"),
        (20 + key % 180).cast("double").alias("max_latency_ms"),
        (key % 12).alias("requesting_node_id"),
    )


def requests(spark, folder) -> DataFrame:
    """Requests against the gateway, one per event."""
    t, key = telemetry(spark, folder), F.col("id")
    return t.select(
        "id", "ts",
        F.col("device_id").alias("client_id"),
        pick(("admin", "user", "device", "guest"), F.col("device_id") % 4).alias("role"),
        F.when(key % 11 == 4, "/health")
         .otherwise(F.concat(F.lit("/api/v1/devices/"), device_uuid(F.col("device_id")), F.lit("/"), F.col("metric")))
         .alias("path"),
        F.when(F.col("metric") == "view", "GET").otherwise("POST").alias("method"),
        F.when(F.col("metric") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value").cast("double") / 100).alias("latency_seconds"),
    )


def counters(spark, folder) -> DataFrame:
    """Hourly samples of a running event count per (device_type, metric), reset on day 15."""
    hourly = (
        telemetry(spark, folder)
        .groupBy("device_type", "metric", F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per hour and label set: this window never grows with the number of events
    running = Window.partitionBy("device_type", "metric", F.col("ts") < "2024-01-15").orderBy("ts")
    return hourly.select("device_type", "metric", "ts", F.sum("n").over(running).alias("value"))


def bucket_samples(spark, folder) -> DataFrame:
    """Running bucket counts of `value` / 200 seconds per device type, sampled every 15 seconds, reset within 15 January."""
    second = F.col("value").cast("double") / 200
    sampled = telemetry(spark, folder).withColumn("ts", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 15) * 15 + 15))
    counts = [F.count_if(second <= le).alias(f"n{i}") for i, le in enumerate(PROCESSING_BUCKETS)]
    per_sample = sampled.groupBy("device_type", "ts").agg(*counts, F.count(F.lit(1)).alias("n_all"))
    bounds = [(F.lit(float(le)), F.col(f"n{i}")) for i, le in enumerate(PROCESSING_BUCKETS)] + [(F.lit(float("inf")), F.col("n_all"))]
    series = per_sample.select("device_type", "ts", F.inline(F.array(*[F.struct(le.alias("le"), n.alias("n")) for le, n in bounds])))
    # one row per sample and bucket, however many events
    running = Window.partitionBy("device_type", "le", F.col("ts") < "2024-01-15 00:02:00").orderBy("ts")
    return series.select("device_type", "le", "ts", F.sum("n").over(running).alias("value"))


def inference_results(spark, folder) -> DataFrame:
    t = telemetry(spark, folder)
    return t.select(
        "id", "device_id", "device_type", "ts",
        (F.col("value") / 10).cast("decimal(12,3)").alias("latency_ms"),
        (F.col("value") >= 50).alias("is_anomaly"),
    )


def ml_models(spark, folder) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), key.cast("string")).alias("version"),
        (key % 3 != 0).alias("is_active"),
        F.timestamp_seconds(F.unix_seconds(as_of()) - key * 60).alias("created_at"),
    )


def firmware_versions(spark, folder) -> DataFrame:
    key = F.col("p_partkey")
    version = F.concat(F.lit("1."), (key % 7).cast("string"), F.lit("."), (F.col("p_size") % 11).cast("string"))
    return (
        table(spark, folder, "part")
        .groupBy(device_type_of(key).alias("device_type"), version.alias("version"))
        .agg(F.min("p_partkey").alias("firmware_id"))
    )


def firmware_submissions(spark, folder) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("submission_id"),
        device_type_of(F.col("o_custkey")).alias("device_type"),
        F.concat(F.lit("1."), (key % 13).cast("string"), F.lit("."), (F.col("o_custkey") % 17).cast("string")).alias("version"),
        F.col("o_orderdate").alias("submitted_at"),
    )


def rollouts(spark, folder) -> DataFrame:
    """A rollout names one firmware and a list of target devices; some firmware is unknown."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("rollout_id"),
        (key * 3).alias("firmware_id"),
        F.sequence(key * 10, key * 10 + key % 7).alias("target_devices"),
    )


def rollout_nodes(spark, folder) -> DataFrame:
    """Nodes of a rollout in update order, with the health seen after updating each."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("rollout_id"),
        F.col("o_orderkey").alias("position"),
        (F.col("o_orderstatus") != "P").alias("healthy"),
        (F.col("o_orderpriority") != "1-URGENT").alias("healthy_after_watch"),
    )


def provisioning_requests(spark, folder) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("device_id"),
        F.when(status == "F", "approved").when(status == "O", "pending").otherwise("rejected").alias("status"),
        F.col("o_orderdate").alias("requested_at"),
    )


def approvals(spark, folder) -> DataFrame:
    """Approval decisions; one per request."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("request_id"))
        .agg(
            F.min("l_shipdate").alias("approved_at"),
            F.concat(F.lit("user-"), F.min("l_suppkey").cast("string")).alias("approved_by"),
        )
    )


def local_config(spark, folder) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("key-"), key.cast("string")).alias("key"),
        F.col("c_mktsegment").alias("value"),
        (key % 50 * 100).alias("version"),
    )


def incoming_config(spark, folder) -> DataFrame:
    """Entries from many peers, several versions per key."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("key-"), (F.col("o_custkey") * 2).cast("string")).alias("key"),
        F.col("o_orderpriority").alias("value"),
        F.col("o_orderkey").alias("version"),
    )


def version_vectors(spark, folder) -> DataFrame:
    """One counter per (object, replica, node)."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.col("l_partkey").alias("object_id"),
            F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_returnflag"))
             .when(F.col("l_linenumber") % 2 == 0, "A").otherwise("R").alias("replica"),
            (F.col("l_suppkey") % 3).cast("string").alias("node_id"),
        )
        .agg(F.max("l_linenumber").cast("bigint").alias("counter"))
    )


def experiment_metrics(spark, folder) -> DataFrame:
    """(job_id, epoch, metric_name, value): a train and a validation loss per line."""
    l = table(spark, folder, "lineitem")
    pairs = F.array(
        F.struct(F.lit("train_loss").alias("metric_name"), money("l_discount").alias("value")),
        F.struct(F.lit("val_loss").alias("metric_name"), money("l_tax").alias("value")),
    )
    return l.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("epoch"),
        F.col("l_shipdate").alias("ts"), F.inline(pairs),
    )


def deliveries(spark, folder) -> DataFrame:
    groups = F.explode(F.array(*[F.lit(g) for g in CONSUMER_GROUPS]))
    return telemetry(spark, folder).select(
        F.lit(RAW_TELEMETRY).alias("stream"), groups.alias("consumer_group"), "id"
    )


def acknowledgements(spark, folder) -> DataFrame:
    """One group confirms everything, one most, and one nothing."""
    done = (F.col("consumer_group") == "data_persistence") | ((F.col("consumer_group") == "ml_inference") & (F.col("id") % 7 != 0))
    return deliveries(spark, folder).filter(done)


def heartbeats(spark, folder) -> DataFrame:
    """Last heartbeat and status per node."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("node_id"),
        pick(NODE_STATUSES, key % 5).alias("status"),
        F.timestamp_seconds(F.unix_seconds(as_of()) - key * 7 % 31).alias("last_heartbeat"),
    )


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        telemetry, alerts, devices, readings, messages, device_events, node_reports, node_report_log,
        tasks, requests, counters, inference_results, ml_models, firmware_versions,
        firmware_submissions, rollouts, rollout_nodes, provisioning_requests, approvals, local_config,
        incoming_config, version_vectors, experiment_metrics, deliveries, acknowledgements, heartbeats,
    )
}
