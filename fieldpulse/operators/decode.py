"""Messages to readings, readings to log entries, validation, and the long metric view."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from fieldpulse.functions import payload as P
from fieldpulse.functions.scalar import is_uuid, iso_timestamp, parse_timestamp, topic_device
from fieldpulse.schemas import ENVELOPE_KEYS, NON_FEATURE_KEYS

MILLISECONDS_FROM = 2e10  # a larger number of seconds since 1970 is taken for milliseconds


def decode_messages(messages: DataFrame) -> DataFrame:
    """(id, topic, body, arrived_at) -> readings with `decode_error`, NULL when good.

    Missing keys get their defaults: the device id comes from the topic, the type
    is `unknown`, the time is the arrival time, and without a payload every key
    that is not part of the envelope belongs to the payload. Of equal keys the last
    one counts. The body must be one JSON object without anything behind it; payload
    and metadata must be objects and the type a string. A time may be a number of
    seconds since 1970, or of milliseconds beyond 2e10.
    """
    # the parser does not look behind the first value: text there breaks one of two wrappings
    listed = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"m":'), F.col("body"), F.lit("}")))
    document = F.when(named.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))
    entries = P.entries_of(P.text_map(F.col("body")))
    parsed = messages.withColumn("_v", document).withColumn("_m", F.map_from_entries(entries))
    m, v = F.col("_m"), F.col("_v")
    has = lambda key: F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))
    kind = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    is_object = lambda key: has(key) & kind(key).startswith("OBJECT")
    loose = F.map_from_entries(F.filter(P.entries_of(P.variant_map(F.col("body"))), lambda e: ~e["key"].isin(*ENVELOPE_KEYS)))
    number = F.try_variant_get(v, "$.timestamp", "double")
    seconds = F.when(F.abs(number) > MILLISECONDS_FROM, number / 1000).otherwise(number)
    time = F.when(kind("timestamp") == "STRING", parse_timestamp(m["timestamp"])).when(
        P.is_number(kind("timestamp")), F.timestamp_micros((seconds * 1_000_000).cast("bigint"))
    )
    out = parsed.select(
        "id", "topic", "body", "arrived_at",
        F.when(has("device_id"), m["device_id"]).otherwise(topic_device(F.col("topic"))).alias("device_id"),
        F.when(~has("device_type"), "unknown").when(kind("device_type") == "STRING", m["device_type"]).alias("device_type"),
        F.when(has("timestamp"), time).otherwise(F.col("arrived_at")).alias("ts"),
        F.when(is_object("payload"), m["payload"]).when(~has("payload"), F.to_json(loose)).alias("payload"),
        F.when(is_object("metadata"), m["metadata"]).when(~has("metadata"), "{}").alias("metadata"),
        (v.isNull() | m.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")).alias("_undecodable"),
    )
    error = (
        F.when(F.col("_undecodable"), "invalid_json")
        .when(F.col("device_id").isNull(), "missing_device_id")
        .when(F.col("device_type").isNull(), "missing_device_type")
        .when(F.col("ts").isNull(), "invalid_timestamp")
        .when(F.col("payload").isNull(), "invalid_payload")
        .when(F.col("metadata").isNull(), "invalid_metadata")
    )
    return out.withColumn("decode_error", error).drop("_undecodable")


def validation_error(now: Column) -> Column:
    """First failing rule of a reading, NULL when it is acceptable."""
    ts = F.col("ts")
    keys = F.json_object_keys("payload")
    return (
        F.when(ts > now + F.expr("INTERVAL 5 MINUTES"), "timestamp_in_future")
        .when(ts < now - F.expr("INTERVAL 24 HOURS"), "timestamp_too_old")
        .when(keys.isNull() | (F.size(keys) == 0), "empty_payload")
        .when(~is_uuid(F.col("device_id")), "invalid_device_id")
    )


def validate(readings: DataFrame, now: Column) -> DataFrame:
    return readings.withColumn("reject_reason", validation_error(now))


def ingest(messages: DataFrame) -> DataFrame:
    """Decode and validate against the arrival time; `reject_reason` covers both steps."""
    checked = decode_messages(messages)
    reason = F.coalesce(F.col("decode_error"), validation_error(F.col("arrived_at")))
    return checked.withColumn("reject_reason", reason).drop("decode_error")


def to_log_entries(readings: DataFrame) -> DataFrame:
    """Flat string columns; nested objects are JSON wrapped in their own key."""
    return readings.select(
        "id",
        F.col("device_id").cast("string").alias("device_id"),
        "device_type",
        iso_timestamp(F.col("ts")).alias("timestamp"),
        P.wrap_json("payload", F.col("payload")).alias("payload"),
        P.wrap_json("metadata", F.col("metadata")).alias("metadata"),
    )


def from_log_entries(entries: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Readings from log entries, with the entries' columns `keep` beside them."""
    return entries.select(
        *keep,
        "id", "device_id", "device_type",
        parse_timestamp(F.col("timestamp")).alias("ts"),
        P.unwrap_json("payload", F.col("payload")).alias("payload"),
        P.unwrap_json("metadata", F.col("metadata")).alias("metadata"),
    )


def long_metrics(readings: DataFrame, nested: bool = False, skip: Iterable[str] = NON_FEATURE_KEYS) -> DataFrame:
    """One row per numeric payload entry, with its position in the document."""
    entries = P.nested_numeric_entries(F.col("payload")) if nested else P.numeric_entries(F.col("payload"), skip)
    return readings.select(
        "id", "device_id", "device_type", "ts", F.posexplode(entries).alias("position", "_entry")
    ).select(
        "id", "device_id", "device_type", "ts", "position",
        F.col("_entry.key").alias("metric"), F.col("_entry.value").alias("value"),
    )
