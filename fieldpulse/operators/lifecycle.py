"""Device lifecycle from its change log, as aggregates and one previous-value window."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from fieldpulse.operators.hot_keys import MAX_ROWS_PER_SLOT, with_previous


FIELDS = ("status", "firmware", "name", "device_type", "metadata")  # those an event table has are folded
ID_RANGE = Decimal(10**19)  # above every event id


def judge_events(events: DataFrame, max_rows: int = MAX_ROWS_PER_SLOT) -> DataFrame:
    """Every lifecycle event with `reject_reason`, NULL when it took effect.

    Events are (event_id, device_id, event_type, status, firmware, ts) and perhaps further
    fields, ordered by (ts, event_id). The rules need no row-by-row replay: a device starts with its
    first `created`; every later update counts until the device is decommissioned,
    by an update to that status or by the first request that finds the device in a
    status other than active; whatever comes first ends the device's life.
    """
    position = F.struct("ts", "event_id")
    born = events.groupBy("device_id").agg(F.min(F.when(F.col("event_type") == "created", position)).alias("_born"))
    dated = events.join(born, "device_id")
    alive = position > F.col("_born")
    kind = F.col("event_type")
    sets_status = (
        F.when(position == F.col("_born"), "registered")
        .when(alive & (kind == "updated"), F.col("status"))
    )
    known = with_previous(dated, ["device_id"], ["ts", "event_id"], sets_status, "_status", max_rows)
    requested = (kind == "decommissioned") & (F.col("_status") != "active")
    updated = (kind == "updated") & (F.col("status") == "decommissioned")
    ended = known.groupBy("device_id").agg(F.min(F.when(alive & (requested | updated), position)).alias("_ended"))
    judged = known.join(ended, "device_id")
    over = F.coalesce(position > F.col("_ended"), F.lit(False))
    reason = (
        F.when((kind == "created") & alive, "already_exists")
        .when(F.col("_born").isNull() | (position < F.col("_born")), "unknown_device")
        .when(over, "decommissioned")
        .when((kind == "decommissioned") & (F.col("_status") == "active"), "active")
    )
    return judged.withColumn("reject_reason", reason).select(*events.columns, "reject_reason")


def _fields(df: DataFrame) -> list[str]:
    return [f for f in FIELDS if f in df.columns]


def device_snapshot(judged: DataFrame) -> DataFrame:
    """Current state per device from the events that took effect: last write per field.

    An event writes the fields it holds a value for. The place of every field's last write is a
    fixed-width maximum, event ids being whole numbers; only the few events at those places, at most one per field, are then
    picked by a join on the device.
    """
    kind, fields = F.col("event_type"), _fields(judged)
    place = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 63))).cast("decimal(19,0)") * F.lit(ID_RANGE) + F.col("event_id").cast("decimal(19,0)")
    writes = {f: F.when(kind != "decommissioned", F.col(f)) for f in fields}
    writes["status"] = (
        F.when(kind == "created", "registered")
        .when(kind == "decommissioned", "decommissioned")
        .otherwise(F.col("status"))
    )
    accepted = judged.filter(F.col("reject_reason").isNull()).select(
        "device_id", "ts", "event_type", place.alias("_place"), *[write.alias(f) for f, write in writes.items()]
    )
    last = accepted.groupBy("device_id").agg(
        *[F.max(F.when(F.col(f).isNotNull(), F.col("_place"))).alias(f"_last_{f}") for f in fields],
        F.min(F.when(kind == "created", F.col("ts"))).alias("created_at"),
        F.max("ts").alias("updated_at"),
    )
    wins = {f: F.col("_place") == F.col(f"_last_{f}") for f in fields}
    picked = accepted.drop("ts", "event_type").join(last, "device_id").filter(F.greatest(*[F.coalesce(w, F.lit(False)) for w in wins.values()]))
    return picked.groupBy("device_id", "created_at", "updated_at").agg(
        *[F.max(F.when(win, F.col(f))).alias(f) for f, win in wins.items()]
    ).select("device_id", *fields, "created_at", "updated_at")


def emit_events(judged: DataFrame) -> DataFrame:
    """One outgoing event per accepted change. The id depends on the content, so a rerun repeats it."""
    accepted = judged.filter(F.col("reject_reason").isNull())
    name = F.concat(F.lit("device_"), F.col("event_type"))
    payload = F.to_json(F.struct(*_fields(accepted)))
    return accepted.select(
        F.sha2(F.concat_ws("|", F.col("device_id").cast("string"), name, F.col("event_id").cast("string")), 256).alias("id"),
        name.alias("event_type"), "device_id", F.col("ts").alias("timestamp"), payload.alias("payload"),
    )


def soft_delete_devices(devices: DataFrame, deletions: DataFrame) -> DataFrame:
    """Devices named in `deletions` become decommissioned, unless they are active or already are."""
    named = deletions.select(F.col("device_id").alias("id")).distinct().withColumn("_deleted", F.lit(True))
    joined = devices.join(named, "id", "left")
    allowed = F.col("_deleted") & ~F.col("status").isin("active", "decommissioned")
    return joined.withColumn(
        "status", F.when(allowed, "decommissioned").otherwise(F.col("status"))
    ).drop("_deleted")


def soft_delete_models(models: DataFrame, deletions: DataFrame) -> DataFrame:
    named = deletions.select("id").distinct().withColumn("_deleted", F.lit(True))
    joined = models.join(named, "id", "left")
    return joined.withColumn("is_active", F.col("is_active") & F.col("_deleted").isNull()).drop("_deleted")


def derive_activity(devices: DataFrame, telemetry: DataFrame, as_of: str, timeout_seconds: int) -> DataFrame:
    """Status from telemetry: provisioned devices that send become active, silent active ones inactive."""
    seen = telemetry.groupBy(F.col("device_id").alias("id")).agg(F.max("ts").alias("_seen"))
    joined = devices.drop("last_seen_at").join(seen, "id", "left")
    now = F.lit(as_of).cast("timestamp")
    silent = F.col("_seen").isNull() | (F.unix_micros(now) - F.unix_micros("_seen") > timeout_seconds * 1_000_000)
    status = F.col("status")
    derived = (
        F.when((status == "provisioned") & F.col("_seen").isNotNull(), "active")
        .when((status == "active") & silent, "inactive")
        .otherwise(status)
    )
    return joined.select(
        *[c for c in devices.columns if c not in ("status", "last_seen_at")],
        derived.alias("status"), F.col("_seen").alias("last_seen_at"),
    )
