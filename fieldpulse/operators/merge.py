"""Joins and merges of registry tables: existence checks, approvals, configuration, inhibition, admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

NO_ID_SLOTS = 4096  # tasks that rows without an id are dealt to, at most


def accept_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mark incoming rows whose key exists already, or came earlier in the same batch.

    The first row per key is found by an aggregate (one row per key after the map
    side), so a key repeated very often does not become one sorted group.
    """
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    per_key = first.join(known, list(keys), "left")
    reason = (
        F.when(F.col("_known"), "exists")
        .when(F.struct(*order) != F.col("_first"), "duplicate_in_batch")
    )
    return incoming.join(per_key, list(keys)).select(*incoming.columns, reason.alias("reject_reason"))


def expand_rollouts(rollouts: DataFrame, firmware: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per rollout and target device, rollouts that name unknown firmware)."""
    known = rollouts.join(firmware.select("firmware_id", "version", "device_type"), "firmware_id")
    targets = known.select(
        "rollout_id", "firmware_id",
        F.col("version").alias("firmware_version"), "device_type",
        F.explode("target_devices").alias("device_id"),
        F.lit("in_progress").alias("status"),
    )
    unknown = rollouts.join(firmware, "firmware_id", "left_anti")
    return targets, unknown


def approve_requests(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """Requests after the approvals: only pending ones change, with approver and time."""
    joined = requests.join(approvals, "request_id", "left")
    approved = (F.col("status") == "pending") & F.col("approved_by").isNotNull()
    return joined.select(
        "request_id", "device_id", "requested_at",
        F.when(approved, "approved").otherwise(F.col("status")).alias("status"),
        F.when(approved, F.col("approved_by")).alias("approved_by"),
        F.when(approved, F.col("approved_at")).alias("approved_at"),
    )


def provision_devices(devices: DataFrame, approved: DataFrame) -> DataFrame:
    """Device snapshot after approval: the devices of `approved` become provisioned."""
    changed = approved.filter(F.col("approved_by").isNotNull()).select(F.col("device_id").alias("id")).distinct()
    joined = devices.join(changed.withColumn("_approved", F.lit(True)), "id", "left")
    status = F.when(F.col("_approved"), "provisioned").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_approved")


def request_provisioning(devices: DataFrame, existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Check incoming requests: the device exists, is registered, and has no pending request.

    Of several requests for one device in a batch the earliest is taken.
    """
    pending = existing.filter(F.col("status") == "pending").select("device_id").distinct().withColumn("_pending", F.lit(True))
    first = incoming.groupBy("device_id").agg(F.min(F.struct("requested_at", "request_id")).alias("_first"))
    facts = (
        first.join(devices.select(F.col("id").alias("device_id"), F.col("status").alias("_status")), "device_id", "left")
        .join(pending, "device_id", "left")
    )
    reason = (
        F.when(F.col("_status").isNull(), "unknown_device")
        .when(F.col("_status") != "registered", "not_registered")
        .when(F.col("_pending"), "already_pending")
        .when(F.struct("requested_at", "request_id") != F.col("_first"), "duplicate_in_batch")
    )
    return incoming.join(facts, "device_id").select(
        "request_id", "device_id", "requested_at",
        F.when(reason.isNull(), "pending").otherwise("refused").alias("status"), reason.alias("reject_reason"),
    )


def merge_config(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newer version wins per key; tells what was applied and what must be sent back.

    Several incoming versions of a key are first reduced to the newest.
    """
    newest = incoming.groupBy("key").agg(F.max(F.struct("version", "value")).alias("_in"))
    both = local.select("key", F.struct("version", "value").alias("_local")).join(newest, "key", "full_outer")
    theirs, ours = F.col("_in"), F.col("_local")
    their_version, our_version = F.coalesce(theirs["version"], F.lit(0)), F.coalesce(ours["version"], F.lit(0))
    apply = their_version > our_version
    action = (
        F.when(apply, "apply")
        .when(theirs.isNotNull() & (our_version > their_version), "send_back")
        .otherwise("keep")
    )
    # an incoming entry at version 0 for an unknown key changes nothing
    kept = F.when(apply, theirs).otherwise(ours)
    return both.select(
        "key", kept["value"].alias("value"), kept["version"].alias("version"), action.alias("action")
    ).filter(F.col("version").isNotNull())


def inhibit_warnings(alerts: DataFrame, keys: Sequence[str] = ("alertname", "service")) -> DataFrame:
    """Alerts without the warnings for which a critical alert with the same keys is firing; a missing key equals a missing one."""
    critical = alerts.filter(F.col("severity") == "critical").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    critical = critical.withColumn("_critical", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = alerts.join(critical, same, "left")
    suppressed = (F.col("severity") == "warning") & F.col("_critical")
    return joined.filter(~F.coalesce(suppressed, F.lit(False))).select(*alerts.columns)


def stream_backlog(published: DataFrame, consumed: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """published - consumed per stream and group; both sides are counter tables.

    `groups` (stream, consumer_group) names all known groups, so that one that has consumed
    nothing yet is listed with the whole stream as its backlog.
    """
    part = lambda df, n, known: df.select("stream", "consumer_group", n.cast("bigint").alias("consumed"), F.lit(known).alias("known"))
    rows = part(consumed, F.col("consumed"), groups is None)
    if groups is not None:
        rows = rows.unionByName(part(groups, F.lit(0), True))
    per_group = rows.groupBy("stream", "consumer_group").agg(F.sum("consumed").alias("consumed"), F.bool_or("known").alias("known")).filter("known")
    # a stream has few groups: they are gathered beside its length, as a join on a stream that is the
    # same in all rows would lose its key and become a product
    listed = per_group.select("stream", F.lit(None).cast("bigint").alias("published"), F.struct("consumer_group", "consumed").alias("group"))
    lengths = published.select("stream", F.col("published").cast("bigint").alias("published"), F.lit(None).cast(listed.schema["group"].dataType).alias("group"))
    per_stream = listed.unionByName(lengths).groupBy("stream").agg(F.max("published").alias("published"), F.collect_list("group").alias("groups"))
    return per_stream.select("stream", "published", F.inline("groups")).select(
        "stream", "consumer_group", (F.coalesce("published", F.lit(0)) - F.coalesce("consumed", F.lit(0))).alias("backlog")
    )


def admit(readings: DataFrame, devices: DataFrame) -> DataFrame:
    """Readings with `reject_reason`: `unknown`, or the status of a device that may not send.

    Readings without a device id meet no device; a second key deals them over many tasks.
    """
    status = devices.select(F.col("id").alias("device_id"), F.col("status").alias("_status"), F.lit(0).cast("bigint").alias("_aside"))
    aside = F.when(F.col("device_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(NO_ID_SLOTS))).otherwise(0)
    reason = (
        F.when(F.col("_status").isNull(), "unknown")
        .when(~F.col("_status").isin("provisioned", "active"), F.col("_status"))
    )
    joined = readings.withColumn("_aside", aside).join(status, ["device_id", "_aside"], "left")
    return joined.withColumn("reject_reason", reason).select(*[c for c in readings.columns if c != "reject_reason"], "reject_reason")


def merge_version_vectors(counters: DataFrame, key: str = "object_id") -> DataFrame:
    """Merge any number of vectors per object: the largest counter per node, as a map."""
    per_node = counters.groupBy(key, "node_id").agg(F.max("counter").alias("counter"))
    return per_node.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "counter")))).alias("vector")
    )
