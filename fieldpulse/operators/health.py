"""Device health scores."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from fieldpulse.functions.scalar import epoch_seconds, health_class, ratio
from fieldpulse.operators.aggregates import per_device_counts
from fieldpulse.operators.filters import apply_filters, time_range


def device_health(
    telemetry: DataFrame, alerts: DataFrame, as_of: str, start=None, end=None, device_type: str | None = None
) -> DataFrame:
    """Score 0-100 from anomaly rate and silence, worst device first.

    Both inputs shrink to one row per device before the join. A time of last
    reading after `as_of` gives a negative penalty, that is a score above 100.
    """
    readings = apply_filters(time_range(telemetry, start, end), device_type=device_type)
    per_device = per_device_counts(readings, "total_readings")
    anomalies = time_range(alerts, start, end).groupBy("device_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    now = epoch_seconds(F.lit(as_of).cast("timestamp"))
    rate = F.least(F.col("anomaly_count") / F.col("total_readings"), F.lit(1.0))
    penalty = F.least((now - epoch_seconds(F.col("last_seen"))) / 3600.0, F.lit(50.0))
    return (
        per_device.join(anomalies, "device_id", "left")
        .fillna(0, ["anomaly_count"])
        .select(
            "device_id", "device_type",
            F.round(F.greatest(F.lit(0.0), 100.0 - rate * 50.0 - penalty), 1).alias("health_score"),
            F.round(rate, 4).alias("anomaly_rate"),
            "last_seen", "total_readings", "anomaly_count",
        )
        .orderBy(F.asc("health_score"), "device_id")
    )


def health_summary(health: DataFrame) -> DataFrame:
    score = F.col("health_score")
    group = health_class(score)
    mean_score = F.sum(score.cast("decimal(12,1)")).cast("double") / F.nullif(F.count(score), F.lit(0))
    return health.agg(
        F.count(F.lit(1)).alias("total_devices"),
        F.coalesce(F.round(mean_score, 1), F.lit(0.0)).alias("avg_health_score"),
        F.count_if(group == "healthy").alias("healthy_count"),
        F.count_if(group == "degraded").alias("degraded_count"),
        F.count_if(group == "critical").alias("critical_count"),
    )


def recent_health(telemetry: DataFrame, alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Score 0-1 since `hours` before `as_of` for every device with readings or alerts.

    The range has no end. A device seen with two types keeps the counts of the type seen last.
    """
    cutoff = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    per_type = time_range(telemetry, cutoff).groupBy("device_id", "device_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")
    )
    readings = per_type.groupBy("device_id").agg(
        F.max_by(F.struct("device_type", "n"), F.struct("last", "device_type")).alias("kept")
    )
    anomalies = time_range(alerts, cutoff).groupBy("device_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    both = readings.join(anomalies, "device_id", "full_outer").select(
        "device_id",
        F.coalesce("kept.device_type", F.lit("unknown")).alias("device_type"),
        F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
        F.coalesce("kept.n", F.lit(0)).alias("total_readings"),
    )
    a, n = F.col("anomaly_count"), F.col("total_readings")
    score = (
        F.when(n > 0, F.greatest(F.lit(0.0), 1.0 - ratio(a, n)))
        .when(a == 0, 1.0)
        .otherwise(0.0)
    )
    return both.withColumn("health_score", F.round(score, 4)).orderBy("device_id")
