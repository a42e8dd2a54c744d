"""Grouped reports. Each reads its input once; the first aggregation step runs before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldpulse.functions.scalar import mean, mean_of, normalise_path, period_start
from fieldpulse.operators.filters import apply_filters, recent_range
from fieldpulse.schemas import GROUP_COLUMNS, HTTP_BUCKETS


def sensor_aggregation(metrics: DataFrame, granularity: str = "hour") -> DataFrame:
    """avg, min, max, count and sample standard deviation by (period, device_type)."""
    value = F.col("value")
    return (
        metrics.groupBy(period_start(F.col("ts"), granularity).alias("period"), "device_type")
        .agg(
            mean(value).alias("avg_value"),
            F.min(value).cast("double").alias("min_value"),
            F.max(value).cast("double").alias("max_value"),
            F.count(value).alias("count"),
            F.stddev_samp(value.cast("double")).alias("stddev_value"),
        )
        .orderBy("period", "device_type")
    )


def aggregation_summary(metrics: DataFrame, granularity: str = "hour") -> DataFrame:
    """Row, device, type and result-row counts.

    Rows are first reduced to one per device, type and period, so the distinct
    counts run over that much smaller table.
    """
    period = period_start(F.col("ts"), granularity).alias("period")
    cells = metrics.groupBy("device_id", "device_type", period).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_distinct(F.struct("period", "device_type")).alias("aggregated_rows"),
        F.count_distinct("device_id").alias("unique_devices"),
        F.count_distinct("device_type").alias("unique_types"),
        F.lit("day" if granularity == "day" else "hour").alias("granularity"),
    )


def breakdown(df: DataFrame, categories: dict[str, Column], total: str = "total") -> DataFrame:
    """Counts by each category and overall as one (category, key, count) table.

    The rows are first counted by all categories together; the grouping sets then
    expand those few combinations and not the input rows. A row of zeros keeps the
    overall count present when there is no input.
    """
    named = [column.cast("string").alias(name) for name, column in categories.items()]
    names = list(categories)
    cells = _with_zero_row(df.groupBy(*named).agg(F.count(F.lit(1)).alias("n")))
    sets = cells.groupingSets([[F.col(n)] for n in names] + [[]], *[F.col(n) for n in names])
    counted = sets.agg(F.sum("n").alias("count"), F.grouping_id().alias("_set"))
    # in the grouping id a 0 bit marks a column that is part of the set
    everything = (1 << len(names)) - 1
    category, key = F.when(F.col("_set") == everything, F.lit(total)), F.when(F.col("_set") == everything, F.lit(None))
    for i, name in enumerate(names):
        own = everything & ~(1 << (len(names) - 1 - i))
        category = category.when(F.col("_set") == own, name)
        key = key.when(F.col("_set") == own, F.col(name))
    return counted.filter((F.col("count") > 0) | (F.col("_set") == everything)).select(
        category.alias("category"), key.alias("key"), "count"
    )


def _with_zero_row(cells: DataFrame, count: str = "n") -> DataFrame:
    zero = cells.sparkSession.range(1).select(
        *[(F.lit(0) if f.name == count else F.lit(None)).cast(f.dataType).alias(f.name) for f in cells.schema]
    )
    return cells.unionAll(zero)


def anomaly_report(alerts: DataFrame) -> DataFrame:
    """Total and counts by device type, severity and hour of day."""
    out = breakdown(
        alerts,
        {"device_type": F.col("device_type"), "severity": F.col("severity"), "hour_of_day": F.hour("ts")},
    )
    by_hour = F.when(F.col("category") == "hour_of_day", F.col("key").cast("int"))
    return out.orderBy("category", by_hour, F.desc("count"), "key")


def per_device_counts(df: DataFrame, count: str) -> DataFrame:
    """(device_id, device_type, count, last_seen); of several types the one seen last.

    Device and type are counted together first, with fixed-width results that the
    hash aggregation can hold; picking the type then works on that small table.
    """
    per_type = df.groupBy("device_id", "device_type").agg(
        F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last")
    )
    return per_type.groupBy("device_id").agg(
        F.max_by("device_type", F.struct("_last", "device_type")).alias("device_type"),
        F.sum("_n").alias(count),
        F.max("_last").alias("last_seen"),
    )


def top_devices(alerts: DataFrame, n: int = 10) -> DataFrame:
    counts = per_device_counts(alerts, "anomaly_count").select("device_id", "anomaly_count", "device_type")
    return counts.orderBy(F.desc("anomaly_count"), "device_id").limit(n)


def anomaly_summary(alerts: DataFrame, as_of: str, start=None, end=None) -> DataFrame:
    """Total and counts by type and severity; by default over the 24 hours before `as_of`."""
    windowed = recent_range(alerts, as_of, 24, start, end)
    return breakdown(windowed, {"device_type": F.col("device_type"), "severity": F.col("severity")})


def count_query(
    telemetry: DataFrame,
    alerts: DataFrame,
    metric: str,
    as_of: str,
    start=None,
    end=None,
    group_by: str | None = None,
    limit: int = 100,
    device_type=None,
    device_id=None,
) -> DataFrame:
    """Counts by one allowed column, largest first; `total` adds up the returned groups.

    Without a start the range begins a week before `as_of`, without an end it ends there.
    """
    metric = "anomaly_count" if metric == "anomaly_count" else "telemetry_count"
    group_by = group_by or "device_type"
    if group_by not in GROUP_COLUMNS[metric]:
        raise ValueError(f"cannot group {metric} by {group_by!r}; allowed: {GROUP_COLUMNS[metric]}")
    df = alerts if metric == "anomaly_count" else telemetry
    df = recent_range(df, as_of, 7 * 24, start, end)
    df = apply_filters(df, device_type=device_type, device_id=device_id)
    top = (
        df.groupBy(group_by).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), group_by)
        .limit(limit)
    )
    total = top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return top.withColumn("total", total.scalar())


def telemetry_stats(telemetry: DataFrame) -> DataFrame:
    """One row per device type and one for everything (device_type NULL), from one pass."""
    cells = telemetry.groupBy("device_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    return _with_zero_row(cells).groupingSets([[F.col("device_type")], []], F.col("device_type")).agg(
        F.sum("n").alias("readings"),
        F.min("first").alias("earliest"),
        F.max("last").alias("latest"),
        F.grouping("device_type").cast("int").alias("is_total"),
    ).filter("readings > 0 OR is_total = 1")


def fleet_stats(devices: DataFrame) -> DataFrame:
    return breakdown(devices, {"device_type": F.col("device_type"), "status": F.col("status")})


def experiment_summary(metrics: DataFrame) -> DataFrame:
    """Best losses and number of distinct epochs per job, newest job first.

    Epochs are made distinct by a first aggregation on (job, epoch), which also
    keeps one very long job from being one group.
    """
    loss = lambda name: F.min(F.when(F.col("metric_name") == name, F.col("value"))).alias(name)
    per_epoch = metrics.groupBy("job_id", "epoch").agg(
        loss("train_loss"), loss("val_loss"), F.max("ts").alias("last")
    )
    return (
        per_epoch.groupBy("job_id")
        .agg(
            F.min("train_loss").cast("double").alias("best_train_loss"),
            F.min("val_loss").cast("double").alias("best_val_loss"),
            F.count("epoch").alias("total_epochs"),
            F.max("last").alias("last_logged_at"),
        )
        .orderBy(F.desc("last_logged_at"), "job_id")
    )


def inference_stats(scored: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return scored.agg(
        n.alias("inference_count"),
        F.coalesce(F.round(mean_of(F.sum("latency_ms"), n), 3), F.lit(0.0)).alias("avg_latency_ms"),
        F.count_if("is_anomaly").alias("anomaly_count"),
    )


def labelled_counter(df: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """A counter as rows (metric, label values, value)."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(name).alias("metric"), *labels, "value"
    )


def latency_histogram(df: DataFrame, labels: Sequence[str], value: str, buckets: Sequence[float]) -> DataFrame:
    """Cumulative buckets per label set, with sum and count.

    Each bucket is one conditional count, so a label set leaves the map side as one row
    whatever its size; the buckets become rows only after the aggregation.
    """
    observed = F.col(value)
    per_label = df.groupBy(*labels).agg(
        F.sum(observed).alias("sum"),
        F.count(observed).alias("total"),
        *[F.count_if(observed <= le).alias(f"_le_{i}") for i, le in enumerate(buckets)],
    )
    rows = [F.struct(F.lit(float(le)).alias("le"), F.col(f"_le_{i}").alias("cumulative")) for i, le in enumerate(buckets)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("cumulative")))
    return per_label.select(*labels, "sum", "total", F.inline(F.array(*rows)))


def active_devices(devices: DataFrame) -> DataFrame:
    """Active devices per type and summed (device_type NULL)."""
    per_type = devices.filter(F.col("status") == "active").groupBy("device_type").agg(F.count(F.lit(1)).alias("n"))
    return _with_zero_row(per_type).groupingSets([[F.col("device_type")], []], F.col("device_type")).agg(
        F.sum("n").alias("active_devices"),
        F.grouping("device_type").cast("int").alias("is_total"),
    ).filter("active_devices > 0 OR is_total = 1")


def http_metrics(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request counts by method, path and status; latency histogram by method and path)."""
    normal = requests.withColumn("path", normalise_path(F.col("path")))
    counts = labelled_counter(normal, "http_requests_total", ["method", "path", "status_code"])
    return counts, latency_histogram(normal, ["method", "path"], "latency_seconds", HTTP_BUCKETS)


def placement_status(placements: DataFrame, nodes: DataFrame, healthy: Column) -> DataFrame:
    """Node totals and the number of tasks per target, one row per target."""
    totals = nodes.agg(F.count(F.lit(1)).alias("total"), F.count_if(healthy).alias("healthy"))
    return placements.groupBy("target").agg(F.count(F.lit(1)).alias("tasks")).select(
        "target", "tasks",
        totals.select("total").scalar().alias("total_nodes"),
        totals.select("healthy").scalar().alias("healthy_nodes"),
    )


def alert_groups(alerts: DataFrame, keys: Sequence[str] = ("alertname", "service")) -> DataFrame:
    return alerts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )


def tumbling_counts(df: DataFrame, width: str, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows per window; works on batch and streaming input (give the stream a watermark)."""
    counted = df.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "count"
    )


def rate_of(windows: DataFrame, seconds: int) -> DataFrame:
    """Counted windows as readings per second, one decimal."""
    return windows.select("window_start", F.round(F.col("count") / seconds, 1).alias("readings_per_second"))


def throughput(df: DataFrame, seconds: int = 2, ts: str = "ts") -> DataFrame:
    """Readings per second over intervals of `seconds`."""
    return rate_of(tumbling_counts(df, f"{seconds} seconds", ts=ts), seconds)
