"""Edge rows of aggregation, health and trend reports."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import as_dicts
from fieldpulse.operators import aggregates as G, filters, health, trend
from fieldpulse.session import scratch_path
from fieldpulse.sources import sinks

T0 = datetime(2024, 1, 30, 12)
AS_OF = "2024-01-30 12:00:00"
TELEMETRY = "id bigint, device_id string, device_type string, metric string, ts timestamp, value double"


def telemetry(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TELEMETRY)


def alerts(spark, rows):
    return spark.createDataFrame([(i, d, t, ts, "critical") for i, (d, t, ts) in enumerate(rows)],
                                 "id bigint, device_id string, device_type string, ts timestamp, severity string")


def test_single_row_has_no_deviation_and_nulls_are_not_counted(spark):
    df = telemetry(spark, [("a", "x", "m", T0, 2.0), ("a", "x", "m", T0, None), ("a", "y", "m", T0, 1.0), ("b", "y", "m", T0, 3.0)])
    rows = as_dicts(G.sensor_aggregation(df, "anything"))
    assert [(r["device_type"], r["count"], r["stddev_value"]) for r in rows] == [("x", 1, None), ("y", 2, pytest.approx(2 ** 0.5))]
    assert rows[0]["period"] == T0


def test_empty_input_keeps_the_total(spark):
    none = alerts(spark, [("a", "x", T0)]).limit(0)
    assert as_dicts(G.anomaly_report(none)) == [{"category": "total", "key": None, "count": 0}]
    assert as_dicts(G.telemetry_stats(telemetry(spark, [("a", "x", "m", T0, 1.0)]).limit(0)))[0]["readings"] == 0


def test_null_keys_are_counted(spark):
    df = alerts(spark, [("a", None, T0), ("a", "x", T0)])
    got = {(r["category"], r["key"]): r["count"] for r in as_dicts(G.anomaly_summary(df, AS_OF))}
    assert got[("device_type", None)] == 1 and got[("total", None)] == 2


def test_count_query_rejects_other_columns(spark):
    df = telemetry(spark, [("a", "x", "m", T0, 1.0)])
    with pytest.raises(ValueError):
        G.count_query(df, df, "telemetry_count", AS_OF, group_by="1; drop table")
    # an unknown metric counts telemetry
    assert as_dicts(G.count_query(df, df, "other", AS_OF)) == [{"device_type": "x", "count": 1, "total": 1}]


def test_time_range_is_inclusive(spark):
    df = telemetry(spark, [("a", "x", "m", T0 + timedelta(seconds=s), 1.0) for s in range(5)])
    assert filters.time_range(df, "2024-01-30T12:00:01", datetime(2024, 1, 30, 12, 0, 3)).count() == 3
    assert filters.time_range(df).count() == 5
    assert filters.last_hours(df, "2024-01-31 12:00:00", 24).count() == 5
    assert filters.recent_range(df, "2024-01-30 12:00:03", 24).count() == 4
    assert filters.recent_range(df, "2024-01-30 12:00:03", 24, start="2024-01-30 12:00:02").count() == 2
    assert filters.recent_range(df, "2024-01-30 12:00:03", 24, end="2024-01-30 12:00:00").count() == 1


def test_listing_total_and_page(spark):
    df = telemetry(spark, [("a", "x", "m", T0 + timedelta(seconds=s), 1.0) for s in range(5)])
    page = as_dicts(filters.listing(df, [df.ts.desc()], 2, 1))
    assert [(r["id"], r["total"]) for r in page] == [(3, 5), (2, 5)]


def score(spark, readings, anomalies, seen):
    t = telemetry(spark, [("a", "x", "m", seen, 1.0)] * readings)
    row = as_dicts(health.device_health(t, alerts(spark, [("a", "x", seen)] * anomalies + [("other", "x", seen)]), AS_OF))[0]
    return row["health_score"], row["anomaly_rate"]


def test_health_score_limits(spark):
    assert score(spark, 3, 0, T0) == (100.0, 0.0)
    assert score(spark, 2, 5, T0) == (50.0, 1.0)
    assert score(spark, 1, 0, T0 - timedelta(hours=49)) == (51.0, 0.0)
    assert score(spark, 1, 0, T0 - timedelta(hours=51)) == (50.0, 0.0)
    assert score(spark, 1, 1, T0 - timedelta(hours=80)) == (0.0, 1.0)
    assert score(spark, 1, 0, T0 + timedelta(hours=10)) == (110.0, 0.0)
    assert score(spark, 3, 1, T0) == (83.3, 0.3333)


def test_health_summary_classes(spark):
    t = telemetry(spark, [(d, "x", "m", T0 - timedelta(hours=h), 1.0) for d, h in (("a", 20), ("b", 21), ("c", 49), ("d", 50))])
    a = alerts(spark, [("d", "x", T0)])
    row = as_dicts(health.health_summary(health.device_health(t, a, AS_OF)))[0]
    assert row == {"total_devices": 4, "avg_health_score": 52.5, "healthy_count": 1, "degraded_count": 2, "critical_count": 1}


def test_recent_health(spark):
    early, late = T0 - timedelta(hours=2), T0 - timedelta(hours=1)
    t = telemetry(spark, [("two", "old", "m", early, 1.0), ("two", "old", "m", early, 1.0), ("two", "new", "m", late, 1.0),
                          ("gone", "x", "m", T0 - timedelta(hours=25), 1.0)])
    rows = {r["device_id"]: r for r in as_dicts(health.recent_health(t, alerts(spark, [("only", "x", T0)]), AS_OF))}
    assert set(rows) == {"two", "only"}
    assert (rows["only"]["health_score"], rows["only"]["device_type"]) == (0.0, "unknown")
    assert (rows["two"]["device_type"], rows["two"]["total_readings"], rows["two"]["health_score"]) == ("new", 1, 1.0)


def line(spark, points):
    df = telemetry(spark, [("a", "x", "m", T0 + timedelta(seconds=s), v) for s, v in points])
    return as_dicts(trend.linear_trends(df))[0]


def test_trend_edges(spark):
    one = line(spark, [(0, 5.0)])
    assert (one["trend_direction"], one["slope"], one["intercept"], one["avg_value"]) == ("stable", 0.0, 0.0, 5.0)
    same = line(spark, [(0, 5.0), (0, 7.0)])
    assert (same["trend_direction"], same["slope"], same["intercept"], same["r_squared"]) == ("stable", 0.0, 6.0, 0.0)
    constant = line(spark, [(0, 5.0), (60, 5.0), (120, 5.0)])
    assert (constant["trend_direction"], constant["slope"], constant["r_squared"]) == ("stable", 0.0, 0.0)
    around_zero = line(spark, [(0, -1.0), (3600, 1.0)])
    assert (around_zero["trend_direction"], around_zero["r_squared"]) == ("upward", 1.0)
    falling = line(spark, [(0, 10.0), (3600, 5.0), (1800, None)])
    assert (falling["trend_direction"], falling["data_points"], falling["max_value"]) == ("downward", 3, 10.0)
    empty = line(spark, [(0, None)])
    assert (empty["avg_value"], empty["trend_direction"]) == (0.0, "stable")


def test_trend_against_numpy(spark):
    rng = np.random.default_rng(3)
    points = [(int(s), float(v)) for s, v in zip(rng.integers(0, 90_000, 500), rng.normal(1013, 5, 500))]
    row = line(spark, points)
    # both sides centred: uncentred sums over epoch seconds are too rough to compare with
    start = (T0 - datetime(1970, 1, 1)).total_seconds()
    x, y = np.array([s for s, _ in points], float), np.array([v for _, v in points])
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    assert row["slope"] == pytest.approx(slope, abs=1e-8)
    assert row["intercept"] == pytest.approx(y.mean() - slope * (start + x.mean()), abs=1e-4)
    assert row["r_squared"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-4)


def test_moving_average_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [("a", t, "m", T0 + timedelta(seconds=int(s)), None if rng.random() < 0.1 else float(rng.integers(0, 99)))
            for t, s in zip(rng.choice(["x", "y"], 400), rng.integers(0, 40_000, 400))]
    got = {r["id"]: r["moving_avg"] for r in trend.moving_average(telemetry(spark, rows), hours=1).collect()}
    assert len(got) == len(rows)
    for i, (_, kind, _, ts, _) in enumerate(rows):
        frame = [r[4] for r in rows if r[1] == kind and 0 <= (ts - r[3]).total_seconds() <= 3600 and r[4] is not None]
        assert got[i] == (pytest.approx(sum(frame) / len(frame)) if frame else None)


def test_csv_export_falls_back_to_the_summary(spark):
    rows, summary = spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(9,)], "total int")
    for df, header in ((rows, ["x", "y"]), (rows.limit(0), ["total"])):
        path = scratch_path(spark, "csv")
        sinks.export_csv(df, path, summary)
        assert spark.read.option("header", True).csv(path).columns == header


def test_write_modes(spark):
    df, path = spark.range(3), scratch_path(spark, "table")
    sinks.write_table(df, path, "error")
    sinks.write_table(df, path, "append")
    sinks.write_table(df, path, "ignore")
    assert spark.read.parquet(path).count() == 6
    sinks.write_table(df, path, "overwrite")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        sinks.write_table(df, path, "error")
    with pytest.raises(ValueError):
        sinks.write_table(df, path, "upsert")


def test_histogram_and_experiment_summary(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 9.0), ("b", None)], "l string, v double")
    got = {(r["l"], r["le"]): (r["cumulative"], r["total"]) for r in G.latency_histogram(df, ["l"], "v", (0.1, 1.0)).collect()}
    assert got[("a", 0.1)] == (1, 3) and got[("a", 1.0)] == (2, 3) and got[("a", float("inf"))] == (3, 3)
    assert got[("b", float("inf"))] == (0, 0)
    metrics = spark.createDataFrame(
        [(1, 1, "train_loss", 0.5, T0), (1, 1, "val_loss", 0.7, T0), (1, 2, "train_loss", 0.4, T0), (2, 1, "train_loss", 0.9, T0 + timedelta(1))],
        "job_id int, epoch int, metric_name string, value double, ts timestamp")
    rows = as_dicts(G.experiment_summary(metrics))
    assert [(r["job_id"], r["best_train_loss"], r["best_val_loss"], r["total_epochs"]) for r in rows] == [(2, 0.9, None, 1), (1, 0.4, 0.7, 2)]


def test_readings_by_day_prune_folders(spark):
    path = scratch_path(spark, "days")
    df = telemetry(spark, [("a", "x", "m", T0 + timedelta(days=d), 1.0) for d in range(5) for _ in range(10)])
    sinks.write_readings(df, path)
    ranged = filters.time_range(spark.read.parquet(path), T0 + timedelta(days=1), T0 + timedelta(days=2))
    assert ranged.count() == 20
    text = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text and "2024-01-31" in text


def test_split_in_one_write(spark):
    df = spark.range(30).withColumn("reject_reason", F.when(F.col("id") % 3 == 0, "bad"))
    good, bad = sinks.write_split(df, scratch_path(spark, "split"))
    assert good.columns == ["id"] and good.count() == 20
    assert bad.columns == ["id", "reject_reason"] and bad.count() == 10
