"""Rows the sample tables do not hold: odd messages, repeated keys, spikes, zero runs, empty vectors, ends of life."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from support import as_dicts
from fieldpulse.operators import decode, detect, features, lifecycle, merge, trend, windows
from fieldpulse.schemas import RAW_MESSAGE, READING
from fieldpulse.session import scratch_path
from fieldpulse.sources import sinks

NOW = datetime(2024, 1, 31)


def decoded(spark, body):
    return as_dicts(decode.decode_messages(spark.createDataFrame([(1, "devices/d/telemetry", body, NOW)], RAW_MESSAGE)))[0]


@pytest.mark.parametrize("body,error", [
    ('{"payload":{"a":1}} junk', "invalid_json"),
    ('{"payload":"{\\"a\\":1}","metadata":{"payload":{"b":2}}}', "invalid_payload"),
    ('{"payload":{"a":1},"metadata":5}', "invalid_metadata"),
    ('{"payload":{"a":1},"device_type":7}', "missing_device_type"),
    ('{"payload":{"a":1},"timestamp":true}', "invalid_timestamp"),
    ('{"payload":{"a":1},"timestamp":1704067200}', None),
])
def test_kinds_of_message_fields(spark, body, error):
    assert decoded(spark, body)["decode_error"] == error


def test_epoch_times_and_last_of_equal_keys(spark):
    assert decoded(spark, '{"payload":{},"timestamp":1704067200}')["ts"] == datetime(2024, 1, 1)
    assert decoded(spark, '{"payload":{},"timestamp":1704067200500}')["ts"] == datetime(2024, 1, 1, 0, 0, 0, 500_000)
    assert decoded(spark, '{"payload":{"a":1},"payload":{"z":2,"b":3}}')["payload"] == '{"z":2,"b":3}'


@pytest.mark.parametrize("nested", [False, True])
def test_repeated_payload_key_counts_once(spark, nested):
    df = spark.createDataFrame([(1, "d", "t", NOW, '{"b":5,"a":1,"c":"x","a":2,"n":{"v":1,"v":3}}', "{}")], READING)
    got = [(r["metric"], r["value"]) for r in decode.long_metrics(df, nested).orderBy("position").collect()]
    assert got == [("b", 5.0), ("a", 2.0)] + ([("n.v", 3.0)] if nested else [])


def test_moving_average_forgets_what_has_left(spark):
    values = [1e17, 1.5, 1.5, float("nan"), 1.5, 1.5, float("inf"), 1.5, 1.5, 1.5]
    rows = [(i, "t", "m", NOW + timedelta(minutes=45 * i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, device_type string, metric string, ts timestamp, value double")
    got = [r["moving_avg"] for r in trend.moving_average(df, hours=1).orderBy("id").collect()]
    want = [sum(values[max(0, i - 1) : i + 1]) / len(values[max(0, i - 1) : i + 1]) for i in range(len(values))]
    assert all((math.isnan(g) and math.isnan(w)) or g == w for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("max_rows", [7, 500, 1_000_000])
def test_smoothed_latency_is_the_same_for_all_slots(spark, max_rows):
    values = [50.0, *[0.0] * 2600, 40.0, 30.0, None, 30.0]
    rows = [("k", NOW + timedelta(seconds=i), i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id int, value double")
    row = windows.smoothed_latency(df, "key", ["ts", "id"], "value", max_rows=max_rows).first()
    ema = 0.0
    for x in (v for v in values if v is not None):
        ema = x if ema == 0 else 0.3 * x + 0.7 * ema
    assert row["observations"] == 2604 and row["ema_latency"] == pytest.approx(ema, abs=1e-9)


def test_empty_vectors_take_no_label(spark):
    rows = [(i, [0.0, float(i)]) for i in range(40)] + [(100 + i, []) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    marked = features.variance_labels(df).filter("label = 1").select("id").collect()
    assert sorted(r[0] for r in marked) == [38, 39]


@pytest.mark.parametrize("n", [10, 300, 4000])
def test_contamination_counts_all_rows(spark, n):
    vectors = spark.range(n).select("id", F.array(F.rand(1), F.randn(2), F.rand(3)).alias("features"))
    scored = detect.score_forest(vectors, detect.train_forest(vectors, n_trees=20)).select("raw_score").collect()
    assert sum(r[0] < 0 for r in scored) == math.ceil((n - 1) * 0.05)


def judged(spark, *events):
    rows = [(i, 1, kind, status, "fw", NOW + timedelta(seconds=i)) for i, (kind, status) in enumerate(events)]
    schema = "event_id int, device_id int, event_type string, status string, firmware string, ts timestamp"
    df = lifecycle.judge_events(spark.createDataFrame(rows, schema))
    return [r["reject_reason"] for r in df.orderBy("event_id").collect()], lifecycle.device_snapshot(df).first()["status"]


def test_update_may_end_a_device(spark):
    reasons, status = judged(
        spark, ("created", None), ("updated", "decommissioned"), ("updated", "active"), ("decommissioned", None), ("created", None)
    )
    assert reasons == [None, None, "decommissioned", "decommissioned", "already_exists"] and status == "decommissioned"


def test_missing_label_equals_missing_label(spark):
    rows = [("a", None, "critical"), ("a", None, "warning"), ("a", "s", "warning")]
    left = merge.inhibit_warnings(spark.createDataFrame(rows, "alertname string, service string, severity string"))
    assert left.columns == ["alertname", "service", "severity"]
    assert sorted((r["service"] or "", r["severity"]) for r in left.collect()) == [("", "critical"), ("s", "warning")]


def test_silent_group_has_a_backlog(spark):
    published = spark.createDataFrame([("s", 10)], "stream string, published bigint")
    consumed = spark.createDataFrame([("s", "g", 4)], "stream string, consumer_group string, consumed bigint")
    groups = spark.createDataFrame([("s", "g"), ("s", "h")], "stream string, consumer_group string")
    got = {r["consumer_group"]: r["backlog"] for r in merge.stream_backlog(published, consumed, groups).collect()}
    assert got == {"g": 6, "h": 10}


def test_rejected_readings_are_kept_with_their_reasons(spark):
    rows = [(i, "bad" if i % 3 == 0 else None) for i in range(9)]
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    counts = sinks.ingest_batch(spark.createDataFrame(rows, "id int, reject_reason string"), good, rejected_path=bad)
    assert counts == {"accepted": 6, "rejected": 3}
    assert sorted(tuple(r) for r in spark.read.parquet(bad).collect()) == [(0, "bad"), (3, "bad"), (6, "bad")]
    assert spark.read.parquet(good).columns == ["id"]


def test_training_set_splits_only_rows_with_numbers(spark):
    rows = [(i, "d", "t", NOW + timedelta(seconds=i), '{"a":%d}' % i if i % 2 else '{"s":"x"}', "{}") for i in range(40)]
    out = features.training_set(spark.createDataFrame(rows, READING), newest_rows=30).collect()
    assert sorted(r["id"] for r in out) == list(range(11, 40, 2))
    assert sorted(r["id"] for r in out if r["split"] == "validation") == [11, 13, 15]
    assert all((r["label"] is None) == (r["split"] == "train") for r in out)
