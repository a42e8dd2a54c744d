"""Message decoding, validation and payload numbers on hand-made rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from support import as_dicts
from fieldpulse.functions.scalar import iso_timestamp, normalise_path, parse_timestamp, version_from_file_name
from fieldpulse.operators import decode
from fieldpulse.schemas import LOG_ENTRY, RAW_MESSAGE, READING
from fieldpulse.sources import sinks
from fieldpulse.session import scratch_path

NOW = datetime(2024, 1, 31)
ID = "123e4567-e89b-12d3-a456-426614174000"


def decoded(spark, topic, body):
    df = spark.createDataFrame([(1, topic, body, NOW)], RAW_MESSAGE)
    return as_dicts(decode.decode_messages(df))[0]


def test_device_from_topic(spark):
    row = decoded(spark, "devices/d1/telemetry", '{"device_type":"x","payload":{"a":1}}')
    assert row["device_id"] == "d1" and row["ts"] == NOW and row["decode_error"] is None


def test_short_topic_has_no_device(spark):
    assert decoded(spark, "devices/d1", '{"payload":{"a":1}}')["decode_error"] == "missing_device_id"


def test_body_device_wins_over_topic(spark):
    assert decoded(spark, "devices/d1/telemetry", '{"device_id":"d2","payload":{}}')["device_id"] == "d2"


def test_loose_keys_become_payload_in_order(spark):
    row = decoded(spark, "t", '{"device_id":"d","z":1,"a":2.5,"metadata":{"v":1},"timestamp":"2024-01-30T10:00:00"}')
    assert row["payload"] == '{"z":1,"a":2.5}'
    assert row["device_type"] == "unknown"
    assert row["ts"] == datetime(2024, 1, 30, 10)
    assert row["metadata"] == '{"v":1}'


def test_zone_and_naive_times_agree(spark):
    for text in ("2024-01-30T10:00:00+00:00", "2024-01-30T12:00:00+02:00", "2024-01-30T10:00:00"):
        assert decoded(spark, "t", f'{{"device_id":"d","payload":{{}},"timestamp":"{text}"}}')["ts"] == datetime(2024, 1, 30, 10)


def test_bad_messages(spark):
    assert decoded(spark, "t", '{"device_id":')["decode_error"] == "invalid_json"
    assert decoded(spark, "t", "[1, 2]")["decode_error"] == "invalid_json"
    assert decoded(spark, "t", '{"device_id":"d","payload":7}')["decode_error"] == "invalid_payload"
    assert decoded(spark, "t", '{"device_id":"d","payload":"{\\"a\\":1}"}')["decode_error"] == "invalid_payload"
    assert decoded(spark, "t", '{"device_id":"d","payload":{},"timestamp":"soon"}')["decode_error"] == "invalid_timestamp"


def reason(spark, offset=timedelta(), payload='{"a":1}', device=ID):
    df = spark.createDataFrame([(1, device, "t", NOW + offset, payload, "{}")], READING)
    return decode.validate(df, F.lit(NOW)).first()["reject_reason"]


def test_validation_limits(spark):
    assert reason(spark, timedelta(minutes=5)) is None
    assert reason(spark, timedelta(minutes=5, seconds=1)) == "timestamp_in_future"
    assert reason(spark, timedelta(hours=-24)) is None
    assert reason(spark, timedelta(hours=-24, seconds=-1)) == "timestamp_too_old"
    assert reason(spark, payload="{}") == "empty_payload"
    assert reason(spark, device="abc") == "invalid_device_id"
    assert reason(spark, device=ID.replace("-", "").upper()) is None


def test_first_failing_rule_is_the_reason(spark):
    assert reason(spark, timedelta(hours=1), "{}", "abc") == "timestamp_in_future"
    assert reason(spark, timedelta(), "{}", "abc") == "empty_payload"


MIXED = '{"z":1.5,"anomaly":false,"unit":"c","a":7,"n":{"v":2,"b":1e3,"t":true},"s":"3.5","anomaly_type":4}'


def test_numbers_in_document_order(spark):
    df = spark.createDataFrame([(1, ID, "t", NOW, MIXED, "{}")], READING)
    flat = [(r["metric"], r["value"]) for r in decode.long_metrics(df).orderBy("position").collect()]
    assert flat == [("z", 1.5), ("a", 7.0)]
    nested = [(r["metric"], r["value"]) for r in decode.long_metrics(df, nested=True).orderBy("position").collect()]
    assert nested == [("z", 1.5), ("a", 7.0), ("n.v", 2.0), ("n.b", 1000.0), ("anomaly_type", 4.0)]


def test_no_numbers(spark):
    rows = [(i, ID, "t", NOW, p, "{}") for i, p in enumerate(["{}", "[]", "x", None, '{"a":"1"}', '{"a":null}', '{"a":[1]}'])]
    assert decode.long_metrics(spark.createDataFrame(rows, READING)).count() == 0


def test_log_round_trip(spark):
    rows = [(1, ID, "t", NOW, '{"b":1,"a":{"x":"ü"}}', '{"v":"1"}'), (2, ID, "t", NOW + timedelta(microseconds=5), "{}", "{}")]
    df = spark.createDataFrame(rows, READING)
    entries = decode.to_log_entries(df)
    assert [(f.name, f.dataType) for f in entries.drop("id").schema] == [(f.name, f.dataType) for f in LOG_ENTRY]
    assert entries.orderBy("id").first()["payload"] == '{"payload":{"b":1,"a":{"x":"ü"}}}'
    assert as_dicts(decode.from_log_entries(entries).orderBy("id")) == as_dicts(df.orderBy("id"))


def test_iso_text(spark):
    df = spark.createDataFrame([(NOW,), (NOW + timedelta(microseconds=1500),)], "ts timestamp")
    assert [r[0] for r in df.select(iso_timestamp(F.col("ts"))).collect()] == ["2024-01-31T00:00:00", "2024-01-31T00:00:00.001500"]
    assert df.select(parse_timestamp(iso_timestamp(F.col("ts"))) == F.col("ts")).distinct().collect()[0][0] is True


def test_paths_and_file_versions(spark):
    paths = [("/api/v1/devices/abc-123", "/api/v1/devices/:id"), ("/api/v1/health-check", "/api/v1/health-check"),
             ("/x/aaaaaaaaaaaaaaaaaaaaa/", "/x/:id"), ("/x/aaaaaaaaaaaaaaaaaaaa", "/x/aaaaaaaaaaaaaaaaaaaa"), ("/", "/")]
    df = spark.createDataFrame(paths, "p string, want string")
    assert df.filter(normalise_path(F.col("p")) != F.col("want")).count() == 0
    files = [("model_v1.2.3.onnx", "1.2.3"), ("model.onnx", "1.0.0"), ("/a_v9/model_v2_v3.onnx", "3"), ("m_v7", "7")]
    df = spark.createDataFrame(files, "p string, want string")
    assert df.filter(version_from_file_name(F.col("p")) != F.col("want")).count() == 0


def test_ingest_counts_and_split(spark):
    rows = [(i, ID, "t", NOW, "{}" if i % 3 == 0 else '{"a":1}', "{}") for i in range(30)]
    checked = decode.validate(spark.createDataFrame(rows, READING), F.lit(NOW))
    path = scratch_path(spark, "t")
    assert sinks.ingest_batch(checked, path) == {"accepted": 20, "rejected": 10}
    assert spark.read.parquet(path).count() == 20
    good, bad = sinks.split_bad_records(checked)
    assert good.count() == 20 and {r[0] for r in bad.select("reject_reason").collect()} == {"empty_payload"}
