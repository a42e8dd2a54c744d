"""Streams against batch, repeated batches, restarts, late state."""

import os
import shutil
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from support import as_dicts
from fieldpulse.operators import features
from fieldpulse.operators.decode import to_log_entries
from fieldpulse.operators.filters import time_range
from fieldpulse.operators.windows import latest_per_key
from fieldpulse.session import scratch_path
from fieldpulse.sources import sample_views as V, tables
from fieldpulse.streaming import batches, feed, jobs, lateness, stateful

T0 = datetime(2024, 1, 1)
READINGS = "id bigint, device_id string, device_type string, ts timestamp, payload string"


def land(spark, folder, df, name):
    """Put one file with the given name into a log folder."""
    os.makedirs(folder, exist_ok=True)
    part = scratch_path(spark, "part")
    df.coalesce(1).write.parquet(part)
    file = next(f for f in os.listdir(part.removeprefix("file:")) if f.endswith(".parquet"))
    shutil.copy(os.path.join(part.removeprefix("file:"), file), os.path.join(folder, f"{name}.parquet"))


def run(job):
    job.awaitTermination()


def test_features_over_several_files_equal_batch(spark, folder, tmp_path):
    """The log is cut into files in time order and read one file per batch."""
    readings = V.readings(spark, folder).withColumn("device_id", F.col("device_id").cast("string"))
    log = str(tmp_path / "log")
    for n in range(4):
        land(spark, log, readings.filter((F.col("id") >= 250 * n) & (F.col("id") < 250 * (n + 1))), f"part{n}")
    stream = tables.read_log(spark, log, READINGS, max_files_per_trigger=1)
    out = scratch_path(spark, "vectors")
    run(jobs.append_job(stateful.stateful_features(stream, buckets=8), out, scratch_path(spark, "cp"), available_now=True))
    got = {r["id"]: r["features"] for r in spark.read.parquet(out).collect()}
    want = {r["id"]: r["features"] for r in features.feature_vectors(readings).collect()}
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_failed_batch_is_repeated_without_duplicates(spark, tmp_path):
    log, out, checkpoint = str(tmp_path / "log"), scratch_path(spark, "out"), scratch_path(spark, "cp")
    land(spark, log, spark.range(100).select("id"), "a")
    stream = lambda: tables.read_log(spark, log, "id bigint")

    def crash(df, n):
        batches.write_batch(df, out, n)
        raise RuntimeError("lost before the confirmation")

    with pytest.raises(Exception):
        run(batches.start(stream(), crash, checkpoint, available_now=True))
    run(jobs.append_job(stream(), out, checkpoint, available_now=True))
    assert spark.read.parquet(out).count() == 100
    land(spark, log, spark.range(100, 130).select("id"), "b")
    run(jobs.append_job(stream(), out, checkpoint, available_now=True))
    ids = sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert ids == list(range(130))


def test_groups_are_independent(spark, tmp_path):
    log = str(tmp_path / "log")
    land(spark, log, spark.range(10).select("id"), "a")
    for _ in range(2):
        out = scratch_path(spark, "out")
        run(jobs.append_job(tables.read_log(spark, log, "id bigint"), out, scratch_path(spark, "cp"), available_now=True))
        assert spark.read.parquet(out).count() == 10


def test_redelivery_in_a_later_file(spark, tmp_path):
    log, out = str(tmp_path / "log"), scratch_path(spark, "out")
    rows = [(i, "d", "t", T0 + timedelta(minutes=i), f'{{"a":{i}}}') for i in range(20)]
    again = [(1000 + r[0], *r[1:]) for r in rows[5:]]
    land(spark, log, spark.createDataFrame(rows, READINGS), "a")
    land(spark, log, spark.createDataFrame(again + [(99, "d", "t", T0, '{"a":99}')], READINGS), "b")
    stream = jobs.without_redelivery(tables.read_log(spark, log, READINGS, max_files_per_trigger=1))
    run(jobs.append_job(stream, out, scratch_path(spark, "cp"), available_now=True))
    assert spark.read.parquet(out).count() == 21


def test_windows_end_with_their_final_count(spark, tmp_path):
    log, out = str(tmp_path / "log"), scratch_path(spark, "out")
    for n in range(3):
        land(spark, log, spark.range(10).select((F.lit(T0) + F.make_dt_interval(mins=F.col("id") * 2)).alias("ts")), f"f{n}")
    stream = tables.read_log(spark, log, "ts timestamp", max_files_per_trigger=1)
    run(jobs.window_count_job(stream, "5 minutes", out, scratch_path(spark, "late"), scratch_path(spark, "cp"), available_now=True))
    final = jobs.final_windows(spark.read.parquet(out)).orderBy("window_start")
    assert [r["count"] for r in final.collect()] == [9, 6, 9, 6]


def test_liveness_changes(spark, tmp_path):
    log, out = str(tmp_path / "log"), scratch_path(spark, "out")
    beat = lambda rows: spark.createDataFrame([(n, T0 + timedelta(seconds=s)) for n, s in rows], "node_id string, ts timestamp")
    land(spark, log, beat([("a", 0), ("b", 0), ("c", 0), ("d", 0), ("clock", 15)]), "a")
    land(spark, log, beat([("b", 16), ("clock", 25)]), "b")
    land(spark, log, beat([("c", 26), ("d", 5), ("clock", 36)]), "c")
    stream = tables.read_log(spark, log, "node_id string, ts timestamp", max_files_per_trigger=1)
    run(jobs.append_job(stateful.liveness_changes(stream, 10, event_time=True, lateness="0 seconds"), out, scratch_path(spark, "cp"), available_now=True))
    changes = spark.read.parquet(out)
    last = {r["node_id"]: r["status"] for r in latest_per_key(changes, ["node_id"], ["batch_id", "changed_at_ms"]).collect()}
    # b is silent for 20 s at the end, a and d for more; c was dead when it came back and stays so
    assert last["a"] == "dead" and last["b"] == "suspect" and last["clock"] == "alive"
    assert {r["status"] for r in changes.filter("node_id = 'a'").collect()} == {"alive", "suspect", "dead"}


def test_ingest_splits_every_message(spark, folder):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    messages = V.messages_of(V.readings_of(V.telemetry_stream(spark, folder)))
    run(jobs.ingest_job(messages, good, bad, scratch_path(spark, "cp"), available_now=True))
    accepted, rejected = spark.read.parquet(good), spark.read.parquet(bad)
    assert accepted.count() + rejected.count() == 1000
    assert rejected.filter("reject_reason IS NULL").isEmpty() and "reject_reason" not in accepted.columns
    assert {"invalid_json", "missing_device_id", "invalid_payload", "empty_payload", "timestamp_too_old"} <= {
        r[0] for r in rejected.select("reject_reason").distinct().collect()}


def test_ingest_deals_out_a_large_batch_by_its_size(spark, folder, monkeypatch):
    """What one task keeps follows neither from the number of files nor from that of the cores."""
    decode, largest = jobs.ingest, []

    def watched(df):
        sizes = df.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("body")).alias("bytes"))
        largest.append(sizes.agg(F.max("bytes")).first()[0])
        return decode(df)

    monkeypatch.setattr(jobs, "ingest", watched)
    monkeypatch.setattr(jobs, "TASK_BYTES", 4096, raising=False)
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    messages = V.messages_of(V.readings_of(V.telemetry_stream(spark, folder)))
    run(jobs.ingest_job(messages, good, bad, scratch_path(spark, "cp"), available_now=True))
    assert len(largest) == 1 and largest[0] <= 2 * 4096
    assert spark.read.parquet(good).count() + spark.read.parquet(bad).count() == 1000


def test_dealing_counts_empty_and_missing_texts(spark):
    rows = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), (F.col("id") % 3).cast("int"))).alias("text"))
    assert tables.deal(rows, "text", 650).rdd.getNumPartitions() == -(-(64 * 1000 + 999) // 650)
    assert tables.deal(rows.limit(0), "text", 650).count() == 0


def test_arrival_class(spark):
    offsets = [0, 300, 301, -86400, -86401]
    df = spark.createDataFrame([(T0 + timedelta(seconds=s), T0) for s in offsets], "ts timestamp, arrived_at timestamp")
    assert [r[0] for r in df.select(jobs.arrival_class()).collect()] == ["on_time", "on_time", "early", "on_time", "late"]


def test_live_feed(spark, folder):
    rows = as_dicts(tables.live_feed(V.telemetry(spark, folder), V.alerts(spark, folder), 990, 995))
    assert sorted(r["id"] for r in rows if r["kind"] == "reading") == list(range(991, 1000))
    assert all(r["stream_length"] == 1000 for r in rows)


def test_feed_polls_new_batches_only(spark, tmp_path):
    """Three batches with a restart, polls in between, a batch written twice, an empty poll and an empty stream."""
    log, path, checkpoint = str(tmp_path / "log"), scratch_path(spark, "feed"), scratch_path(spark, "cp")
    part = lambda first, n: spark.range(first, first + n).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    schema = "id bigint, ts timestamp"
    job = lambda: feed.feed_job(tables.read_log(spark, log, schema, max_files_per_trigger=1), path, checkpoint, available_now=True)
    nothing = scratch_path(spark, "feed")
    paths = {"reading": path, "alert": nothing}
    rows, cursor = feed.poll_feed(spark, paths, schema)
    assert rows.count() == 0 and cursor == {"reading": -1, "alert": -1}
    land(spark, log, part(0, 10).coalesce(1), "a")
    run(job())
    rows, cursor = feed.poll_feed(spark, paths, schema, cursor)
    assert {(r["id"], r["reading_length"], r["alert_length"]) for r in rows.collect()} == {(i, 10, 0) for i in range(10)}
    land(spark, log, part(10, 7).coalesce(1), "b")
    run(job())
    land(spark, log, part(17, 3).coalesce(1), "c")
    run(job())
    rows, later = feed.poll_feed(spark, paths, schema, cursor)
    assert sorted(r["id"] for r in rows.collect()) == list(range(10, 20)) and rows.first()["reading_length"] == 20
    assert later["reading"] > cursor["reading"]
    assert not any(f"batch_id={n}/" in f for f in rows.inputFiles() for n in range(cursor["reading"] + 1))
    rows, same = feed.poll_feed(spark, paths, schema, later)
    assert rows.count() == 0 and same == later
    assert feed.totals_of(spark, path, later["reading"])[0] == 20


def test_persisted_readings_are_pruned_by_day_and_survive_a_restart(spark, folder, tmp_path):
    readings = V.readings(spark, folder).withColumn("device_id", F.col("device_id").cast("string")).withColumn("metadata", F.lit("{}"))
    entries = to_log_entries(readings)
    log, out, checkpoint = str(tmp_path / "log"), scratch_path(spark, "persisted"), scratch_path(spark, "cp")
    schema = entries.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for n in range(2):
        land(spark, log, entries.filter(F.col("id") % 2 == n), f"part{n}")
        run(jobs.persist_job(tables.read_log(spark, log, schema), out, checkpoint, available_now=True))
    written = spark.read.parquet(out)
    assert written.count() == readings.count() and written.select("batch_id").distinct().count() == 2
    day = time_range(written, "2024-01-05 00:00:00", "2024-01-05 23:59:59")
    text = day._jdf.queryExecution().executedPlan().toString()
    assert "date" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert day.count() == readings.filter(F.to_date("ts") == "2024-01-05").count() > 0
    whole = scratch_path(spark, "compacted")
    for _ in range(2):
        jobs.compact_days(written, whole, "2024-01-05", "2024-01-06")
    assert spark.read.parquet(whole).count() == readings.filter(F.to_date("ts").between("2024-01-05", "2024-01-06")).count()


def test_window_counts_and_late_rows_add_up(spark, tmp_path):
    """A file that comes too late, over several batches and a restart; rows without a time are late too."""
    log, out, late, checkpoint = str(tmp_path / "log"), scratch_path(spark, "out"), scratch_path(spark, "late"), scratch_path(spark, "cp")
    minutes = lambda first, n: spark.range(n).select((F.lit(T0) + F.make_dt_interval(mins=F.col("id") + first)).alias("ts"))
    stream = lambda: tables.read_log(spark, log, "ts timestamp", max_files_per_trigger=1)
    job = lambda: jobs.window_count_job(stream(), "5 minutes", out, late, checkpoint, lateness="10 minutes", available_now=True)
    land(spark, log, minutes(0, 10), "a")
    land(spark, log, minutes(60, 10), "b")
    run(job())
    land(spark, log, minutes(20, 10), "c")  # behind the 59 minutes that file b has left
    run(job())
    land(spark, log, minutes(62, 10).unionByName(spark.createDataFrame([(None,)], "ts timestamp")), "d")
    run(job())
    windows = {r["window_start"]: r["count"] for r in jobs.final_windows(spark.read.parquet(out)).collect()}
    assert sum(windows.values()) == 30 and windows[T0 + timedelta(minutes=60)] == 5 + 3
    assert {r["batch_id"]: r["late_rows"] for r in lateness.late_counts(spark.read.parquet(late)).collect()} == {2: 10, 3: 1}


def test_a_row_behind_the_watermark_counts_while_its_window_is_open(spark, tmp_path):
    log, out, late = str(tmp_path / "log"), scratch_path(spark, "out"), scratch_path(spark, "late")
    at = lambda *minutes: spark.createDataFrame([(T0 + timedelta(minutes=m),) for m in minutes], "ts timestamp")
    land(spark, log, at(22), "a")  # leaves a watermark of 12 minutes
    land(spark, log, at(11, 14, 9), "b")  # the window from 10 to 15 is open, the one before is not
    stream = tables.read_log(spark, log, "ts timestamp", max_files_per_trigger=1)
    run(jobs.window_count_job(stream, "5 minutes", out, late, scratch_path(spark, "cp"), lateness="10 minutes", available_now=True))
    assert {r["window_start"].minute: r["count"] for r in jobs.final_windows(spark.read.parquet(out)).collect()} == {20: 1, 10: 2}
    assert [r["ts"].minute for r in spark.read.parquet(late).collect()] == [9]


def test_failed_batch_is_split_alike_when_repeated(spark, tmp_path):
    log, out, late, checkpoint = str(tmp_path / "log"), scratch_path(spark, "out"), scratch_path(spark, "late"), scratch_path(spark, "cp")
    at = lambda *minutes: spark.createDataFrame([(T0 + timedelta(minutes=m),) for m in minutes], "ts timestamp")
    land(spark, log, at(60), "a")
    land(spark, log, at(10, 200), "b")
    stream = lambda: tables.read_log(spark, log, "ts timestamp", max_files_per_trigger=1)
    job = lambda write: lateness.start_without_late(stream(), write, late, checkpoint, lateness="30 minutes", available_now=True)

    def crash(df, n):
        batches.write_batch(df, out, n)
        if n == 1:
            raise RuntimeError("lost before the confirmation")

    with pytest.raises(Exception):
        run(job(crash))
    run(job(lambda df, n: batches.write_batch(df, out, n)))
    assert sorted((r["ts"] - T0).seconds // 60 for r in spark.read.parquet(out).collect()) == [60, 200]
    assert [(r["ts"] - T0).seconds // 60 for r in spark.read.parquet(late).collect()] == [10]


def test_redelivery_and_late_readings_add_up(spark, tmp_path):
    log, kept, late, out = str(tmp_path / "log"), scratch_path(spark, "kept"), scratch_path(spark, "late"), scratch_path(spark, "out")
    rows = [(i, "d", "t", T0 + timedelta(hours=i), f'{{"a":{i}}}') for i in range(40)]
    land(spark, log, spark.createDataFrame(rows, READINGS), "a")
    again = [(100 + r[0], *r[1:]) for r in rows]  # those up to 15 hours are behind 24 hours of lateness
    land(spark, log, spark.createDataFrame(again, READINGS), "b")
    stream = tables.read_log(spark, log, READINGS, max_files_per_trigger=1)
    run(lateness.on_time_log_job(stream, kept, late, scratch_path(spark, "cp"), available_now=True))
    unique = jobs.without_redelivery(lateness.on_time_stream(spark, kept, READINGS, 1))
    run(jobs.append_job(unique, out, scratch_path(spark, "cp"), available_now=True))
    assert spark.read.parquet(late).count() == 16
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(40))


def test_late_heartbeats_are_counted(spark, tmp_path):
    log, kept, late, out = str(tmp_path / "log"), scratch_path(spark, "kept"), scratch_path(spark, "late"), scratch_path(spark, "out")
    beat = lambda rows: spark.createDataFrame([(n, T0 + timedelta(seconds=s)) for n, s in rows], "node_id string, ts timestamp")
    land(spark, log, beat([("a", 0), ("clock", 30)]), "a")
    land(spark, log, beat([("a", 5), ("clock", 40)]), "b")
    stream = tables.read_log(spark, log, "node_id string, ts timestamp", max_files_per_trigger=1)
    run(lateness.on_time_log_job(stream, kept, late, scratch_path(spark, "cp"), lateness="1 second", available_now=True))
    beats = lateness.on_time_stream(spark, kept, "node_id string, ts timestamp", 1)
    run(jobs.append_job(stateful.liveness_changes(beats, 10, True, "1 second"), out, scratch_path(spark, "cp"), available_now=True))
    assert [(r["node_id"], r["late_rows"]) for r in spark.read.parquet(late).groupBy("node_id").agg(F.count("*").alias("late_rows")).collect()] == [("a", 1)]
    assert spark.read.parquet(kept).count() == 3


@pytest.mark.parametrize("slice_size", [2_000_000, 30])
def test_feature_rows_against_plain_statistics(monkeypatch, slice_size):
    """Readings of 0 to 9 numbers, taken in several calls with the state of the calls before."""
    monkeypatch.setattr(stateful, "SLICE", slice_size)
    rng = np.random.default_rng(3)
    values = [rng.normal(100, 5, rng.integers(0, 10)) for _ in range(60)]

    class State(dict):
        getValue = dict.get
        updateValue = dict.__setitem__

    processor = stateful.RecentReadings(10)
    processor.recent = State()
    device = rng.choice(["a", "b", None], 60)
    got = {}
    for begin, end in ((0, 1), (1, 25), (25, 60)):
        ids = rng.permutation(np.arange(begin, end))
        frame = pd.DataFrame({"id": ids, "device_id": device[ids], "ts": [T0] * len(ids), "device_type": "t", "payload": "{}",
                              "values": [list(values[i]) for i in ids]})
        parts = iter([frame.iloc[:3], frame.iloc[3:]])
        for out in processor.handleInputRows((5,), parts, None):
            got |= {r.id: (r.device_id, r.features) for r in out.itertuples()}
    assert len(got) == 60 and {k: len(v[0]) for k, v in processor.recent.items()} == {("=a",): 10, ("=b",): 10, ("",): 10}
    for i, (name, vector) in got.items():
        own = [j for j in range(i + 1) if device[j] == device[i]]
        flat = np.concatenate([values[j] for j in own[-10:]])
        stats = [flat.mean(), flat.std(), flat.min(), flat.max()] if len(flat) else [0.0] * 4
        if len(own) == 1:
            stats = [values[i][0] if len(values[i]) else 0.0] * 4
        want = ([*values[i], *stats] + [0.0] * 8)[:8]
        assert name == device[i] and list(vector) == pytest.approx(want)


def test_features_of_a_stream_that_forgets(spark, folder, tmp_path):
    readings = V.readings(spark, folder).withColumn("device_id", F.col("device_id").cast("string"))
    log, out = str(tmp_path / "log"), scratch_path(spark, "vectors")
    land(spark, log, readings, "a")
    vectors = stateful.stateful_features(tables.read_log(spark, log, READINGS), forget_after_ms=86_400_000, buckets=8)
    job = jobs.append_job(vectors, out, scratch_path(spark, "cp"))  # with processing time there is always a next batch
    while not any(p.numInputRows for p in job.recentProgress) and job.isActive:
        time.sleep(0.2)
    job.stop()
    got = {r["id"]: r["features"] for r in spark.read.parquet(out).collect()}
    want = {r["id"]: r["features"] for r in features.feature_vectors(readings).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_flushed_files_hold_at_most_the_bound(spark, tmp_path):
    log, out, checkpoint = str(tmp_path / "log"), scratch_path(spark, "out"), scratch_path(spark, "cp")
    rows = spark.range(950).select("id", (F.lit(T0) + F.make_dt_interval(hours=F.col("id") % 30)).alias("ts"))
    land(spark, log, rows, "a")
    stream = lambda: tables.read_log(spark, log, "id bigint, ts timestamp")
    run(jobs.append_job(stream(), out, checkpoint, flush_rows=batches.FLUSH_ROWS, available_now=True))
    land(spark, log, rows.limit(120), "b")
    run(jobs.append_job(stream(), out, checkpoint, flush_rows=batches.FLUSH_ROWS, available_now=True))
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1070 and max(sizes) == 100
    dated = scratch_path(spark, "dated")
    run(jobs.append_job(stream(), dated, scratch_path(spark, "cp"), "ts", flush_rows=100, available_now=True))
    sizes = [r["count"] for r in spark.read.parquet(dated).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1070 and max(sizes) <= 100
