"""Logs kept by day: retention, lengths and gathered days against plain versions, and what their plans read."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldpulse.session import scratch_path
from fieldpulse.sources import dated
from fieldpulse.streaming import jobs
from fieldpulse.streaming.batches import write_batch

T0 = datetime(2024, 3, 1)
ROW = "id bigint, ts timestamp, value double"


def rows(first, n, hours=5):
    """Entries over several days, two at a time in one instant, and every tenth without a time."""
    return [(i, None if i % 10 == 9 else T0 + timedelta(hours=hours * (i // 2)), i / 2) for i in range(first, first + n)]


@pytest.fixture
def log(spark):
    path = scratch_path(spark, "dated")
    for n, part in enumerate((rows(0, 30), rows(30, 30))):
        write_batch(spark.createDataFrame(part, ROW), path, n, "ts")
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keep", [0, 1, 3, 4, 17, 40, 53, 54, 57, 60, 500])
def test_newest_entries_over_days(spark, log, keep):
    kept = dated.keep_newest_days(spark.read.parquet(log), keep)
    order = sorted(rows(0, 60), key=lambda r: (r[1] or datetime.min, r[0]), reverse=True)
    assert sorted(r["id"] for r in kept.collect()) == sorted(r[0] for r in order[:keep])
    assert kept.columns == spark.read.parquet(log).columns


def test_older_days_are_pruned(spark, log):
    text = plan(dated.keep_newest_days(spark.read.parquet(log), 4))
    assert "date" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_lengths_read_no_column(spark, log):
    df = spark.read.parquet(log)
    for lengths in (dated.day_lengths({"a": df, "b": df}), dated.log_lengths({"a": df, "b": df})):
        schemas = [part.split(">", 1)[0] for part in plan(lengths).split("ReadSchema: struct<")[1:]]
        assert schemas == ["", ""]
    got = {(r["stream"], r["date"]): r["length"] for r in dated.day_lengths({"a": df}).collect()}
    assert got[("a", None)] == 6 and sum(got.values()) == 60 and got[("a", T0.date())] == 9
    assert dated.log_lengths({"a": df, "none": df.limit(0)}).collect() == [("a", 60), ("none", 0)]


def test_old_folders_are_deleted(spark, log):
    day = dated.border_day(spark.read.parquet(log), 20)[0]
    newest = sorted(r["id"] for r in dated.keep_newest_days(spark.read.parquet(log), 20).collect())
    gone = dated.drop_days_before(spark, log, day)
    assert "date=2024-03-01" in gone and "date=__HIVE_DEFAULT_PARTITION__" in gone and f"date={day}" not in gone
    assert dated.drop_days_before(spark, log, day) == []
    left = spark.read.parquet(log)
    assert left.agg(F.min("date")).first()[0] == day
    assert sorted(r["id"] for r in dated.keep_newest_days(left, 20).collect()) == newest


def test_gathered_and_open_days_are_one_log(spark, log):
    gathered = scratch_path(spark, "gathered")
    ids = lambda: sorted(r["id"] for r in dated.with_gathered(spark.read.parquet(log), spark.read.parquet(gathered)).collect())
    assert dated.with_gathered(spark.read.parquet(log), None).count() == 60
    for _ in range(2):
        jobs.compact_days(spark.read.parquet(log), gathered, "2024-03-02", "2024-03-04")
        assert ids() == list(range(60))
    # a batch that comes late for a gathered day is read from its own folder, then gathered again
    late = [(100 + i, datetime(2024, 3, 3, i), 0.0) for i in range(5)]
    write_batch(spark.createDataFrame(late, ROW), log, 2, "ts")
    assert ids() == [*range(60), *range(100, 105)]
    jobs.compact_days(spark.read.parquet(log), gathered, "2024-03-03", "2024-03-03")
    assert ids() == [*range(60), *range(100, 105)]
    both = dated.with_gathered(spark.read.parquet(log), spark.read.parquet(gathered))
    filters = [part.split("PushedFilters", 1)[0] for part in plan(both).split("PartitionFilters: [")[1:]]
    assert len(filters) == 2 and all("element_at" in f and "date#" in f for f in filters)
    assert both.filter(F.col("date") == date(2024, 3, 3)).count() == 5 + sum(r[1] is not None and r[1].date() == date(2024, 3, 3) for r in rows(0, 60))


def test_empty_log(spark):
    path = scratch_path(spark, "dated")
    write_batch(spark.createDataFrame([], ROW), path, 0, "ts")
    log = spark.read.parquet(path)
    assert dated.keep_newest_days(log, 5).count() == 0 and dated.border_day(log, 5) is None
    assert dated.day_lengths({"a": log}).count() == 0
