"""Continuous queries. Each has its own checkpoint; each batch is written under its batch number.

A batch that is repeated after a failure replaces what its first attempt wrote,
so sinks hold every batch exactly once. Late rows are set aside before a stateful
step (`lateness`). Readings and scores are kept by day and
batch, so that a time range prunes folders; `compact_days` gathers closed days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldpulse.operators.aggregates import tumbling_counts
from fieldpulse.operators.decode import from_log_entries, ingest
from fieldpulse.operators.detect import ALERT_THRESHOLD, Forest, emit_alerts, score_forest
from fieldpulse.sources.sinks import split_bad_records
from fieldpulse.sources.tables import deal
from fieldpulse.streaming.batches import start, write_batch
from fieldpulse.streaming.lateness import interval_micros, start_without_late

TASK_BYTES = 32 << 20  # messages of one task

def compact_days(batches: DataFrame, target: str, first: str, last: str) -> None:
    """Gather the closed days `first` to `last` of a table kept by day and batch into one kept by day.

    The folder `through=n` names the last batch that was there; `sources.dated.with_gathered` reads both
    tables as one. A repeated run replaces the same folders, a run after further batches adds newer ones.
    """
    through = batches.agg(F.max("batch_id")).first()[0]
    if through is None:
        return
    closed = batches.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("batch_id") <= through))
    dated = closed.drop("batch_id").withColumn("through", F.lit(through))
    gathered = dated.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    gathered.partitionBy("date", "through").parquet(target)


def append_job(
    stream: DataFrame, path: str, checkpoint: str, ts: str | None = None, flush_rows: int | None = None, **how
) -> StreamingQuery:
    """Append a stream to a table in micro-batches, by day of `ts`; confirmed only after the batch is written.

    A batch is due every five seconds; with `flush_rows` (100 in the service this follows) it is
    written in files of at most so many rows.
    """
    return start(stream, lambda df, n: write_batch(df, path, n, ts, flush_rows), checkpoint, **how)


def ingest_job(messages: DataFrame, good: str, quarantine: str, checkpoint: str, **how) -> StreamingQuery:
    """Raw messages to a readings table and a quarantine table with reasons; decoded once per batch.

    The messages are dealt out by their size first: a log that is small in its files, or ordered by
    time, would leave all of a large batch, or whole days, with a few tasks.
    """

    def on_batch(df: DataFrame, n: int) -> None:
        checked = ingest(deal(df, "body", TASK_BYTES)).persist()
        try:
            accepted, rejected = split_bad_records(checked)
            write_batch(accepted, good, n, "ts")
            write_batch(rejected, quarantine, n)
        finally:
            checked.unpersist()

    return start(messages, on_batch, checkpoint, **how)


def persist_job(entries: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Log entries to the readings table."""
    return append_job(from_log_entries(entries), path, checkpoint, "ts", **how)


def scoring_job(
    vectors: DataFrame,
    forest: Forest,
    results: str,
    alerts: str,
    checkpoint: str,
    threshold: float = ALERT_THRESHOLD,
    **how,
) -> StreamingQuery:
    """Score a stream of feature vectors; all scores are kept, alerts are the part above the threshold."""

    def on_batch(df: DataFrame, n: int) -> None:
        scored = score_forest(df, forest).persist()
        try:
            write_batch(scored, results, n, "ts")
            write_batch(emit_alerts(scored, forest.version, threshold), alerts, n)
        finally:
            scored.unpersist()

    return start(vectors, on_batch, checkpoint, **how)


def window_count_job(
    stream: DataFrame, width: str, path: str, late: str, checkpoint: str, keys: Sequence[str] = (), ts: str = "ts",
    lateness: str = "24 hours", **how,
) -> StreamingQuery:
    """Tumbling counts; every batch writes what it adds to its windows. Add up with `final_windows`.

    Rows whose window was closed by the batches before go to the table `late`. Counts add up,
    so no window is kept between batches and none is written again.
    """
    size = interval_micros(stream.sparkSession, width)
    micros = F.unix_micros(ts)
    end = F.timestamp_micros(micros - F.pmod(micros, F.lit(size)) + size)
    count = lambda df, n: write_batch(tumbling_counts(df, width, keys, ts), path, n)
    return start_without_late(stream, count, late, checkpoint, ts, lateness, end, **how)


def final_windows(written: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The whole count of each window."""
    return written.groupBy("window_start", "window_end", *keys).agg(F.sum("count").alias("count"))


def without_redelivery(readings: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """Drop repeated deliveries. The id is a function of the content, so a repeat has the same one.

    A repeat is known as long as its first delivery is within `lateness` of the newest reading.
    Read from `lateness.on_time_stream`, so that readings behind that are counted and not lost.
    """
    content = F.concat_ws("|", F.col("device_id").cast("string"), F.unix_micros("ts").cast("string"), F.col("payload"))
    return (
        readings.withColumn("content_id", F.sha2(content, 256))
        .withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["content_id"])
    )


def arrival_class(arrived_at: str = "arrived_at", ts: str = "ts"):
    """`late` beyond 24 hours, `early` beyond 5 minutes, else `on_time`."""
    return (
        F.when(F.col(ts) < F.col(arrived_at) - F.expr("INTERVAL 24 HOURS"), "late")
        .when(F.col(ts) > F.col(arrived_at) + F.expr("INTERVAL 5 MINUTES"), "early")
        .otherwise("on_time")
    )
