"""Late rows set aside before a stateful step, by a watermark of the query's own that survives restarts.

Spark's stateful operators drop rows behind the watermark without a trace. Here every micro-batch is
split first: a row is late if its deadline (its time, or the end of its window) is not after
the watermark that the batches before have left. Late rows go to a quarantine table by batch,
so rows in and rows late always add up. The watermark is the newest time of all batches so far less
the allowed lateness; it is written under the batch number next to the checkpoint, and a
repeated batch reads the one before it again, so it is split alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldpulse.sources.tables import read_log
from fieldpulse.streaming.batches import start, write_batch


def interval_micros(spark: SparkSession, interval: str) -> int:
    """Microseconds of an interval such as `5 minutes`."""
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {interval}"))).first()[0]


def _mark_folder(checkpoint: str, batch_id: int) -> str:
    return f"{checkpoint}/event_time/batch_id={batch_id}"


def watermark_before(spark: SparkSession, checkpoint: str, batch_id: int) -> int | None:
    """Watermark in microseconds that the batches before `batch_id` have left; None before the first time seen."""
    if batch_id == 0:
        return None
    return spark.read.schema("micros bigint").parquet(_mark_folder(checkpoint, batch_id - 1)).first()["micros"]


def start_without_late(
    stream: DataFrame,
    on_time: Callable[[DataFrame, int], None],
    late: str,
    checkpoint: str,
    ts: str = "ts",
    lateness: str = "24 hours",
    deadline: Column | None = None,
    **how,
) -> StreamingQuery:
    """Run `on_time` on every batch without its late rows; those are written to the table `late`.

    Rows without a time, or without a deadline, can never be in time and are late too.
    """
    allowed = interval_micros(stream.sparkSession, lateness)
    due = F.unix_micros(F.col(ts) if deadline is None else deadline)

    def on_batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        before = watermark_before(spark, checkpoint, n)
        behind = due.isNull() if before is None else due.isNull() | (due <= F.lit(before))
        held = df.withColumn("_late", behind).persist()
        try:
            newest = held.agg(F.max(F.unix_micros(ts))).first()[0]
            write_batch(held.filter("_late").drop("_late"), late, n)
            on_time(held.filter("NOT _late").drop("_late"), n)
            marks = [m for m in (before, None if newest is None else newest - allowed) if m is not None]
            mark = F.lit(max(marks, default=None)).cast("bigint").alias("micros")
            spark.range(1).select(mark).write.mode("overwrite").parquet(_mark_folder(checkpoint, n))
        finally:
            held.unpersist()

    return start(stream, on_batch, checkpoint, **how)


def on_time_log_job(
    stream: DataFrame, log: str, late: str, checkpoint: str, ts: str = "ts", lateness: str = "24 hours", **how
) -> StreamingQuery:
    """Keep the rows that are in time as a log for stateful queries, the others in the table `late`.

    A query that reads the log in order with the same lateness finds no late row in it: its
    watermark follows from batches that were written before, so it is never ahead of this one's.
    """
    return start_without_late(stream, lambda df, n: write_batch(df, log, n), late, checkpoint, ts, lateness, **how)


def on_time_stream(spark: SparkSession, log: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The log of `on_time_log_job` as a stream."""
    return read_log(spark, f"{log}/*", schema, max_files_per_trigger=max_files_per_trigger)


def late_counts(late: DataFrame) -> DataFrame:
    """(batch_id, late_rows) of a quarantine table."""
    return late.groupBy("batch_id").agg(F.count(F.lit(1)).alias("late_rows"))
