"""Writing micro-batches so that each can be repeated, and starting a query that does so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

FLUSH_SECONDS = 5
FLUSH_ROWS = 100
NO_DAY = "1970-01-01"


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int, ts: str | None = None, flush_rows: int | None = None) -> None:
    """Append that can be repeated: the folder of this batch is replaced.

    With `flush_rows` no file holds more rows than that: a task closes its file and goes on with the next.

    With `ts` the batch is split by day, `date=.../batch_id=...`, and only the folders it
    writes are replaced. The first batch also leaves an empty folder, so that a table
    nothing was written to can be read.
    """
    if ts is None:
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", flush_rows or 0)
        writer.parquet(batch_folder(path, batch_id))
        return
    if batch_id == 0:
        df.limit(0).write.mode("overwrite").parquet(batch_folder(f"{path}/date={NO_DAY}", batch_id))
    dated = df.withColumn("date", F.to_date(ts)).withColumn("batch_id", F.lit(batch_id))
    by_day = dated.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_day.option("maxRecordsPerFile", flush_rows or 0).partitionBy("date", "batch_id").parquet(path)


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
    available_now: bool = False,
    every: str = f"{FLUSH_SECONDS} seconds",
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()
