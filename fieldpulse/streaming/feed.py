"""Live feed of several logs: new entries by batch, with running lengths, without looking at history.

Every stream of the feed is a query of its own. A batch leaves its entries and one row of totals
(the totals of the batch before plus its own), both under its batch number, so a repeated batch
replaces what its first attempt wrote. A poll names the last batch it has seen and opens the folders
after it only; the newest totals are the length of the stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldpulse.streaming.batches import batch_folder, start, write_batch

TOTALS = "length bigint, newest timestamp"
ENTRY_COLUMNS = ("id", "ts")


def totals_of(spark: SparkSession, path: str, batch_id: int) -> tuple[int, object]:
    """(length, newest time) of a stream after the batch; an empty stream before the first."""
    if batch_id < 0:
        return 0, None
    row = spark.read.schema(TOTALS).parquet(batch_folder(f"{path}/totals", batch_id)).first()
    return row["length"], row["newest"]


def feed_job(stream: DataFrame, path: str, checkpoint: str, columns: Sequence[str] = ENTRY_COLUMNS, **how) -> StreamingQuery:
    """Keep a stream's entries and totals for polls. Entries without a time count like all others."""

    def on_batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        length, newest = totals_of(spark, path, n - 1)
        entries = df.select(*columns)
        write_batch(entries, f"{path}/entries", n)
        written = spark.read.schema(entries.schema).parquet(batch_folder(f"{path}/entries", n))
        totals = written.agg(
            (F.count(F.lit(1)) + F.lit(length)).alias("length"),
            F.greatest(F.max("ts"), F.lit(newest).cast("timestamp")).alias("newest"),
        )
        # written last: a poll takes a batch for whole once its totals are there
        totals.coalesce(1).write.mode("overwrite").parquet(batch_folder(f"{path}/totals", n))

    return start(stream, on_batch, checkpoint, **how)


def last_batch(spark: SparkSession, path: str, after: int = -1) -> int:
    """Number of the newest whole batch, looking only at those after `after`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    n = after
    while files.exists(spark._jvm.org.apache.hadoop.fs.Path(batch_folder(f"{path}/totals", n + 1) + "/_SUCCESS")):
        n += 1
    return n


def poll(spark: SparkSession, path: str, schema: str, after: int = -1) -> tuple[DataFrame, int, int]:
    """(entries of the batches after `after`, length of the stream, number of the last batch read)."""
    last = last_batch(spark, path, after)
    folders = [batch_folder(f"{path}/entries", n) for n in range(after + 1, last + 1)]
    reader = spark.read.schema(schema)
    entries = reader.parquet(*folders) if folders else spark.createDataFrame([], schema)
    return entries, totals_of(spark, path, last)[0], last


def poll_feed(
    spark: SparkSession, paths: Mapping[str, str], schema: str, after: Mapping[str, int] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """New entries of all streams with `kind` and every stream's length beside each row, and the next cursors."""
    after = after or {}
    polled = {kind: poll(spark, path, schema, after.get(kind, -1)) for kind, path in paths.items()}
    lengths = [F.lit(length).cast("bigint").alias(f"{kind}_length") for kind, (_, length, _) in polled.items()]
    rows = None
    for kind, (entries, _, _) in polled.items():
        part = entries.select(F.lit(kind).alias("kind"), "*", *lengths)
        rows = part if rows is None else rows.unionByName(part)
    return rows, {kind: last for kind, (_, _, last) in polled.items()}
