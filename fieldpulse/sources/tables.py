"""Reading tables, logs and their newest or oldest parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fieldpulse.operators.ranking import row_at_rank

ROW_BYTES = 64  # what a row takes beside its text


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet scan; with a schema only its columns exist and nothing is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer tasks than the cluster has cores.

    For work that costs much per row, such as reading JSON, on few files that cannot
    be split. A scan with at least one task per core is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def deal(df: DataFrame, text: str, task_bytes: int) -> DataFrame:
    """Deal out the rows evenly, with about `task_bytes` of `text` or less for a task, and at least one task per core.

    For rows that are kept or cost much, and whose number the files do not tell. Sizes are added
    up in a pass of their own; the number of tasks is no matter of files or settings.
    """
    size = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    num_partitions: int,
    properties: Mapping[str, str],
) -> DataFrame:
    """Database scan split over `num_partitions` connections by ranges of one column.

    `table` may also be a query in parentheses with an alias; the database runs it.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **properties)
        .options(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper))
        .option("numPartitions", str(num_partitions))
        .load()
    )


def read_query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """Run SQL over DataFrames given by name; filters and pruning reach their scans."""
    return spark.sql(sql, **views)


def read_log(
    spark: SparkSession, path: str, schema: StructType | str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A log of files as a stream; `path` is a folder or a pattern.

    A consumer group is a streaming query with a checkpoint of its own: every
    group sees each entry once and keeps its own position.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def newest(df: DataFrame, n: int = 20, ts: str = "ts", tie_break: str = "id") -> DataFrame:
    """The last n entries, newest first."""
    return df.orderBy(F.col(ts).desc(), F.col(tie_break).desc()).limit(n)


def after_cursor(df: DataFrame, cursor, n: int = 50, id_column: str = "id") -> DataFrame:
    """The next n entries strictly after the cursor, oldest first.

    The new cursor is the last id returned, or the old one when nothing came.
    """
    return df.filter(F.col(id_column) > cursor).orderBy(id_column).limit(n)


def next_cursor(page: DataFrame, cursor, id_column: str = "id") -> DataFrame:
    return page.agg(F.coalesce(F.max(id_column), F.lit(cursor)).alias("cursor"))


def keep_newest(df: DataFrame, max_length: int = 100_000, id_column: str = "id") -> DataFrame:
    """Retention: the newest `max_length` entries, however large that number is.

    The id at which the kept part starts is found first; the trim itself is then
    a filter on the id column that needs no sort and reaches the scan.
    """
    keyed = df.select(id_column, F.col(id_column).alias("_tie"))
    cut = row_at_rank(keyed, id_column, "_tie", max_length)
    return df if cut is None else df.filter(F.col(id_column) >= cut[0])


def stream_lengths(streams: Mapping[str, DataFrame]) -> DataFrame:
    """One row per stream with its number of entries."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("length")).select(F.lit(name).alias("stream"), "length")
        for name, df in streams.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionAll(other)
    return out


def pending_entries(delivered: DataFrame, acked: DataFrame, keys: Sequence[str] = ("stream", "consumer_group", "id")) -> DataFrame:
    """Entries handed to a group that it has not confirmed."""
    return delivered.join(acked.select(*keys), list(keys), "left_anti")


def live_feed(telemetry: DataFrame, alerts: DataFrame, telemetry_cursor, alert_cursor, n: int = 50) -> DataFrame:
    """What came after the two cursors, with the lengths of both streams beside every row."""
    length = lambda df: df.agg(F.count(F.lit(1)).alias("length")).scalar()
    new = lambda df, cursor, kind: after_cursor(df, cursor, n).select(F.lit(kind).alias("kind"), "id", "ts")
    rows = new(telemetry, telemetry_cursor, "reading").unionAll(new(alerts, alert_cursor, "alert"))
    return rows.select("*", length(telemetry).alias("stream_length"), length(alerts).alias("alert_count"))
