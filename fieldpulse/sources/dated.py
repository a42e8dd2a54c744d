"""Logs kept by day: lengths, retention and gathered days, from folder names and file footers.

A dated log has the partition column `date` and, as written by the streaming jobs, `batch_id`.
Counting by partition columns needs the number of rows in each file's footer and no data column.
The driver holds one small row per day.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldpulse.operators.ranking import is_in_first, row_at_rank

OLDEST = -(1 << 63)


def day_lengths(logs: Mapping[str, DataFrame]) -> DataFrame:
    """(stream, date, length) of every day with entries; rows without a time have no date."""
    parts = [
        log.groupBy("date").agg(F.count(F.lit(1)).alias("length")).select(F.lit(name).alias("stream"), "date", "length")
        for name, log in logs.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def log_lengths(logs: Mapping[str, DataFrame]) -> DataFrame:
    """One row per stream with its number of entries, 0 for an empty one."""
    counts = [log.agg(F.count(F.lit(1)).alias("length")).select(F.lit(name).alias("stream"), "length") for name, log in logs.items()]
    return reduce(DataFrame.unionAll, counts)


def border_day(log: DataFrame, max_length: int) -> tuple[date | None, int, int] | None:
    """(day, its entries, how many of them stay) of the day that the newest `max_length` entries begin in.

    None if the whole log is short enough. Entries without a time are the oldest.
    """
    days = log.groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("date").desc_nulls_last()).collect()
    left = max_length
    for row in days:
        if row["n"] > left:
            return row["date"], row["n"], left
        left -= row["n"]
    return None


def keep_newest_days(log: DataFrame, max_length: int = 100_000, ts: str = "ts", row_id: str = "id") -> DataFrame:
    """The newest `max_length` entries by (time, id), which must be unique.

    Whole days are kept or dropped by their folders; only the border day's times and ids are read to
    find the place of the cut.
    """
    border = border_day(log, max_length)
    if border is None:
        return log
    day, n, stay = border
    if day is None:  # the cut lies among the entries without a time
        newer, on_border = F.col("date").isNotNull(), F.col("date").isNull()
    else:
        newer, on_border = F.col("date") > F.lit(day), F.col("date") == F.lit(day)
    if not stay:
        return log.filter(newer)
    micros = F.coalesce(F.unix_micros(ts), F.lit(OLDEST))
    keyed = log.filter(on_border).select(micros.alias("_at"), F.col(row_id).alias("_tie"))
    cut = row_at_rank(keyed, "_at", "_tie", stay, n=n)
    kept = log.filter(newer | on_border).withColumns({"_at": micros, "_tie": F.col(row_id)})
    return kept.filter(newer | is_in_first("_at", "_tie", cut)).drop("_at", "_tie")


def drop_days_before(spark: SparkSession, path: str, day: date) -> list[str]:
    """Delete the folders of the days before `day`, and that of entries without a time; tells their names.

    Folders are listed and deleted whole; no file is opened. A repeated run finds nothing left to do.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        label = name.removeprefix("date=")
        if label != name and (label < day.isoformat() or label == "__HIVE_DEFAULT_PARTITION__"):
            if files.delete(status.getPath(), True):
                gone.append(name)
    return sorted(gone)


def with_gathered(batches: DataFrame, gathered: DataFrame | None) -> DataFrame:
    """All entries once: gathered days from `gathered`, everything else from `batches`.

    Of a day gathered twice the later state counts. A batch that came after a day was gathered is
    still read from `batches`. Both choices use partition columns only, so folders are pruned.
    """
    plain = batches.drop("batch_id")
    if gathered is None:
        return plain
    tops = [r for r in gathered.groupBy("date").agg(F.max("through").alias("through")).collect() if r["date"] is not None]
    if not tops:
        return plain
    through = F.try_element_at(F.create_map(*[part for r in tops for part in (F.lit(r["date"]), F.lit(r["through"]))]), F.col("date"))
    newest = gathered.filter(F.col("through") == through).drop("through")
    rest = batches.filter(_unknown_or_later(through)).drop("batch_id")
    return newest.select(*rest.columns).unionByName(rest)


def _unknown_or_later(through: Column) -> Column:
    return through.isNull() | (F.col("batch_id") > through)
