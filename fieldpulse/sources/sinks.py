"""Writing tables, CSV exports, counted appends and quarantine splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from fieldpulse.session import materialize

WRITE_MODES = ("append", "overwrite", "ignore", "error")


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}, not {mode!r}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_readings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Readings are kept by day, so a time range prunes folders before row groups.

    The rebalance hint gathers each day's rows, so that no task opens a file for every
    day, and splits a day with very many rows over several tasks.
    """
    dated = df.withColumn("date", F.to_date("ts"))
    write_table(dated.hint("rebalance", "date"), path, mode, ["date"])


def write_jdbc(df: DataFrame, url: str, table: str, mode: str, properties: dict[str, str], batch_size: int = 1000) -> None:
    (
        df.write.format("jdbc").mode(mode)
        .options(url=url, dbtable=table, batchsize=str(batch_size), **properties)
        .save()
    )


def export_csv(df: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """CSV with a header. Without rows the one-row summary is written instead.

    A DataFrame of one unnamed value per row should name its column `value`.
    """
    out = summary if summary is not None and df.isEmpty() else df
    out.write.option("header", True).csv(path)


def ingest_batch(
    readings: DataFrame, path: str, reason: str = "reject_reason", rejected_path: str | None = None
) -> dict[str, int]:
    """Append the accepted readings; the counts come from the same pass as the write.

    With `rejected_path` the rejected ones are appended there with their reasons, from the
    same judged rows, which are written to the shared folder first.
    """
    if rejected_path:
        readings = materialize(readings, "judged")
        write_table(readings.filter(F.col(reason).isNotNull()), rejected_path, "append")
    seen = Observation("ingest")
    accepted = (
        readings.observe(
            seen,
            F.count_if(F.col(reason).isNull()).alias("accepted"),
            F.count_if(F.col(reason).isNotNull()).alias("rejected"),
        )
        .filter(F.col(reason).isNull())
        .drop(reason)
    )
    write_table(accepted, path, "append")
    return dict(seen.get)


def split_bad_records(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine rows with the reason)."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def write_split(df: DataFrame, path: str, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Write good and rejected rows in one pass, into two folders of one table, and return both."""
    df.withColumn("accepted", F.col(reason).isNull()).write.partitionBy("accepted").parquet(path)
    schema = StructType([*df.schema.fields, StructField("accepted", BooleanType())])
    written = df.sparkSession.read.schema(schema).parquet(path)
    good = written.filter("accepted").drop("accepted", reason)
    return good, written.filter("NOT accepted").drop("accepted")
