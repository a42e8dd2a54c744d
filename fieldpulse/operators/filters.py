"""Filters, listings and projections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType

from fieldpulse.functions.scalar import iso_timestamp


def time_range(df: DataFrame, start=None, end=None, ts: str = "ts", day: str = "date") -> DataFrame:
    """Both ends inclusive; a missing end is open.

    The bounds are literals of the column's type, so the comparison reaches the scan.
    A table kept by day (see `write_readings`) also gets the days of the range, which
    prunes its folders.
    """
    by_day = day in df.columns and isinstance(df.schema[day].dataType, DateType)
    if start is not None:
        bound = F.lit(start).cast("timestamp")
        df = df.filter(F.col(ts) >= bound)
        df = df.filter(F.col(day) >= F.to_date(bound)) if by_day else df
    if end is not None:
        bound = F.lit(end).cast("timestamp")
        df = df.filter(F.col(ts) <= bound)
        df = df.filter(F.col(day) <= F.to_date(bound)) if by_day else df
    return df


def apply_filters(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; an absent (None) value filters nothing."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def recent_range(df: DataFrame, as_of: str, hours: int, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Time range whose missing start is `hours` before `as_of` and whose missing end is `as_of`."""
    now = datetime.fromisoformat(as_of)
    return time_range(df, now - timedelta(hours=hours) if start is None else start, now if end is None else end, ts)


def last_hours(df: DataFrame, as_of: str, hours: int, ts: str = "ts") -> DataFrame:
    return recent_range(df, as_of, hours, ts=ts)


def cast_timestamp(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts in df.columns else df


def point_lookup(df: DataFrame, value, id_column: str = "id") -> DataFrame:
    return df.filter(F.col(id_column) == F.lit(value))


def active_only(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def listing(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page plus `total`, the number of rows before paging.

    Sort and limit stay adjacent, so each task keeps only its first rows. The
    total is a scalar subquery over the same filters and no columns.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("total", total.scalar())


def response(df: DataFrame, columns: dict[str, str], timestamps: Sequence[str] = ()) -> DataFrame:
    """Select and rename; the named timestamps become ISO text."""
    return df.select(
        *[
            (iso_timestamp(F.col(source)) if source in timestamps else F.col(source)).alias(name)
            for source, name in columns.items()
        ]
    )
