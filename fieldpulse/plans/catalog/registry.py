"""Named queries over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, TimestampType

from fieldpulse.plans.catalog.oracle_views import with_views
from fieldpulse.session import prepare

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Times without zone and plain doubles, the types both sides can show alike."""
    def shown(field):
        if isinstance(field.dataType, TimestampType):
            return F.col(field.name).cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        return F.col(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            return presentable(run(prepare(spark), folder))

        text = sql
        if text and text.strip().upper().startswith("WITH "):
            text = f"SELECT * FROM ({text})"
        QUERIES[name] = Query(prepared, with_views(text, views) if text else None)
        return run

    return register
