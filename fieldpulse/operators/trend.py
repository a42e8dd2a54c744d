"""Trailing averages and linear trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldpulse.functions.scalar import clamp, epoch_seconds, mean_of, trend_class

# x is counted from here: epoch seconds themselves are so large that their squares lose digits
ORIGIN = 1_577_836_800  # 2020-01-01


def trailing_sums(
    df: DataFrame, keys: Sequence[str], second: Column, values: dict[str, Column], width: int
) -> DataFrame:
    """Sums over the seconds [t - width, t] for every second t that has rows.

    A window partitioned by `keys` alone would give each task a whole series. Here
    rows are first added up per second; every second then goes to its own time
    bucket and, as a row that leaves the frame `width` + 1 seconds later, to the
    next one. A frame never reaches back further than one bucket, so a task holds
    at most two buckets of seconds however many rows the series has. What has
    entered is added up forwards and what is still to leave backwards: nothing is
    subtracted, so a value that has left the frame leaves no rounding error, no NaN
    and no infinity behind.
    """
    size = max(width, 1)
    cells = df.groupBy(*keys, second.alias("second")).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    bucket = F.floor(F.col("second") / size)
    placed = cells.select(
        "*",
        F.inline(F.array(
            F.struct(bucket.alias("bucket"), F.col("second").alias("at"), F.lit(True).alias("enters")),
            F.struct((bucket + 1).alias("bucket"), (F.col("second") + width + 1).alias("at"), F.lit(False).alias("enters")),
        )),
    )
    whole = Window.partitionBy(*keys, "bucket")
    so_far = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    still_to_leave = whole.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    zero = lambda name: F.lit(0).cast(cells.schema[name].dataType)

    def trailing(name: str) -> Column:
        amount = F.coalesce(F.col(name), zero(name))
        entered = F.when(F.col("enters"), amount).otherwise(zero(name))
        left = F.when(F.col("enters"), zero(name)).otherwise(amount)
        return (F.coalesce(F.sum(left).over(still_to_leave), zero(name)) + F.sum(entered).over(so_far)).alias(name)

    return (
        placed.select(*keys, "second", "enters", *[trailing(name) for name in values])
        .filter("enters")
        .drop("enters")
    )


def moving_average_points(
    metrics: DataFrame, hours: int = 24, keys: Sequence[str] = ("device_type", "metric")
) -> DataFrame:
    """Trailing average at every second that has rows."""
    sums = trailing_sums(
        metrics, keys, epoch_seconds(F.col("ts")),
        {"_sum": F.col("value"), "_n": F.when(F.col("value").isNotNull(), 1).otherwise(0)},
        hours * 3600,
    )
    return sums.select(*keys, "second", mean_of(F.col("_sum"), F.col("_n")).alias("moving_avg"))


def moving_average(
    metrics: DataFrame, hours: int = 24, keys: Sequence[str] = ("device_type", "metric")
) -> DataFrame:
    """The trailing average beside every row; rows of one second share it."""
    points = moving_average_points(metrics, hours, keys)
    return (
        metrics.withColumn("second", epoch_seconds(F.col("ts")))
        .join(points, [*keys, "second"], "left")
        .drop("second")
    )


def linear_trends(metrics: DataFrame, keys: Sequence[str] = ("device_type", "metric")) -> DataFrame:
    """Least-squares line of value on time per group, strongest slope first.

    One aggregation with partial sums. Fewer than two points or one single time
    give slope 0, as does a constant value r² 0.
    """
    x, y = epoch_seconds(F.col("ts")) - ORIGIN, F.col("value").cast("double")
    points = F.count(y)
    sums = metrics.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_slope"),
        F.regr_r2(y, x).alias("_r2"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_avgx(y, x).alias("_mean_x"),
        mean_of(F.sum("value"), points).alias("_mean"),
        points.alias("_points"),
        F.min(y).alias("_min"),
        F.max(y).alias("_max"),
        F.count(F.lit(1)).alias("data_points"),
    )
    slope = F.when(F.col("_points") >= 2, F.coalesce("_slope", F.lit(0.0))).otherwise(0.0)
    has_line = (F.col("_points") >= 2) & F.col("_slope").isNotNull()
    rounded = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    intercept = F.when(
        F.col("_points") >= 2, F.col("_mean") - slope * (F.col("_mean_x") + ORIGIN)
    ).otherwise(0.0)
    r2 = F.when(has_line & (F.col("_syy") > 0), clamp(F.col("_r2"), 0.0, 1.0)).otherwise(0.0)
    out = sums.select(
        *keys,
        F.when(has_line, trend_class(slope, F.col("_mean"))).otherwise("stable").alias("trend_direction"),
        F.round(slope, 8).alias("slope"),
        F.round(intercept, 4).alias("intercept"),
        rounded(r2).alias("r_squared"),
        rounded(F.col("_mean")).alias("avg_value"),
        rounded(F.col("_min")).alias("min_value"),
        rounded(F.col("_max")).alias("max_value"),
        "data_points",
    )
    return out.orderBy(F.desc(F.abs("slope")), *keys)


def trend_summary(trends: DataFrame) -> DataFrame:
    direction = F.col("trend_direction")
    return trends.agg(
        F.count(F.lit(1)).alias("total_trends"),
        F.count_if(direction == "upward").alias("upward_count"),
        F.count_if(direction == "downward").alias("downward_count"),
        F.count_if(direction == "stable").alias("stable_count"),
    )
