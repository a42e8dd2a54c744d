"""Global order without a one-task window: rank, and exact cut at rank k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldpulse.session import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position in the total order given by `order`.

    The rows are range-partitioned and sorted once and written to the shared
    folder, so that a lost executor cannot change the partition boundaries
    between counting and numbering. The rank is then the row's position in its
    partition plus the number of rows in the partitions before it; that table
    has one row per partition. `order` must be a total order.
    """
    ordered = materialize(df.orderBy(*order).withColumn("_position", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_position", ROW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    within = F.col("_position").bitwiseAND((1 << ROW_BITS) - 1)
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .drop("_part", "_offset", "_position")
    )


def row_at_rank(df: DataFrame, value: str, tie_break: str, k: int, descending: bool = True, n: int | None = None):
    """(value, tie_break) of the k-th row in the order by both columns, or None.

    Only a narrow band of rows around the wanted position is ranked. The band
    comes from approximate percentiles; how many rows lie before it is counted
    exactly, and a band that misses position k is replaced by all rows, so the
    answer is always exact. `value` must be a non-NULL number; `n` is the number of
    rows, if known.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    keys = df.select(value, tie_break)
    n = keys.count() if n is None else n
    if not 1 <= k <= n:
        return None
    share = k / n if not descending else 1 - k / n
    margin = 0.001
    low, high = keys.agg(
        F.percentile_approx(value, [max(0.0, share - margin), min(1.0, share + margin)], 10_000)
    ).first()[0]
    before_band = F.col(value) > high if descending else F.col(value) < low
    counts = keys.agg(
        F.count_if(before_band).alias("before"),
        F.count_if(F.col(value).between(low, high)).alias("inside"),
    ).first()
    before, band = counts["before"], keys.filter(F.col(value).between(low, high))
    if not before < k <= before + counts["inside"]:
        before, band = 0, keys
    ranked = global_rank(band, [direction(value), direction(tie_break)])
    row = ranked.filter(F.col("rank") == k - before).first()
    return row[value], row[tie_break]


def is_in_first(value: str, tie_break: str, cut, descending: bool = True) -> Column:
    """True for the rows up to and including the one `row_at_rank` found."""
    if cut is None:
        return F.lit(False)
    at, tie = F.lit(cut[0]), F.lit(cut[1])
    if descending:
        return (F.col(value) > at) | ((F.col(value) == at) & (F.col(tie_break) >= tie))
    return (F.col(value) < at) | ((F.col(value) == at) & (F.col(tie_break) <= tie))
