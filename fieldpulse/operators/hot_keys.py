"""Ordered per-key computations that survive a key holding a large share of all rows.

A window partitioned by device puts a device's whole history into one task. Here
the keys with more than `max_rows` rows are cut into slots of so many rows in order, the window runs
per (key, slot), and what a slot needs from the slots before it is carried over
through one small summary row per slot. All other keys keep a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldpulse.operators.ranking import global_rank
from fieldpulse.session import materialize

MAX_ROWS_PER_SLOT = 1_000_000
# a broadcast hint is given only below this number of hot keys (about 40 bytes each)
MAX_BROADCAST_KEYS = 200_000

SLOT = "_slot"
HOT = "_hot"


def with_slots(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS_PER_SLOT
) -> tuple[DataFrame, bool]:
    """Add `_slot` (0 for ordinary keys) and `_hot`, and tell whether any key is hot.

    Counting is one map-side-combined aggregation over the key columns. With several keys the
    first is counted alone to begin with: a combination can only be hot if its first key is,
    and mostly none is. The rows of hot keys are sorted by (keys, order) and numbered; every
    `max_rows` of them are a slot, so a slot's size is exact even if all rows of a key fall into one
    instant. Slots follow each other in the order of `order`.
    """
    plain = df.withColumn(SLOT, F.lit(0).cast("bigint")).withColumn(HOT, F.lit(False))
    counted = df
    if len(keys) > 1:
        first = df.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
        n_first = first.count()
        if n_first == 0:
            return plain, False
        first = F.broadcast(first) if n_first <= MAX_BROADCAST_KEYS else first
        counted = df.join(first, keys[0], "left_semi")
    hot = materialize(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows).select(*keys), "hot-keys")
    n_hot = hot.count()
    if n_hot == 0:
        return plain, False
    if n_hot <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    total = [F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order)]
    numbered = global_rank(df.join(hot, list(keys), "left_semi"), total, "_number")
    begins = numbered.groupBy(*keys).agg(F.min("_number").alias("_begin"))
    if n_hot <= MAX_BROADCAST_KEYS:
        begins = F.broadcast(begins)
    slot = F.floor((F.col("_number") - F.col("_begin")) / F.lit(max_rows)).cast("bigint")
    of_hot = numbered.join(begins, list(keys)).select(*df.columns, slot.alias(SLOT), F.lit(True).alias(HOT))
    slotted = df.join(hot, list(keys), "left_anti").select(*df.columns, F.lit(0).cast("bigint").alias(SLOT), F.lit(False).alias(HOT)).unionByName(of_hot)
    # explicit, because input already partitioned by the keys alone would satisfy the
    # window and leave all slots of a hot key in one task
    return slotted.repartition(*keys, SLOT), True


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    max_rows: int = MAX_ROWS_PER_SLOT,
) -> DataFrame:
    """Add the latest non-NULL `value` of the rows before this one, per key.

    `order` starts with the timestamp column and ends with a unique tie-break.
    """
    slotted, any_hot = with_slots(df, keys, order, max_rows)
    slotted = slotted.withColumn("_value", value)
    in_order = Window.partitionBy(*keys, SLOT).orderBy(*order)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    out = slotted.withColumn(name, F.last("_value", ignorenulls=True).over(before))
    if any_hot:
        position = F.struct(*order)
        hot_rows = slotted.filter(HOT)
        ends = (
            hot_rows.filter(F.col("_value").isNotNull())
            .groupBy(*keys, SLOT)
            .agg(F.max_by("_value", position).alias("_end"))
        )
        # a slot without values still needs what came before it
        slots = hot_rows.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_rows"))
        earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            slots.join(ends, [*keys, SLOT], "left")
            .withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
            .select(*keys, SLOT, "_carried")
        )
        out = (
            out.join(carried, [*keys, SLOT], "left")
            .withColumn(name, F.coalesce(name, "_carried"))
        )
    return out.select(*df.columns, name)


def with_recent(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    size: int,
    max_rows: int = MAX_ROWS_PER_SLOT,
) -> DataFrame:
    """Add an array of the last `size` values per key, this row's included, oldest first.

    `order` identifies a row within its key. For hot keys the last rows of every slot
    are found on the key and order columns alone, and `value`, which may cost much,
    is computed again for those few rows only.
    """
    slotted, any_hot = with_slots(df, keys, order, max_rows)
    in_order = Window.partitionBy(*keys, SLOT).orderBy(*order)
    frame = in_order.rowsBetween(1 - size, 0)
    out = slotted.withColumn("_value", value).withColumn(name, F.collect_list("_value").over(frame))
    if any_hot and size > 1:
        last_of = lambda array, n: F.slice(array, F.greatest(F.lit(1), F.size(array) - n + 1), n)
        newest = Window.partitionBy(*keys, SLOT).orderBy(*[F.desc(c) for c in order])
        tails = (
            slotted.filter(HOT).select(*keys, SLOT, *order)
            .withColumn("_age", F.row_number().over(newest))
            .filter(F.col("_age") < size)
            .drop("_age")
        )
        tail_rows = df.join(tails, [*keys, *order]).select(
            *keys, SLOT, F.struct(*order, value.alias("_value")).alias("_row")
        )
        ends = tail_rows.groupBy(*keys, SLOT).agg(F.array_sort(F.collect_list("_row")).alias("_end"))
        # every slot in `ends` has at least one row, so size - 1 slots reach back far enough
        earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(1 - size, -1)
        carried = (
            ends.withColumn("_rows", F.flatten(F.collect_list("_end").over(earlier)))
            .select(*keys, SLOT, F.transform(last_of(F.col("_rows"), size - 1), lambda r: r["_value"]).alias("_carried"))
        )
        joined = last_of(F.concat("_carried", name), size)
        out = out.join(carried, [*keys, SLOT], "left").withColumn(
            name, F.when(F.col("_carried").isNull(), F.col(name)).otherwise(joined)
        )
    return out.select(*df.columns, F.col("_value"), name)
