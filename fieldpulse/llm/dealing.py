"""A join to one row per key whose hot keys are dealt over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_dealt(rows: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`rows` joined (inner or left) to `one`, which has at most one row for each key.

    A key is hot if it holds more than a quarter of a task's mean share of the rows. There are fewer
    hot keys than four times the shuffle partitions, whatever the data, so their list may be
    broadcast. The rows of a hot key are dealt over slots of that size, and its one row of `one` is
    repeated for each slot. `rows` must be a written table, as its rows are dealt by their place
    in it. A NULL key meets nothing.
    """
    shares = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, rows.count() // shares)
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held")).filter(F.col("_held") > share)
    slots = F.broadcast(held.select(*keys, F.ceil(F.col("_held") / share).alias("_slots")))
    n_slots = F.coalesce("_slots", F.lit(1))
    dealt = rows.join(slots, list(keys), "left").withColumn("_slot", F.pmod(F.monotonically_increasing_id(), n_slots))
    copies = one.join(slots, list(keys), "left").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), n_slots - 1)))
    return dealt.drop("_slots").join(copies.drop("_slots"), [*keys, "_slot"], how).drop("_slot")
