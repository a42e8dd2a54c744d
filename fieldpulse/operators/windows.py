"""Ordered per-key computations: latest state, rate limits, smoothed latency, counter rates, quantiles, replays."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldpulse.functions.scalar import epoch_seconds, liveness_class
from fieldpulse.operators.hot_keys import HOT, MAX_ROWS_PER_SLOT, SLOT, with_previous, with_slots
from fieldpulse.operators.trend import trailing_sums
from fieldpulse.schemas import (
    RATE_LIMIT_EXCLUDED_PATHS, RATE_LIMIT_REQUESTS, RATE_LIMIT_WINDOW_SECONDS, ROLE_MULTIPLIERS,
)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. An aggregate and not a window: one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*")


def rate_limit(
    requests: DataFrame,
    base_limit: int = RATE_LIMIT_REQUESTS,
    window_seconds: int = RATE_LIMIT_WINDOW_SECONDS,
    max_rows: int = MAX_ROWS_PER_SLOT,
) -> DataFrame:
    """Fixed-window limit per client: the n-th request of a window is denied when n > limit.

    Excluded paths pass and are not counted. A client's window with very many
    requests is cut into slots whose sizes are added up before numbering.
    """
    multiplier = F.lit(1.0)
    for role, factor in ROLE_MULTIPLIERS.items():
        multiplier = F.when(F.col("role") == role, factor).otherwise(multiplier)
    second = epoch_seconds(F.col("ts"))
    counted = requests.withColumn("window", F.floor(second / window_seconds)).withColumn(
        "limit", F.floor(base_limit * multiplier).cast("int")
    )
    # excluded requests form groups of their own and their numbers are not used
    numbered = counted.withColumn("_excluded", F.col("path").isin(*RATE_LIMIT_EXCLUDED_PATHS))
    keys = ["client_id", "window", "_excluded"]
    slotted, any_hot = with_slots(numbered, keys, ["ts", "id"], max_rows)
    n = F.row_number().over(Window.partitionBy(*keys, SLOT).orderBy("ts", "id")).cast("bigint")
    out = slotted.withColumn("_n", n)
    if any_hot:
        earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            slotted.filter(HOT).groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_rows"))
            .select(*keys, SLOT, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
        )
        out = out.join(offsets, [*keys, SLOT], "left").withColumn(
            "_n", F.col("_n") + F.coalesce("_offset", F.lit(0))
        )
    out = out.withColumn("_n", F.when(~F.col("_excluded"), F.col("_n")))
    reset = (F.col("window") + 1) * window_seconds
    denied = F.coalesce(F.col("_n") > F.col("limit"), F.lit(False))
    counts = F.col("_n").isNotNull()
    return out.select(
        *requests.columns,
        (~denied).alias("allowed"),
        F.when(counts, F.col("limit")).alias("limit"),
        F.when(counts, F.greatest(F.col("limit") - F.col("_n"), F.lit(0))).alias("remaining"),
        F.when(counts, reset).alias("reset_at"),
        F.when(denied, F.greatest(reset - second, F.lit(1))).alias("retry_after"),
    )


# --- smoothed latency -----------------------------------------------------------
EMA_ALPHA = 0.3
SLA_MS = 100.0
THRESHOLD_START, THRESHOLD_LOW, THRESHOLD_HIGH = 80.0, 60.0, 90.0


def _next_ema(ema: Column, x: Column) -> Column:
    return F.when(ema == 0, x).otherwise(EMA_ALPHA * x + (1 - EMA_ALPHA) * ema)


def _step(state: Column, x: Column, sla_ms: float) -> Column:
    """Next (ema, shift, low, high): the threshold so far is min(high, max(low, start + shift)).

    Moving the threshold up or down within its limits is such a clamped shift, and
    clamped shifts combine into one, so a slot's effect on the threshold is known
    without knowing the threshold it starts from.
    """
    def moved(ema: Column, move: Column) -> Column:
        bounded = lambda v: (
            F.when(move > 0, F.least(v + move, F.lit(THRESHOLD_HIGH)))
            .when(move < 0, F.greatest(v + move, F.lit(THRESHOLD_LOW)))
            .otherwise(v)
        )
        return F.struct(
            ema.alias("ema"),
            (state["shift"] + move).alias("shift"),
            bounded(state["low"]).alias("low"),
            bounded(state["high"]).alias("high"),
        )

    move = lambda ema: (
        F.when(ema <= 0, 0.0)
        .when(ema / sla_ms < 0.5, 1.0)
        .when(ema / sla_ms > 0.9, -2.0)
        .otherwise(0.0)
    )
    return _let(_next_ema(state["ema"], x), lambda ema: _let(move(ema), lambda m: moved(ema, m)))


def _let(value: Column, body) -> Column:
    """Use `value` several times in `body` while computing it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SMALLEST = 5e-324  # the positive number next to 0


def _carry_ema(slots: pd.DataFrame) -> pd.DataFrame:
    """EMA before each slot of one key; one short row per slot comes in."""
    slots = slots.sort_values("_slot")
    before, ema = [], 0.0
    for factor, started, fresh in zip(slots["_factor"], slots["_started"], slots["_fresh"]):
        before.append(ema)
        # an average that has started never falls to exactly 0 again row by row: `factor` may
        if ema == 0:
            ema = fresh
        else:
            ema = factor * ema + started or SMALLEST
    slots["_before"] = before
    return slots[["_key", "_slot", "_before"]]


def smoothed_latency(
    df: DataFrame, key: str, order: Sequence[str], value: str, sla_ms: float = SLA_MS, max_rows: int = 100_000
) -> DataFrame:
    """Exponential average and adaptive CPU threshold per key, after all observations.

    Observations of one key and slot are folded in time order in one row, at most
    `max_rows` of them; missing ones are left out. Slots of a hot key are joined up afterwards: the
    average enters a slot as `factor * before + started`, the threshold as one
    clamped shift per slot.
    """
    slotted, any_hot = with_slots(
        df.select(F.col(key).alias("_key"), *order, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL"),
        ["_key"], order, max_rows,
    )
    folded = slotted.groupBy("_key", SLOT, HOT).agg(
        F.array_sort(F.collect_list(F.struct(*order, "_x"))).alias("_obs"), F.count(F.lit(1)).alias("_n")
    )
    xs = F.transform("_obs", lambda o: o["_x"])
    if any_hot:
        linear = F.aggregate(xs, F.lit(0.0), lambda e, x: EMA_ALPHA * x + (1 - EMA_ALPHA) * e)
        shapes = folded.filter(HOT).select(
            "_key", F.col(SLOT),
            F.pow(F.lit(1 - EMA_ALPHA), F.col("_n")).alias("_factor"),
            linear.alias("_started"),
            F.aggregate(xs, F.lit(0.0), _next_ema).alias("_fresh"),
        )
        schema = f"_key {df.schema[key].dataType.simpleString()}, {SLOT} bigint, _before double"
        carried = shapes.groupBy("_key").applyInPandas(_carry_ema, schema)
        folded = folded.join(carried, ["_key", SLOT], "left").fillna(0.0, ["_before"])
    else:
        folded = folded.withColumn("_before", F.lit(0.0))
    start = F.struct(
        F.col("_before").alias("ema"), F.lit(0.0).alias("shift"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
    )
    slots = folded.select(
        "_key", F.col(SLOT), "_n", F.aggregate(xs, start, lambda s, x: _step(s, x, sla_ms)).alias("_state")
    )
    per_key = slots.groupBy("_key").agg(
        F.sum("_n").alias("observations"),
        F.max_by("_state.ema", SLOT).alias("ema_latency"),
        F.array_sort(F.collect_list(F.struct(SLOT, "_state.shift", "_state.low", "_state.high"))).alias("_moves"),
    )
    threshold = F.aggregate(
        "_moves", F.lit(THRESHOLD_START),
        lambda t, m: F.least(m["high"], F.greatest(m["low"], t + m["shift"])),
    )
    return per_key.select(
        F.col("_key").alias(key), "observations", "ema_latency", threshold.alias("cpu_threshold")
    )


def counter_increase(
    samples: DataFrame, labels: Sequence[str], seconds: int, value: str = "value", max_rows: int = MAX_ROWS_PER_SLOT
) -> DataFrame:
    """Reset-aware growth of a counter over the last `seconds`, and per second, at every sample.

    After a reset the whole new value counts as growth. The first sample of a
    series is its baseline. The window is (t - seconds, t]; there is no
    extrapolation to the window's edges.
    """
    with_prev = with_previous(samples, labels, ["ts"], F.col(value), "_previous", max_rows)
    growth = (
        F.when(F.col("_previous").isNull(), 0)
        .when(F.col(value) < F.col("_previous"), F.col(value))
        .otherwise(F.col(value) - F.col("_previous"))
    )
    grown = with_prev.withColumn("_growth", growth.cast(samples.schema[value].dataType))
    sums = trailing_sums(grown, labels, epoch_seconds(F.col("ts")), {"increase": F.col("_growth")}, seconds - 1)
    return sums.select(
        *labels, F.timestamp_seconds("second").alias("ts"), "increase",
        (F.col("increase") / F.lit(float(seconds))).alias("rate"),
    )


def histogram_quantile(buckets: DataFrame, labels: Sequence[str], q: float = 0.99) -> DataFrame:
    """Quantile by linear interpolation in cumulative buckets (le, cumulative).

    A rank in the +Inf bucket gives the highest finite bound; an empty histogram NULL.
    The array per label set has one entry per bucket bound.
    """
    per_label = buckets.groupBy(*labels).agg(
        F.array_sort(F.collect_list(F.struct("le", "cumulative"))).alias("b")
    )
    return _quantile_of_buckets(per_label, labels, q)


def _quantile_of_buckets(per_label: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """`b` holds the (le, cumulative) of one histogram, in order."""
    total = F.element_at("b", -1)["cumulative"]
    ranked = per_label.withColumn("_rank", q * total).withColumn(
        "_before", F.filter("b", lambda x: x["cumulative"] < F.col("_rank"))
    )
    finite = F.filter("b", lambda x: x["le"] != float("inf"))
    found = F.get("b", F.size("_before"))
    below = F.get("_before", F.size("_before") - 1)
    low, low_count = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["cumulative"], F.lit(0))
    inside = low + (found["le"] - low) * (F.col("_rank") - low_count) / F.nullif(found["cumulative"] - low_count, F.lit(0))
    quantile = (
        F.when(total == 0, None)
        .when(found["le"] == float("inf"), F.element_at(finite, -1)["le"])
        .otherwise(F.coalesce(inside, found["le"]))
    )
    return ranked.select(*labels, total.alias("total"), quantile.alias("quantile"))


def rate_quantile(
    samples: DataFrame, labels: Sequence[str], seconds: int, q: float = 0.99, value: str = "value",
    max_rows: int = MAX_ROWS_PER_SLOT,
) -> DataFrame:
    """Quantile at every sample time of what was observed in the last `seconds`, from bucket counters.

    `samples` are (labels, le, ts, value): cumulative bucket counts that may fall back to 0. Growth is
    reset-aware in every (labels, le) series, as in `counter_increase`. A reset seen by some buckets
    only can leave a bucket with less growth than a lower one; it then counts as much as that
    one. `total` is the growth of the highest bucket; a time without growth has quantile NULL.
    """
    grown = counter_increase(samples, [*labels, "le"], seconds, value, max_rows)
    # one entry per bucket bound
    buckets = grown.groupBy(*labels, "ts").agg(F.array_sort(F.collect_list(F.struct("le", "increase"))).alias("g"))
    rising = F.transform("g", lambda x, i: F.struct(
        x["le"].alias("le"), F.array_max(F.transform(F.slice("g", F.lit(1), i + 1), lambda y: y["increase"])).alias("cumulative")
    ))
    return _quantile_of_buckets(buckets.withColumn("b", rising), [*labels, "ts"], q)


def replay_rollout(nodes: DataFrame, canary: bool = False) -> DataFrame:
    """Outcome per node of a rollout that stops at its first unhealthy node.

    Nodes are updated by `position`. With `canary` the first node must also be
    healthy after the watch period before any other node is touched. The stopping
    point is an aggregate per rollout, so no ordered window is needed.
    """
    stops = nodes.groupBy("rollout_id").agg(
        F.min("position").alias("_first"),
        F.min(F.when(~F.col("healthy"), F.col("position"))).alias("_failed"),
        F.min_by(F.col("healthy") & F.col("healthy_after_watch"), "position").alias("_canary_ok"),
    )
    failed = F.col("_failed")
    if canary:
        failed = F.when(~F.col("_canary_ok"), F.col("_first")).otherwise(failed)
    position = F.col("position")
    status = (
        F.when(position > failed, "untouched")
        .when(position == failed, "rollback")
        .when(F.lit(canary) & (position == F.col("_first")), "canary_updated")
        .otherwise("updated")
    )
    return nodes.join(stops, "rollout_id").select("rollout_id", "position", status.alias("status"))


def node_liveness(heartbeats: DataFrame, as_of: str, timeout_seconds: float = 10.0, own_node=None) -> DataFrame:
    """Status of each node after checking its silence at `as_of`; the own node is never timed out."""
    now = F.lit(as_of).cast("timestamp")
    silent = (F.unix_micros(now) - F.unix_micros("last_heartbeat")) / 1e6
    status = liveness_class(F.col("status"), silent, timeout_seconds)
    if own_node is not None:
        status = F.when(F.col("node_id") == F.lit(own_node), F.col("status")).otherwise(status)
    return heartbeats.select("node_id", "last_heartbeat", status.alias("status"))
