"""Placement ranking: the best target for each inference task under three policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values ---------------------------------------------------------------
STALE_SECONDS = 30
CPU_LIMIT, MEMORY_LIMIT = 85.0, 90.0
SMALL_INPUT_BYTES = 10 * 1024 * 1024
CLOUD_COST_FACTOR = 0.15
LATENCY_WEIGHT, COST_WEIGHT = 0.6, 0.4
CLOUD_LATENCY_MS, CLOUD_LATENCY_COST_MS = 50.0, 40.0
POLICIES = ("latency_first", "cost_aware", "balanced")
# --- end of fixed values --------------------------------------------------------


def fresh_nodes(nodes: DataFrame, as_of: str, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_reported")
    return nodes.filter(age <= stale_seconds * 1_000_000)


def is_healthy() -> Column:
    return (F.col("cpu") <= CPU_LIMIT) & (F.col("mem") <= MEMORY_LIMIT)


def nodes_by_cpu(nodes: DataFrame, as_of: str) -> DataFrame:
    """Fresh nodes, lowest CPU first."""
    return fresh_nodes(nodes, as_of).orderBy("cpu", "node_id")


def _effective(latency: Column, fallback: float) -> Column:
    return F.when(latency > 0, latency).otherwise(fallback)


def _option(policy: str, score, target, node, estimate) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(score).cast("double").alias("score"),
        F.lit(-POLICIES.index(policy)).alias("precedence"),
        as_column(target).cast("string").alias("target"),
        as_column(node).cast("bigint").alias("node_id"),
        as_column(estimate).cast("double").alias("estimate"),
        F.lit(policy).alias("policy"),
    )


def place_tasks(tasks: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """(task_id, target, target_node_id, estimated_latency_ms, score, policy) per task.

    No policy looks at more than four nodes for a task: the requesting node, the
    one with the least CPU, the one with the least latency, and the first by id
    (the last two decide ties). The three that do not depend on the task come from
    one aggregation and reach the tasks as a scalar subquery, the requesting node
    by an equi-join; tasks and nodes are never multiplied.
    """
    fresh = fresh_nodes(nodes, as_of)
    healthy = is_healthy()
    node = F.struct("node_id", "latency_ms")
    known = fresh.agg(
        F.count(F.lit(1)).alias("n_fresh"),
        F.min_by(node, F.when(healthy, F.struct("cpu", "node_id"))).alias("idle"),
        F.min_by(node, F.when(healthy, F.struct(_effective(F.col("latency_ms"), 10.0), F.col("node_id")))).alias("quick"),
        F.min_by(node, F.when(healthy, F.col("node_id"))).alias("first"),
    ).select(F.struct("n_fresh", "idle", "quick", "first"))
    requesters = fresh.filter(healthy).select(
        F.col("node_id").alias("requesting_node_id"), F.col("latency_ms").alias("_own_latency")
    )
    # step by step in columns of their own, so that no expression is repeated inside another
    facts = (
        tasks.join(requesters, "requesting_node_id", "left")
        .withColumn("_n", known.scalar())
        .select(
            "task_id", "requesting_node_id", "_own_latency",
            F.col("max_latency_ms").alias("_limit"),
            (F.col("input_size_bytes") < SMALL_INPUT_BYTES).alias("_small"),
            (F.col("_n.n_fresh") > 0).alias("_any_fresh"),
            F.col("_n.idle").isNotNull().alias("_any_healthy"),
            F.col("_n.idle.node_id").alias("_idle"), F.col("_n.idle.latency_ms").alias("_idle_latency"),
            F.col("_n.quick").alias("_quick"), F.col("_n.first").alias("_first"),
            _effective(F.col("_n.quick.latency_ms"), 10.0).alias("_quickest"),
        )
        # when no node meets the limit all edge scores are equal and the first node stands
        .withColumn("_best", F.when(F.col("_quickest") >= F.col("_limit"), F.col("_first")).otherwise(F.col("_quick")))
        .withColumn("_best_id", F.col("_best.node_id"))
        .withColumn("_best_latency", _effective(F.col("_best.latency_ms"), 10.0))
    )
    limit, small = F.col("_limit"), F.col("_small")

    def headroom(latency: Column) -> Column:
        return F.when(latency >= limit, 0.0).otherwise(1.0 - latency / F.nullif(limit, F.lit(0.0)))

    scored = facts.withColumn(
        "_edge", LATENCY_WEIGHT * headroom(F.col("_best_latency")) + COST_WEIGHT * F.when(small, 0.9).otherwise(0.5)
    ).withColumn(
        "_cloud", LATENCY_WEIGHT * headroom(F.lit(CLOUD_LATENCY_MS)) + COST_WEIGHT * F.when(small, 0.3).otherwise(0.7)
    )
    own = F.col("_own_latency").isNotNull()
    any_healthy, any_fresh = F.col("_any_healthy"), F.col("_any_fresh")

    def nearest(policy: str, own_score: float, other_score: float, fallback: float) -> Column:
        latency = F.when(own, F.col("_own_latency")).otherwise(F.col("_idle_latency"))
        return _option(
            policy,
            F.when(own, own_score).otherwise(other_score),
            F.when(own, "edge_local").otherwise("edge_remote"),
            F.when(own, F.col("requesting_node_id")).otherwise(F.col("_idle")),
            _effective(latency, fallback),
        )

    latency_first = F.when(any_healthy, nearest("latency_first", 0.9, 0.8, 10.0)).otherwise(
        _option("latency_first", F.when(any_fresh, 0.35).otherwise(0.3), "cloud", None, CLOUD_LATENCY_MS)
    )
    cost_aware = F.when(small & any_healthy, nearest("cost_aware", 0.85, 0.75, 15.0)).otherwise(
        _option(
            "cost_aware", F.when(any_fresh, 0.7 - CLOUD_COST_FACTOR).otherwise(0.6), "cloud", None, CLOUD_LATENCY_COST_MS
        )
    )
    is_local = F.col("_best_id") == F.col("requesting_node_id")
    balanced = F.when(
        any_healthy & (F.col("_edge") >= F.col("_cloud")),
        _option(
            "balanced", F.round("_edge", 4), F.when(is_local, "edge_local").otherwise("edge_remote"),
            F.col("_best_id"), F.col("_best_latency"),
        ),
    ).otherwise(_option("balanced", F.round("_cloud", 4), "cloud", None, CLOUD_LATENCY_MS))

    # structs compare by their first differing field: the higher score, then the earlier policy
    chosen = scored.select("task_id", F.greatest(latency_first, cost_aware, balanced).alias("_best"))
    return chosen.select(
        "task_id",
        F.col("_best.target").alias("target"),
        F.col("_best.node_id").alias("target_node_id"),
        F.col("_best.estimate").alias("estimated_latency_ms"),
        F.col("_best.score").alias("score"),
        F.col("_best.policy").alias("policy"),
    )
