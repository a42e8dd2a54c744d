"""Fixed-width vectors and version vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pad(values: Column, width: int) -> Column:
    """Exactly `width` entries: cut off, or filled with 0.0."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), width)), 1, width)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def population_variance(values: Column) -> Column:
    """Two passes over one short array; NULL for an empty one.

    The mean goes through a one-element array so that it is computed once and
    not again for every entry.
    """
    n = F.nullif(F.size(values), F.lit(0))
    squares = F.transform(
        F.array(total(values) / n),
        lambda centre: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre)),
    )
    return F.get(squares, F.lit(0)) / n


def sliding_stats(values: Column) -> Column:
    """struct(mean, std, min, max) of an array; zeros when it is empty."""
    empty = F.size(values) == 0
    zero = F.lit(0.0)
    return F.struct(
        F.when(empty, zero).otherwise(total(values) / F.nullif(F.size(values), F.lit(0))).alias("mean"),
        F.when(empty, zero).otherwise(F.sqrt(population_variance(values))).alias("std"),
        F.when(empty, zero).otherwise(F.array_min(values)).alias("min"),
        F.when(empty, zero).otherwise(F.array_max(values)).alias("max"),
    )


def _zip_counters(a: Column, b: Column) -> Column:
    """Counters of both vectors side by side; a missing node counts as 0."""
    zipped = F.map_zip_with(
        a, b,
        lambda _, x, y: F.struct(
            F.coalesce(x, F.lit(0)).alias("a"), F.coalesce(y, F.lit(0)).alias("b")
        ),
    )
    return F.map_values(zipped)


def merge_vectors(a: Column, b: Column) -> Column:
    return F.map_zip_with(
        a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))
    )


def dominates(a: Column, b: Column) -> Column:
    pairs = _zip_counters(a, b)
    return F.forall(pairs, lambda p: p["a"] >= p["b"]) & F.exists(pairs, lambda p: p["a"] > p["b"])


def vectors_equal(a: Column, b: Column) -> Column:
    return F.forall(_zip_counters(a, b), lambda p: p["a"] == p["b"])


def concurrent(a: Column, b: Column) -> Column:
    return ~dominates(a, b) & ~dominates(b, a) & ~vectors_equal(a, b)
