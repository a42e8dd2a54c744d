"""Small column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mean_of(total: Column, count: Column) -> Column:
    """Mean from an exact sum: DECIMAL input is added exactly and divided once."""
    return total.cast("double") / F.nullif(count, F.lit(0))


def mean(value: Column) -> Column:
    return mean_of(F.sum(value), F.count(value))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the denominator is 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts)


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1000000
    return F.when(micros == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 with or without a zone; naive values are UTC, bad ones NULL."""
    return text.try_cast("timestamp")


def period_start(ts: Column, granularity: str) -> Column:
    return F.date_trunc("day" if granularity == "day" else "hour", ts)


def anomaly_probability(raw: Column) -> Column:
    """Map a forest decision value to [0, 1]; negative raw values are anomalous."""
    return clamp(1.0 / (1.0 + F.exp(40.0 * raw)), 0.0, 1.0)


def alert_severity(score: Column, threshold: float = 0.7) -> Column:
    """NULL when the score raises no alert."""
    return F.when(score > threshold, F.when(score > 0.9, F.lit("critical")).otherwise(F.lit("warning")))


def trend_class(slope: Column, mean_value: Column) -> Column:
    """Less than 1 % of the mean per hour is stable."""
    relative = F.abs(slope * 3600.0) / F.greatest(F.abs(mean_value), F.lit(1e-10))
    return (
        F.when(relative < 0.01, "stable")
        .when(slope > 0, "upward")
        .otherwise("downward")
    )


def health_class(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 50, "degraded").otherwise("critical")


def liveness_class(status: Column, silent_seconds: Column, timeout_seconds: float = 10.0) -> Column:
    """Dead and leaving nodes keep their status."""
    return (
        F.when(status.isin("dead", "leaving"), status)
        .when(silent_seconds > 2 * timeout_seconds, "dead")
        .when(silent_seconds > timeout_seconds, "suspect")
        .otherwise(status)
    )


def is_uuid(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"urn:|uuid:|[{}\-]", "")
    return F.coalesce(bare.rlike("^[0-9a-f]{32}$"), F.lit(False))


def topic_device(topic: Column) -> Column:
    """Second topic segment, when the topic has three or more."""
    parts = F.split(topic, "/")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1)))


def normalise_path(path: Column) -> Column:
    """Replace the path segments that look like identifiers by `:id`."""
    segments = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    looks_like_id = lambda s: (F.length(s) > 20) | (s.rlike("[0-9]") & s.contains("-"))
    cleaned = F.transform(segments, lambda s: F.when(looks_like_id(s), ":id").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(cleaned, "/"))


def version_from_file_name(path: Column) -> Column:
    """Text after the last `_v` of the file stem, `1.0.0` when there is none."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, "_v")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("1.0.0")
