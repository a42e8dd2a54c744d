"""Ordered computations, features, splits, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions.payload import numeric_values
from fieldpulse.functions.scalar import alert_severity, anomaly_probability
from fieldpulse.functions.vectors import pad
from fieldpulse.operators import aggregates as G, detect, features, windows
from fieldpulse.plans.catalog.oracle_views import nested_numbers, numbers
from fieldpulse.plans.catalog.registry import query
from fieldpulse.schemas import PROCESSING_BUCKETS
from fieldpulse.session import materialize
from fieldpulse.sources import sample_views as V, tables

VECTOR_VIEWS = {
    "parsed": f"SELECT *, {numbers()} AS vals FROM readings",
    "recent": """
        SELECT id, device_id, ts, vals, count(*) OVER w AS seen, flatten(list(vals) OVER w) AS flat FROM parsed
        WINDOW w AS (PARTITION BY device_id ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "stats": """
        SELECT id, device_id, ts, vals,
               CASE WHEN seen = 1 THEN coalesce(vals[1], 0) WHEN len(flat) = 0 THEN 0 ELSE list_avg(flat) END AS mean,
               CASE WHEN seen = 1 THEN coalesce(vals[1], 0) WHEN len(flat) = 0 THEN 0 ELSE list_stddev_pop(flat) END AS std,
               CASE WHEN seen = 1 THEN coalesce(vals[1], 0) WHEN len(flat) = 0 THEN 0 ELSE list_min(flat) END AS min,
               CASE WHEN seen = 1 THEN coalesce(vals[1], 0) WHEN len(flat) = 0 THEN 0 ELSE list_max(flat) END AS max
        FROM recent""",
    "vectors": """
        SELECT id, device_id, ts, (vals || [mean, std, min, max] || [0.0::DOUBLE for i in range(8)])[1:8] AS f FROM stats""",
}


@query("e2_sliding_device_stats", """
    SELECT id, device_id, round(mean, 6) AS mean, round(std, 6) AS std, min, max FROM stats""", VECTOR_VIEWS)
def e2(spark, folder):
    out = features.sliding_device_stats(V.readings(spark, folder))
    return out.select("id", "device_id", F.round("stats.mean", 6).alias("mean"), F.round("stats.std", 6).alias("std"),
                      "stats.min", "stats.max")


@query("h2_feature_vectors", "SELECT id, " + ", ".join(f"round(f[{i + 1}], 6) AS f{i}" for i in range(8)) + " FROM vectors",
       VECTOR_VIEWS)
def h2(spark, folder):
    out = features.feature_vectors(V.readings(spark, folder))
    return out.select("id", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(8)])


@query("g13_padded_vectors", """
    SELECT id, i AS position, coalesce(vals[i + 1], 0.0) AS value
    FROM (SELECT id, vals FROM parsed), (SELECT unnest(range(8)) AS i)""", VECTOR_VIEWS)
def g13(spark, folder):
    padded = pad(numeric_values(F.col("payload")), 8)
    return V.readings(spark, folder).select("id", F.posexplode(padded).alias("position", "value")).select(
        "id", F.col("position").cast("bigint").alias("position"), "value"
    )


ROLE_LIMIT = "CASE role WHEN 'admin' THEN 5 * {base} WHEN 'device' THEN 2 * {base} ELSE {base} END"


def limit_sql(base: int, seconds: int) -> str:
    limit = ROLE_LIMIT.format(base=base)
    return f"""
    SELECT id, client_id, path, n IS NULL OR n <= lim AS allowed, CAST(CASE WHEN n IS NOT NULL THEN lim END AS INTEGER) AS limit,
           CASE WHEN n IS NOT NULL THEN greatest(lim - n, 0) END AS remaining,
           CASE WHEN n IS NOT NULL THEN (sec // {seconds} + 1) * {seconds} END AS reset_at,
           CASE WHEN n > lim THEN greatest((sec // {seconds} + 1) * {seconds} - sec, 1) END AS retry_after
    FROM (SELECT *, {limit} AS lim,
                 CASE WHEN path NOT IN ('/health', '/ready', '/health/dependencies') THEN
                 row_number() OVER (PARTITION BY client_id, sec // {seconds}, path IN ('/health', '/ready', '/health/dependencies')
                                    ORDER BY ts, id) END AS n
          FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM requests))"""


LIMIT_COLUMNS = ["id", "client_id", "path", "allowed", "limit", "remaining", "reset_at", "retry_after"]


@query("e4_rate_limit", limit_sql(100, 60))
def e4(spark, folder):
    return windows.rate_limit(V.requests(spark, folder)).select(*LIMIT_COLUMNS)


@query("e4_rate_limit_daily", limit_sql(2, 86400))
def e4_daily(spark, folder):
    return windows.rate_limit(V.requests(spark, folder), base_limit=2, window_seconds=86400).select(*LIMIT_COLUMNS)


@query("e5_smoothed_latency", """
    SELECT device_id, max(rn) AS observations, round(arg_max(ema, rn), 6) AS ema_latency, arg_max(thr, rn) AS cpu_threshold
    FROM fold GROUP BY device_id""", {
    "numbered": """
        SELECT device_id, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY device_id ORDER BY ts, id) AS rn
        FROM telemetry""",
    "fold": """
        SELECT device_id, rn, x AS ema,
               CASE WHEN x <= 0 THEN 80.0 WHEN x / 100 < 0.5 THEN 81.0 WHEN x / 100 > 0.9 THEN 78.0 ELSE 80.0 END::DOUBLE AS thr
        FROM numbered WHERE rn = 1
        UNION ALL
        SELECT device_id, rn, ema, CASE WHEN ema <= 0 THEN thr WHEN ema / 100 < 0.5 THEN least(90, thr + 1)
                                        WHEN ema / 100 > 0.9 THEN greatest(60, thr - 2) ELSE thr END
        FROM (SELECT n.device_id, n.rn, f.thr,
                     CASE WHEN f.ema = 0 THEN n.x ELSE 0.3::DOUBLE * n.x + 0.7::DOUBLE * f.ema END AS ema
              FROM fold f JOIN numbered n ON n.device_id = f.device_id AND n.rn = f.rn + 1)"""})
def e5(spark, folder):
    out = windows.smoothed_latency(V.telemetry(spark, folder), "device_id", ["ts", "id"], "value")
    return out.withColumn("ema_latency", F.round("ema_latency", 6))


GROWTH = {
    "growth": """
        SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS g
        FROM (SELECT *, lag(value) OVER (PARTITION BY device_type, metric ORDER BY ts) AS prev FROM counters)""",
}


def increase_sql(seconds: int) -> str:
    return f"""
    SELECT device_type, metric, ts, CAST(sum(g) OVER w AS BIGINT) AS increase,
           CAST(sum(g) OVER w AS DOUBLE) / {seconds} AS rate FROM growth
    WINDOW w AS (PARTITION BY device_type, metric ORDER BY CAST(epoch(ts) AS BIGINT)
                 RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW)"""


@query("e6_counter_increase_1h", increase_sql(3600), GROWTH)
def e6_hour(spark, folder):
    return windows.counter_increase(V.counters(spark, folder), ["device_type", "metric"], 3600)


@query("e6_counter_rate_6h", increase_sql(6 * 3600), GROWTH)
def e6_rate(spark, folder):
    return windows.counter_increase(V.counters(spark, folder), ["device_type", "metric"], 6 * 3600)


@query("e7_histogram_quantile", """
    WITH b AS (
        SELECT device_type, metric, le, count(*) FILTER (s <= le) AS cum
        FROM (SELECT device_type, metric, CAST(value AS DOUBLE) / 200 AS s FROM telemetry),
             (VALUES (0.001::DOUBLE), (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), ('inf'::DOUBLE)) v(le)
        GROUP BY ALL),
    l AS (
        SELECT *, max(cum) OVER (PARTITION BY device_type, metric) AS total,
               lag(le, 1, 0) OVER w AS low, lag(cum, 1, 0) OVER w AS low_cum FROM b
        WINDOW w AS (PARTITION BY device_type, metric ORDER BY le))
    SELECT device_type, metric, total,
           round(CASE WHEN le = 'inf'::DOUBLE THEN 1.0 ELSE low + (le - low) * (0.99 * total - low_cum) / (cum - low_cum) END, 6) AS quantile
    FROM l WHERE cum >= 0.99 * total
    QUALIFY row_number() OVER (PARTITION BY device_type, metric ORDER BY le) = 1""")
def e7(spark, folder):
    df = V.telemetry(spark, folder).withColumn("seconds", F.col("value").cast("double") / 200)
    buckets = G.latency_histogram(df, ["device_type", "metric"], "seconds", PROCESSING_BUCKETS)
    return windows.histogram_quantile(buckets, ["device_type", "metric"]).withColumn("quantile", F.round("quantile", 6))


BUCKET_BOUNDS = "(VALUES (0.001::DOUBLE), (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), ('inf'::DOUBLE)) v(le)"


@query("e7_quantile_of_rate", f"""
    WITH c AS (SELECT device_type, le, make_timestamp((epoch_us(ts) // 15000000 * 15 + 15) * 1000000) AS ts,
                      count(*) FILTER (CAST(value AS DOUBLE) / 200 <= le) AS n
               FROM telemetry, {BUCKET_BOUNDS} GROUP BY ALL),
    s AS (SELECT device_type, le, ts, sum(n) OVER (PARTITION BY device_type, le, ts < '2024-01-15 00:02:00' ORDER BY ts) AS value FROM c),
    g AS (SELECT device_type, le, ts, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS growth
          FROM (SELECT *, lag(value) OVER (PARTITION BY device_type, le ORDER BY ts) AS p FROM s)),
    i AS (SELECT device_type, le, ts, sum(growth) OVER (PARTITION BY device_type, le ORDER BY ts RANGE BETWEEN INTERVAL 299 SECONDS PRECEDING AND CURRENT ROW) AS grown FROM g),
    b AS (SELECT device_type, ts, le, max(grown) OVER (PARTITION BY device_type, ts ORDER BY le) AS cum FROM i),
    l AS (SELECT *, max(cum) OVER (PARTITION BY device_type, ts) AS total, lag(le, 1, 0) OVER w AS low, lag(cum, 1, 0) OVER w AS low_cum
          FROM b WINDOW w AS (PARTITION BY device_type, ts ORDER BY le))
    SELECT device_type, ts, total::BIGINT AS total,
           round(CASE WHEN total = 0 THEN NULL WHEN le = 'inf'::DOUBLE THEN 1.0 ELSE low + (le - low) * (0.99 * total - low_cum) / nullif(cum - low_cum, 0) END, 6) AS quantile
    FROM l WHERE cum >= 0.99 * total QUALIFY row_number() OVER (PARTITION BY device_type, ts ORDER BY le) = 1""")
def e7_rate(spark, folder):
    """99 % quantile over the last five minutes at every 15-second sample, with a reset inside a window."""
    out = windows.rate_quantile(V.bucket_samples(spark, folder), ["device_type"], 300)
    return out.select("device_type", "ts", F.col("total").cast("bigint").alias("total"), F.round("quantile", 6).alias("quantile"))


@query("e8_rollout_replay", """
    WITH o AS (SELECT *, max(CASE WHEN healthy THEN 0 ELSE 1 END) OVER (PARTITION BY rollout_id ORDER BY position
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM rollout_nodes)
    SELECT rollout_id, position, CASE WHEN coalesce(failed, 0) = 1 THEN 'untouched' WHEN healthy THEN 'updated' ELSE 'rollback' END AS status
    FROM o""")
def e8(spark, folder):
    return windows.replay_rollout(V.rollout_nodes(spark, folder))


@query("e8_canary_replay", """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY position) AS rn FROM rollout_nodes),
    h AS (SELECT *, CASE WHEN rn = 1 THEN healthy AND healthy_after_watch ELSE healthy END AS ok FROM n),
    o AS (SELECT *, max(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY rollout_id ORDER BY position
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM h)
    SELECT rollout_id, position, CASE WHEN coalesce(failed, 0) = 1 THEN 'untouched' WHEN NOT ok THEN 'rollback'
                                      WHEN rn = 1 THEN 'canary_updated' ELSE 'updated' END AS status FROM o""")
def e8_canary(spark, folder):
    return windows.replay_rollout(V.rollout_nodes(spark, folder), canary=True)


@query("f4_newest_sample", "SELECT id, payload FROM readings ORDER BY ts DESC, id DESC LIMIT 50000")
def f4(spark, folder):
    return tables.newest(V.readings(spark, folder), 50_000).select("id", "payload")


@query("g4_anomaly_probability", """
    SELECT id, round(1 / (1 + exp(40 * (0.05 - CAST(value AS DOUBLE) / 1000))), 6) AS score FROM telemetry""")
def g4(spark, folder):
    raw = 0.05 - F.col("value").cast("double") / 1000
    return V.telemetry(spark, folder).select("id", F.round(anomaly_probability(raw), 6).alias("score"))


@query("g5_alert_severity", """
    SELECT id, CASE WHEN anomaly_score > 0.7 THEN CASE WHEN anomaly_score > 0.9 THEN 'critical' ELSE 'warning' END END AS severity
    FROM alerts""")
def g5(spark, folder):
    return V.alerts(spark, folder).select("id", alert_severity(F.col("anomaly_score")).alias("severity"))


MATRIX = {
    "rows_": f"SELECT id, vals FROM (SELECT id, {nested_numbers()} AS vals FROM readings) WHERE len(vals) > 0",
    "width": "SELECT least(max(len(vals)), 16) AS w FROM rows_",
    "cells": """SELECT id, i AS position, coalesce(vals[i + 1], 0.0) AS x
                FROM rows_, (SELECT unnest(range(16)) AS i) WHERE i < (SELECT w FROM width)""",
    "moments": "SELECT position, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY 1",
}


@query("h3_training_matrix", """
    SELECT id, position, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z
    FROM cells JOIN moments USING (position)""", MATRIX)
def h3(spark, folder):
    out = features.training_matrix(V.readings(spark, folder))
    return out.select("id", F.posexplode("features").alias("p", "v")).select(
        "id", F.col("p").cast("bigint").alias("position"), F.round("v", 6).alias("z")
    )


@query("h4_ordered_split", """
    SELECT id, CASE WHEN row_number() OVER (ORDER BY ts DESC, id DESC) <= floor((SELECT count(*) FROM readings) * 0.8::DOUBLE)
                    THEN 'train' ELSE 'validation' END AS split FROM readings""")
def h4(spark, folder):
    return features.ordered_split(V.readings(spark, folder)).select("id", "split")


@query("h4_training_set", """
    WITH newest AS (SELECT * FROM readings ORDER BY ts DESC, id DESC LIMIT 50000),
    numbered AS (SELECT r.id, row_number() OVER (ORDER BY n.ts DESC, n.id DESC) AS rn, count(*) OVER () AS total
                 FROM rows_ r JOIN newest n ON n.id = r.id),
    split AS (SELECT id, CASE WHEN rn <= floor(total * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM numbered),
    spread AS (SELECT c.id, var_pop((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END) AS v
               FROM cells c JOIN moments USING (position) GROUP BY c.id),
    ranked AS (SELECT id, row_number() OVER (ORDER BY v, id) AS rn, count(*) OVER () AS total
               FROM split JOIN spread USING (id) WHERE split = 'validation')
    SELECT s.id, s.split, CASE WHEN s.split = 'validation' THEN CASE WHEN r.rn <= floor(r.total * 0.95::DOUBLE) THEN 0 ELSE 1 END END AS label
    FROM split s LEFT JOIN ranked r USING (id)""",
       {**MATRIX, "rows_": f"""
    SELECT id, vals FROM (SELECT id, {nested_numbers()} AS vals FROM
        (SELECT * FROM readings ORDER BY ts DESC, id DESC LIMIT 50000)) WHERE len(vals) > 0"""})
def h4_training_set(spark, folder):
    return features.training_set(V.readings(spark, folder)).select("id", "split", "label")


def embeddings(spark, folder):
    return V.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )


@query("h5_variance_labels", """
    SELECT id, CASE WHEN row_number() OVER (ORDER BY v, id) <= floor((SELECT count(*) FROM embeddings) * 0.95::DOUBLE)
                    THEN 0 ELSE 1 END AS label
    FROM (SELECT vec_id AS id, list_var_pop(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)""")
def h5(spark, folder):
    return features.variance_labels(embeddings(spark, folder)).select("id", "label")


ERRORS = {"errors": "SELECT id, CAST(value AS DOUBLE) AS error FROM telemetry"}


def errors(spark, folder):
    return V.telemetry(spark, folder).select("id", F.col("value").cast("double").alias("error"))


@query("h6_error_threshold", """
    SELECT round(avg(error), 6) AS mean, round(stddev_pop(error), 6) AS std, min(error) AS min, max(error) AS max,
           round(avg(error) + 2 * stddev_pop(error), 6) AS threshold FROM errors""", ERRORS)
def h6(spark, folder):
    report = detect.error_report(errors(spark, folder))
    return report.select(*[F.round(c, 6).alias(c) if c in ("mean", "std", "threshold") else c for c in report.columns])


@query("h6_flagged_errors", """
    SELECT id, error, error > (SELECT avg(error) + 2 * stddev_pop(error) FROM errors) AS is_anomaly FROM errors""", ERRORS)
def h6_flags(spark, folder):
    return detect.flag_errors(errors(spark, folder))


@query("h7_confusion_metrics", """
    SELECT round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
           round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1,
           round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy,
           tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives
    FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
                 count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)""")
def h7(spark, folder):
    return detect.confusion_metrics(V.table(spark, folder, "labels"), "quality", "toxic")


@query("h8_isolation_forest_scores")
def h8(spark, folder):
    vectors = materialize(features.feature_vectors(V.readings(spark, folder)).drop("payload"), "vectors")
    forest = detect.train_forest(vectors)
    return detect.score_forest(vectors, forest).select("id", "device_id", "raw_score", "anomaly_score")


@query("h9_reconstruction_error")
def h9(spark, folder):
    return detect.flag_errors(detect.reconstruction_errors(embeddings(spark, folder)))


@query("h10_alert_emission", """
    SELECT sha256(CAST(device_id AS VARCHAR) || '|' || CAST(epoch_us(ts) AS VARCHAR) || '|' || CAST(id AS VARCHAR) || '|1.0.0') AS alert_id,
           CAST(device_id AS VARCHAR) AS device_id, device_type, 'anomaly_detected' AS alert_type,
           CASE WHEN score > 0.9 THEN 'critical' ELSE 'warning' END AS severity, ts, score AS anomaly_score,
           '1.0.0' AS model_version, '{"reading":' || payload || '}' AS details
    FROM (SELECT r.*, least(CAST(t.value AS DOUBLE) / 100, 1.0) AS score FROM readings r JOIN telemetry t USING (id))
    WHERE score > 0.7""")
def h10(spark, folder):
    scores = V.telemetry(spark, folder).select(
        "id", F.least(F.col("value").cast("double") / 100, F.lit(1.0)).alias("anomaly_score")
    )
    return detect.emit_alerts(V.readings(spark, folder).join(scores, "id"), "1.0.0")
