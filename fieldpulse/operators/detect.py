"""Anomaly scoring: isolation forest, reconstruction error, thresholds, confusion metrics, alerts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from fieldpulse.functions.scalar import alert_severity, anomaly_probability, ratio
from fieldpulse.operators.isolation import SAMPLE_LIMIT, Nodes, expected_path, grow_tree, mean_path, pack
from fieldpulse.operators.ranking import row_at_rank
from fieldpulse.session import materialize
from fieldpulse.sources.tables import spread

# --- fixed values ---------------------------------------------------------------
N_TREES = 100
SAMPLE_PER_TREE = SAMPLE_LIMIT
CONTAMINATION = 0.05
SEED = 42
ALERT_THRESHOLD = 0.7
# --- end of fixed values --------------------------------------------------------

HASH_RANGE = 1 << 40


@dataclass(frozen=True)
class Forest:
    """A trained forest. Its size depends on the number of trees and not on the data."""

    nodes: Nodes
    sample_size: int
    offset: float
    version: str


def _hash(*columns: Column) -> Column:
    """Uniform whole number below HASH_RANGE; the same row gets the same number in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(HASH_RANGE))


def train_forest(
    vectors: DataFrame,
    id_column: str = "id",
    n_trees: int = N_TREES,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
    version: str = "1.0.0",
) -> Forest:
    """Grow one tree per group of sampled rows; only the finished trees come to the driver.

    Every tree samples the whole table: a hash of the row first lets through about as many rows as all
    trees together want twice over, and only those meet the trees, each with a hash of its own; a
    tree's task takes the smallest of about twice the rows wanted. So the rows times trees that are
    looked at do not grow with the table. The offset is the exact
    contamination quantile of the scores of all rows. `vectors` is read several times;
    materialize it first when computing it costs much.
    """
    n = vectors.count()
    if n == 0:
        raise ValueError("no rows to train on")
    sample_size = min(SAMPLE_PER_TREE, n)
    share = min(1.0, 2.0 * sample_size / n)
    pool = min(1.0, n_trees * share)
    tree = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    samples = (
        spread(vectors.filter(_hash(F.col(id_column), F.lit(seed)) <= int(HASH_RANGE * pool)))
        .select(id_column, "features", tree)
        .withColumn("order", _hash(F.col(id_column), F.lit(seed), F.col("tree")))
        .filter(F.col("order") <= int(HASH_RANGE * share / pool))
        .select("tree", "order", "features")
    )

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chosen = rows.sort_values("order").head(sample_size)
        nodes = grow_tree(np.stack(chosen["features"].to_numpy()).astype(float), seed + int(key[0]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", key[0])
        return out

    schema = "tree int, node int, feature int, threshold double, left int, right int, path double"
    nodes = samples.groupBy("tree").applyInPandas(grow, schema).toPandas()
    columns = {c: nodes[c].to_numpy() for c in nodes.columns if c != "tree"}
    packed = pack(nodes["tree"].to_numpy(), columns, n_trees)
    fitted = Forest(packed, sample_size, 0.0, version)
    scored = vectors.select(F.col(id_column).alias("id"), _normality(fitted)(F.col("features")).alias("s"))
    return Forest(packed, sample_size, _quantile(materialize(scored, "forest-scores"), "s", "id", contamination, n), version)


def _quantile(df: DataFrame, value: str, tie_break: str, share: float, n: int) -> float:
    """Exact quantile, linear between the two neighbouring rows."""
    place = (n - 1) * share
    low = int(place)
    at = [row_at_rank(df, value, tie_break, min(k, n), descending=False, n=n)[0] for k in (low + 1, low + 2)]
    return float(at[0] + (at[1] - at[0]) * (place - low))


def _normality(forest: Forest):
    """Arrow-batched column function: minus the isolation score, higher is more normal."""
    nodes, typical = forest.nodes, float(expected_path([forest.sample_size])[0]) or 1.0

    @F.pandas_udf("double")
    def normality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for features in batches:
            if len(features) == 0:
                yield pd.Series([], dtype=float)
                continue
            points = np.stack(features.to_numpy()).astype(float)
            yield pd.Series(-np.power(2.0, -mean_path(points, nodes) / typical))

    return normality


def score_forest(vectors: DataFrame, forest: Forest) -> DataFrame:
    """Add `raw_score` (negative is anomalous) and `anomaly_score` in [0, 1]."""
    raw = _normality(forest)(F.col("features")) - F.lit(forest.offset)
    scored = vectors.withColumn("raw_score", raw)
    return scored.withColumn("anomaly_score", anomaly_probability(F.col("raw_score")))


def reconstruction_errors(vectors: DataFrame, id_column: str = "id", k: int | None = None) -> DataFrame:
    """(id, error): mean squared difference from the projection on the first k principal components."""
    vectors = materialize(vectors.select(id_column, "features"), "vectors")
    width = len(vectors.select("features").first()[0])
    k = min(k or max(width // 2, 2), width)
    points = vectors.select(id_column, array_to_vector("features").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(points)
    model = PCA(k=k, inputCol="centred", outputCol="code").fit(centred.transform(points))
    mean, components = centred.mean.toArray(), model.pc.toArray()

    @F.pandas_udf("double")
    def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for features in batches:
            if len(features) == 0:
                yield pd.Series([], dtype=float)
                continue
            x = np.stack(features.to_numpy()).astype(float) - mean
            yield pd.Series(((x - x @ components @ components.T) ** 2).mean(axis=1))

    return vectors.select(id_column, error(F.col("features")).alias("error"))


def error_report(errors: DataFrame, threshold: float | None = None) -> DataFrame:
    """Mean, population std, min, max of `error`, and the threshold in use."""
    e = F.col("error").cast("double")
    mean, std = F.avg(e), F.stddev_pop(e)
    limit = F.lit(float(threshold)) if threshold is not None else mean + 2 * std
    return errors.agg(
        mean.alias("mean"), std.alias("std"), F.min(e).alias("min"), F.max(e).alias("max"), limit.alias("threshold")
    )


def flag_errors(errors: DataFrame, threshold: float | None = None) -> DataFrame:
    """Add `is_anomaly`: the error is above the threshold, by default mean + 2 std of all errors."""
    limit = F.lit(float(threshold)) if threshold is not None else error_report(errors).select("threshold").scalar()
    return errors.withColumn("is_anomaly", F.col("error").cast("double") > limit)


def confusion_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count_if(a & p).alias("true_positives"),
        F.count_if(~a & p).alias("false_positives"),
        F.count_if(a & ~p).alias("false_negatives"),
        F.count_if(~a & ~p).alias("true_negatives"),
    )
    tp, fp, fn, tn = (F.col(c) for c in counts.columns)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return counts.select(
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
        F.round(ratio(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"), *counts.columns,
    )


def emit_alerts(scored: DataFrame, model_version: str, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Alert rows for scores above the threshold; the id is a function of the content."""
    severity = alert_severity(F.col("anomaly_score"), threshold)
    return (
        scored.withColumn("severity", severity)
        .filter(F.col("severity").isNotNull())
        .select(
            F.sha2(
                F.concat_ws("|", F.col("device_id").cast("string"), F.unix_micros("ts").cast("string"),
                            F.col("id").cast("string"), F.lit(model_version)), 256,
            ).alias("alert_id"),
            F.col("device_id").cast("string").alias("device_id"),
            "device_type",
            F.lit("anomaly_detected").alias("alert_type"),
            "severity", "ts", "anomaly_score",
            F.lit(model_version).alias("model_version"),
            F.concat(F.lit('{"reading":'), F.col("payload"), F.lit("}")).alias("details"),
        )
    )
