"""Feature vectors, training matrices, splits and pseudo-labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldpulse.functions.payload import numeric_values
from fieldpulse.functions.vectors import pad, population_variance, sliding_stats
from fieldpulse.operators.hot_keys import MAX_ROWS_PER_SLOT, with_recent
from fieldpulse.operators.ranking import is_in_first, row_at_rank
from fieldpulse.schemas import FEATURE_WIDTH, FEATURE_WINDOW, MAX_TRAINING_WIDTH
from fieldpulse.session import materialize
from fieldpulse.sources.tables import newest


def sliding_device_stats(readings: DataFrame, size: int = FEATURE_WINDOW, max_rows: int = MAX_ROWS_PER_SLOT) -> DataFrame:
    """Readings with `values` (their numbers) and `stats` over the device's last `size` readings.

    The statistics cover all numbers of all keys together. A device's first
    reading has four copies of its first number, or zeros without one.
    """
    values = numeric_values(F.col("payload"))
    recent = with_recent(readings, ["device_id"], ["ts", "id"], values, "_recent", size, max_rows)
    recent = recent.withColumnRenamed("_value", "values")
    first_value = F.coalesce(F.get("values", F.lit(0)), F.lit(0.0))
    placeholder = F.struct(*[first_value.alias(n) for n in ("mean", "std", "min", "max")])
    flat = recent.withColumn("_flat", F.flatten("_recent")).withColumn("_windowed", sliding_stats(F.col("_flat")))
    stats = F.when(F.size("_recent") == 1, placeholder).otherwise(F.col("_windowed"))
    return flat.withColumn("stats", stats).drop("_recent", "_flat", "_windowed")


def feature_vectors(readings: DataFrame, size: int = FEATURE_WINDOW, max_rows: int = MAX_ROWS_PER_SLOT) -> DataFrame:
    """Readings with `features`: own numbers, then the sliding statistics, cut or filled to 8."""
    with_stats = sliding_device_stats(readings, size, max_rows)
    s = F.col("stats")
    joined = F.concat("values", F.array(s["mean"], s["std"], s["min"], s["max"]))
    return with_stats.withColumn("features", pad(joined, FEATURE_WIDTH)).drop("values", "stats")


def training_matrix(readings: DataFrame) -> DataFrame:
    """(id, ts, features): numbers of the payload and of its nested objects, z-scored per position.

    Rows without numbers are dropped. The payloads are parsed once and the numbers
    written to the shared folder, because two passes need them: the moments of all
    positions come from one aggregation to one row, which then reaches the rows as a
    scalar subquery.
    """
    kept = [c for c in ("id", "ts") if c in readings.columns]
    parsed = readings.select(*kept, numeric_values(F.col("payload"), nested=True).alias("_v"))
    rows = materialize(parsed, "training-values").filter(F.size("_v") > 0)
    padded = pad(F.col("_v"), MAX_TRAINING_WIDTH)
    at = lambda i: F.get(F.col("_p"), F.lit(i))
    moments = (
        rows.select(F.size("_v").alias("_size"), padded.alias("_p"))
        .agg(
            F.least(F.max("_size"), F.lit(MAX_TRAINING_WIDTH)).alias("width"),
            F.array(*[F.avg(at(i)) for i in range(MAX_TRAINING_WIDTH)]).alias("mean"),
            F.array(*[F.stddev_pop(at(i)) for i in range(MAX_TRAINING_WIDTH)]).alias("std"),
        )
        .select(F.struct("width", "mean", "std"))
    )
    scored = rows.select(*kept, padded.alias("_p"), moments.scalar().alias("_m"))
    m = F.col("_m")
    std = lambda i: F.when(F.get(m["std"], i) == 0, 1.0).otherwise(F.get(m["std"], i))
    z = F.transform(F.slice("_p", F.lit(1), m["width"]), lambda x, i: (x - F.get(m["mean"], i)) / std(i))
    return scored.select(*kept, z.alias("features"))


def training_set(readings: DataFrame, newest_rows: int = 50_000, share: float = 0.8, ratio: float = 0.05) -> DataFrame:
    """(id, ts, features, split, label): the newest readings as a matrix, split in time order.

    Rows without numbers are dropped before the split. Only validation rows have a label: 1 for
    the share `ratio` of them with the largest variance.
    """
    split = materialize(ordered_split(training_matrix(newest(readings, newest_rows)), share=share), "training-set")
    labelled = variance_labels(split.filter("split = 'validation'"), ratio).drop("variance")
    return split.filter("split = 'train'").withColumn("label", F.lit(None).cast("int")).unionByName(labelled)


def ordered_split(df: DataFrame, ts: str = "ts", tie_break: str = "id", share: float = 0.8) -> DataFrame:
    """Newest rows first: the first `share` of them are `train`, the rest `validation`.

    Only the row at the cut is looked up; the split itself is a filter without a
    sort. A side that would be empty gets one row, if there are two.
    """
    order = df.withColumn("_ts", F.unix_micros(ts))
    n = df.count()
    cut = int(n * share)
    if cut in (0, n):
        cut = max(1, n - 1)
    at = row_at_rank(order, "_ts", tie_break, cut, n=n)
    side = F.when(is_in_first("_ts", tie_break, at), "train").otherwise("validation")
    return order.withColumn("split", side).drop("_ts")


def variance_labels(vectors: DataFrame, ratio: float = 0.05, tie_break: str = "id") -> DataFrame:
    """Label 1 for the share `ratio` of rows with the largest population variance.

    Empty vectors have no variance; they get label 0 and do not count for the share.
    """
    scored = vectors.withColumn("variance", population_variance(F.col("features")))
    known = scored.filter("variance IS NOT NULL")
    n = known.count()
    at = row_at_rank(known, "variance", tie_break, int(n * (1 - ratio)), descending=False, n=n)
    low = F.col("variance").isNull() | is_in_first("variance", tie_break, at, descending=False)
    return scored.withColumn("label", F.when(low, 0).otherwise(1))
