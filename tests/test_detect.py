"""Thresholds, confusion metrics, forest and reconstruction scoring, alerts."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import as_dicts
from fieldpulse.functions.scalar import alert_severity, anomaly_probability
from fieldpulse.operators import detect
from fieldpulse.operators.isolation import expected_path, grow_tree, mean_path, pack
from fieldpulse.schemas import ALERT

T0 = datetime(2024, 1, 1)


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 1), (0, 0)], "a int, p int")
    row = as_dicts(detect.confusion_metrics(df, "a", "p"))[0]
    assert row == {"precision": 0.6667, "recall": 0.6667, "f1": 0.6667, "accuracy": 0.6, "true_positives": 2,
                   "false_positives": 1, "false_negatives": 1, "true_negatives": 1}
    nothing = as_dicts(detect.confusion_metrics(df.withColumn("p", F.lit(0)), "a", "p"))[0]
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0.0, 0.0, 0.0)
    assert as_dicts(detect.confusion_metrics(df.limit(0), "a", "p"))[0]["accuracy"] == 0.0


def test_threshold(spark):
    values = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 50.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, error double")
    report = as_dicts(detect.error_report(df))[0]
    assert report["threshold"] == pytest.approx(np.mean(values) + 2 * np.std(values))
    assert [r["id"] for r in detect.flag_errors(df).filter("is_anomaly").collect()] == [7]
    assert detect.flag_errors(df, 1.0).filter("is_anomaly").count() == 1
    assert detect.flag_errors(df, 0.5).filter("is_anomaly").count() == 8


def test_probability_and_severity(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (-100.0,), (100.0,)], "raw double")
    got = [r[0] for r in df.select(anomaly_probability(F.col("raw"))).collect()]
    assert got == pytest.approx([0.5, 1.0, 0.0, 1.0, 0.0], abs=1e-9)
    scores = spark.createDataFrame([(0.7,), (0.71,), (0.9,), (0.91,)], "s double")
    assert [r[0] for r in scores.select(alert_severity(F.col("s"))).collect()] == [None, "warning", "warning", "critical"]


def walk(nodes, point):
    by_number = {n[0]: n for n in nodes}
    node = by_number[0]
    while node[1] >= 0:
        node = by_number[node[3] if point[node[1]] <= node[2] else node[4]]
    return node[5]


def test_path_lengths_against_walking_each_tree():
    rng = np.random.default_rng(0)
    trees = [grow_tree(rng.normal(size=(n, 3)), seed) for seed, n in enumerate((256, 64, 2, 1))]
    rows = [(t, *node) for t, nodes in enumerate(trees) for node in nodes]
    columns = dict(zip(("node", "feature", "threshold", "left", "right", "path"), map(np.array, list(zip(*rows))[1:])))
    packed = pack(np.array([r[0] for r in rows]), columns, len(trees))
    points = rng.normal(size=(500, 3)) * 2
    want = [np.mean([walk(nodes, p) for nodes in trees]) for p in points]
    np.testing.assert_allclose(mean_path(points, packed, chunk=64), want)


def test_every_point_of_a_tree_has_its_leaf():
    assert list(expected_path([1, 2])) == [0.0, 1.0]
    same = grow_tree(np.ones((10, 2)), 1)
    assert len(same) == 1 and same[0][5] == pytest.approx(float(expected_path([10])[0]))


@pytest.fixture(scope="module")
def with_outliers(spark):
    rng = np.random.default_rng(1)
    normal = rng.normal(0, 1, (900, 8))
    strange = rng.normal(0, 1, (18, 8)) + 9
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([normal, strange]))]
    return spark.createDataFrame(rows, "id bigint, features array<double>")


def test_outliers_rank_first_and_runs_agree(with_outliers):
    forest = detect.train_forest(with_outliers)
    scored = detect.score_forest(with_outliers, forest)
    top = [r["id"] for r in scored.orderBy(F.desc("anomaly_score"), "raw_score").limit(18).collect()]
    assert set(top) == set(range(900, 918))
    # about the contamination share is negative on the training rows
    assert scored.filter("raw_score < 0").count() == pytest.approx(0.05 * 918, abs=2)
    again = detect.train_forest(with_outliers.repartition(5))
    first, second = ({r["id"]: r["raw_score"] for r in detect.score_forest(with_outliers, f).collect()} for f in (forest, again))
    assert first == second


def test_reconstruction_against_numpy(with_outliers):
    got = {r["id"]: r["error"] for r in detect.reconstruction_errors(with_outliers).collect()}
    x = np.array([r["features"] for r in with_outliers.orderBy("id").collect()])
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = ((c - c @ vt[:4].T @ vt[:4]) ** 2).mean(axis=1)
    np.testing.assert_allclose([got[i] for i in range(len(x))], want, atol=1e-9)


def test_alerts_repeat_their_ids(spark):
    df = spark.createDataFrame([(1, "d", "t", T0, '{"a":1}', 0.95), (2, "d", "t", T0, '{"a":1}', 0.8), (3, "d", "t", T0, "{}", 0.7)],
                               "id bigint, device_id string, device_type string, ts timestamp, payload string, anomaly_score double")
    first, second = (as_dicts(detect.emit_alerts(df, "2.0").orderBy("severity")) for _ in range(2))
    assert first == second
    assert [(r["severity"], r["model_version"], r["details"]) for r in first] == [
        ("critical", "2.0", '{"reading":{"a":1}}'), ("warning", "2.0", '{"reading":{"a":1}}')]
    assert first[0]["alert_id"] != first[1]["alert_id"]
    alerts = detect.emit_alerts(df, "2.0")
    assert [(f.name, f.dataType) for f in alerts.schema] == [(f.name, f.dataType) for f in ALERT]
