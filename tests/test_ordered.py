"""Ordered computations: hand-made edges, brute force, and hot keys cut into slots."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from support import as_dicts
from fieldpulse.operators import features, hot_keys, ranking, windows
from fieldpulse.sources import sample_views as V, tables

T0 = datetime(2024, 1, 1)


def series(spark, n, keys=("a", "a", "a", "b"), seed=1):
    """One key has three quarters of the rows; times come in bursts and repeat."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(keys), T0 + timedelta(seconds=rng.choice([rng.randrange(50), rng.randrange(90_000)])),
             None if rng.random() < 0.3 else float(rng.randrange(200))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, device_id string, ts timestamp, value double")


def in_order(rows, key):
    return sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("max_rows", [1_000_000, 7])
def test_previous_value(spark, max_rows):
    rows, df = series(spark, 300)
    out = hot_keys.with_previous(df, ["device_id"], ["ts", "id"], F.col("value"), "prev", max_rows)
    assert set(out.columns) == {*df.columns, "prev"}
    got = {r["id"]: r["prev"] for r in out.collect()}
    assert len(got) == 300
    for key in "ab":
        last = None
        for r in in_order(rows, key):
            assert got[r[0]] == last
            last = last if r[3] is None else r[3]


@pytest.mark.parametrize("max_rows", [1_000_000, 7, 1])
def test_recent_values(spark, max_rows):
    rows, df = series(spark, 300)
    got = {r["id"]: [x[0] for x in r["recent"]] for r in
           hot_keys.with_recent(df, ["device_id"], ["ts", "id"], F.array("id"), "recent", 10, max_rows).collect()}
    for key in "ab":
        ids = [r[0] for r in in_order(rows, key)]
        for i, row_id in enumerate(ids):
            assert got[row_id] == ids[max(0, i - 9):i + 1]


def test_one_instant_stays_together(spark):
    df = spark.range(100).select("id", F.lit("a").alias("device_id"), F.lit(T0).alias("ts"), F.col("id").cast("double").alias("value"))
    out = hot_keys.with_previous(df, ["device_id"], ["ts", "id"], F.col("value"), "prev", 5)
    assert {r["id"]: r["prev"] for r in out.collect()} == {i: None if i == 0 else i - 1.0 for i in range(100)}


@pytest.mark.parametrize("query", ["e2", "h2"])
def test_hot_devices_give_the_same_features(spark, folder, query):
    make = features.sliding_device_stats if query == "e2" else features.feature_vectors
    plain, cut = make(V.readings(spark, folder)), make(V.readings(spark, folder), max_rows=6)
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()


def vectors(spark, payloads):
    df = spark.createDataFrame([(i, "d", T0 + timedelta(seconds=i), p) for i, p in enumerate(payloads)],
                               "id bigint, device_id string, ts timestamp, payload string")
    return [r["features"] for r in features.feature_vectors(df).orderBy("id").collect()]


def test_feature_vector_rules(spark):
    out = vectors(spark, ['{"a":3,"b":5}', '{"unit":"x"}', '{"a":7,"flag":true}'])
    assert out[0] == [3.0, 5.0, 3.0, 3.0, 3.0, 3.0, 0.0, 0.0]
    assert out[1] == [4.0, 1.0, 3.0, 5.0, 0.0, 0.0, 0.0, 0.0]
    assert out[2] == pytest.approx([7.0, 5.0, np.std([3, 5, 7]), 3.0, 7.0, 0.0, 0.0, 0.0])
    assert vectors(spark, ["{}", "{}"]) == [[0.0] * 8] * 2
    wide = vectors(spark, ['{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6,"g":7,"h":8,"i":9}'])
    assert wide == [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]]


def test_window_holds_ten_readings(spark):
    out = vectors(spark, [f'{{"a":{v}}}' for v in [100] + [1] * 10])
    assert out[9][4] == 100.0 and out[10][4] == 1.0


def limit(spark, n, role, **how):
    df = spark.range(n).select("id", F.lit(T0).alias("ts"), F.lit("c").alias("client_id"), F.lit(role).alias("role"), F.lit("/x").alias("path"))
    return windows.rate_limit(df, **how).filter("NOT allowed").select("id", "retry_after", "remaining", "reset_at").collect()


def test_rate_limits_per_role(spark):
    for role, n in (("device", 201), ("admin", 501), ("user", 101), ("guest", 101)):
        denied = limit(spark, n, role)
        assert [(r["id"], r["remaining"], r["retry_after"]) for r in denied] == [(n - 1, 0, 60)]


def test_excluded_paths_are_not_counted(spark):
    df = spark.range(300).select("id", F.lit(T0).alias("ts"), F.lit("c").alias("client_id"), F.lit("user").alias("role"),
                                 F.when(F.col("id") % 3 == 0, "/x").otherwise("/health").alias("path"))
    out = windows.rate_limit(df)
    assert out.count() == 300 and out.filter("NOT allowed").count() == 0
    assert out.filter("path = '/health' AND remaining IS NOT NULL").count() == 0


def test_hot_client_window(spark, folder):
    requests = V.requests(spark, folder)
    plain, cut = (windows.rate_limit(requests, 2, 86_400, n) for n in (1_000_000, 3))
    assert plain.exceptAll(cut).isEmpty() and plain.count() == cut.count()


def smoothed(spark, values, **how):
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=i), i, v) for i, v in enumerate(values)],
                               "k string, ts timestamp, id int, x double")
    row = as_dicts(windows.smoothed_latency(df, "k", ["ts", "id"], "x", **how))[0]
    return row["ema_latency"], row["cpu_threshold"]


def fold(values):
    ema, limit = 0.0, 80.0
    for x in values:
        ema = x if ema == 0 else 0.3 * x + 0.7 * ema
        if ema > 0:
            limit = min(90.0, limit + 1) if ema / 100 < 0.5 else max(60.0, limit - 2) if ema / 100 > 0.9 else limit
    return ema, limit


def test_smoothed_latency_steps(spark):
    for n, want in ((1, (100.0, 78.0)), (2, (82.0, 78.0)), (3, (85.9, 78.0))):
        assert smoothed(spark, [100.0, 40.0, 95.0][:n]) == pytest.approx(want)
    assert smoothed(spark, [0.0, 0.0, 30.0]) == pytest.approx((30.0, 81.0))


@pytest.mark.parametrize("max_rows", [1_000_000, 9, 1])
def test_smoothed_latency_in_slots(spark, max_rows):
    rng = random.Random(4)
    for values in ([0.0, 0.0, 0.0] + [rng.uniform(0, 200) for _ in range(60)],
                   [200.0] * 30 + [1.0] * 60, [0.0] * 12 + [rng.uniform(0, 60) for _ in range(40)]):
        assert smoothed(spark, values, max_rows=max_rows) == pytest.approx(fold(values))


def increase(spark, values, seconds=3600, **how):
    df = spark.createDataFrame([("s", T0 + timedelta(seconds=15 * i), v) for i, v in enumerate(values)], "s string, ts timestamp, value bigint")
    return [r["increase"] for r in windows.counter_increase(df, ["s"], seconds, **how).orderBy("ts").collect()]


def test_counter_increase(spark):
    assert increase(spark, [5, 8, 2, 4]) == [0, 3, 5, 7]
    assert increase(spark, [5, 8, 2, 4], max_rows=1) == [0, 3, 5, 7]
    # the window (t - 15 s, t] holds one sample
    assert increase(spark, [5, 8, 2, 4], seconds=15) == [0, 3, 2, 2]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.sampled_from([15, 40, 100]))
def test_counter_increase_property(spark, values, seconds):
    growth = [0] + [b if b < a else b - a for a, b in zip(values, values[1:])]
    want = [sum(g for j, g in enumerate(growth[:i + 1]) if 15 * (i - j) < seconds) for i in range(len(values))]
    got = increase(spark, values, seconds)
    assert got == want and min(got) >= 0


def quantile(spark, buckets, q=0.99):
    df = spark.createDataFrame([("l", float(le), c) for le, c in buckets], "l string, le double, cumulative bigint")
    return as_dicts(windows.histogram_quantile(df, ["l"], q))[0]["quantile"]


def test_histogram_quantile(spark):
    assert quantile(spark, [(0.1, 0), (0.5, 0), (float("inf"), 7)]) == 0.5
    assert quantile(spark, [(0.1, 0), (float("inf"), 0)]) is None
    assert quantile(spark, [(1, 50), (2, 100), (float("inf"), 100)], 0.75) == pytest.approx(1.5)
    assert quantile(spark, [(1, 100), (float("inf"), 100)], 0.5) == pytest.approx(0.5)


def test_rollouts(spark):
    rows = [(1, 1, True, True), (1, 2, False, True), (1, 3, True, True), (2, 1, True, False), (2, 2, True, True),
            (3, 5, False, True), (4, 1, True, True)]
    df = spark.createDataFrame(rows, "rollout_id int, position int, healthy boolean, healthy_after_watch boolean")
    outcome = lambda canary: {(r["rollout_id"], r["position"]): r["status"] for r in windows.replay_rollout(df, canary).collect()}
    assert outcome(False) == {(1, 1): "updated", (1, 2): "rollback", (1, 3): "untouched", (2, 1): "updated", (2, 2): "updated",
                              (3, 5): "rollback", (4, 1): "updated"}
    assert outcome(True) == {(1, 1): "canary_updated", (1, 2): "rollback", (1, 3): "untouched", (2, 1): "rollback",
                             (2, 2): "untouched", (3, 5): "rollback", (4, 1): "canary_updated"}


def test_liveness_limits(spark):
    rows = [("n", "alive", 10), ("o", "alive", 11), ("p", "alive", 20), ("q", "joining", 21), ("r", "leaving", 99), ("s", "dead", 1), ("me", "alive", 99)]
    df = spark.createDataFrame([(n, s, T0 - timedelta(seconds=e)) for n, s, e in rows], "node_id string, status string, last_heartbeat timestamp")
    got = {r["node_id"]: r["status"] for r in windows.node_liveness(df, "2024-01-01 00:00:00", own_node="me").collect()}
    assert got == {"n": "alive", "o": "suspect", "p": "suspect", "q": "dead", "r": "leaving", "s": "dead", "me": "alive"}


def test_global_rank_with_hot_value(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("v"))
    ranked = ranking.global_rank(df, [F.desc("v"), F.asc("id")]).collect()
    want = sorted(((r["v"], r["id"]) for r in ranked), key=lambda p: (-p[0], p[1]))
    assert [(r["v"], r["id"]) for r in sorted(ranked, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in ranked) == list(range(1, 501))


@pytest.mark.parametrize("descending", [True, False])
def test_row_at_rank(spark, descending):
    rng = random.Random(2)
    rows = [(i, rng.choice([5, 5, rng.randrange(1000)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, v bigint")
    order = sorted(((v, i) for i, v in rows), reverse=descending)
    for k in (1, 2, 200, 201, 399, 400):
        cut = ranking.row_at_rank(df, "v", "id", k, descending)
        assert cut == order[k - 1]
        assert df.filter(ranking.is_in_first("v", "id", cut, descending)).count() == k
    assert ranking.row_at_rank(df, "v", "id", 0) is None and ranking.row_at_rank(df, "v", "id", 401) is None


def test_split_sizes(spark):
    for n, train in ((1, 1), (2, 1), (5, 4), (10, 8)):
        df = spark.range(n).select("id", F.lit(T0).alias("ts"))
        out = features.ordered_split(df)
        newest = {r["id"] for r in out.filter("split = 'train'").collect()}
        assert newest == set(range(n - train, n))


def test_training_matrix_against_numpy(spark):
    payloads = ['{"a":1,"n":{"z":4,"b":2},"unit":"c"}', '{"a":3}', '{"x":"y"}', "bad", '{"a":5,"b":true,"anomaly":6}']
    df = spark.createDataFrame(list(enumerate(payloads)), "id bigint, payload string")
    got = {r["id"]: r["features"] for r in features.training_matrix(df).collect()}
    x = np.array([[1.0, 4, 2], [3, 0, 0], [5, 6, 0]])
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    assert sorted(got) == [0, 1, 4]
    np.testing.assert_allclose([got[i] for i in (0, 1, 4)], z)


def test_variance_labels(spark):
    df = spark.createDataFrame([(i, [0.0, float(i % 10)]) for i in range(40)], "id bigint, features array<double>")
    labelled = {r["id"] for r in features.variance_labels(df, 0.05).filter("label = 1").collect()}
    assert labelled == {29, 39}


def test_retention_and_cursor(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("id"))
    kept = sorted(r["id"] for r in tables.keep_newest(df, 10).collect())
    assert kept == [i * 3 for i in range(90, 100)]
    assert tables.keep_newest(df, 1000).count() == 100
    page = tables.after_cursor(df, 30, 5)
    assert [r["id"] for r in page.collect()] == [33, 36, 39, 42, 45]
    assert tables.next_cursor(page, 30).first()["cursor"] == 45
    assert tables.next_cursor(tables.after_cursor(df, 999), 999).first()["cursor"] == 999


def test_quantile_of_a_rate_with_a_reset(spark):
    """Three buckets sampled every 15 seconds; all fall back to 0 after the third sample."""
    t0 = datetime(2024, 1, 1)
    counts = [(0, 0, 0), (10, 20, 20), (10, 20, 30), (5, 5, 5), (5, 15, 15)]
    rows = [("x", le, t0 + timedelta(seconds=15 * i), c) for i, at in enumerate(counts) for le, c in zip((0.1, 0.5, float("inf")), at)]
    df = spark.createDataFrame(rows, "l string, le double, ts timestamp, value bigint")
    got = [(r["total"], r["quantile"]) for r in windows.rate_quantile(df, ["l"], 30, 0.5).orderBy("ts").collect()]
    # growth of the last 30 seconds: 0 0 0; 10 20 20; 10 20 30; 5 5 15; 5 15 15
    assert got == [(0, None), (20, pytest.approx(0.1)), (30, pytest.approx(0.3)), (15, 0.5), (15, pytest.approx(0.2))]


def test_quantile_of_buckets_that_do_not_rise(spark):
    """A bucket whose reset was missed counts as much as the one below it."""
    t0 = datetime(2024, 1, 1)
    rows = [("x", le, t0 + timedelta(seconds=15 * i), c) for i, at in enumerate([(0, 0, 0), (10, 4, 20)]) for le, c in zip((0.1, 0.5, float("inf")), at)]
    df = spark.createDataFrame(rows, "l string, le double, ts timestamp, value bigint")
    last = windows.rate_quantile(df, ["l"], 60, 0.5).orderBy(F.desc("ts")).first()
    assert (last["total"], last["quantile"]) == (20, pytest.approx(0.1))


def test_a_key_whose_rows_share_one_instant_is_cut_by_rows(spark):
    """Slots of 7 rows and of a million agree, for all rows of a key in one second."""
    t0 = datetime(2024, 1, 1)
    rng = random.Random(8)
    rows = [("hot", t0, i, rng.choice([0.0, 20.0, 95.0, 400.0])) for i in range(500)] + [("cold", t0, i, 50.0) for i in range(3)] + [(None, t0, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id bigint, x double")
    cut, any_hot = hot_keys.with_slots(df, ["k"], ["ts", "id"], 7)
    assert any_hot and cut.count() == len(rows)
    sizes = cut.filter("_hot").groupBy("_slot").agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy("_slot").collect()
    assert [r["n"] for r in sizes] == [7] * 71 + [3] and [r["low"] for r in sizes] == list(range(0, 500, 7))
    one, many = (sorted(as_dicts(windows.smoothed_latency(df, "k", ["ts", "id"], "x", max_rows=n)), key=lambda r: str(r["k"])) for n in (1_000_000, 7))
    for a, b in zip(one, many, strict=True):
        assert (a["k"], a["observations"], a["cpu_threshold"]) == (b["k"], b["observations"], b["cpu_threshold"])
        assert a["ema_latency"] == pytest.approx(b["ema_latency"], rel=1e-9)
