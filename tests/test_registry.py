"""Registry merges, device lifecycle, version vectors, placement."""

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from support import as_dicts
from fieldpulse.functions import vectors as X
from fieldpulse.operators import lifecycle, merge, placement

T0 = datetime(2024, 1, 1)
NOW = "2024-01-01 00:00:00"
EVENT = "event_id bigint, device_id string, event_type string, status string, firmware string, ts timestamp"


def replay(events):
    """The rules one event at a time."""
    state, reasons = {}, {}
    for e in sorted(events, key=lambda e: (e[5], e[0])):
        i, device, kind, status, firmware, _ = e
        now = state.get(device)
        if kind == "created":
            reasons[i] = "already_exists" if now else None
            if not now:
                state[device] = {"status": "registered", "firmware": firmware}
        elif now is None:
            reasons[i] = "unknown_device"
        elif now["status"] == "decommissioned":
            reasons[i] = "decommissioned"
        elif kind == "updated":
            reasons[i] = None
            now["status"], now["firmware"] = status or now["status"], firmware or now["firmware"]
        else:
            reasons[i] = "active" if now["status"] == "active" else None
            if reasons[i] is None:
                now["status"] = "decommissioned"
    return reasons, state


@pytest.mark.parametrize("max_rows", [1_000_000, 5])
def test_lifecycle_against_replay(spark, max_rows):
    rng = random.Random(6)
    kinds = ["created"] * 2 + ["updated"] * 7 + ["decommissioned"]
    events = [(i, rng.choice("aaabcdefgh"), rng.choice(kinds), rng.choice([None, "active", "inactive", "provisioned", "active"]),
               rng.choice([None, "v1", "v2"]), T0 + timedelta(seconds=rng.randrange(200))) for i in range(250)]
    events = [e if e[2] == "updated" else (*e[:3], None, *e[4:]) for e in events]
    reasons, state = replay(events)
    judged = lifecycle.judge_events(spark.createDataFrame(events, EVENT), max_rows)
    assert {r["event_id"]: r["reject_reason"] for r in judged.collect()} == reasons
    got = {r["device_id"]: {"status": r["status"], "firmware": r["firmware"]} for r in lifecycle.device_snapshot(judged).collect()}
    assert got == state
    emitted = lifecycle.emit_events(judged)
    assert emitted.count() == emitted.select("id").distinct().count() == sum(r is None for r in reasons.values())


def test_fields_against_replay(spark):
    """Partial updates of five fields, events in one instant, NULL times, and a missing field column."""
    rng = random.Random(16)
    some = lambda *values: rng.choice([None, None, *values])
    kinds = ["created"] * 2 + ["updated"] * 8 + ["decommissioned"]
    events = [(i, rng.choice("aabcdefgh"), rng.choice(kinds), some("active", "inactive"), some("v1", "v2"), some("n1", "n2"), some("t1", "t2"),
               some("{}", '{"a":1}'), rng.choice([None] + [T0 + timedelta(seconds=rng.randrange(40))] * 30)) for i in range(400)]
    fields = ("status", "firmware", "name", "device_type", "metadata")
    first = (T0 - timedelta(days=1))
    state = {}
    for e in sorted(events, key=lambda e: (e[8] or first, e[0])):
        now, kind = state.get(e[1]), e[2]
        if now is None:
            if kind == "created":
                state[e[1]] = dict(zip(fields, ("registered", *e[4:8]), strict=True))
        elif kind == "updated" and now["status"] != "decommissioned":
            now.update({f: v for f, v in zip(fields, e[3:8], strict=True) if v is not None})
        elif kind == "decommissioned" and now["status"] != "active":
            now["status"] = "decommissioned"
    schema = "event_id bigint, device_id string, event_type string, status string, firmware string, name string, device_type string, metadata string, ts timestamp"
    judged = lifecycle.judge_events(spark.createDataFrame(events, schema))
    shown = lifecycle.device_snapshot(judged)
    assert {r["device_id"]: {f: r[f] for f in fields} for r in shown.collect()} == state
    assert lifecycle.device_snapshot(judged.drop("name", "metadata")).columns == ["device_id", "status", "firmware", "device_type", "created_at", "updated_at"]
    keys = {k for r in lifecycle.emit_events(judged).collect() for k in json.loads(r["payload"])}
    assert keys == set(fields)


def test_activity(spark):
    devices = spark.createDataFrame([("a", "provisioned"), ("b", "provisioned"), ("c", "active"), ("d", "active"), ("e", "active"), ("f", "decommissioned")],
                                    "id string, status string")
    seen = spark.createDataFrame([("a", T0 - timedelta(1)), ("c", T0 - timedelta(seconds=60)), ("d", T0 - timedelta(seconds=61)), ("f", T0)],
                                 "device_id string, ts timestamp")
    got = {r["id"]: r["status"] for r in lifecycle.derive_activity(devices, seen, NOW, 60).collect()}
    assert got == {"a": "active", "b": "provisioned", "c": "active", "d": "inactive", "e": "inactive", "f": "decommissioned"}


def test_soft_delete(spark):
    devices = spark.createDataFrame([("a", "active"), ("b", "inactive"), ("c", "registered")], "id string, status string")
    deletions = spark.createDataFrame([("a",), ("b",), ("b",), ("zz",)], "device_id string")
    got = {r["id"]: r["status"] for r in lifecycle.soft_delete_devices(devices, deletions).collect()}
    assert got == {"a": "active", "b": "decommissioned", "c": "registered"}


def test_admission(spark):
    devices = spark.createDataFrame([("r", "registered"), ("p", "provisioned"), ("a", "active"), ("d", "decommissioned")], "id string, status string")
    readings = spark.createDataFrame([("u",), ("r",), ("p",), ("a",), ("d",), (None,), (None,)], "device_id string")
    judged = merge.admit(readings, devices.union(spark.createDataFrame([(None, "active")], devices.schema)))
    assert judged.count() == 7 and merge.admit(judged, devices).columns == judged.columns
    got = {r["device_id"]: r["reject_reason"] for r in judged.collect()}
    assert got == {None: "unknown", "u": "unknown", "r": "registered", "p": None, "a": None, "d": "decommissioned"}


def test_config_merge(spark):
    schema = "key string, value string, version bigint"
    local = spark.createDataFrame([("same", "l", 3), ("old", "l", 1), ("new", "l", 9), ("only", "l", 2)], schema)
    incoming = spark.createDataFrame([("same", "i", 3), ("old", "i", 2), ("old", "j", 5), ("new", "i", 4), ("fresh", "i", 1), ("zero", "i", 0)], schema)
    got = {r["key"]: (r["value"], r["version"], r["action"]) for r in merge.merge_config(local, incoming).collect()}
    assert got == {"same": ("l", 3, "keep"), "old": ("j", 5, "apply"), "new": ("l", 9, "send_back"), "only": ("l", 2, "keep"),
                   "fresh": ("i", 1, "apply")}


def test_inhibition(spark):
    rows = [(1, "a", "s", "critical"), (2, "a", "s", "warning"), (3, "a", "t", "warning"), (4, "b", "s", "info"), (5, "a", "s", "info")]
    df = spark.createDataFrame(rows, "id int, alertname string, service string, severity string")
    assert sorted(r["id"] for r in merge.inhibit_warnings(df).collect()) == [1, 3, 4, 5]


def test_new_firmware(spark):
    incoming = spark.createDataFrame([(1, "x", "1"), (2, "x", "2"), (3, "x", "2"), (4, "y", "1")], "n int, device_type string, version string")
    existing = spark.createDataFrame([("x", "1"), ("x", "1")], "device_type string, version string")
    got = {r["n"]: r["reject_reason"] for r in merge.accept_new(incoming, existing, ["device_type", "version"], ["n"]).collect()}
    assert got == {1: "exists", 2: None, 3: "duplicate_in_batch", 4: None}


counters = st.dictionaries(st.sampled_from("abc"), st.integers(0, 3), max_size=3)


def vector_facts(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a map<string,bigint>, b map<string,bigint>")
    x, y = F.col("a"), F.col("b")
    return df.select(
        X.dominates(x, y).alias("ab"), X.dominates(y, x).alias("ba"), X.vectors_equal(x, y).alias("eq"), X.concurrent(x, y).alias("cc"),
        X.merge_vectors(x, y).alias("m"), X.merge_vectors(y, x).alias("n"), X.merge_vectors(x, x).alias("same"),
    ).first()


def test_version_vector_examples(spark):
    assert vector_facts(spark, {"a": 1}, {"a": 1, "b": 0})["eq"]
    assert vector_facts(spark, {"a": 2}, {"b": 1})["cc"]
    assert vector_facts(spark, {"a": 2, "b": 1}, {"a": 1})["ab"]


@settings(max_examples=12, deadline=None)
@given(counters, counters)
def test_version_vector_laws(spark, a, b):
    r = vector_facts(spark, a, b)
    assert r["m"] == r["n"] and r["same"] == a
    assert r["ab"] + r["ba"] + r["eq"] + r["cc"] == 1
    assert r["m"] == {k: max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}}


NODE = "node_id bigint, cpu double, mem double, latency_ms double, last_reported timestamp"
TASK = "task_id bigint, input_size_bytes bigint, max_latency_ms double, requesting_node_id bigint"


def place(spark, nodes, size=1, limit=100.0, requester=1):
    nodes = spark.createDataFrame([(n, c, m, lat, T0 - timedelta(seconds=age)) for n, c, m, lat, age in nodes], NODE)
    r = as_dicts(placement.place_tasks(spark.createDataFrame([(1, size, limit, requester)], TASK), nodes, NOW))[0]
    return r["policy"], r["target"], r["target_node_id"], r["estimated_latency_ms"], r["score"]


BIG = 50 * 1024 * 1024


def test_placement_rules(spark):
    assert place(spark, []) == ("cost_aware", "cloud", None, 40.0, 0.6)
    assert place(spark, [(1, 10.0, 10.0, 5.0, 31)]) == ("cost_aware", "cloud", None, 40.0, 0.6)
    # all overloaded: 0.35, 0.55, and for a large input the balanced cloud score 0.58
    assert place(spark, [(1, 86.0, 10.0, 5.0, 0)])[:2] == ("cost_aware", "cloud")
    assert place(spark, [(1, 86.0, 10.0, 5.0, 0)], BIG) == ("balanced", "cloud", None, 50.0, 0.58)
    assert place(spark, [(1, 85.0, 90.0, 20.0, 30), (2, 1.0, 1.0, 1.0, 0)], limit=25.0) == ("balanced", "edge_remote", 2, 1.0, 0.936)
    assert place(spark, [(1, 85.0, 90.0, 20.0, 30), (2, 1.0, 1.0, 30.0, 0)]) == ("latency_first", "edge_local", 1, 20.0, 0.9)
    assert place(spark, [(3, 5.0, 5.0, 0.0, 0), (2, 5.0, 5.0, 0.0, 0)], limit=15.0) == ("latency_first", "edge_remote", 2, 10.0, 0.8)
    assert place(spark, [(3, 5.0, 5.0, 500.0, 0), (2, 9.0, 5.0, 400.0, 0)], limit=0.0) == ("latency_first", "edge_remote", 3, 500.0, 0.8)


def test_placement_ignores_stale_nodes(spark):
    assert place(spark, [(1, 5.0, 5.0, 5.0, 60), (2, 50.0, 5.0, 90.0, 30)]) == ("latency_first", "edge_remote", 2, 90.0, 0.8)
