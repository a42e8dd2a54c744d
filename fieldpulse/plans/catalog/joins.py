"""Joins and merges, version vectors, change logs, placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldpulse.functions import vectors as X
from fieldpulse.functions.scalar import normalise_path, version_from_file_name
from fieldpulse.operators import aggregates as G, filters, lifecycle, merge, placement
from fieldpulse.operators.windows import latest_per_key, node_liveness
from fieldpulse.plans.catalog.oracle_views import AS_OF
from fieldpulse.plans.catalog.registry import query
from fieldpulse.plans.catalog.reports import FIRING, NORMAL_PATH, firing
from fieldpulse.sources import sample_views as V


@query("d3_new_firmware", """
    SELECT s.*, CASE WHEN f.firmware_id IS NOT NULL THEN 'exists'
                     WHEN row_number() OVER (PARTITION BY s.device_type, s.version ORDER BY submitted_at, submission_id) > 1
                     THEN 'duplicate_in_batch' END AS reject_reason
    FROM firmware_submissions s LEFT JOIN firmware_versions f USING (device_type, version)""")
def d3(spark, folder):
    return merge.accept_new(V.firmware_submissions(spark, folder), V.firmware_versions(spark, folder),
                            ["device_type", "version"], ["submitted_at", "submission_id"])


@query("d4_rollout_expansion", """
    SELECT rollout_id, firmware_id, f.version AS firmware_version, f.device_type, device_id, 'in_progress' AS status
    FROM (SELECT rollout_id, firmware_id, unnest(target_devices) AS device_id FROM rollouts)
    JOIN firmware_versions f USING (firmware_id)""")
def d4(spark, folder):
    return merge.expand_rollouts(V.rollouts(spark, folder), V.firmware_versions(spark, folder))[0]


@query("d4_unknown_firmware", """
    SELECT rollout_id, firmware_id FROM rollouts
    WHERE firmware_id NOT IN (SELECT firmware_id FROM firmware_versions)""")
def d4_unknown(spark, folder):
    unknown = merge.expand_rollouts(V.rollouts(spark, folder), V.firmware_versions(spark, folder))[1]
    return unknown.select("rollout_id", "firmware_id")


APPROVED = """
    SELECT request_id, device_id, requested_at,
           CASE WHEN status = 'pending' AND approved_by IS NOT NULL THEN 'approved' ELSE status END AS status,
           CASE WHEN status = 'pending' THEN approved_by END AS approved_by,
           CASE WHEN status = 'pending' THEN approved_at END AS approved_at
    FROM provisioning_requests LEFT JOIN approvals USING (request_id)"""


@query("d5_approval_merge", "SELECT * FROM approved", {"approved": APPROVED})
def d5(spark, folder):
    return merge.approve_requests(V.provisioning_requests(spark, folder), V.approvals(spark, folder))


@query("d5_provisioned_devices", """
    SELECT id, name, device_type, last_seen_at,
           CASE WHEN id IN (SELECT device_id FROM approved WHERE approved_by IS NOT NULL) THEN 'provisioned' ELSE status END AS status
    FROM devices""", {"approved": APPROVED})
def d5_devices(spark, folder):
    approved = merge.approve_requests(V.provisioning_requests(spark, folder), V.approvals(spark, folder))
    return merge.provision_devices(V.devices(spark, folder), approved)


@query("d6_config_merge", """
    SELECT key, CASE WHEN coalesce(i.version, 0) > coalesce(l.version, 0) THEN i.value ELSE l.value END AS value,
           CASE WHEN coalesce(i.version, 0) > coalesce(l.version, 0) THEN i.version ELSE l.version END AS version,
           CASE WHEN coalesce(i.version, 0) > coalesce(l.version, 0) THEN 'apply'
                WHEN i.version IS NOT NULL AND coalesce(l.version, 0) > i.version THEN 'send_back' ELSE 'keep' END AS action
    FROM local_config l FULL JOIN (
        SELECT key, max(version) AS version, arg_max(value, version) AS value FROM incoming_config GROUP BY key) i USING (key)
    WHERE CASE WHEN coalesce(i.version, 0) > coalesce(l.version, 0) THEN i.version ELSE l.version END IS NOT NULL""")
def d6(spark, folder):
    return merge.merge_config(V.local_config(spark, folder), V.incoming_config(spark, folder))


@query("d7_alert_inhibition", """
    SELECT f.* FROM firing f WHERE NOT (severity = 'warning' AND EXISTS (
        SELECT 1 FROM firing c WHERE c.severity = 'critical' AND c.alertname = f.alertname AND c.service = f.service))""",
       {"firing": FIRING})
def d7(spark, folder):
    return merge.inhibit_warnings(firing(spark, folder))


@query("d8_stream_backlog", """
    SELECT stream, consumer_group, (SELECT count(*) FROM telemetry) - count(a.id) AS backlog
    FROM deliveries d LEFT JOIN acknowledgements a USING (stream, consumer_group, id) GROUP BY stream, consumer_group""")
def d8(spark, folder):
    deliveries = V.deliveries(spark, folder)
    groups = deliveries.groupBy("stream", "consumer_group").agg(F.countDistinct("id").alias("published"))
    published = groups.groupBy("stream").agg(F.max("published").alias("published"))
    consumed = V.acknowledgements(spark, folder).groupBy("stream", "consumer_group").agg(F.count(F.lit(1)).alias("consumed"))
    return merge.stream_backlog(published, consumed, groups)


@query("d9_telemetry_admission", """
    SELECT t.id, t.device_id, CASE WHEN d.id IS NULL THEN 'unknown'
                                   WHEN d.status NOT IN ('provisioned', 'active') THEN d.status END AS reject_reason
    FROM telemetry t LEFT JOIN devices d ON d.id = t.device_id""")
def d9(spark, folder):
    return merge.admit(V.telemetry(spark, folder), V.devices(spark, folder)).select("id", "device_id", "reject_reason")


@query("g9_normalised_paths", f"SELECT page_id, {NORMAL_PATH} AS path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path FROM pages)")
def g9(spark, folder):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1)
    return V.table(spark, folder, "pages").select("page_id", normalise_path(path).alias("path"))


@query("g11_version_from_file_name", """
    SELECT id, CASE WHEN id % 3 = 0 THEN '1.0.0' ELSE version END AS version FROM ml_models""")
def g11(spark, folder):
    models = V.ml_models(spark, folder)
    suffix = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("_v"), F.col("version")))
    path = F.concat(F.lit("/models/run_v2/"), F.translate("name", " ", "-"), suffix, F.lit(".onnx"))
    return models.select("id", version_from_file_name(path).alias("version"))


@query("g12_version_vector_merge", """
    SELECT object_id, node_id, max(counter) AS counter FROM version_vectors GROUP BY 1, 2""")
def g12_merge(spark, folder):
    merged = merge.merge_version_vectors(V.version_vectors(spark, folder))
    return merged.select("object_id", F.explode("vector").alias("node_id", "counter"))


@query("g12_version_vector_compare", """
    SELECT object_id,
           bool_and(a >= b) AND bool_or(a > b) AS a_dominates, bool_and(b >= a) AND bool_or(b > a) AS b_dominates,
           NOT (bool_and(a >= b) AND bool_or(a > b)) AND NOT (bool_and(b >= a) AND bool_or(b > a)) AND NOT bool_and(a = b) AS concurrent
    FROM (SELECT object_id, node_id, coalesce(max(counter) FILTER (replica = 'A'), 0) AS a,
                 coalesce(max(counter) FILTER (replica = 'R'), 0) AS b
          FROM version_vectors GROUP BY 1, 2)
    GROUP BY object_id""")
def g12_compare(spark, folder):
    counters = V.version_vectors(spark, folder)
    none = F.create_map().cast("map<string,bigint>")
    a, b = (
        merge.merge_version_vectors(counters.filter(F.col("replica") == r)).withColumnRenamed("vector", r) for r in ("A", "R")
    )
    both = a.join(b, "object_id", "full_outer").select(
        "object_id", F.coalesce("A", none).alias("a"), F.coalesce("R", none).alias("b")
    )
    return both.select(
        "object_id", X.dominates(F.col("a"), F.col("b")).alias("a_dominates"),
        X.dominates(F.col("b"), F.col("a")).alias("b_dominates"), X.concurrent(F.col("a"), F.col("b")).alias("concurrent"),
    )


@query("e3_latest_node_report", """
    SELECT node_id, ts, l_orderkey, l_linenumber, l_partkey, cpu, CAST(mem AS DOUBLE) AS mem FROM node_report_log
    QUALIFY row_number() OVER (PARTITION BY node_id
                               ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, mem DESC) = 1""")
def e3_nodes(spark, folder):
    return latest_per_key(V.node_report_log(spark, folder), ["node_id"], ["ts", "l_orderkey", "l_linenumber", "l_partkey", "mem"])


@query("e3_latest_active_model", """
    SELECT name, id, version, is_active, created_at FROM ml_models WHERE is_active
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id DESC) = 1""")
def e3_models(spark, folder):
    return latest_per_key(V.ml_models(spark, folder).filter("is_active"), ["name"], ["created_at", "id"])


LATEST_REQUEST = """
    SELECT device_id, request_id, status, requested_at FROM provisioning_requests
    QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY requested_at DESC, request_id DESC) = 1"""


@query("e3_latest_provisioning_request", "SELECT * FROM latest_request", {"latest_request": LATEST_REQUEST})
def e3_requests(spark, folder):
    return latest_per_key(V.provisioning_requests(spark, folder), ["device_id"], ["requested_at", "request_id"])


@query("f3_healthy_nodes_by_cpu", f"SELECT * FROM node_reports WHERE last_reported >= {AS_OF} - INTERVAL 30 SECOND")
def f3(spark, folder):
    return placement.nodes_by_cpu(V.node_reports(spark, folder), V.AS_OF)


@query("g8_node_liveness", f"""
    SELECT node_id, last_heartbeat,
           CASE WHEN status IN ('dead', 'leaving') OR node_id = 3 THEN status
                WHEN epoch({AS_OF} - last_heartbeat) > 20 THEN 'dead'
                WHEN epoch({AS_OF} - last_heartbeat) > 10 THEN 'suspect' ELSE status END AS status
    FROM heartbeats""")
def g8(spark, folder):
    return node_liveness(V.heartbeats(spark, folder), V.AS_OF, own_node=3)


# the same rules replayed event by event: state is (status, firmware) after each step
REPLAY = {
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS rn FROM device_events""",
    "replay": """
        SELECT event_id, device_id, event_type, status, firmware, ts, rn,
               CASE WHEN event_type = 'created' THEN NULL ELSE 'unknown_device' END AS reject_reason,
               CASE WHEN event_type = 'created' THEN 'registered' END AS now_status,
               CASE WHEN event_type = 'created' THEN firmware END AS now_firmware
        FROM numbered WHERE rn = 1
        UNION ALL
        SELECT n.event_id, n.device_id, n.event_type, n.status, n.firmware, n.ts, n.rn,
               CASE WHEN r.now_status IS NULL THEN CASE WHEN n.event_type = 'created' THEN NULL ELSE 'unknown_device' END
                    WHEN n.event_type = 'created' THEN 'already_exists'
                    WHEN r.now_status = 'decommissioned' THEN 'decommissioned'
                    WHEN n.event_type = 'decommissioned' AND r.now_status = 'active' THEN 'active' END,
               CASE WHEN r.now_status IS NULL THEN CASE WHEN n.event_type = 'created' THEN 'registered' END
                    WHEN n.event_type = 'created' OR r.now_status = 'decommissioned' THEN r.now_status
                    WHEN n.event_type = 'decommissioned' THEN CASE WHEN r.now_status = 'active' THEN 'active' ELSE 'decommissioned' END
                    ELSE n.status END,
               CASE WHEN r.now_status IS NULL THEN CASE WHEN n.event_type = 'created' THEN n.firmware END
                    WHEN n.event_type = 'updated' AND r.now_status <> 'decommissioned' THEN n.firmware
                    ELSE r.now_firmware END
        FROM replay r JOIN numbered n ON n.device_id = r.device_id AND n.rn = r.rn + 1""",
}


@query("j1_judged_events", "SELECT event_id, device_id, event_type, status, firmware, ts, reject_reason FROM replay", REPLAY)
def j1_events(spark, folder):
    return lifecycle.judge_events(V.device_events(spark, folder))


@query("j1_device_snapshot", """
    SELECT device_id, arg_max(now_status, rn) AS status, arg_max(now_firmware, rn) AS firmware,
           min(ts) FILTER (event_type = 'created' AND reject_reason IS NULL) AS created_at,
           max(ts) FILTER (reject_reason IS NULL) AS updated_at
    FROM replay GROUP BY device_id HAVING count(now_status) > 0""", REPLAY)
def j1_snapshot(spark, folder):
    return lifecycle.device_snapshot(lifecycle.judge_events(V.device_events(spark, folder)))


# the same replay with partial updates of all five fields
FIELD_REPLAY = {
    "changes": """
        SELECT event_id, device_id, event_type, CASE WHEN event_id % 13 <> 1 THEN status END AS status,
               CASE WHEN event_type = 'created' OR event_id % 3 = 1 THEN firmware END AS firmware,
               CASE WHEN event_type = 'created' THEN 'device-' || device_id
                    WHEN event_type = 'updated' AND event_id % 5 = 0 THEN 'renamed-' || event_id % 50 END AS name,
               CASE WHEN event_type = 'created' THEN 'smart_meter'
                    WHEN event_type = 'updated' AND event_id % 7 = 0 THEN 'type-' || event_id % 4 END AS device_type,
               CASE WHEN event_type = 'created' THEN '{}'
                    WHEN event_type = 'updated' AND event_id % 2 = 0 THEN '{"zone":"z' || event_id % 6 || '"}' END AS metadata,
               ts FROM device_events""",
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS rn FROM changes""",
    "replay": """
        SELECT device_id, rn, event_type = 'created' AS taken, ts, CASE WHEN event_type = 'created' THEN ts END AS created_at,
               CASE WHEN event_type = 'created' THEN 'registered' END AS status,
               CASE WHEN event_type = 'created' THEN firmware END AS firmware,
               CASE WHEN event_type = 'created' THEN name END AS name,
               CASE WHEN event_type = 'created' THEN device_type END AS device_type,
               CASE WHEN event_type = 'created' THEN metadata END AS metadata
        FROM numbered WHERE rn = 1
        UNION ALL
        SELECT device_id, rn, taken, ts, CASE WHEN taken AND old_status IS NULL THEN ts ELSE created_at END,
               CASE WHEN NOT taken THEN old_status WHEN event_type = 'created' THEN 'registered'
                    WHEN event_type = 'decommissioned' THEN 'decommissioned' ELSE coalesce(status, old_status) END,
               CASE WHEN writes THEN coalesce(firmware, old_firmware) ELSE old_firmware END,
               CASE WHEN writes THEN coalesce(name, old_name) ELSE old_name END,
               CASE WHEN writes THEN coalesce(device_type, old_type) ELSE old_type END,
               CASE WHEN writes THEN coalesce(metadata, old_metadata) ELSE old_metadata END
        FROM (SELECT *, taken AND event_type <> 'decommissioned' AS writes
              FROM (SELECT n.*, r.created_at, r.status AS old_status, r.firmware AS old_firmware, r.name AS old_name,
                           r.device_type AS old_type, r.metadata AS old_metadata,
                           CASE WHEN r.status IS NULL THEN n.event_type = 'created'
                                WHEN n.event_type = 'created' OR r.status = 'decommissioned' THEN false
                                ELSE n.event_type = 'updated' OR r.status <> 'active' END AS taken
                    FROM replay r JOIN numbered n ON n.device_id = r.device_id AND n.rn = r.rn + 1))""",
}


@query("j1_field_snapshot", """
    SELECT device_id, arg_max(status, rn) AS status, arg_max(firmware, rn) AS firmware, arg_max(name, rn) AS name,
           arg_max(device_type, rn) AS device_type, arg_max(metadata, rn) AS metadata,
           min(created_at) AS created_at, max(ts) FILTER (taken) AS updated_at
    FROM replay GROUP BY device_id HAVING count(status) > 0""", FIELD_REPLAY)
def j1_fields(spark, folder):
    return lifecycle.device_snapshot(lifecycle.judge_events(V.device_changes(spark, folder)))


INCOMING = """
    SELECT event_id AS request_id, CASE WHEN event_id % 10 = 0 THEN device_id + 1000000 ELSE device_id END AS device_id,
           ts AS requested_at FROM device_events WHERE event_type = 'created'"""


@query("j2_provisioning_requests", """
    WITH judged AS (
        SELECT i.*, CASE WHEN d.id IS NULL THEN 'unknown_device' WHEN d.status <> 'registered' THEN 'not_registered'
                         WHEN EXISTS (SELECT 1 FROM latest_request l WHERE l.device_id = i.device_id AND l.status = 'pending')
                         THEN 'already_pending'
                         WHEN row_number() OVER (PARTITION BY i.device_id ORDER BY requested_at, request_id) > 1
                         THEN 'duplicate_in_batch' END AS reject_reason
        FROM incoming i LEFT JOIN devices d ON d.id = i.device_id)
    SELECT *, CASE WHEN reject_reason IS NULL THEN 'pending' ELSE 'refused' END AS status FROM judged""",
       {"incoming": INCOMING, "latest_request": LATEST_REQUEST})
def j2(spark, folder):
    created = V.device_events(spark, folder).filter(F.col("event_type") == "created")
    incoming = created.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 10 == 0, F.col("device_id") + 1000000).otherwise(F.col("device_id")).alias("device_id"),
        F.col("ts").alias("requested_at"),
    )
    existing = latest_per_key(V.provisioning_requests(spark, folder), ["device_id"], ["requested_at", "request_id"])
    return merge.request_provisioning(V.devices(spark, folder), existing, incoming)


@query("j3_soft_delete_devices", """
    SELECT id, name, device_type, last_seen_at,
           CASE WHEN id IN (SELECT device_id FROM device_events WHERE event_type = 'decommissioned')
                     AND status NOT IN ('active', 'decommissioned') THEN 'decommissioned' ELSE status END AS status
    FROM devices""")
def j3_devices(spark, folder):
    deletions = V.device_events(spark, folder).filter(F.col("event_type") == "decommissioned")
    return lifecycle.soft_delete_devices(V.devices(spark, folder), deletions)


@query("j3_soft_delete_models", """
    SELECT id, name, version, created_at, is_active AND id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS is_active
    FROM ml_models""")
def j3_models(spark, folder):
    named = V.table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("id"))
    return lifecycle.soft_delete_models(V.ml_models(spark, folder), named)


@query("j4_event_emission", """
    SELECT sha256(CAST(device_id AS VARCHAR) || '|device_' || event_type || '|' || CAST(event_id AS VARCHAR)) AS id,
           'device_' || event_type AS event_type, device_id, ts AS timestamp,
           '{' || CASE WHEN status IS NOT NULL THEN '"status":"' || status || '",' ELSE '' END
               || '"firmware":"' || firmware || '"}' AS payload
    FROM replay WHERE reject_reason IS NULL""", REPLAY)
def j4(spark, folder):
    return lifecycle.emit_events(lifecycle.judge_events(V.device_events(spark, folder)))


@query("j5_activity_status", f"""
    SELECT id, name, device_type, last_seen_at,
           CASE WHEN status = 'provisioned' AND last_seen_at IS NOT NULL THEN 'active'
                WHEN status = 'active' AND (last_seen_at IS NULL OR last_seen_at < {AS_OF} - INTERVAL 6 HOUR) THEN 'inactive'
                ELSE status END AS status
    FROM devices""")
def j5(spark, folder):
    return lifecycle.derive_activity(V.devices(spark, folder), V.telemetry(spark, folder), V.AS_OF, 6 * 3600)


# every policy over every healthy node, in node order; an independent check of the reduced candidates
# (scores are rounded by their exact value: 0.94124999... is not a tie)
PLACED = f"""
    WITH fresh AS (SELECT * FROM node_reports WHERE last_reported >= {AS_OF} - INTERVAL 30 SECOND),
    healthy AS (SELECT *, CASE WHEN latency_ms > 0 THEN latency_ms ELSE 10 END AS lat FROM fresh WHERE cpu <= 85 AND mem <= 90),
    t AS (SELECT *, input_size_bytes < 10485760 AS small FROM tasks),
    near AS (
        SELECT task_id, arg_min(node_id, (CASE WHEN node_id = requesting_node_id THEN 0 ELSE 1 END, cpu, node_id)) AS node_id,
               arg_min(latency_ms, (CASE WHEN node_id = requesting_node_id THEN 0 ELSE 1 END, cpu, node_id)) AS latency_ms,
               bool_or(node_id = requesting_node_id) AS is_local
        FROM t, healthy GROUP BY task_id),
    edge AS (
        SELECT task_id, arg_max(node_id, (score, -node_id)) AS node_id, arg_max(lat, (score, -node_id)) AS lat, max(score) AS score
        FROM (SELECT task_id, node_id, lat, 0.6::DOUBLE * CASE WHEN lat >= max_latency_ms THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - lat / max_latency_ms END
                     + 0.4::DOUBLE * CASE WHEN small THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS score FROM t, healthy)
        GROUP BY task_id),
    cloud AS (
        SELECT task_id, 0.6::DOUBLE * CASE WHEN 50 >= max_latency_ms THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - 50.0::DOUBLE / max_latency_ms END
               + 0.4::DOUBLE * CASE WHEN small THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS score FROM t),
    options AS (
        SELECT task_id, 1 AS rank, 'latency_first' AS policy, CASE WHEN is_local THEN 0.9 ELSE 0.8 END::DOUBLE AS score,
               CASE WHEN is_local THEN 'edge_local' ELSE 'edge_remote' END AS target, node_id,
               CASE WHEN latency_ms > 0 THEN latency_ms ELSE 10 END AS estimate FROM near
        UNION ALL
        SELECT task_id, 2, 'cost_aware', CASE WHEN NOT small THEN 0.7::DOUBLE - 0.15::DOUBLE WHEN is_local THEN 0.85 ELSE 0.75 END::DOUBLE,
               CASE WHEN NOT small THEN 'cloud' WHEN is_local THEN 'edge_local' ELSE 'edge_remote' END,
               CASE WHEN small THEN node_id END,
               CASE WHEN NOT small THEN 40 WHEN latency_ms > 0 THEN latency_ms ELSE 15 END FROM near JOIN t USING (task_id)
        UNION ALL
        SELECT task_id, 3, 'balanced',
               CAST(round(CAST(CASE WHEN e.score >= c.score THEN e.score ELSE c.score END AS DECIMAL(38,18)), 4) AS DOUBLE),
               CASE WHEN e.score < c.score THEN 'cloud' WHEN node_id = requesting_node_id THEN 'edge_local' ELSE 'edge_remote' END,
               CASE WHEN e.score >= c.score THEN node_id END, CASE WHEN e.score >= c.score THEN lat ELSE 50 END
        FROM edge e JOIN cloud c USING (task_id) JOIN t USING (task_id))
    SELECT task_id, target, node_id AS target_node_id, CAST(estimate AS DOUBLE) AS estimated_latency_ms, score, policy
    FROM options QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY score DESC, rank) = 1"""


@query("h11_placement_ranking", "SELECT * FROM placed", {"placed": PLACED})
def h11(spark, folder):
    return placement.place_tasks(V.tasks(spark, folder), V.node_reports(spark, folder), V.AS_OF)


@query("c17_placement_status", """
    SELECT target, count(*) AS tasks, (SELECT count(*) FROM node_reports) AS total_nodes,
           (SELECT count(*) FROM node_reports WHERE cpu <= 85 AND mem <= 90) AS healthy_nodes
    FROM placed GROUP BY target""", {"placed": PLACED})
def c17(spark, folder):
    nodes = V.node_reports(spark, folder)
    return G.placement_status(placement.place_tasks(V.tasks(spark, folder), nodes, V.AS_OF), nodes, placement.is_healthy())


@query("b7_placement_listing", """
    SELECT task_id, target, policy, (SELECT count(*) FROM placed) AS total FROM placed ORDER BY task_id DESC LIMIT 100 OFFSET 100""",
       {"placed": PLACED})
def b7_placements(spark, folder):
    placed = placement.place_tasks(V.tasks(spark, folder), V.node_reports(spark, folder), V.AS_OF)
    return filters.listing(placed.select("task_id", "target", "policy"), [F.desc("task_id")], 100, 100)
