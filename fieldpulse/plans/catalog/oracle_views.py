"""The sample views once more, as SQL text for the independent check."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TYPES = "['temperature_sensor','vibration_sensor','pressure_sensor','smart_meter','gps_tracker']"
STATUSES = "['registered','provisioned','active','inactive','decommissioned']"


def uuid(key: str) -> str:
    h = f"md5(CAST({key} AS VARCHAR))"
    return (f"(substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||"
            f"substr({h},17,4)||'-'||substr({h},21,12))")


VIEWS = {
    "telemetry": f"""
        SELECT event_id AS id, user_id AS device_id, {TYPES}[user_id % 5 + 1] AS device_type,
               event_type AS metric, CAST(value AS DECIMAL(12,2)) AS value, ts, props AS payload
        FROM events""",
    "alerts": """
        SELECT id, device_id, device_type, ts, value,
               CASE WHEN value >= 50 THEN 'critical' WHEN value >= 20 THEN 'warning' ELSE 'info' END AS severity,
               least(CAST(value AS DOUBLE) / 100, 1.0) AS anomaly_score
        FROM telemetry WHERE metric = 'error'""",
    "devices": f"""
        SELECT c_custkey AS id, c_name AS name, {TYPES}[c_custkey % 5 + 1] AS device_type,
               {STATUSES}[(c_custkey // 5) % 5 + 1] AS status, last_seen_at
        FROM customer LEFT JOIN (SELECT device_id, max(ts) AS last_seen_at FROM telemetry GROUP BY 1)
             ON c_custkey = device_id""",
    "readings": """
        SELECT id, device_id, device_type, ts,
               CASE WHEN id % 17 = 3 THEN '{}' WHEN id % 17 = 5 THEN '{"unit":"u"}'
               ELSE '{"' || metric || '":' || CAST(value AS VARCHAR) || ',"k":' || json_extract_string(payload, '$.k')
                 || ',"unit":"u","anomaly":' || CASE WHEN metric = 'error' THEN 'true' ELSE 'false' END
                 || CASE WHEN id % 4 = 0 THEN ',"nested":{"z":' || json_extract_string(payload, '$.k')
                         || ',"a":0.5,"t":"x"}' ELSE '' END
                 || CASE WHEN id % 6 = 0 THEN ',"note":"3.5"' ELSE '' END || '}' END AS payload
        FROM telemetry""",
    "messages": f"""
        SELECT id,
               CASE WHEN id % 20 = 1 THEN 'devices/telemetry'
                    ELSE 'devices/' || {uuid('device_id')} || '/telemetry' END AS topic,
               '{{' || concat_ws(',',
                 CASE WHEN id % 20 NOT IN (0, 1) THEN '"device_id":"' ||
                   CASE WHEN id % 20 = 6 THEN 'not-a-uuid' ELSE {uuid('device_id')} END || '"' END,
                 CASE WHEN id % 20 <> 4 THEN '"device_type":"' || device_type || '"' END,
                 CASE WHEN id % 20 <> 5 THEN '"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
                   || CASE WHEN id % 20 = 8 THEN '+00:00' ELSE '' END || '"' END,
                 CASE WHEN id % 20 = 2 THEN '"temperature":' || CAST(device_id AS VARCHAR)
                        || ',"humidity":' || CAST(id % 100 AS VARCHAR)
                      WHEN id % 20 = 9 THEN '"payload":12'
                      WHEN id % 20 = 7 THEN '"payload":{{}}'
                      ELSE '"payload":' || payload END,
                 '"metadata":{{"firmware_version":"1.0.0"}}')
               || CASE WHEN id % 20 = 3 THEN '' ELSE '}}' END AS body,
               ts + CASE WHEN id % 23 = 7 THEN INTERVAL 25 HOUR WHEN id % 23 = 11 THEN INTERVAL (-600) SECOND
                         ELSE INTERVAL 1 SECOND END AS arrived_at
        FROM readings""",
    "device_events": """
        SELECT o_orderkey AS event_id, o_custkey AS device_id,
               CASE o_orderstatus WHEN 'F' THEN 'created' WHEN 'O' THEN 'updated' ELSE 'decommissioned' END AS event_type,
               CASE WHEN o_orderstatus = 'O' AND o_orderkey % 11 = 5 THEN 'decommissioned'
                    WHEN o_orderstatus = 'O'
                    THEN ['provisioned','active','active','inactive'][o_orderkey % 4 + 1] END AS status,
               'fw-' || CAST(o_orderkey % 9 AS VARCHAR) AS firmware, o_orderdate AS ts
        FROM orders""",
    "node_reports": f"""
        SELECT s_suppkey AS node_id, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS cpu,
               CAST(s_suppkey * 53 % 100 AS DOUBLE) AS mem, CAST(s_suppkey * 17 % 120 AS DOUBLE) AS latency_ms,
               {AS_OF} - to_seconds(s_suppkey % 45) AS last_reported
        FROM supplier""",
    "node_report_log": """
        SELECT l_suppkey AS node_id, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey,
               l_quantity AS cpu, CAST(l_extendedprice AS DECIMAL(12,2)) AS mem FROM lineitem""",
    "tasks": """
        SELECT o_orderkey AS task_id, CAST(floor(CAST(o_totalprice AS DECIMAL(12,2)) * 100) AS BIGINT) AS input_size_bytes,
               CAST(20 + o_orderkey % 180 AS DOUBLE) AS max_latency_ms, o_orderkey % 12 AS requesting_node_id
        FROM orders""",
    "requests": f"""
        SELECT id, ts, device_id AS client_id, ['admin','user','device','guest'][device_id % 4 + 1] AS role,
               CASE WHEN id % 11 = 4 THEN '/health'
                    ELSE '/api/v1/devices/' || {uuid('device_id')} || '/' || metric END AS path,
               CASE WHEN metric = 'view' THEN 'GET' ELSE 'POST' END AS method,
               CASE WHEN metric = 'error' THEN 500 ELSE 200 END AS status_code,
               CAST(value AS DOUBLE) / 100 AS latency_seconds
        FROM telemetry""",
    "counters": """
        SELECT device_type, metric, ts,
               CAST(sum(n) OVER (PARTITION BY device_type, metric, ts < TIMESTAMP '2024-01-15' ORDER BY ts) AS BIGINT) AS value
        FROM (SELECT device_type, metric, date_trunc('hour', ts) AS ts, count(*) AS n FROM telemetry GROUP BY ALL)""",
    "inference_results": """
        SELECT id, device_id, device_type, ts, CAST(CAST(value AS DOUBLE) / 10 AS DECIMAL(12,3)) AS latency_ms,
               value >= 50 AS is_anomaly FROM telemetry""",
    "ml_models": f"""
        SELECT p_partkey AS id, p_name AS name,
               '1.' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey AS VARCHAR) AS version,
               p_partkey % 3 <> 0 AS is_active, {AS_OF} - to_seconds(p_partkey * 60) AS created_at
        FROM part""",
    "firmware_versions": f"""
        SELECT {TYPES}[p_partkey % 5 + 1] AS device_type,
               '1.' || CAST(p_partkey % 7 AS VARCHAR) || '.' || CAST(p_size % 11 AS VARCHAR) AS version,
               min(p_partkey) AS firmware_id FROM part GROUP BY 1, 2""",
    "firmware_submissions": f"""
        SELECT o_orderkey AS submission_id, {TYPES}[o_custkey % 5 + 1] AS device_type,
               '1.' || CAST(o_orderkey % 13 AS VARCHAR) || '.' || CAST(o_custkey % 17 AS VARCHAR) AS version,
               o_orderdate AS submitted_at FROM orders""",
    "rollouts": """
        SELECT s_suppkey AS rollout_id, s_suppkey * 3 AS firmware_id,
               generate_series(s_suppkey * 10, s_suppkey * 10 + s_suppkey % 7) AS target_devices FROM supplier""",
    "rollout_nodes": """
        SELECT o_custkey AS rollout_id, o_orderkey AS position, o_orderstatus <> 'P' AS healthy,
               o_orderpriority <> '1-URGENT' AS healthy_after_watch FROM orders""",
    "provisioning_requests": """
        SELECT o_orderkey AS request_id, o_custkey AS device_id,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
               o_orderdate AS requested_at FROM orders""",
    "approvals": """
        SELECT l_orderkey AS request_id, min(l_shipdate) AS approved_at,
               'user-' || CAST(min(l_suppkey) AS VARCHAR) AS approved_by FROM lineitem GROUP BY 1""",
    "local_config": """
        SELECT 'key-' || CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value, c_custkey % 50 * 100 AS version
        FROM customer""",
    "incoming_config": """
        SELECT 'key-' || CAST(o_custkey * 2 AS VARCHAR) AS key, o_orderpriority AS value, o_orderkey AS version
        FROM orders""",
    "version_vectors": """
        SELECT l_partkey AS object_id,
               CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END AS replica,
               CAST(l_suppkey % 3 AS VARCHAR) AS node_id, CAST(max(l_linenumber) AS BIGINT) AS counter
        FROM lineitem GROUP BY 1, 2, 3""",
    "experiment_metrics": """
        SELECT l_orderkey AS job_id, l_linenumber AS epoch, l_shipdate AS ts, 'train_loss' AS metric_name,
               CAST(l_discount AS DECIMAL(12,2)) AS value FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_shipdate, 'val_loss', CAST(l_tax AS DECIMAL(12,2)) FROM lineitem""",
    "deliveries": """
        SELECT 'raw_telemetry' AS stream, g AS consumer_group, id
        FROM telemetry, (VALUES ('ml_inference'), ('data_persistence'), ('alert_handler')) v(g)""",
    "acknowledgements": """
        SELECT * FROM deliveries
        WHERE consumer_group = 'data_persistence' OR (consumer_group = 'ml_inference' AND id % 7 <> 0)""",
    "heartbeats": f"""
        SELECT s_suppkey AS node_id, ['joining','alive','suspect','dead','leaving'][s_suppkey % 5 + 1] AS status,
               {AS_OF} - to_seconds(s_suppkey * 7 % 31) AS last_heartbeat FROM supplier""",
}


def _needed(text: str, views: dict[str, str]) -> set[str]:
    return {name for name in views if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text)}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the views a query names, and those they name, in front of it as CTEs."""
    views = {**VIEWS, **(extra or {})}
    wanted, queue = set(), [body]
    while queue:
        for name in _needed(queue.pop(), views) - wanted:
            wanted.add(name)
            queue.append(views[name])
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in _needed(views[name], views) - {name}:
            place(other)
        order.append(name)

    for name in sorted(wanted):
        place(name)
    if not order:
        return body
    ctes = ",\n".join(f"{name} AS ({views[name]})" for name in order)
    return f"WITH RECURSIVE {ctes}\n{body}"


# --- decoding and payload expressions ------------------------------------------
NUMBER_TYPES = "('UBIGINT','BIGINT','HUGEINT','UHUGEINT','DOUBLE')"


def at(document: str, key: str) -> str:
    return f"""{document}, '$."' || {key} || '"'"""


def numbers(payload: str = "payload", skip: tuple[str, ...] = ("anomaly", "anomaly_type", "unit")) -> str:
    skipped = "".join(f" AND k <> '{s}'" for s in skip)
    return (f"[TRY_CAST(json_extract({at(payload, 'k')}) AS DOUBLE) for k in json_keys({payload}) "
            f"if json_type({at(payload, 'k')}) IN {NUMBER_TYPES}{skipped}]")


def nested_numbers(payload: str = "payload") -> str:
    child = f"json_extract({at(payload, 'k')})"
    return (f"flatten([CASE WHEN json_type({at(payload, 'k')}) IN {NUMBER_TYPES} "
            f"THEN [CAST({child} AS DOUBLE)] "
            f"WHEN json_type({at(payload, 'k')}) = 'OBJECT' THEN "
            f"[TRY_CAST(json_extract({at(child, 'c')}) AS DOUBLE) for c in json_keys({child}) "
            f"if json_type({at(child, 'c')}) IN {NUMBER_TYPES}] "
            f"ELSE [] END for k in json_keys({payload})])")


DECODED = """
    SELECT id, topic, arrived_at,
           CASE WHEN json_exists(b, '$.device_id') THEN json_extract_string(b, '$.device_id')
                WHEN len(string_split(topic, '/')) >= 3 THEN string_split(topic, '/')[2] END AS device_id,
           CASE WHEN json_exists(b, '$.device_type') THEN json_extract_string(b, '$.device_type') ELSE 'unknown' END AS device_type,
           CASE WHEN json_exists(b, '$.timestamp')
                THEN TRY_CAST(replace(json_extract_string(b, '$.timestamp'), '+00:00', '') AS TIMESTAMP)
                ELSE arrived_at END AS ts,
           CASE WHEN b IS NULL THEN NULL
                WHEN NOT json_exists(b, '$.payload') THEN CAST(json_merge_patch(b,
                     '{"device_id":null,"device_type":null,"timestamp":null,"metadata":null}') AS VARCHAR)
                WHEN json_type(b, '$.payload') = 'OBJECT' THEN CAST(json_extract(b, '$.payload') AS VARCHAR) END AS payload,
           b IS NULL AS undecodable
    FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS b FROM messages)"""

CHECKED = """
    SELECT *, CASE WHEN undecodable THEN 'invalid_json' WHEN device_id IS NULL THEN 'missing_device_id'
                   WHEN device_type IS NULL THEN 'missing_device_type' WHEN ts IS NULL THEN 'invalid_timestamp'
                   WHEN payload IS NULL THEN 'invalid_payload' END AS decode_error,
           CASE WHEN ts > arrived_at + INTERVAL 5 MINUTE THEN 'timestamp_in_future'
                WHEN ts < arrived_at - INTERVAL 24 HOUR THEN 'timestamp_too_old'
                WHEN coalesce(len(json_keys(payload)), 0) = 0 THEN 'empty_payload'
                WHEN NOT coalesce(regexp_full_match(regexp_replace(lower(device_id), 'urn:|uuid:|[{}-]', '', 'g'), '[0-9a-f]{32}'), false)
                THEN 'invalid_device_id' END AS rule
    FROM decoded"""

INGEST_VIEWS = {"decoded": DECODED, "checked": CHECKED}

# numeric payload entries as rows, in document order
LONG_FLAT = f"""
    SELECT id, device_id, device_type, ts, CAST(p - 1 AS INTEGER) AS position, e.k AS metric, e.v AS value
    FROM (SELECT id, device_id, device_type, ts, unnest(entries) AS e, generate_subscripts(entries, 1) AS p FROM (
        SELECT *, [{{'k': k, 'v': TRY_CAST(json_extract({at('payload', 'k')}) AS DOUBLE)}} for k in json_keys(payload)
                   if json_type({at('payload', 'k')}) IN {NUMBER_TYPES}
                      AND k NOT IN ('anomaly', 'anomaly_type', 'unit')] AS entries FROM readings))"""
