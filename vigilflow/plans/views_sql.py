"""The domain views as DuckDB common table expressions, for the oracle SQL."""

from __future__ import annotations

from vigilflow import fixed_values as V
from vigilflow.sources.domain import CASE_SPREAD_SECONDS, CATEGORIES, PORTS


def text_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def pick(values, index: str) -> str:
    items = text_list(values) if isinstance(values[0], str) else ", ".join(map(str, values))
    return f"list_extract([{items}], CAST({index} AS INTEGER) + 1)"


def ip(n: str) -> str:
    return f"'10.' || ({n}) // 65536 % 256 || '.' || ({n}) // 256 % 256 || '.' || ({n}) % 256"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def fixed(x: str, digits: int) -> str:
    """Fixed-point text with half-up rounding of the decimal value."""
    return f"CAST(CAST(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(28,{digits})) AS VARCHAR)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(100.0 * {part} / {whole} + 1e-9, 2) ELSE 0.0 END"


def rank(c: str) -> str:
    return f"CASE upper({c}) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


FLOW_ID = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"

VIEWS = {
    "predictions": f"""
  SELECT *, CASE
      WHEN intrusion_flag AND classification_confidence >= 0.85 AND anomaly_score >= 0.60 THEN 'CRITICAL'
      WHEN intrusion_flag AND classification_confidence >= 0.70 THEN 'HIGH'
      WHEN intrusion_flag OR anomaly_label = 'ANOMALOUS' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE
      WHEN intrusion_flag AND classification_confidence >= 0.85 AND anomaly_score >= 0.60 THEN '{V.ACTION_CRITICAL}'
      WHEN intrusion_flag AND classification_confidence >= 0.70 THEN '{V.ACTION_HIGH}'
      WHEN intrusion_flag OR (anomaly_label = 'ANOMALOUS' AND anomaly_score >= 0.75) THEN '{V.ACTION_INSPECT}'
      WHEN anomaly_label = 'ANOMALOUS' THEN '{V.ACTION_DRIFT}' ELSE '{V.ACTION_LOW}' END AS recommended_action,
    '1.0.0' AS model_version, timestamp AS created_at
  FROM (
    SELECT event_id AS id, ts AS timestamp,
      CASE WHEN event_id % 97 = 13 THEN NULL WHEN event_id % 101 = 7 THEN '' ELSE {ip("user_id")} END AS source_ip,
      '192.168.0.' || event_id % 20 AS destination_ip,
      CAST(1024 + event_id % 60000 AS INTEGER) AS source_port,
      {pick(PORTS, "k % 11")} AS destination_port,
      CASE WHEN k % 2 = 0 THEN '6' ELSE '17' END AS protocol,
      value * 1000 AS flow_duration, CAST(k AS BIGINT) AS total_forward_packets,
      event_id % 40 AS total_backward_packets, CAST(k * 64 + event_id % 1500 AS BIGINT) AS total_bytes,
      CASE WHEN least(value / 100, 1.0) >= 0.5 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS anomaly_label,
      least(value / 100, 1.0) AS anomaly_score, (0.5 - least(value / 100, 1.0)) / 2 AS raw_decision_score,
      CASE event_type WHEN 'click' THEN 'Port Scan' WHEN 'purchase' THEN 'Web Attack' WHEN 'error' THEN 'DoS' ELSE 'BENIGN' END AS predicted_threat,
      event_type IN ('click', 'purchase', 'error') AS intrusion_flag,
      k / 100 AS classification_confidence, props AS raw_flow_data
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))""",
    "alerts": f"""
  SELECT id, id AS prediction_id, timestamp,
    CASE risk_level WHEN 'CRITICAL' THEN 'CRITICAL_INTRUSION' WHEN 'HIGH' THEN 'NETWORK_INTRUSION' WHEN 'MEDIUM' THEN 'ANOMALY_MONITORING' END AS alert_type,
    risk_level AS severity, predicted_threat AS threat_label, anomaly_score,
    classification_confidence AS confidence, source_ip, destination_ip,
    {pick(V.ALERT_STATUSES, "id % 3")} AS status, recommended_action, created_at,
    CASE WHEN id % 3 <> 0 THEN created_at + INTERVAL 10 MINUTE END AS acknowledged_at,
    CASE WHEN id % 3 = 2 THEN created_at + INTERVAL 2 HOUR END AS resolved_at
  FROM predictions WHERE risk_level <> 'LOW'""",
    "audit_logs": f"""
  SELECT event_id AS id, ts AS timestamp, 'user' || user_id AS username,
    {pick(["ADMIN", "ANALYST", "VIEWER"], "user_id % 3")} AS user_role,
    CASE event_type WHEN 'error' THEN 'LOGIN_FAILURE' WHEN 'click' THEN 'ACCESS_DENIED' WHEN 'purchase' THEN 'RATE_LIMIT_EXCEEDED'
      WHEN 'signup' THEN CASE WHEN event_id % 4 = 2 THEN 'INCIDENT_ASSIGNED' ELSE 'LOGIN_SUCCESS' END
      ELSE CASE WHEN event_id % 4 = 2 THEN 'INCIDENT_STATUS_CHANGED' ELSE 'ANALYTICS_VIEWED' END END AS action,
    {pick(["PREDICTION", "ALERT", "INCIDENT", "AUTH"], "event_id % 4")} AS resource_type,
    CAST(event_id AS VARCHAR) AS resource_id,
    CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'click' THEN 'DENIED' WHEN 'purchase' THEN 'DENIED' ELSE 'SUCCESS' END AS outcome,
    {ip("user_id")} AS ip_address, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS request_method,
    '/api/v1/' || event_type AS request_path,
    CASE event_type WHEN 'error' THEN 401 WHEN 'click' THEN 403 WHEN 'purchase' THEN 429 ELSE 200 END AS status_code,
    props AS details, ts AS created_at
  FROM events""",
    "incidents": f"""
  SELECT id, 'INC-2024-' || CASE WHEN id + 1 < 1000000 THEN lpad(CAST(id + 1 AS VARCHAR), 6, '0') ELSE CAST(id + 1 AS VARCHAR) END AS incident_key,
    'Case ' || category || ' #' || id AS title, 'Observed by customer ' || o_custkey AS description,
    severity, status, category, {ip("o_custkey")} AS source_ip,
    CASE WHEN o_custkey % 5 <> 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS assigned_to,
    'analyst' || o_custkey % 7 AS created_by, created_at,
    coalesce(resolved_at, investigation_started_at, acknowledged_at, created_at) AS updated_at,
    acknowledged_at, investigation_started_at, resolved_at,
    CASE WHEN status = 'RESOLVED' AND id % 4 <> 0 THEN 'Blocked ' || {ip("o_custkey")} END AS resolution_summary
  FROM (
    SELECT *, CASE WHEN status <> 'OPEN' THEN created_at + INTERVAL 15 MINUTE END AS acknowledged_at,
      CASE WHEN status IN ('INVESTIGATING', 'CONTAINED', 'RESOLVED') THEN created_at + INTERVAL 1 HOUR END AS investigation_started_at,
      CASE WHEN status = 'RESOLVED' THEN created_at + to_hours(CAST(2 + o_custkey % 72 AS INTEGER)) END AS resolved_at
    FROM (
      SELECT o_orderkey AS id, o_custkey,
        TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey * 7919 % {CASE_SPREAD_SECONDS}) AS created_at,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        CASE o_orderstatus WHEN 'F' THEN 'RESOLVED'
          WHEN 'P' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'CONTAINED' ELSE 'INVESTIGATING' END
          ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'ACKNOWLEDGED' ELSE 'OPEN' END END AS status,
        {pick(CATEGORIES, "o_custkey % 5")} AS category
      FROM orders))""",
    "incident_alerts": "SELECT DISTINCT l_orderkey AS incident_id, l_partkey AS alert_id FROM lineitem",
    "incident_predictions": "SELECT DISTINCT l_orderkey AS incident_id, l_suppkey AS prediction_id FROM lineitem",
    "incident_notes": """
  SELECT conv_id * 1000 + turn AS id, conv_id AS incident_id, role AS author, text AS note,
    TIMESTAMP '2024-01-15 00:00:00' + to_minutes(turn) + to_seconds(conv_id) AS created_at FROM conversations""",
    "users": """
  SELECT c_custkey AS id, c_name AS username,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'VIEWER' WHEN 'MACHINERY' THEN 'ADMIN' ELSE 'ANALYST' END AS role,
    c_acctbal > 0 AS is_active FROM customer""",
    "system_nodes": f"""
  SELECT s_suppkey AS id, s_name AS hostname, '192.168.' || s_suppkey // 256 % 256 || '.' || s_suppkey % 256 AS ip_address,
    {pick(["production", "staging", "internal_dmz"], "s_nationkey % 3")} AS environment,
    s_nationkey % 4 + 1 AS criticality_level, s_acctbal > 0 AS is_active FROM supplier""",
    "threat_intel": f"""
  SELECT {ip("s_suppkey")} AS indicator,
    CASE WHEN s_acctbal < 0 THEN 'MALICIOUS' WHEN s_acctbal < 3000 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS reputation,
    (s_suppkey % 100) / 100 AS confidence, n_name || '|' || r_name AS categories, 'Reported by ' || s_name AS notes,
    '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS first_seen,
    '2024-02-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS last_seen
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "flows": f"""
  SELECT {FLOW_ID} AS flow_id, l_shipdate AS captured_at, {ip("l_suppkey")} AS source_ip,
    '192.168.0.' || l_partkey % 20 AS destination_ip,
    CASE WHEN l_partkey % 97 = 0 THEN 70000 ELSE {pick(PORTS, "l_partkey % 11")} END AS destination_port,
    CASE WHEN l_partkey % 3 = 0 THEN 17 ELSE 6 END AS protocol,
    CASE WHEN l_discount > 0 THEN l_partkey * 1000.0::DOUBLE END AS flow_duration,
    CASE WHEN l_tax > 0 THEN l_quantity END AS total_fwd_packets,
    CAST(l_linenumber AS DOUBLE) AS total_backward_packets,
    l_extendedprice AS total_length_of_fwd_packets, l_quantity * 40.0::DOUBLE AS total_length_of_bwd_packets,
    CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 1.0 END AS syn_flag_count,
    CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rst_flag_count,
    CASE WHEN l_partkey % 50 = 0 THEN 'inf'::DOUBLE WHEN l_partkey % 50 = 1 THEN '-inf'::DOUBLE ELSE l_extendedprice END AS flow_bytes_per_s,
    0.0::DOUBLE AS urg_flag_count,
    CASE WHEN l_partkey % 40 = 0 THEN 'Infinity' ELSE CAST(l_discount AS VARCHAR) END AS down_per_up_ratio,
    CASE WHEN l_suppkey % 10 <> 0 THEN l_returnflag END AS service,
    CASE WHEN l_linenumber = 7 THEN {pick(["abnormal", "dos", "DDoS LOIC", "Botnet"], "l_partkey % 4")}
      WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'BENIGN' ELSE 'DoS Hulk' END
      WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'PortScan' ELSE ' Benign ' END
      ELSE CASE WHEN l_linestatus = 'F' THEN 'SSH-Patator' ELSE 'Web Attack – XSS' END END AS label
  FROM lineitem""",
    "traffic_records": f"""
  SELECT {FLOW_ID} AS id, l_shipdate AS captured_at, {ip("l_suppkey")} AS source_ip,
    '192.168.0.' || l_partkey % 20 AS destination_ip, CAST(1024 + l_orderkey % 60000 AS INTEGER) AS source_port,
    CASE WHEN l_partkey % 97 = 0 THEN 70000 ELSE {pick(PORTS, "l_partkey % 11")} END AS destination_port,
    CASE WHEN l_partkey % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol, l_partkey / 1000 AS duration_seconds,
    CAST(l_quantity + l_linenumber AS BIGINT) AS total_packets, CAST(floor(l_extendedprice) AS BIGINT) AS total_bytes,
    l_returnflag <> 'A' AS is_suspicious FROM lineitem""",
    "threat_events": f"""
  SELECT 't-' || {FLOW_ID} AS id, {FLOW_ID} AS traffic_record_id,
    CASE WHEN l_returnflag = 'N' THEN 'PortScan' ELSE 'BruteForce' END AS threat_type,
    l_quantity / 50 AS anomaly_score, l_discount * 10 AS confidence_score,
    CASE WHEN l_linenumber = 6 THEN 'SEVERE' ELSE {pick(["LOW", "MEDIUM", "HIGH", "CRITICAL"], "l_linenumber % 4")} END AS severity,
    {pick(["DETECTED", "INVESTIGATING", "MITIGATED", "DISMISSED"], "l_partkey % 4")} AS status,
    l_shipdate AS detected_at FROM lineitem WHERE l_returnflag <> 'A'""",
    "ml_predictions": f"""
  SELECT event_id AS id, {pick(["isolation_forest", "threat_classifier"], "event_id % 2")} AS model_name,
    {pick(["1.0.0", "1.1.0"], "user_id % 2")} AS model_version, value AS inference_latency_ms,
    event_type AS raw_prediction, ts AS executed_at FROM events""",
    "hunt_history": f"""
  SELECT event_id AS id, ts AS timestamp, 'user' || user_id AS username,
    CASE WHEN event_id % 2 = 0 THEN {ip("user_id")} END AS source_ip,
    CASE WHEN event_id % 3 = 0 THEN event_type END AS threat_category,
    CASE WHEN event_id % 5 = 0 THEN 'HIGH' END AS severity,
    CASE WHEN event_id % 7 = 0 THEN {pick(PORTS, "CAST(json_extract(props, '$.k') AS INTEGER) % 11")} END AS destination_port,
    CASE WHEN event_id % 11 = 0 THEN repeat(event_type, 50) END AS query_text, CASE WHEN event_id % 13 = 0 THEN '17' END AS protocol,
    CASE WHEN event_id % 4 = 1 THEN CAST(json_extract(props, '$.k') AS INTEGER) / 100 END AS min_confidence,
    CASE WHEN event_id % 6 = 5 THEN 'NEW' END AS alert_status, '24h' AS time_range, 50 AS "limit", 0 AS "offset",
    CAST(json_extract(props, '$.k') AS BIGINT) AS result_count FROM events""",
}
# alerts are drawn from predictions
NEEDS = {"alerts": ["predictions"]}


def with_views(names, body: str, **extra: str) -> str:
    """Prefix ``body`` with the named views and any further CTEs."""
    order: list[str] = []
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    head = f"WITH {', '.join(parts)}\n" if parts else ""
    return head + body


ATTACK = "lower(predicted_threat) <> 'benign'"
#: The sentences that explain a scored flow, joined.
REASONS_SQL = f"""SELECT id, array_to_string(list_filter([
      CASE WHEN anomaly_score >= 0.70 THEN 'Severe anomaly divergence (score: ' || {fixed('anomaly_score', 3)} || ') detected by Isolation Forest'
        WHEN anomaly_score >= 0.50 THEN 'Elevated statistical outlier score (' || {fixed('anomaly_score', 3)} || ') above nominal traffic baseline' END,
      CASE WHEN {ATTACK} THEN 'Supervised Random Forest classified flow signature as ''' || predicted_threat || ''' attack vector' END,
      CASE WHEN {ATTACK} AND classification_confidence >= 0.85 THEN 'High classifier confidence (' || {fixed('classification_confidence * 100', 1)} || '%) supporting threat designation'
        WHEN {ATTACK} AND classification_confidence < 0.50 THEN 'Moderate classifier confidence (' || {fixed('classification_confidence * 100', 1)} || '%); recommends secondary validation' END,
      CASE WHEN destination_port IN (21, 22, 23, 3389) THEN 'Target involves administrative remote access service (port ' || destination_port || ')'
        WHEN destination_port IN (80, 443, 8080, 8443) THEN 'Target involves public web application service (port ' || destination_port || ')'
        WHEN destination_port = 53 THEN 'Target involves core DNS resolution infrastructure (port 53)' END,
      CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN 'Composite risk assessment assigned ' || risk_level || ' priority based on combined anomaly and threat scores' END,
      CASE WHEN NOT intrusion_flag AND NOT ({ATTACK}) THEN 'Flow telemetry metrics conform to expected baseline benign traffic patterns' END], lambda x: x IS NOT NULL), ' | ') AS reasons FROM predictions"""
