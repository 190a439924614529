"""Registered queries: hunts, correlation, profiles, pages, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilflow import fixed_values as V
from vigilflow.functions import timerange
from vigilflow.functions.expr import iso as spark_iso
from vigilflow.operators import hunting as H, paging as P
from vigilflow.plans.registry import query
from vigilflow.plans.views_sql import fixed, iso, rank
from vigilflow.sources.domain import AS_OF

MONTH = timerange.resolve("30d", AS_OF)
WEEK = timerange.resolve("7d", AS_OF)
IN_MONTH = "{} BETWEEN TIMESTAMP '" + AS_OF + "' - INTERVAL 30 DAY AND TIMESTAMP '" + AS_OF + "'"
IN_WEEK = IN_MONTH.replace("30 DAY", "7 DAY")


def texts(df, *columns):
    """Timestamps as ISO text for comparison."""
    for c in columns:
        df = df.withColumn(c, spark_iso(c))
    return df


@query(
    "time_range_filter",
    f"SELECT id, {iso('timestamp')} AS timestamp FROM predictions WHERE {IN_WEEK.format('timestamp')}",
    "predictions",
)
def time_range_filter(t):
    return texts(t.domain.predictions.filter(WEEK.contains("timestamp")).select("id", "timestamp"), "timestamp")


@query(
    "time_range_custom",
    f"SELECT id, {iso('timestamp')} AS timestamp FROM predictions WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-06 00:00:00'",
    "predictions",
)
def time_range_custom(t):
    window = timerange.resolve("custom", AS_OF, "2024-01-05T08:00:00+02:00", "2024-01-06T00:00:00Z")
    return texts(t.domain.predictions.filter(window.contains("timestamp")).select("id", "timestamp"), "timestamp")


HUNT = H.HuntFilters(threat_category=" SCAN ", min_confidence=0.2, max_confidence=0.95, min_anomaly_score=0.01,
                     max_anomaly_score=0.9, protocol="17", severity="high", query_text="192.168.0.1")
HUNT_SQL = f"""{IN_MONTH.format('timestamp')} AND protocol = '17' AND lower(predicted_threat) LIKE '%scan%' AND risk_level = 'HIGH'
  AND anomaly_score BETWEEN 0.01 AND 0.9 AND classification_confidence BETWEEN 0.2 AND 0.95
  AND (lower(predicted_threat) LIKE '%192.168.0.1%' OR lower(anomaly_label) LIKE '%192.168.0.1%'
    OR lower(source_ip) LIKE '%192.168.0.1%' OR lower(destination_ip) LIKE '%192.168.0.1%')"""
ITEM = f"""id, {iso('timestamp')} AS timestamp, source_ip, destination_ip, source_port, destination_port, protocol, predicted_threat, risk_level,
  round(anomaly_score, 4) AS anomaly_score, round(classification_confidence, 4) AS classification_confidence, intrusion_flag"""


@query(
    "hunt_predictions",
    f"SELECT {ITEM} FROM predictions WHERE {HUNT_SQL} ORDER BY predictions.timestamp DESC, id DESC LIMIT 500",
    "predictions",
)
def hunt_predictions(t):
    return texts(H.hunt_predictions(t.domain.predictions, HUNT, MONTH, 500), "timestamp")


@query(
    "hunt_by_address",
    f"""SELECT {ITEM} FROM predictions WHERE {IN_MONTH.format('timestamp')} AND source_ip = '10.0.0.7' AND destination_port = 443
      ORDER BY predictions.timestamp DESC, id DESC LIMIT 50""",
    "predictions",
)
def hunt_by_address(t):
    wanted = H.HuntFilters(source_ip="10.0.0.7", destination_port=443)
    return texts(H.hunt_predictions(t.domain.predictions, wanted, MONTH), "timestamp")


ALERT_HUNT = H.HuntFilters(threat_category="dos", severity="critical", alert_status="new", query_text="intrusion")
ALERT_SQL = f"""{IN_MONTH.format('timestamp')} AND lower(threat_label) LIKE '%dos%' AND severity = 'CRITICAL' AND status = 'NEW'
  AND (lower(threat_label) LIKE '%intrusion%' OR lower(alert_type) LIKE '%intrusion%' OR lower(source_ip) LIKE '%intrusion%' OR lower(destination_ip) LIKE '%intrusion%')"""


@query(
    "hunt_alerts",
    f"""SELECT id, {iso('timestamp')} AS timestamp, prediction_id, severity, status, alert_type, threat_label, round(confidence, 4) AS confidence,
      source_ip, destination_ip FROM alerts WHERE {ALERT_SQL}""",
    "alerts",
)
def hunt_alerts(t):
    return texts(H.hunt_alerts(t.domain.alerts, ALERT_HUNT, MONTH, None), "timestamp")


CASE_HUNT = H.HuntFilters(threat_category="attack", severity="CRITICAL", incident_status="open", query_text="case web")
CASE_SQL = f"""{IN_MONTH.format('created_at')} AND lower(category) LIKE '%attack%' AND severity = 'CRITICAL' AND status = 'OPEN'
  AND (lower(incident_key) LIKE '%case web%' OR lower(title) LIKE '%case web%' OR lower(description) LIKE '%case web%' OR lower(category) LIKE '%case web%')"""


@query(
    "hunt_incidents",
    f"""SELECT id, incident_key, title, severity, status, category, source_ip, assigned_to, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at
    FROM incidents WHERE {CASE_SQL}""",
    "incidents",
)
def hunt_incidents(t):
    return texts(H.hunt_incidents(t.domain.incidents, CASE_HUNT, MONTH, None), "created_at", "updated_at")


@query(
    "hunt_page",
    f"SELECT {ITEM} FROM predictions WHERE {IN_MONTH.format('timestamp')} ORDER BY predictions.timestamp DESC, id DESC LIMIT 1000 OFFSET 400",
    "predictions",
)
def hunt_page(t):
    return texts(H.hunt_predictions(t.domain.predictions, H.HuntFilters(), MONTH, 1000, 400), "timestamp")


BROAD = H.HuntFilters(severity="high")
BROAD_P = f"{IN_MONTH.format('timestamp')} AND risk_level = 'HIGH'"
BROAD_I = f"{IN_MONTH.format('created_at')} AND severity = 'HIGH'"


@query(
    "query_counts",
    f"""SELECT (SELECT count(*) FROM predictions WHERE {BROAD_P}) AS total_predictions,
      (SELECT count(*) FROM alerts WHERE {IN_MONTH.format('timestamp')} AND severity = 'HIGH') AS total_alerts,
      (SELECT count(*) FROM incidents WHERE {BROAD_I}) AS total_incidents""",
    "predictions alerts incidents",
)
def query_counts(t):
    d = t.domain
    return H.query_counts(d.predictions, d.alerts, d.incidents, BROAD, MONTH)


CONVERGENCE = f"""SELECT source_ip, count(*) AS event_count,
      coalesce(string_agg(DISTINCT CAST(destination_port AS VARCHAR), ',') , '') AS unsorted,
      list_sort(list_distinct(list(destination_port))) AS ports,
      CASE WHEN count(*) >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
    FROM predictions WHERE {{}} AND source_ip <> '' GROUP BY 1 HAVING count(*) >= 2"""


@query(
    "network_convergence",
    "SELECT source_ip, event_count, array_to_string(ports, ', ') AS ports, confidence FROM c",
    "predictions",
    c=CONVERGENCE.format(BROAD_P),
)
def network_convergence(t):
    found = H.match_predictions(t.domain.predictions, BROAD, MONTH)
    return H.network_convergence(found).withColumn("ports", F.array_join("ports", ", "))


INSIGHT_CASES = f"""SELECT 'CASE_CORRELATION' AS correlation_type, 'Associated SOC Incident Case: ' || incident_key AS title,
      'Active case ''' || title || ''' (' || severity || ', status ' || status || ') shares search attributes with current threat hunt results.' AS description,
      1::BIGINT AS event_count, 'HIGH' AS confidence
    FROM (SELECT * FROM incidents WHERE {BROAD_I} ORDER BY created_at DESC, id DESC LIMIT 3)"""


@query("case_correlation", "SELECT * FROM k", "incidents", k=INSIGHT_CASES)
def case_correlation(t):
    return H.case_insights(H.match_incidents(t.domain.incidents, BROAD, MONTH))


INSIGHT_NET = """SELECT 'NETWORK_CONVERGENCE' AS correlation_type, 'Repeated Probe / Attack Convergence from ' || source_ip AS title,
      'Source IP ''' || source_ip || ''' generated ' || event_count || ' matching flow predictions targeting destination port(s): '
        || CASE WHEN len(ports) > 0 THEN array_to_string(ports, ', ') ELSE 'N/A' END || '.' AS description,
      event_count, confidence FROM c"""


def burst_sql(where: str) -> str:
    return f"""SELECT 'TEMPORAL_BURST' AS correlation_type, '{V.BURST_TITLE}' AS title,
      'Observed ' || n || ' suspicious flows within a tight ' || CAST(floor(span / 60) AS BIGINT) || ' minute window. Indicates potential automated script or tool.' AS description,
      n AS event_count, 'HIGH' AS confidence
    FROM (SELECT count(*) AS n, date_diff('microsecond', min(timestamp), max(timestamp)) / 1e6 AS span FROM predictions WHERE {where})
    WHERE n >= 3 AND span > 0 AND span <= 600"""


@query(
    "hunt_correlations",
    f"SELECT * FROM k UNION ALL ({INSIGHT_NET}) UNION ALL ({burst_sql(BROAD_P)})",
    "predictions incidents",
    k=INSIGHT_CASES,
    c=CONVERGENCE.format(BROAD_P),
)
def hunt_correlations(t):
    d = t.domain
    return H.correlations(
        H.match_predictions(d.predictions, BROAD, MONTH), H.match_incidents(d.incidents, BROAD, MONTH)
    )


BURST_FROM, BURST_TO = "2024-01-10 08:00:00", "2024-01-10 08:10:00"


@query("temporal_burst", burst_sql(f"timestamp BETWEEN TIMESTAMP '{BURST_FROM}' AND TIMESTAMP '{BURST_TO}'"), "predictions")
def temporal_burst(t):
    window = timerange.resolve("custom", AS_OF, BURST_FROM, BURST_TO)
    return H.burst_insights(H.match_predictions(t.domain.predictions, H.HuntFilters(), window))


@query(
    "source_bursts",
    f"""SELECT source_ip, {iso("time_bucket(INTERVAL 10 MINUTE, timestamp)")} AS window_start, count(*) AS event_count,
      date_diff('microsecond', min(timestamp), max(timestamp)) / 1e6 AS span_seconds
    FROM predictions WHERE source_ip <> '' GROUP BY source_ip, time_bucket(INTERVAL 10 MINUTE, timestamp)
    HAVING count(*) >= 3 AND min(timestamp) < max(timestamp)""",
    "predictions",
)
def source_bursts(t):
    return texts(H.source_bursts(t.domain.predictions), "window_start")


@query(
    "source_bursts_6h",
    f"""SELECT source_ip, {iso("time_bucket(INTERVAL 6 HOUR, timestamp)")} AS window_start, count(*) AS event_count,
      date_diff('microsecond', min(timestamp), max(timestamp)) / 1e6 AS span_seconds
    FROM predictions WHERE source_ip <> '' GROUP BY source_ip, time_bucket(INTERVAL 6 HOUR, timestamp)
    HAVING count(*) >= 3 AND min(timestamp) < max(timestamp)""",
    "predictions",
)
def source_bursts_6h(t):
    return texts(H.source_bursts(t.domain.predictions, 6 * 3600), "window_start")


@query(
    "hunting_summary",
    """SELECT (SELECT count(*) FROM predictions) AS total_flows_investigated,
      (SELECT count(*) FROM predictions WHERE intrusion_flag OR anomaly_score < 0 OR predicted_threat <> 'BENIGN') AS total_threat_detections,
      (SELECT count(DISTINCT source_ip) FROM predictions WHERE source_ip IS NOT NULL) AS unique_source_ips,
      (SELECT count(*) FROM alerts WHERE status IN ('NEW', 'ACKNOWLEDGED')) AS total_active_alerts,
      (SELECT count(*) FROM incidents WHERE status <> 'RESOLVED') AS total_open_incidents""",
    "predictions alerts incidents",
)
def hunting_summary(t):
    return H.hunting_summary(t.domain.predictions, t.domain.alerts, t.domain.incidents)


@query(
    "hunting_top_threats",
    "SELECT predicted_threat AS threat, count(*) AS count FROM predictions WHERE predicted_threat <> 'BENIGN' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "predictions",
)
def hunting_top_threats(t):
    return H.top_threats(t.domain.predictions)


@query(
    "hunting_top_sources",
    "SELECT source_ip, count(*) AS count FROM predictions WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "predictions",
)
def hunting_top_sources(t):
    return H.top_sources(t.domain.predictions)


PAI = "predictions alerts incidents"
SEEN = """SELECT source_ip, timestamp AS seen_at, predicted_threat AS threat, risk_level AS severity FROM predictions WHERE source_ip <> ''
    UNION ALL SELECT source_ip, timestamp, threat_label, severity FROM alerts WHERE source_ip <> ''
    UNION ALL SELECT source_ip, created_at, NULL, NULL FROM incidents WHERE source_ip <> ''"""


@query(
    "source_profile",
    f"""SELECT s.source_ip, {iso("first_seen")} AS first_seen, {iso("last_seen")} AS last_seen, total_observations, destination_ports, protocols
    FROM (SELECT source_ip, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS total_observations FROM seen GROUP BY 1) s
    LEFT JOIN (SELECT source_ip, array_to_string(list_sort(list_distinct(list(destination_port))), ',') AS destination_ports,
      array_to_string(list_sort(list_distinct(list(protocol))), ',') AS protocols FROM predictions GROUP BY 1) p ON p.source_ip = s.source_ip""",
    PAI,
    seen=SEEN,
)
def source_profile(t):
    d = t.domain
    profile = H.source_profile(d.predictions, d.alerts, d.incidents)
    return texts(profile, "first_seen", "last_seen").withColumns(
        {c: F.array_join(c, ",") for c in ("destination_ports", "protocols")}
    )


@query("source_threats", "SELECT source_ip, threat, count(*) AS count FROM seen WHERE threat IS NOT NULL GROUP BY 1, 2", PAI, seen=SEEN)
def source_threats(t):
    return H.source_threats(t.domain.predictions, t.domain.alerts, t.domain.incidents)


@query("source_severities", "SELECT source_ip, severity, count(*) AS count FROM seen WHERE severity IS NOT NULL GROUP BY 1, 2", PAI, seen=SEEN)
def source_severities(t):
    return H.source_severities(t.domain.predictions, t.domain.alerts, t.domain.incidents)


@query(
    "source_destinations",
    """SELECT source_ip, destination_ip, destination_port, count, place FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY source_ip ORDER BY count DESC, destination_ip, destination_port) AS INTEGER) AS place
      FROM (SELECT source_ip, destination_ip, destination_port, count(*) AS count FROM predictions WHERE source_ip <> '' GROUP BY 1, 2, 3))
    WHERE place <= 15""",
    "predictions",
)
def source_destinations(t):
    return H.source_destinations(t.domain.predictions)


@query(
    "first_seen_gap",
    "SELECT source_ip, date_diff('microsecond', min(timestamp), max(timestamp)) / 1e6 AS span_seconds FROM predictions WHERE source_ip <> '' GROUP BY 1",
    "predictions",
)
def first_seen_gap(t):
    return H.first_seen_gap(t.domain.predictions)


EVENTS = f"""SELECT {iso('timestamp')} AS timestamp, 'PREDICTION' AS event_type, risk_level AS severity, source_ip AS source,
      destination_ip || ':' || destination_port AS destination, 'PREDICTION' AS resource_type, CAST(id AS VARCHAR) AS resource_id,
      'Flow evaluated as ' || predicted_threat || ' (' || risk_level || ' risk, score ' || {fixed('anomaly_score', 2)} || ').' AS description
    FROM predictions WHERE {{0}}
    UNION ALL SELECT {iso('timestamp')}, 'ALERT', severity, source_ip, destination_ip, 'ALERT', CAST(id AS VARCHAR),
      'Security alert #' || id || ' (' || severity || ') triggered: ' || threat_label || '.' FROM alerts WHERE {{0}}
    UNION ALL SELECT {iso('created_at')}, 'INCIDENT', severity, source_ip, NULL, 'INCIDENT', CAST(id AS VARCHAR),
      'SOC Incident ' || incident_key || ' opened: ''' || title || '''.' FROM incidents WHERE {{0}}"""


@query("source_timeline", EVENTS.format("source_ip <> ''"), PAI)
def source_timeline(t):
    return texts(H.source_timeline(t.domain.predictions, t.domain.alerts, t.domain.incidents), "timestamp")


@query("source_timeline_one", EVENTS.format("source_ip = '10.0.0.7'"), PAI)
def source_timeline_one(t):
    events = H.source_timeline(t.domain.predictions, t.domain.alerts, t.domain.incidents, "10.0.0.7")
    return texts(events, "timestamp")


# --- history --------------------------------------------------------------------

HISTORY = """SELECT id, timestamp, username, left(concat_ws(', ', 'src:' || source_ip, 'threat:' || threat_category, 'sev:' || severity,
      'port:' || destination_port, 'q:''' || query_text || '''', 'Last 24 Hours'), 250) AS filter_summary,
    '{' || concat_ws(',', '"source_ip":"' || source_ip || '"', '"destination_port":' || destination_port, '"protocol":"' || protocol || '"',
      '"threat_category":"' || threat_category || '"', '"severity":"' || severity || '"', '"min_confidence":' || min_confidence,
      '"query_text":"' || query_text || '"', '"alert_status":"' || alert_status || '"', '"time_range":"24h"', '"limit":50', '"offset":0') || '}' AS filters_json,
    result_count FROM hunt_history"""


@query("hunt_history_append", f"SELECT * REPLACE ({iso('timestamp')} AS timestamp) FROM h", "hunt_history", h=HISTORY)
def hunt_history_append(t):
    return texts(H.history_entries(t.domain.hunt_history), "timestamp")


@query(
    "history_trim",
    f"""SELECT id, {iso('timestamp')} AS timestamp, username FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY timestamp DESC, id DESC) AS rn
      FROM hunt_history) WHERE rn <= 50""",
    "hunt_history",
)
def history_trim(t):
    kept = H.history_trim(t.domain.hunt_history.select("id", "timestamp", "username"))
    return texts(kept, "timestamp")


@query(
    "history_list",
    f"""SELECT id, {iso('timestamp')} AS timestamp, username, filter_summary,
      coalesce(json_extract_string(filters_json, '$.threat_category'), '') AS threat_category, coalesce(json_extract_string(filters_json, '$.time_range'), '') AS time_range,
      result_count FROM (SELECT id, timestamp, username, filter_summary, CASE WHEN id % 10 = 3 THEN '{{}}' ELSE filters_json END AS filters_json, result_count
        FROM h WHERE username = 'user7' ORDER BY timestamp DESC, id DESC LIMIT 20)""",
    "hunt_history",
    h=HISTORY,
)
def history_list(t):
    entries = H.history_entries(t.domain.hunt_history)
    # every tenth entry carries broken JSON
    damaged = F.when(F.col("id") % 10 == 3, F.lit("{broken")).otherwise(F.col("filters_json"))
    listed = H.history_list(entries.withColumn("filters_json", damaged), "user7", 20)
    return texts(listed, "timestamp").select(
        "id", "timestamp", "username", "filter_summary",
        *[F.coalesce(F.try_element_at("filters", F.lit(k)), F.lit("")).alias(k) for k in ("threat_category", "time_range")],
        "result_count",
    )


# --- filters and pages ------------------------------------------------------------


@query(
    "alerts_filter",
    "SELECT id, severity, status FROM alerts WHERE severity = 'HIGH' AND status = 'NEW'",
    "alerts",
)
def alerts_filter(t):
    return P.alerts_filter(t.domain.alerts, " high ", "new").select("id", "severity", "status")


@query(
    "incidents_filter",
    "SELECT id, status, severity, category, assigned_to FROM incidents WHERE status = 'OPEN' AND severity = 'CRITICAL' AND category = 'Port Scan'",
    "incidents",
)
def incidents_filter(t):
    found = P.incidents_filter(t.domain.incidents, "open", "critical", "Port Scan ")
    return found.select("id", "status", "severity", "category", "assigned_to")


@query(
    "audit_filter",
    """SELECT id, username, action, outcome FROM audit_logs WHERE username ILIKE '%SER12%' AND action = 'LOGIN_FAILURE' AND outcome = 'FAILURE'
      AND timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'""",
    "audit_logs",
)
def audit_filter(t):
    start, end = timerange.literal("2024-01-05"), timerange.literal("2024-01-25")
    found = P.audit_filter(t.domain.audit_logs, "SER12", "login_failure", "failure", start=start, end=end)
    return found.select("id", "username", "action", "outcome")


@query(
    "predictions_page",
    f"SELECT id, {iso('created_at')} AS created_at, risk_level FROM predictions ORDER BY predictions.created_at DESC, id DESC LIMIT 100 OFFSET 200",
    "predictions",
)
def predictions_page(t):
    rows = P.page(t.domain.predictions, "created_at", V.MAX_PAGE_ROWS, 200)
    return texts(rows.select("id", "created_at", "risk_level"), "created_at")


@query(
    "predictions_page_after",
    f"""SELECT id, {iso('created_at')} AS created_at, risk_level FROM predictions WHERE created_at < TIMESTAMP '2024-01-20 00:00:00'
      OR (created_at = TIMESTAMP '2024-01-20 00:00:00' AND id < 5000) ORDER BY predictions.created_at DESC, id DESC LIMIT 100""",
    "predictions",
)
def predictions_page_after(t):
    cursor = (timerange.literal("2024-01-20"), 5000)
    rows = P.page_after(t.domain.predictions, "created_at", 100, cursor)
    return texts(rows.select("id", "created_at", "risk_level"), "created_at")


@query(
    "alerts_page",
    f"SELECT id, {iso('created_at')} AS created_at, severity FROM alerts ORDER BY alerts.created_at DESC, id DESC LIMIT 50 OFFSET 50",
    "alerts",
)
def alerts_page(t):
    return texts(P.page(t.domain.alerts, "created_at", 50, 50).select("id", "created_at", "severity"), "created_at")


@query(
    "audit_page",
    f"SELECT id, {iso('timestamp')} AS timestamp, action FROM audit_logs ORDER BY audit_logs.timestamp DESC, id DESC LIMIT 20 OFFSET 20",
    "audit_logs",
)
def audit_page(t):
    return texts(P.page(t.domain.audit_logs, "timestamp", 20, 20).select("id", "timestamp", "action"), "timestamp")


@query(
    "incidents_page",
    f"SELECT id, {iso('created_at')} AS created_at, status FROM incidents ORDER BY incidents.created_at DESC, id DESC LIMIT 20 OFFSET 40",
    "incidents",
)
def incidents_page(t):
    return texts(P.page(t.domain.incidents, "created_at", 20, 40).select("id", "created_at", "status"), "created_at")


@query(
    "notes_newest_first",
    f"SELECT id, incident_id, {iso('created_at')} AS created_at, note FROM incident_notes WHERE incident_id = 7 ORDER BY incident_notes.created_at DESC",
    "incident_notes",
)
def notes_newest_first(t):
    mine = t.domain.incident_notes.filter(F.col("incident_id") == 7)
    ordered = mine.orderBy(F.desc("created_at"), F.desc("id"))
    return texts(ordered.select("id", "incident_id", "created_at", "note"), "created_at")


@query(
    "severity_order",
    f"SELECT id, severity, {rank('severity')} AS rank FROM incidents WHERE status = 'CONTAINED' ORDER BY 3 DESC, 1",
    "incidents",
)
def severity_order(t):
    from vigilflow.functions.expr import severity_rank

    contained = t.domain.incidents.filter(F.col("status") == "CONTAINED")
    return P.by_severity(contained, "severity", F.asc("id")).select("id", "severity", severity_rank("severity").alias("rank"))


@query(
    "point_lookup",
    "SELECT id, status, severity FROM incidents WHERE id IN (SELECT conv_id FROM conversations)",
    "incidents",
)
def point_lookup(t):
    ids = t.conversations.select(F.col("conv_id").alias("id"))
    return P.lookup(t.domain.incidents, ids).select("id", "status", "severity")


@query(
    "newest_n_per_entity",
    f"""SELECT source_ip, id, {iso('timestamp')} AS timestamp, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_ip ORDER BY timestamp DESC, id DESC) AS INTEGER) AS place
      FROM predictions WHERE source_ip <> '') WHERE place <= 10""",
    "predictions",
)
def newest_n_per_entity(t):
    rows = t.domain.predictions.filter(F.col("source_ip") != "").select("source_ip", "id", "timestamp")
    return texts(P.newest_per_group(rows, ["source_ip"], P.newest_first("timestamp"), 10), "timestamp")
