"""Registered queries: reports, exports, evidence, privacy, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilflow import fixed_values as V
from vigilflow.functions import privacy, timerange
from vigilflow.operators import evidence as E, evidence_tree as HT, reports as R, retention as T
from vigilflow.plans.hunting_queries import texts
from vigilflow.plans.registry import query
from vigilflow.plans.views_sql import fixed, iso, pct
from vigilflow.session import scratch_path, settle
from vigilflow.sources.domain import AS_OF

WEEK = timerange.resolve("last_7d", AS_OF)
IN_WEEK = "{} BETWEEN TIMESTAMP '" + AS_OF + "' - INTERVAL 7 DAY AND TIMESTAMP '" + AS_OF + "'"
AT, CREATED = IN_WEEK.format("timestamp"), IN_WEEK.format("created_at")
PAI = "predictions alerts incidents"


def week(t):
    d = t.domain
    return (
        R.report_predictions(d.predictions, WEEK),
        R.report_alerts(d.alerts, WEEK),
        R.report_incidents(d.incidents, WEEK),
    )


FRAMES = {
    "p": f"SELECT * FROM predictions WHERE {AT}",
    "a": f"SELECT * FROM alerts WHERE {AT}",
    "i": f"SELECT * FROM incidents WHERE {CREATED}",
}
THREAT = "(intrusion_flag OR anomaly_score < 0 OR predicted_threat <> 'BENIGN')"
SUMMARY = f"""SELECT *, greatest(0, total_incidents - resolved_incidents) AS unresolved_incidents, greatest(0, total_predictions - total_threats) AS benign_flows,
    {pct('total_threats', 'total_predictions')} AS threat_ratio_percent
  FROM (SELECT (SELECT count(*) FROM p) AS total_predictions, (SELECT count(*) FROM p WHERE {THREAT}) AS total_threats, (SELECT count(*) FROM a) AS total_alerts,
    (SELECT count(*) FROM a WHERE severity = 'CRITICAL') AS critical_alerts, (SELECT count(*) FROM a WHERE severity = 'HIGH') AS high_alerts,
    (SELECT count(*) FROM i) AS total_incidents, (SELECT count(*) FROM i WHERE status = 'RESOLVED') AS resolved_incidents)"""


def map_sql(frame: str, column: str) -> str:
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce({column}, 'UNKNOWN') AS k, count(*) AS n FROM {frame} GROUP BY 1))"


def map_text(c: str):
    pair = lambda e: F.concat_ws("=", e["key"], e["value"])
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), pair)), ",")


@query(
    "report_summary",
    f"SELECT *, {map_sql('a', 'severity')} AS alerts_by_severity, {map_sql('i', 'status')} AS incidents_by_status FROM s",
    PAI,
    **FRAMES,
    s=SUMMARY,
)
def report_summary(t):
    maps = ("alerts_by_severity", "incidents_by_status")
    return R.report_summary(*week(t)).withColumns({c: map_text(c) for c in maps})


TOP_THREATS = "SELECT coalesce(predicted_threat, 'Unknown') AS threat, count(*) AS count FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
TOP_SOURCES = "SELECT * FROM (SELECT source_ip, count(*) AS count FROM p WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) WHERE source_ip <> ''"


@query("report_top_threats", TOP_THREATS, PAI, **FRAMES)
def report_top_threats(t):
    return R.report_top_threats(week(t)[0])


@query("report_top_sources", TOP_SOURCES, PAI, **FRAMES)
def report_top_sources(t):
    return R.report_top_sources(week(t)[0])


@query(
    "important_findings",
    f"""SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS place, finding FROM (
      SELECT 1 AS o, CASE WHEN total_predictions = 0 THEN '{V.FINDING_EMPTY}' ELSE 'Observed ' || total_threats || ' suspicious/anomalous flows out of ' || total_predictions
        || ' total evaluations (' || {fixed('total_threats * 100.0::DOUBLE / total_predictions', 1)} || '% anomaly density).' END AS finding FROM s
      UNION ALL SELECT 2, 'High-priority alert volume: ' || critical_alerts || ' CRITICAL and ' || high_alerts || ' HIGH severity alerts triggered.' FROM s WHERE critical_alerts > 0 OR high_alerts > 0
      UNION ALL SELECT 3, 'SOC Incident Resolution Rate: ' || {fixed('resolved_incidents * 100.0::DOUBLE / total_incidents', 1)} || '% (' || resolved_incidents || ' resolved, ' || unresolved_incidents || ' open/in-progress).' FROM s WHERE total_incidents > 0
      UNION ALL SELECT 4, 'Primary detected attack vector: ''' || threat || ''' with ' || count || ' matching event signatures.' FROM (SELECT * FROM tt ORDER BY count DESC, threat LIMIT 1)
      UNION ALL SELECT 5, 'Most active source address: ''' || source_ip || ''' with ' || count || ' associated ingress flows.' FROM (SELECT * FROM ts ORDER BY count DESC, source_ip LIMIT 1))""",
    PAI,
    **FRAMES,
    s=SUMMARY,
    tt=TOP_THREATS,
    ts=TOP_SOURCES,
)
def important_findings(t):
    p, a, i = week(t)
    return R.important_findings(R.report_summary(p, a, i), R.report_top_threats(p), R.report_top_sources(p))


@query(
    "report_filters",
    f"""SELECT 'predictions' AS entity, count(*) AS rows FROM p WHERE risk_level = 'HIGH' AND lower(predicted_threat) LIKE '%scan%'
    UNION ALL SELECT 'alerts', count(*) FROM a WHERE severity = 'HIGH' AND lower(threat_label) LIKE '%scan%'
    UNION ALL SELECT 'incidents', count(*) FROM i WHERE severity = 'HIGH' AND lower(category) LIKE '%scan%'""",
    PAI,
    **FRAMES,
)
def report_filters(t):
    d = t.domain
    frames = {
        "predictions": R.report_predictions(d.predictions, WEEK, "high", "Scan"),
        "alerts": R.report_alerts(d.alerts, WEEK, "high", "Scan"),
        "incidents": R.report_incidents(d.incidents, WEEK, "high", "Scan"),
    }
    counts = [df.agg(F.lit(n).alias("entity"), F.count(F.lit(1)).alias("rows")) for n, df in frames.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "snapshot_top",
    f"""SELECT id, predicted_threat, risk_level, round(anomaly_score, 4) AS anomaly_score, round(classification_confidence, 4) AS classification_confidence,
      source_ip, destination_ip, {iso('timestamp')} AS timestamp FROM p ORDER BY p.timestamp DESC, id DESC LIMIT 5000""",
    PAI,
    **FRAMES,
)
def snapshot_top(t):
    return texts(R.prediction_snapshot(week(t)[0], 5000), "timestamp")


@query(
    "report_alert_items",
    f"""SELECT id, {iso('timestamp')} AS timestamp, prediction_id, severity, status, alert_type, threat_label, round(confidence, 4) AS confidence, source_ip, destination_ip,
      {iso('acknowledged_at')} AS acknowledged_at, {iso('resolved_at')} AS resolved_at FROM a ORDER BY a.timestamp DESC, id DESC LIMIT 500""",
    PAI,
    **FRAMES,
)
def report_alert_items(t):
    return texts(R.alert_snapshot(week(t)[1]), "timestamp", "acknowledged_at", "resolved_at")


LINKS = """(SELECT count(*) FROM incident_alerts l WHERE l.incident_id = i.id) AS {}, (SELECT count(*) FROM incident_predictions l WHERE l.incident_id = i.id) AS {}"""


@query(
    "report_incident_items",
    f"""SELECT id, incident_key, title, severity, status, category, source_ip, assigned_to, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at,
      {iso('resolved_at')} AS resolved_at, resolution_summary, {LINKS.format('alerts_count', 'predictions_count')} FROM i ORDER BY i.created_at DESC, id DESC LIMIT 500""",
    PAI + " incident_alerts incident_predictions",
    **FRAMES,
)
def report_incident_items(t):
    d = t.domain
    rows = R.incident_report_items(week(t)[2], d.incident_alerts, d.incident_predictions)
    return texts(rows, "created_at", "updated_at", "resolved_at")


def py_iso(c: str) -> str:
    return f"coalesce(regexp_replace({iso(c)}, '\\.000000$', ''), '')"


@query(
    "predictions_csv",
    f"""SELECT id AS Prediction_ID, {py_iso('timestamp')} AS Timestamp_UTC, coalesce(source_ip, '') AS Source_IP, destination_ip AS Destination_IP,
      CAST(destination_port AS VARCHAR) AS Destination_Port, protocol AS Protocol, predicted_threat AS Predicted_Threat, CASE WHEN intrusion_flag THEN 'True' ELSE 'False' END AS Intrusion_Flag,
      round(anomaly_score, 4) AS Anomaly_Score, round(classification_confidence, 4) AS Classification_Confidence, risk_level AS Risk_Level, recommended_action AS Recommended_Action
    FROM p""",
    PAI,
    **FRAMES,
)
def predictions_csv(t):
    return R.predictions_export(week(t)[0], None)


@query(
    "alerts_csv",
    f"""SELECT id AS Alert_ID, CASE WHEN prediction_id = 0 THEN '' ELSE CAST(prediction_id AS VARCHAR) END AS Prediction_ID, {py_iso('timestamp')} AS Timestamp_UTC, severity AS Severity, status AS Status,
      alert_type AS Alert_Type, threat_label AS Threat_Label, round(confidence, 4) AS Confidence, coalesce(source_ip, '') AS Source_IP, destination_ip AS Destination_IP,
      {py_iso('acknowledged_at')} AS Acknowledged_At, {py_iso('resolved_at')} AS Resolved_At FROM a""",
    PAI,
    **FRAMES,
)
def alerts_csv(t):
    return R.alerts_export(week(t)[1], None)


@query(
    "incidents_csv",
    f"""SELECT id AS Incident_ID, incident_key AS Incident_Key, title AS Title, severity AS Severity, status AS Status, category AS Category, source_ip AS Source_IP,
      coalesce(assigned_to, '') AS Assigned_To, created_by AS Created_By, {py_iso('created_at')} AS Created_At_UTC, {py_iso('acknowledged_at')} AS Acknowledged_At,
      {py_iso('investigation_started_at')} AS Investigation_Started_At, {py_iso('resolved_at')} AS Resolved_At, coalesce(resolution_summary, '') AS Resolution_Summary,
      {LINKS.format('Linked_Alerts_Count', 'Linked_Predictions_Count')} FROM i""",
    PAI + " incident_alerts incident_predictions",
    **FRAMES,
)
def incidents_csv(t):
    return R.incidents_export(week(t)[2], t.domain.incident_alerts, t.domain.incident_predictions, None)


@query(
    "audit_csv",
    f"""SELECT id AS Audit_ID, {py_iso('timestamp')} AS Timestamp_UTC, username AS Username, user_role AS User_Role, action AS Action, resource_type AS Resource_Type, resource_id AS Resource_ID,
      outcome AS Outcome, ip_address AS IP_Address, request_method AS Request_Method, request_path AS Request_Path, CAST(status_code AS VARCHAR) AS Status_Code
    FROM audit_logs WHERE {AT}""",
    "audit_logs",
)
def audit_csv(t):
    return R.audit_export(t.domain.audit_logs.filter(WEEK.contains("timestamp")), None)


# Engines write the same small number in different ways (5.0E-4, 0.0005), so items are compared without their scores and these as numbers.
SCORES = ("anomaly_score", "raw_decision_score")


def scores_apart(items):
    texts = items.select("*", *[F.get_json_object("item", f"$.{c}").cast("double").alias(c) for c in SCORES])
    return texts.withColumn("item", F.regexp_replace("item", f'"({"|".join(SCORES)})":[^,]*,', ""))


def items_apart(item):
    numbers = ", ".join(f"CAST(json_extract_string({item}, '$.{c}') AS DOUBLE) AS {c}" for c in SCORES)
    return f"""regexp_replace({item}, '"({"|".join(SCORES)})":[^,]*,', '', 'g') AS item, {numbers}"""


ALL_COLUMNS = {
    "alerts": """id prediction_id timestamp alert_type severity threat_label anomaly_score confidence source_ip destination_ip status recommended_action
        created_at acknowledged_at resolved_at""".split(),
    "incidents": """id incident_key title description severity status category source_ip assigned_to created_by created_at updated_at acknowledged_at
        investigation_started_at resolved_at resolution_summary""".split(),
    "predictions": """id timestamp source_ip destination_ip source_port destination_port protocol flow_duration total_forward_packets total_backward_packets
        total_bytes anomaly_label anomaly_score raw_decision_score predicted_threat intrusion_flag classification_confidence risk_level recommended_action
        model_version created_at""".split(),
}


def items_sql(dataset: str) -> str:
    stamps = ("timestamp", "created_at", "updated_at", "acknowledged_at", "investigation_started_at", "resolved_at")
    pairs = ", ".join(f"'{c}': {iso(c) if c in stamps else c}" for c in ALL_COLUMNS[dataset])
    return f"SELECT '{dataset}' AS dataset, id, CAST(to_json({{{pairs}}}) AS VARCHAR) AS item FROM {dataset[0]}"


@query("dataset_json_export", f"SELECT dataset, id, {items_apart('item')} FROM (" + " UNION ALL ".join(items_sql(d) for d in ALL_COLUMNS) + ")", PAI, **FRAMES)
def dataset_json_export(t):
    """All rows and all fields of the three datasets; the raw record of a flow stays in its table."""
    parts = [R.json_export(name, df.select(*ALL_COLUMNS[name])) for name, df in zip(("predictions", "alerts", "incidents"), week(t))]
    return scores_apart(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# --- evidence ------------------------------------------------------------------------

ALL_CASE = "predictions alerts incidents incident_alerts incident_predictions incident_notes audit_logs"


def item_sql(**fields: str) -> str:
    pairs = ", ".join(f"'{k}': {v}" for k, v in sorted(fields.items()))
    return f"CAST(to_json({{{pairs}}}) AS VARCHAR)"


def life(kind: str, at: str, actor: str, summary: str) -> str:
    body = item_sql(event_type=f"'{kind}'", timestamp=iso(at), actor=actor, summary=summary)
    return f"SELECT id, 'timeline', {body} FROM incidents WHERE {at} IS NOT NULL"


ITEMS = f"""SELECT * FROM (
    SELECT incident_id, 'alerts' AS part, {item_sql(alert_id='alert_id', timestamp=iso('timestamp'), severity='severity', threat_label='threat_label', confidence=fixed('confidence', 4),
        source_ip='source_ip', destination_ip='destination_ip', status='status', recommended_action='recommended_action')} AS item FROM incident_alerts JOIN alerts ON alerts.id = alert_id
    UNION ALL SELECT incident_id, 'predictions', {item_sql(prediction_id='prediction_id', timestamp=iso('timestamp'), anomaly_label='anomaly_label', anomaly_score=fixed('anomaly_score', 4),
        predicted_threat='predicted_threat', classification_confidence=fixed('classification_confidence', 4), risk_level='risk_level', source_ip='source_ip', destination_ip='destination_ip',
        destination_port='destination_port', protocol='protocol')} FROM incident_predictions JOIN predictions ON predictions.id = prediction_id
    UNION ALL SELECT incident_id, 'notes', {item_sql(note_id='id', author='author', note='note', created_at=iso('created_at'))} FROM incident_notes
    UNION ALL SELECT CAST(resource_id AS BIGINT), 'audit_events', {item_sql(audit_id='id', timestamp=iso('timestamp'), username='username', user_role='user_role', action='action', outcome='outcome',
        ip_address='ip_address', request_method='request_method', request_path='request_path')} FROM audit_logs WHERE resource_type = 'INCIDENT')
    WHERE incident_id IN (SELECT id FROM incidents)
    UNION ALL {life('INCIDENT_CREATED', 'created_at', 'created_by', "'Incident ' || incident_key || ' created with initial status OPEN.'")}
    UNION ALL {life('INCIDENT_ACKNOWLEDGED', 'acknowledged_at', 'coalesce(assigned_to, created_by)', "'Incident acknowledged by security operator.'")}
    UNION ALL {life('INVESTIGATION_STARTED', 'investigation_started_at', "coalesce(assigned_to, 'SOC Operator')", "'Deep forensic investigation commenced.'")}
    UNION ALL {life('INCIDENT_RESOLVED', 'resolved_at', "coalesce(assigned_to, 'SOC Operator')", "'Incident resolved. Remediation: ' || coalesce(resolution_summary, 'Completed.')")}"""
SUMS = ", ".join(f"CAST(sum({p}_count) AS BIGINT) AS {p}_count" for p in E.PARTS)
HASHES = f"""SELECT incident_id, sha256(string_agg(digest, ',' ORDER BY digest)) AS evidence_hash, {SUMS} FROM (
      SELECT incident_id, left(digest, 3) AS branch, sha256(string_agg(digest, ',' ORDER BY digest)) AS digest, {", ".join(f"count(*) FILTER (WHERE part = '{p}') AS {p}_count" for p in E.PARTS)}
      FROM (SELECT incident_id, part, sha256(part || '|' || item) AS digest FROM (
        SELECT * FROM items UNION ALL SELECT id, 'incident', concat_ws('|', id, incident_key, title, severity, status, {iso('created_at')}) FROM incidents))
      GROUP BY 1, 2) GROUP BY 1"""


def package(t, **options):
    d = t.domain
    items = E.evidence_items(
        d.incidents, d.alerts, d.predictions, d.incident_notes, d.incident_alerts, d.incident_predictions, d.audit_logs, **options
    )
    return d.incidents, items


def sizes(t):
    d = t.domain
    return E.case_sizes(d.incident_notes, d.incident_alerts, d.incident_predictions, d.audit_logs)


@query("evidence_items", "SELECT * FROM items", ALL_CASE, items=ITEMS)
def evidence_items(t):
    return package(t)[1]


@query(
    "incident_evidence",
    "SELECT h.*, incident_key, title, severity, status, 'auditor' AS exported_by, 'incident_overview, alerts, predictions, notes, timeline, audit_events' AS artifacts FROM h JOIN incidents i ON i.id = h.incident_id",
    ALL_CASE,
    items=ITEMS,
    h=HASHES,
)
def incident_evidence(t):
    return E.evidence_manifest(*package(t, unknown=True), "auditor", sizes(t))


@query(
    "evidence_verify",
    "SELECT h.incident_id, incident_key, sha256(CAST(h.incident_id AS VARCHAR)) AS evidence_hash, h.evidence_hash AS current_hash, false AS intact FROM h JOIN incidents i ON i.id = h.incident_id",
    ALL_CASE,
    items=ITEMS,
    h=HASHES,
)
def evidence_verify(t):
    incidents, items = package(t, unknown=True)
    # a forged manifest: no recorded hash may pass
    forged = incidents.select(
        F.col("id").alias("incident_id"), "incident_key", F.sha2(F.col("id").cast("string"), 256).alias("evidence_hash")
    )
    return E.evidence_verify(forged, incidents, items, sizes(t))


@query(
    "evidence_differences",
    """SELECT incident_id, part, sha256(part || '|' || item) AS digest, count(*) AS copies_before, 0 AS copies_now FROM items WHERE part = 'notes' AND incident_id % 7 = 0 GROUP BY ALL
    UNION ALL SELECT incident_id, part, sha256(part || '|' || item || ' '), 0, count(*) FROM items WHERE part = 'notes' AND incident_id % 7 = 0 GROUP BY ALL""",
    ALL_CASE,
    items=ITEMS,
)
def evidence_differences(t):
    """A stored tree finds the notes that were changed after it was built, and nothing else."""
    incidents, items = package(t)
    recorded = settle(HT.leaves(incidents, items), "leaves", "zstd")
    tree = settle(HT.nodes(recorded, HT.depths(recorded)), "tree", "zstd")
    touched = (F.col("part") == "notes") & (F.col("incident_id") % 7 == 0)
    return HT.differences(tree, recorded, incidents, items.withColumn("item", F.when(touched, F.concat("item", F.lit(" "))).otherwise(F.col("item"))))


@query("evidence_files", "SELECT part, count(*) AS rows FROM (SELECT part FROM items UNION ALL SELECT 'incident_overview' FROM incidents) GROUP BY 1", ALL_CASE, items=ITEMS)
def evidence_files(t):
    incidents, items = package(t, keyed=True)
    path = scratch_path(t.spark, "evidence")

    def manifest(stored):
        of_case = stored.groupBy("incident_id").agg(F.count(F.lit(1)).alias("rows"))
        return E.evidence_manifest(incidents, stored, "auditor", of_case)

    if E.ids_repeat(incidents):
        manifest = E.evidence_manifest(*package(t, unknown=True), "auditor", sizes(t))
    E.write_evidence(incidents, items, manifest, path)
    return t.spark.read.json(f"{path}/items").groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


# --- privacy ----------------------------------------------------------------------------


@query(
    "scrub_text",
    f"""SELECT doc_id, CASE WHEN lower(text) LIKE '%bearer %' OR lower(text) LIKE '%password%' OR lower(text) LIKE '%token%' THEN '{V.SCRUBBED_TEXT}' ELSE text END AS details FROM documents""",
)
def scrub_text(t):
    return t.documents.select("doc_id", privacy.scrub_text("text").alias("details"))


DETAILS = """CASE event_type WHEN 'click' THEN '{"user": ' || user_id || ', "PassWord": "p' || event_id || '", "nested": {"Token": {"a": [1, 2]}, "list": [{"jwt": "x", "n": ' || event_id || '}, null, true, 1.5]}}'
    WHEN 'view' THEN '{"user":' || user_id || ', "tokens":"kept"}' WHEN 'error' THEN 'Bearer ' || event_id WHEN 'signup' THEN 'plain text' ELSE props END"""


@query(
    "scrub_details",
    """SELECT event_id, CASE event_type WHEN 'click' THEN '{"user": ' || user_id || ', "PassWord": "[REDACTED]", "nested": {"Token": "[REDACTED]", "list": [{"jwt": "[REDACTED]", "n": ' || event_id || '}, null, true, 1.5]}}'
      WHEN 'view' THEN '{"user":' || user_id || ', "tokens":"kept"}' WHEN 'error' THEN '"""
    + V.SCRUBBED_TEXT
    + """' WHEN 'signup' THEN 'plain text' ELSE props END AS details FROM events""",
)
def scrub_details(t):
    return privacy.scrub_json(t.events.select("event_id", F.expr(DETAILS).alias("details")), "details")


@query(
    "leak_scan",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{n}' AS pattern, count(*) AS hits FROM documents WHERE regexp_matches({c}, '{p}')"
        for c in ("text", "source")
        for n, p in privacy.LEAK_PATTERNS.items()
    ),
)
def leak_scan(t):
    return privacy.leak_scan(t.documents, ["text", "source"])


# --- retention --------------------------------------------------------------------------


@query(
    "retention",
    f"""SELECT CASE WHEN timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY THEN 'keep' ELSE 'archive' END AS side, count(*) AS rows, {iso('min(timestamp)')} AS first FROM audit_logs GROUP BY 1""",
    "audit_logs",
)
def retention(t):
    keep, archive = T.retention_split(t.domain.audit_logs, "timestamp", AS_OF, 20)
    sides = [
        df.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"))
        for n, df in (("keep", keep), ("archive", archive))
    ]
    return texts(sides[0].unionByName(sides[1]), "first")


@query(
    "month_partition",
    "SELECT CAST(year(captured_at) AS INTEGER) AS year, CAST(month(captured_at) AS INTEGER) AS month, count(*) AS rows FROM traffic_records GROUP BY 1, 2",
    "traffic_records",
)
def month_partition(t):
    path = scratch_path(t.spark, "months")
    T.write_by_month(t.domain.traffic_records, "captured_at", path, "source_ip")
    return t.spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))
