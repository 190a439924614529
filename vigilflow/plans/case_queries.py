"""Registered queries: cases, links, lifecycles, enrichment, timelines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import iso as spark_iso
from vigilflow.operators import cases as C, lifecycle as L, scoring
from vigilflow.plans.hunting_queries import texts
from vigilflow.plans.registry import query
from vigilflow.plans.report_queries import items_apart, scores_apart
from vigilflow.plans.views_sql import REASONS_SQL, iso, text_list

ACTIVE = f"status IN ({text_list(V.ACTIVE_INCIDENT_STATUSES)})"
TAKEN = f"""SELECT alert_id, incident_id, incident_key, status FROM incident_alerts JOIN incidents ON incidents.id = incident_id WHERE {ACTIVE}"""


@query("active_incident_by_alert", "SELECT * FROM taken", "incidents incident_alerts", taken=TAKEN)
def active_incident_by_alert(t):
    return C.active_incident_by_alert(t.domain.incidents, t.domain.incident_alerts)


@query(
    "free_requests",
    "SELECT id AS alert_id, severity FROM alerts WHERE id NOT IN (SELECT alert_id FROM taken)",
    "alerts incidents incident_alerts",
    taken=TAKEN,
)
def free_requests(t):
    d = t.domain
    asked = d.alerts.select(F.col("id").alias("alert_id"), "severity")
    return C.free_requests(asked, d.incidents, d.incident_alerts)


@query(
    "incident_linked_counts",
    """SELECT id, incident_key, (SELECT count(*) FROM incident_alerts a WHERE a.incident_id = i.id) AS alerts_count,
      (SELECT count(*) FROM incident_predictions p WHERE p.incident_id = i.id) AS predictions_count,
      (SELECT count(*) FROM incident_notes n WHERE n.incident_id = i.id) AS notes_count FROM incidents i""",
    "incidents incident_alerts incident_predictions incident_notes",
)
def incident_linked_counts(t):
    d = t.domain
    counted = C.incident_linked_counts(d.incidents, d.incident_alerts, d.incident_predictions, d.incident_notes)
    return counted.select("id", "incident_key", "alerts_count", "predictions_count", "notes_count")


ALL_CASE = "predictions alerts incidents incident_alerts incident_predictions incident_notes"


@query(
    "incident_detail",
    f"""SELECT incident_id, part, item_id, {items_apart('item')} FROM (SELECT id AS incident_id, 'incident' AS part, id AS item_id, CAST(to_json({{'incident_key': incident_key, 'title': title, 'description': description, 'severity': severity,
        'status': status, 'category': category, 'source_ip': source_ip, 'assigned_to': assigned_to, 'created_by': created_by, 'created_at': {iso('created_at')},
        'updated_at': {iso('updated_at')}, 'acknowledged_at': {iso('acknowledged_at')}, 'investigation_started_at': {iso('investigation_started_at')},
        'resolved_at': {iso('resolved_at')}, 'resolution_summary': resolution_summary,
        'alerts_count': (SELECT count(*) FROM incident_alerts x WHERE x.incident_id = incidents.id),
        'predictions_count': (SELECT count(*) FROM incident_predictions x WHERE x.incident_id = incidents.id),
        'notes_count': (SELECT count(*) FROM incident_notes x WHERE x.incident_id = incidents.id)}}) AS VARCHAR) AS item FROM incidents
    UNION ALL SELECT incident_id, 'alert', alert_id, CAST(to_json({{'status': status, 'severity': severity, 'threat_label': threat_label, 'anomaly_score': anomaly_score, 'confidence': confidence, 'created_at': {iso('created_at')}}}) AS VARCHAR)
      FROM incident_alerts JOIN alerts ON alerts.id = alert_id WHERE incident_id IN (SELECT id FROM incidents)
    UNION ALL SELECT incident_id, 'prediction', prediction_id, CAST(to_json({{'predicted_threat': predicted_threat, 'risk_level': risk_level, 'anomaly_score': anomaly_score, 'classification_confidence': classification_confidence, 'timestamp': {iso('timestamp')}}}) AS VARCHAR)
      FROM incident_predictions JOIN predictions ON predictions.id = prediction_id WHERE incident_id IN (SELECT id FROM incidents)
    UNION ALL SELECT incident_id, 'note', id, CAST(to_json({{'incident_id': incident_id, 'author': author, 'note': note, 'created_at': {iso('created_at')}}}) AS VARCHAR)
      FROM incident_notes WHERE incident_id IN (SELECT id FROM incidents))""",
    ALL_CASE,
)
def incident_detail(t):
    d = t.domain
    parts = C.detail_parts(d.incidents, d.alerts, d.predictions, d.incident_notes, d.incident_alerts, d.incident_predictions)
    return scores_apart(parts)


@query(
    "alert_prediction",
    """SELECT a.id, prediction_id, severity, a.status, p.anomaly_label, p.destination_port, p.protocol, p.total_bytes
    FROM alerts a LEFT JOIN predictions p ON p.id = prediction_id""",
    "predictions alerts",
)
def alert_prediction(t):
    joined = C.alert_with_prediction(t.domain.alerts, t.domain.predictions)
    return joined.select("id", "prediction_id", "severity", "status", "anomaly_label", "destination_port", "protocol", "total_bytes")


@query(
    "audit_for_resource",
    "SELECT i.id AS entity_id, a.id, a.action, a.outcome FROM audit_logs a JOIN incidents i ON a.resource_id = CAST(i.id AS VARCHAR) AND resource_type = 'INCIDENT'",
    "audit_logs incidents",
)
def audit_for_resource(t):
    rows = C.audit_for_resource(t.domain.audit_logs, t.domain.incidents, "INCIDENT")
    return rows.select("entity_id", "id", "action", "outcome")


@query(
    "audit_for_any_resource",
    "SELECT i.id AS entity_id, a.id, a.action, a.outcome FROM audit_logs a JOIN predictions i ON a.resource_id = CAST(i.id AS VARCHAR)",
    "audit_logs predictions",
)
def audit_for_any_resource(t):
    rows = C.audit_for_resource(t.domain.audit_logs, t.domain.predictions, None)
    return rows.select("entity_id", "id", "action", "outcome")


@query(
    "asset_context",
    """SELECT p.id, p.destination_ip, hostname, environment, criticality_level FROM predictions p
    LEFT JOIN system_nodes n ON n.ip_address = p.destination_ip""",
    "predictions system_nodes",
)
def asset_context(t):
    joined = C.asset_context(t.domain.predictions, t.domain.system_nodes)
    return joined.select("id", "destination_ip", "hostname", "environment", "criticality_level")


@query(
    "orphan_check",
    "SELECT incident_id, alert_id FROM incident_alerts WHERE alert_id NOT IN (SELECT id FROM alerts)",
    "alerts incident_alerts",
)
def orphan_check(t):
    return C.orphans(t.domain.incident_alerts, "alert_id", t.domain.alerts).select("incident_id", "alert_id")


INTEL_COLUMNS = f"""{{}} IS NOT NULL AS found, 'LOCAL_DEMO_INTELLIGENCE' AS intel_source, coalesce(i.reputation, 'UNKNOWN') AS reputation,
      coalesce(i.confidence, 0.0::DOUBLE) AS intel_confidence, coalesce(i.categories, '') AS intel_categories,
      CASE WHEN {{}} IS NOT NULL THEN i.notes ELSE 'No reputation record found in local demonstration threat intelligence base.' END AS intel_notes,
      i.first_seen AS intel_first_seen, i.last_seen AS intel_last_seen"""


def flat(df):
    return df.withColumn("intel_categories", F.array_join("intel_categories", "|"))


@query(
    "intel_enrich",
    f"""SELECT p.id, p.source_ip, {INTEL_COLUMNS.format('i.indicator', 'i.indicator')}
    FROM (SELECT id, CASE id % 5 WHEN 0 THEN '2001:0DB8:0:0:0:0:0:' || upper(to_hex(id % 50 + 1)) WHEN 1 THEN source_ip || '.9' ELSE ' ' || source_ip END AS source_ip,
      CASE id % 5 WHEN 0 THEN '2001:db8::' || lower(to_hex(id % 50 + 1)) WHEN 1 THEN NULL ELSE source_ip END AS address FROM predictions) p LEFT JOIN i ON address = i.indicator""",
    "predictions threat_intel",
    i="SELECT * FROM threat_intel UNION ALL SELECT * REPLACE ('2001:db8::' || lower(to_hex(CAST(split_part(notes, '#', 2) AS BIGINT))) AS indicator) FROM threat_intel",
)
def intel_enrich(t):
    """Addresses with blanks, in long form, and what is no address; entries in upper case and short form."""
    address = (
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(F.col("id") % 50 + 1)))
        .when(F.col("id") % 5 == 1, F.concat("source_ip", F.lit(".9"))).otherwise(F.concat(F.lit(" "), "source_ip"))
    )
    known = t.domain.threat_intel
    short = known.withColumn("indicator", F.concat(F.lit("2001:DB8::"), F.hex(F.split("notes", "#")[1].cast("long"))))
    rows = t.domain.predictions.select("id", address.alias("source_ip"))
    return flat(C.intel_enrich(rows, "source_ip", known.unionByName(short)))


HOST = r"regexp_extract(url, '^https?://([^/:?#]+)', 1)"


def host():
    return F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)


@query(
    "intel_domain",
    f"""SELECT page_id, domain, {INTEL_COLUMNS.format('i.indicator', 'i.indicator')}
    FROM (SELECT page_id, ' ' || upper({HOST}) AS domain FROM pages) p LEFT JOIN i ON lower(trim(p.domain)) = i.indicator""",
    i=f"""SELECT {HOST} AS indicator, CASE WHEN min(page_id) % 2 = 0 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS reputation,
      0.5::DOUBLE AS confidence, 'domain' AS categories, 'Seen on pages' AS notes, NULL::VARCHAR AS first_seen, NULL::VARCHAR AS last_seen FROM pages WHERE {HOST} LIKE 'm.%' GROUP BY 1""",
)
def intel_domain(t):
    listed = (
        t.pages.filter(host().like("m.%"))
        .groupBy(host().alias("indicator"))
        .agg(F.when(F.min("page_id") % 2 == 0, "MALICIOUS").otherwise("SUSPICIOUS").alias("reputation"))
        .select("indicator", "reputation", F.lit(0.5).alias("confidence"), F.array(F.lit("domain")).alias("categories"), F.lit("Seen on pages").alias("notes"))
    )
    asked = t.pages.select("page_id", F.concat(F.lit(" "), F.upper(host())).alias("domain"))
    return flat(C.intel_enrich(asked, "domain", listed, normalise=True))


@query(
    "intel_hash",
    f"""SELECT doc_id, file_hash, {INTEL_COLUMNS.format('i.indicator', 'i.indicator')}
    FROM (SELECT doc_id, upper(sha256(text)) AS file_hash FROM documents) d LEFT JOIN i ON lower(trim(d.file_hash)) = i.indicator""",
    i="""SELECT sha256(text) AS indicator, 'MALICIOUS' AS reputation, 0.9::DOUBLE AS confidence, 'payload' AS categories, 'Listed ' || min(d.doc_id) AS notes, NULL::VARCHAR AS first_seen, NULL::VARCHAR AS last_seen
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1 GROUP BY 1""",
)
def intel_hash(t):
    listed = (
        t.documents.join(t.labels.filter("toxic = 1"), "doc_id")
        .groupBy(F.sha2("text", 256).alias("indicator"))
        .agg(F.concat(F.lit("Listed "), F.min("doc_id")).alias("notes"))
        .select("indicator", F.lit("MALICIOUS").alias("reputation"), F.lit(0.9).alias("confidence"), F.array(F.lit("payload")).alias("categories"), "notes")
    )
    asked = t.documents.select("doc_id", F.upper(F.sha2("text", 256)).alias("file_hash"))
    return flat(C.intel_enrich(asked, "file_hash", listed, normalise=True))


@query(
    "prediction_investigation",
    f"""SELECT p.id, {iso('p.timestamp')} AS timestamp, p.predicted_threat, p.risk_level, p.anomaly_score, p.classification_confidence, p.intrusion_flag, p.source_ip,
      p.destination_ip, p.source_port, p.destination_port, p.protocol, p.flow_duration, p.total_forward_packets, p.total_backward_packets, p.total_bytes,
      CASE WHEN json_type(p.raw_flow_data) = 'OBJECT' THEN p.raw_flow_data END AS raw_features, r.reasons AS risk_reasons,
      a.id AS alert_id, a.status AS alert_status, a.severity AS alert_severity, a.alert_type, a.threat_label AS alert_threat_label, a.anomaly_score AS alert_anomaly_score,
      a.confidence AS alert_confidence, a.recommended_action AS alert_recommended_action, {iso('a.created_at')} AS alert_created_at,
      {iso('a.acknowledged_at')} AS alert_acknowledged_at, {iso('a.resolved_at')} AS alert_resolved_at, coalesce(t.related_audit, '') AS related_audit, {INTEL_COLUMNS.format('i.indicator', 'i.indicator')}
    FROM predictions p
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY id) AS rn FROM alerts) WHERE rn = 1) a ON a.prediction_id = p.id
    LEFT JOIN (SELECT resource_id, string_agg(id || ':' || action || ':' || outcome || ':' || username || ':' || {iso('timestamp')}, ';' ORDER BY rn) AS related_audit FROM (
        SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY timestamp DESC, id DESC) AS rn FROM audit_logs WHERE resource_type = 'PREDICTION')
      WHERE rn <= 10 GROUP BY 1) t ON t.resource_id = CAST(p.id AS VARCHAR)
    JOIN r ON r.id = p.id
    LEFT JOIN threat_intel i ON trim(p.source_ip) = i.indicator""",
    "predictions alerts audit_logs threat_intel",
    r=REASONS_SQL,
)
def prediction_investigation(t):
    d = t.domain
    rows = C.prediction_investigation(d.predictions, d.alerts, d.audit_logs, d.threat_intel)
    line = lambda r: F.concat_ws(":", r["id"], r["action"], r["outcome"], r["username"], spark_iso(r["timestamp"]))
    stamps = ["timestamp", "alert_created_at", "alert_acknowledged_at", "alert_resolved_at"]
    rows = rows.withColumn("related_audit", F.array_join(F.transform("related_audit", line), ";"))
    return flat(texts(rows.withColumn("risk_reasons", F.array_join("risk_reasons", " | ")), *stamps))


# --- requests drawn from the event stream ------------------------------------------

K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def number_k():
    return F.get_json_object("props", "$.k").cast("int")


def chosen(column, mapping, other):
    value = other
    for key, name in mapping.items():
        value = F.when(F.col(column) == key, F.lit(name)).otherwise(value)
    return value


CREATE_SQL = f"""SELECT event_id AS request_id, CASE WHEN event_id % 3 <> 0 THEN event_id // 2 END AS alert_id,
    CASE WHEN event_id % 5 = 0 THEN user_id * 100 END AS prediction_id,
    CASE WHEN event_id % 7 = 0 THEN 'low' WHEN event_id % 11 = 0 THEN 'SEVERE' END AS severity,
    CASE WHEN event_id % 13 = 0 THEN 'Custom' END AS category, ' Case ' || event_type || ' ' AS title,
    CASE WHEN event_id % 2 = 0 THEN ' Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') WHEN event_id % 17 = 0 THEN 'nobody' END AS assigned_to,
    ts AS created_at FROM events"""


def create_requests(t):
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN event_id div 2 END").alias("alert_id"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN user_id * 100 END").alias("prediction_id"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'low' WHEN event_id % 11 = 0 THEN 'SEVERE' END").alias("severity"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN 'Custom' END").alias("category"),
        F.concat(F.lit(" Case "), "event_type", F.lit(" ")).alias("title"),
        F.when(F.expr("event_id % 2 = 0"), F.format_string(" Customer#%09d", "user_id")).when(F.expr("event_id % 17 = 0"), "nobody").alias("assigned_to"),
        F.col("ts").alias("created_at"),
    )


ASSIGNEE = """CASE WHEN assigned_to IS NULL THEN NULL WHEN u.username IS NULL THEN 'unknown operator'
      WHEN NOT u.is_active THEN 'inactive operator' WHEN u.role = 'VIEWER' THEN 'viewer role' END"""


@query(
    "eligible_assignee",
    f"SELECT request_id, {ASSIGNEE} AS assignee_problem FROM r LEFT JOIN users u ON u.username = trim(assigned_to)",
    "users",
    r=CREATE_SQL,
)
def eligible_assignee(t):
    return C.check_assignee(create_requests(t), t.domain.users).select("request_id", "assignee_problem")


INHERIT = """SELECT r.*, a.id IS NOT NULL AS alert_found, p.id IS NOT NULL AS prediction_found, a.prediction_id AS alert_prediction_id,
      upper(CASE WHEN r.severity IS NOT NULL THEN r.severity WHEN a.id IS NOT NULL THEN a.severity WHEN p.id IS NOT NULL THEN p.risk_level ELSE 'HIGH' END) AS final_severity,
      CASE WHEN r.category IS NOT NULL THEN r.category WHEN a.id IS NOT NULL THEN a.threat_label WHEN p.id IS NOT NULL THEN p.predicted_threat ELSE 'Suspicious Network Activity' END AS final_category,
      coalesce(nullif(a.source_ip, ''), nullif(p.source_ip, '')) AS final_source
    FROM r LEFT JOIN alerts a ON a.id = r.alert_id LEFT JOIN predictions p ON p.id = r.prediction_id"""


@query(
    "incident_inherit",
    "SELECT request_id, alert_found, prediction_found, alert_prediction_id, final_severity, final_category, final_source FROM h",
    "predictions alerts",
    r=CREATE_SQL,
    h=INHERIT,
)
def incident_inherit(t):
    filled = C.inherit(create_requests(t), t.domain.alerts, t.domain.predictions)
    return filled.select(
        "request_id", "alert_found", "prediction_found", "alert_prediction_id", "final_severity", "final_category", "final_source"
    )


JUDGED = f"""SELECT *, coalesce(early, CASE WHEN (created_at, request_id) > (first_at, first_id) THEN 'active incident exists' END, late) AS reason FROM (
      SELECT *, min(CASE WHEN early IS NULL AND late IS NULL AND alert_id IS NOT NULL THEN created_at END) OVER (PARTITION BY alert_id) AS first_at,
        arg_min(CASE WHEN early IS NULL AND late IS NULL AND alert_id IS NOT NULL THEN request_id END,
          CASE WHEN early IS NULL AND late IS NULL AND alert_id IS NOT NULL THEN created_at END) OVER (PARTITION BY alert_id) AS first_id
      FROM (SELECT h.*, CASE WHEN alert_id IS NOT NULL AND NOT alert_found THEN 'alert not found'
            WHEN alert_id IN (SELECT alert_id FROM taken) THEN 'active incident exists' END AS early,
          CASE WHEN prediction_id IS NOT NULL AND NOT prediction_found THEN 'prediction not found'
            WHEN final_severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN 'invalid severity' ELSE {ASSIGNEE} END AS late
        FROM h LEFT JOIN users u ON u.username = trim(assigned_to)))"""
ALL_CREATE = "predictions alerts incidents incident_alerts users"


def created(t):
    d = t.domain
    return C.create_incidents(create_requests(t), d.incidents, d.incident_alerts, d.alerts, d.predictions, d.users)


@query(
    "incident_create",
    f"""SELECT request_id, 'INC-2024-' || lpad(CAST((SELECT max(CAST(right(incident_key, -9) AS BIGINT)) FROM incidents)
        + row_number() OVER (ORDER BY created_at, request_id) AS VARCHAR), 6, '0') AS incident_key, trim(title) AS title, final_severity AS severity, 'OPEN' AS status,
      final_category AS category, final_source AS source_ip, trim(assigned_to) AS assigned_to, alert_id, prediction_id, alert_prediction_id, {iso('created_at')} AS created_at
    FROM j WHERE reason IS NULL""",
    ALL_CREATE,
    r=CREATE_SQL,
    h=INHERIT,
    taken=TAKEN,
    j=JUDGED,
)
def incident_create(t):
    return texts(created(t)[0], "created_at")


@query(
    "incident_create_refused",
    "SELECT request_id, alert_id, reason FROM j WHERE reason IS NOT NULL",
    ALL_CREATE,
    r=CREATE_SQL,
    h=INHERIT,
    taken=TAKEN,
    j=JUDGED,
)
def incident_create_refused(t):
    return created(t)[1]


@query(
    "incident_prediction_links",
    """SELECT DISTINCT request_id, pid AS prediction_id FROM (SELECT request_id, prediction_id AS pid FROM j WHERE reason IS NULL
      UNION ALL SELECT request_id, alert_prediction_id FROM j WHERE reason IS NULL) WHERE pid IS NOT NULL""",
    ALL_CREATE,
    r=CREATE_SQL,
    h=INHERIT,
    taken=TAKEN,
    j=JUDGED,
)
def incident_prediction_links(t):
    accepted = created(t)[0]
    links = C.prediction_links(accepted)
    return links.join(accepted.select("incident_key", "request_id"), "incident_key").select("request_id", "prediction_id")


@query(
    "incident_keys",
    """SELECT event_id, 'INC-2024-' || lpad(CAST((SELECT max(CAST(right(incident_key, -9) AS BIGINT)) FROM incidents)
      + row_number() OVER (ORDER BY ts, event_id) AS VARCHAR), 6, '0') AS incident_key FROM events""",
    "incidents",
)
def incident_keys(t):
    rows = t.events.select("event_id", "ts")
    return C.number_cases(rows, t.domain.incidents, ["ts", "event_id"], "ts").select("event_id", "incident_key")


@query(
    "incident_assign",
    f"""SELECT incident_id, incident_key, trim(assigned_to) AS assigned_to, reason IS NULL AS accepted, reason FROM (
      SELECT o_orderkey * 2 AS incident_id, i.incident_key, a.assigned_to,
        CASE WHEN i.id IS NULL THEN 'incident not found' ELSE {ASSIGNEE} END AS reason
      FROM (SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS assigned_to FROM orders) a
      LEFT JOIN incidents i ON i.id = o_orderkey * 2 LEFT JOIN users u ON u.username = assigned_to)""".replace("assigned_to IS NULL", "a.assigned_to IS NULL").replace("u.username = assigned_to", "u.username = a.assigned_to"),
    "incidents users",
)
def incident_assign(t):
    asked = t.orders.select(
        (F.col("o_orderkey") * 2).alias("incident_id"), F.format_string("Customer#%09d", F.col("o_custkey") * 2).alias("assigned_to")
    )
    return C.assign_incidents(t.domain.incidents, asked, t.domain.users)


@query(
    "assignment_push",
    f"""SELECT id, {iso('created_at')} AS timestamp, incident_key, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS assigned_to, 'lead' AS assigned_by
    FROM incidents i JOIN orders ON o_orderkey = i.id JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND c_mktsegment <> 'HOUSEHOLD'""",
    "incidents",
)
def assignment_push(t):
    """Push envelopes of accepted assignments, dated at the opening of the case."""
    asked = t.orders.select(F.col("o_orderkey").alias("incident_id"), F.format_string("Customer#%09d", "o_custkey").alias("assigned_to"))
    opened = t.domain.incidents.select(F.col("id").alias("incident_id"), "created_at")
    done = C.assign_incidents(t.domain.incidents, asked, t.domain.users).join(opened, "incident_id")
    sent = scoring.assignment_events(done, "lead", F.col("created_at"))
    data = F.from_json("data", "id long, incident_key string, assigned_to string, assigned_by string")
    return texts(sent.select("timestamp", data.alias("d")).select("timestamp", "d.*"), "timestamp")


@query(
    "note_append",
    r"""SELECT incident_id, author, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS note,
      CASE WHEN id IS NULL THEN 'incident not found' WHEN regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') = '' THEN 'empty note' END AS reason
    FROM (SELECT conv_id * 200 AS incident_id, role AS author, CASE WHEN turn = 3 THEN '  ' ELSE ' ' || text || ' ' END AS raw FROM conversations)
    LEFT JOIN incidents i ON i.id = incident_id""",
    "incidents",
)
def note_append(t):
    asked = t.conversations.select(
        (F.col("conv_id") * 200).alias("incident_id"), F.col("role").alias("author"),
        F.when(F.col("turn") == 3, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("note"),
    )
    return C.append_notes(t.domain.incidents, asked).select("incident_id", "author", "note", "reason")


# --- lifecycle ------------------------------------------------------------------------

ALERT_TARGETS = {"click": "ACKNOWLEDGED", "purchase": "RESOLVED", "error": "new", "view": " acknowledged", "signup": "resolved "}
ALERT_REQUESTS = f"""SELECT event_id AS request_id, (user_id * 7 + {K}) % 2000 AS alert_id, ts AS requested_at,
    upper(trim(CASE event_type WHEN 'click' THEN 'ACKNOWLEDGED' WHEN 'purchase' THEN 'RESOLVED' WHEN 'error' THEN 'new' WHEN 'view' THEN ' acknowledged' ELSE 'resolved ' END)) AS target
  FROM events"""


def alert_requests(t):
    return t.events.select(
        F.col("event_id").alias("request_id"), ((F.col("user_id") * 7 + number_k()) % 2000).alias("alert_id"),
        F.col("ts").alias("requested_at"), chosen("event_type", ALERT_TARGETS, F.lit("")).alias("target"),
    )


def walk_sql(entity: str, initial: str, key: str, ok: str, reason: str) -> str:
    """Applies the requests of each entity one after the other."""

    def own(sql: str) -> str:
        return re.sub(r"\btarget\b", "s.target", sql.format(state="w.state"))

    return f"""SELECT s.*, row_number() OVER (PARTITION BY s.{key} ORDER BY requested_at, request_id) AS n, upper({initial}) AS initial
      FROM requests s LEFT JOIN {entity} e ON e.id = s.{key}), walk AS (
      SELECT request_id, {key}, target, requested_at, n, initial AS status_before, ({ok.format(state='initial')}) AS accepted,
        CASE WHEN {ok.format(state='initial')} THEN target ELSE initial END AS state, {reason.format(state='initial')} AS reason FROM steps WHERE n = 1
      UNION ALL
      SELECT s.request_id, s.{key}, s.target, s.requested_at, s.n, w.state, ({own(ok)}),
        CASE WHEN {own(ok)} THEN s.target ELSE w.state END, {own(reason)}
      FROM walk w JOIN steps s ON s.{key} = w.{key} AND s.n = w.n + 1"""


def recursive(views_sql: str) -> str:
    return views_sql.replace("WITH ", "WITH RECURSIVE ", 1)


ALERT_OK = "coalesce(({state} = 'NEW' AND target IN ('ACKNOWLEDGED', 'RESOLVED')) OR ({state} = 'ACKNOWLEDGED' AND target = 'RESOLVED'), false)"
ALERT_REASON = f"""CASE WHEN {ALERT_OK} THEN NULL WHEN {{state}} IS NULL THEN 'alert not found' WHEN {{state}} = target THEN 'already in this status'
  WHEN {{state}} = 'RESOLVED' THEN 'terminal status' ELSE 'invalid transition' END"""
ALERT_WALK = walk_sql("alerts", "e.status", "alert_id", ALERT_OK, ALERT_REASON)


def register_walk(name, select, views, key_ctes):
    def wrap(fn):
        from vigilflow.plans.registry import ORACLES

        query(name, select, views, **key_ctes)(fn)
        ORACLES[name] = recursive(ORACLES[name])
        return fn

    return wrap


@register_walk(
    "alert_transitions",
    f"SELECT request_id, alert_id, target, {iso('requested_at')} AS requested_at, status_before, accepted, reason FROM walk",
    "predictions alerts",
    {"requests": ALERT_REQUESTS, "steps": ALERT_WALK},
)
def alert_transitions(t):
    return texts(L.alert_transitions(alert_requests(t), t.domain.alerts), "requested_at")


@register_walk(
    "alert_state",
    f"""SELECT a.id, coalesce(w.last, a.status) AS status, {iso('coalesce(w.ack, a.acknowledged_at)')} AS acknowledged_at, {iso('coalesce(w.res, a.resolved_at)')} AS resolved_at
    FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(target, n) AS last, max(requested_at) FILTER (WHERE target = 'ACKNOWLEDGED') AS ack,
      max(requested_at) FILTER (WHERE target = 'RESOLVED') AS res FROM walk WHERE accepted GROUP BY 1) w ON w.alert_id = a.id""",
    "predictions alerts",
    {"requests": ALERT_REQUESTS, "steps": ALERT_WALK},
)
def alert_state(t):
    judged = L.alert_transitions(alert_requests(t), t.domain.alerts)
    return texts(L.alert_state(t.domain.alerts, judged), "acknowledged_at", "resolved_at")


CASE_REQUESTS = f"""SELECT event_id AS request_id, user_id * 5 + {K} % 5 AS incident_id, ts AS requested_at,
    CASE event_type WHEN 'click' THEN 'ACKNOWLEDGED' WHEN 'view' THEN 'INVESTIGATING' WHEN 'purchase' THEN 'CONTAINED' WHEN 'error' THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS target,
    CASE {K} % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ok  ' ELSE 'Patched hosts' END AS resolution_summary FROM events"""


def case_requests(t):
    targets = {"click": "ACKNOWLEDGED", "view": "investigating", "purchase": "CONTAINED ", "error": "RESOLVED"}
    k = number_k()
    return t.events.select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 5 + k % 5).alias("incident_id"), F.col("ts").alias("requested_at"),
        chosen("event_type", targets, F.lit("ACKNOWLEDGED")).alias("target"),
        F.when(k % 3 == 1, " ok  ").when(k % 3 == 2, "Patched hosts").alias("resolution_summary"),
    )


CASE_ALLOWED = " OR ".join(
    f"({{state}} = '{a}' AND target IN ({text_list(b)}))" for a, b in V.INCIDENT_TRANSITIONS.items() if b
)
CASE_OK = f"coalesce(({CASE_ALLOWED}) AND (target <> 'RESOLVED' OR length(trim(coalesce(resolution_summary, ''))) >= 5), false)"
CASE_REASON = f"""CASE WHEN {CASE_OK} THEN NULL WHEN {{state}} IS NULL THEN 'incident not found' WHEN {{state}} = target THEN 'already in this status'
  WHEN {{state}} = 'RESOLVED' THEN 'terminal status' WHEN NOT ({CASE_ALLOWED}) THEN 'invalid transition' ELSE 'resolution summary required' END"""


@register_walk(
    "incident_transitions",
    f"SELECT request_id, incident_id, target, {iso('requested_at')} AS requested_at, status_before, accepted, reason FROM walk",
    "incidents",
    {"requests": CASE_REQUESTS, "steps": walk_sql("incidents", "e.status", "incident_id", CASE_OK, CASE_REASON)},
)
def incident_transitions(t):
    return texts(L.incident_transitions(case_requests(t), t.domain.incidents), "requested_at")


# --- timelines and purge ------------------------------------------------------------------

CASE_TIMELINE = f"""SELECT id AS incident_id, 'INCIDENT_CREATED' AS event_type, created_at AS ts, created_by AS actor, 'Incident ' || incident_key || ' created with severity ' || severity || '.' AS summary FROM incidents
    UNION ALL SELECT id, 'INCIDENT_ACKNOWLEDGED', acknowledged_at, coalesce(assigned_to, 'SOC Analyst'), 'Incident acknowledged and triaged.' FROM incidents WHERE acknowledged_at IS NOT NULL
    UNION ALL SELECT id, 'INVESTIGATION_STARTED', investigation_started_at, coalesce(assigned_to, 'SOC Analyst'), 'Active forensic investigation initiated.' FROM incidents WHERE investigation_started_at IS NOT NULL
    UNION ALL SELECT id, 'INCIDENT_RESOLVED', resolved_at, coalesce(assigned_to, 'SOC Lead'), 'Incident resolved: ' || coalesce(resolution_summary, 'Remediated') FROM incidents WHERE resolved_at IS NOT NULL
    UNION ALL SELECT n.incident_id, 'INCIDENT_NOTE_ADDED', n.created_at, author, CASE WHEN length(note) > 80 THEN 'Analyst note added: ' || left(note, 80) || '...' ELSE 'Analyst note: ' || note END
      FROM incident_notes n JOIN incidents i ON i.id = n.incident_id
    UNION ALL SELECT l.incident_id, 'LINKED_ALERT', coalesce(a.created_at, i.created_at), 'DETECTION_ENGINE', 'Linked Alert #' || a.id || ' (' || threat_label || ', severity ' || a.severity || ').'
      FROM incident_alerts l JOIN alerts a ON a.id = l.alert_id JOIN incidents i ON i.id = l.incident_id
    UNION ALL SELECT l.incident_id, 'LINKED_PREDICTION', p.timestamp, 'DETECTION_ENGINE', 'Linked Prediction #' || p.id || ' (' || predicted_threat || ', risk ' || risk_level || ').'
      FROM incident_predictions l JOIN predictions p ON p.id = l.prediction_id JOIN incidents i ON i.id = l.incident_id
    UNION ALL SELECT i.id, a.action, a.timestamp, coalesce(a.username, 'SYSTEM'), 'Audit event: ' || a.action FROM audit_logs a JOIN incidents i ON a.resource_id = CAST(i.id AS VARCHAR)
      WHERE a.resource_type = 'INCIDENT' AND a.action IN ('INCIDENT_ASSIGNED', 'INCIDENT_STATUS_CHANGED')"""


def whole_timeline(t, incident_id=None):
    d = t.domain
    return texts(
        C.incident_timeline(
            d.incidents, d.alerts, d.predictions, d.incident_notes, d.incident_alerts, d.incident_predictions, d.audit_logs, incident_id
        ),
        "timestamp",
    )


@query(
    "incident_timeline",
    f"SELECT incident_id, event_type, {iso('ts')} AS timestamp, actor, summary FROM x",
    ALL_CASE + " audit_logs",
    x=CASE_TIMELINE,
)
def incident_timeline(t):
    return whole_timeline(t)


@query(
    "evidence_timeline",
    f"""SELECT id AS incident_id, 'INCIDENT_CREATED' AS event_type, {iso('created_at')} AS timestamp, created_by AS actor, 'Incident ' || incident_key || ' created with initial status OPEN.' AS summary FROM incidents
    UNION ALL SELECT id, 'INCIDENT_ACKNOWLEDGED', {iso('acknowledged_at')}, coalesce(assigned_to, created_by), 'Incident acknowledged by security operator.' FROM incidents WHERE acknowledged_at IS NOT NULL
    UNION ALL SELECT id, 'INVESTIGATION_STARTED', {iso('investigation_started_at')}, coalesce(assigned_to, 'SOC Operator'), 'Deep forensic investigation commenced.' FROM incidents WHERE investigation_started_at IS NOT NULL
    UNION ALL SELECT id, 'INCIDENT_RESOLVED', {iso('resolved_at')}, coalesce(assigned_to, 'SOC Operator'), 'Incident resolved. Remediation: ' || coalesce(resolution_summary, 'Completed.') FROM incidents WHERE resolved_at IS NOT NULL""",
    "incidents",
)
def evidence_timeline(t):
    return texts(C.evidence_timeline(t.domain.incidents), "timestamp")


@query(
    "purge_cascade",
    """SELECT 'alerts' AS kept_table, count(*) AS kept_rows FROM alerts WHERE prediction_id NOT IN (SELECT id FROM predictions WHERE timestamp < TIMESTAMP '2024-01-08 00:00:00')
    UNION ALL SELECT 'incident_predictions', count(*) FROM incident_predictions WHERE prediction_id NOT IN (SELECT id FROM predictions WHERE timestamp < TIMESTAMP '2024-01-08 00:00:00')""",
    "predictions alerts incident_predictions",
)
def purge_cascade(t):
    from vigilflow.functions.timerange import literal

    d = t.domain
    doomed = d.predictions.filter(F.col("timestamp") < literal("2024-01-08"))
    kept = C.purge_cascade(doomed, {"alerts": (d.alerts, "prediction_id"), "incident_predictions": (d.incident_predictions, "prediction_id")})
    counts = [df.agg(F.lit(n).alias("kept_table"), F.count(F.lit(1)).alias("kept_rows")) for n, df in kept.items()]
    return counts[0].unionByName(counts[1])
