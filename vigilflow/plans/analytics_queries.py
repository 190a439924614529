"""Registered queries: counters, distributions, timelines."""

from __future__ import annotations

from vigilflow import fixed_values as V
from vigilflow.operators import analytics as A
from vigilflow.plans.registry import query
from vigilflow.plans.views_sql import pct, rank, text_list
from vigilflow.sources.domain import AS_OF

P_A_L = "predictions alerts audit_logs"
COUNT = "CAST(count(*) FILTER (WHERE {}) AS BIGINT) AS {}"


def counters(*pairs) -> str:
    return ", ".join(COUNT.format(cond, name) for cond, name in pairs)


AUDIT = [("action = 'LOGIN_FAILURE'", "failed_logins"), ("action = 'ACCESS_DENIED'", "access_denied")]


@query(
    "overview_kpis",
    f"""SELECT * FROM (SELECT count(*) AS total_predictions, {counters(
        ("upper(predicted_threat) = 'BENIGN' OR NOT intrusion_flag", "benign_predictions"),
        ("upper(predicted_threat) <> 'BENIGN' AND intrusion_flag", "malicious_predictions"),
        (f"upper(anomaly_label) IN ({text_list(V.ANOMALY_LABELS)}) OR anomaly_score >= 0.5", "anomaly_predictions"))}
      FROM predictions),
    (SELECT count(*) AS total_alerts, {counters(
        ("status IN ('NEW', 'ACKNOWLEDGED')", "open_alerts"), ("severity = 'CRITICAL'", "critical_alerts"),
        ("severity = 'HIGH'", "high_alerts"), ("severity = 'MEDIUM'", "medium_alerts"),
        ("status = 'RESOLVED'", "resolved_alerts"))} FROM alerts),
    (SELECT {counters(*AUDIT, ("action = 'RATE_LIMIT_EXCEEDED'", "rate_limit_events"))} FROM audit_logs)""",
    P_A_L,
)
def overview_kpis(t):
    return A.overview_kpis(t.domain.predictions, t.domain.alerts, t.domain.audit_logs)


@query(
    "threat_distribution",
    f"""SELECT predicted_threat AS category, count(*) AS count, {pct("count(*)", "(SELECT count(*) FROM predictions)")} AS percentage
    FROM predictions GROUP BY 1""",
    "predictions",
)
def threat_distribution(t):
    return A.threat_distribution(t.domain.predictions)


@query(
    "share_of_total",
    f"""SELECT action, count(*) AS count, {pct("count(*)", "(SELECT count(*) FROM audit_logs)")} AS percentage
    FROM audit_logs GROUP BY 1""",
    "audit_logs",
)
def share_of_total(t):
    return A.counts_with_share(t.domain.audit_logs, "action", "action")


@query(
    "severity_distribution",
    f"""SELECT l.severity, count(p.id) AS count, {pct("count(p.id)", "(SELECT count(*) FROM predictions)")} AS percentage
    FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) l(severity)
    LEFT JOIN predictions p ON upper(p.risk_level) = l.severity GROUP BY 1""",
    "predictions",
)
def severity_distribution(t):
    return A.severity_distribution(t.domain.predictions)


SOURCES = f"""SELECT source_ip, CAST(count(*) AS BIGINT) AS prediction_count,
      CAST(count(*) FILTER (WHERE upper(predicted_threat) <> 'BENIGN') AS BIGINT) AS malicious_count,
      CASE max({rank("risk_level")}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS highest_severity
    FROM predictions WHERE source_ip IS NOT NULL AND source_ip <> '' GROUP BY source_ip"""
MODES = """SELECT source_ip, predicted_threat, row_number() OVER (PARTITION BY source_ip ORDER BY count(*) DESC, predicted_threat) AS rn
    FROM predictions WHERE upper(predicted_threat) <> 'BENIGN' AND source_ip <> '' GROUP BY 1, 2"""


@query(
    "top_threat_sources",
    """SELECT s.source_ip, prediction_count, malicious_count, highest_severity,
      coalesce(m.predicted_threat, 'Benign') AS most_common_threat, (SELECT count(*) FROM s) AS total_sources
    FROM s LEFT JOIN m ON m.source_ip = s.source_ip AND rn = 1 ORDER BY prediction_count DESC, s.source_ip LIMIT 10""",
    "predictions",
    s=SOURCES,
    m=MODES,
)
def top_threat_sources(t):
    return A.top_threat_sources(t.domain.predictions)


@query(
    "dominant_threat",
    """SELECT s.source_ip, coalesce(m.predicted_threat, 'Benign') AS most_common_threat
    FROM s LEFT JOIN m ON m.source_ip = s.source_ip AND rn = 1""",
    "predictions",
    s=SOURCES,
    m=MODES,
)
def dominant_threat(t):
    return A.dominant_threat(t.domain.predictions)


@query(
    "distinct_sources",
    "SELECT count(DISTINCT source_ip) AS total_sources FROM predictions WHERE source_ip <> ''",
    "predictions",
)
def distinct_sources(t):
    return A.distinct_sources(t.domain.predictions)


def timeline_sql(days: int, fmt: str) -> str:
    since = f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"
    body = counters(
        ("kind = 'prediction'", "predictions"),
        ("kind = 'alert'", "alerts"),
        ("kind = 'LOGIN_FAILURE'", "failed_logins"),
        ("kind = 'ACCESS_DENIED'", "access_denied"),
        ("kind = 'RATE_LIMIT_EXCEEDED'", "rate_limit_events"),
    )
    return f"""SELECT strftime(timestamp, '{fmt}') AS bucket_time, {body} FROM (
      SELECT timestamp, 'prediction' AS kind FROM predictions WHERE {since}
      UNION ALL SELECT timestamp, 'alert' FROM alerts WHERE {since}
      UNION ALL SELECT timestamp, action FROM audit_logs WHERE {since}) GROUP BY 1 ORDER BY 1 DESC LIMIT 50"""


@query("security_timeline", timeline_sql(7, "%Y-%m-%d"), P_A_L)
def security_timeline(t):
    return A.security_timeline(t.domain.predictions, t.domain.alerts, t.domain.audit_logs, AS_OF, "7d")


@query("security_timeline_24h", timeline_sql(1, "%Y-%m-%d %H:00"), P_A_L)
def security_timeline_24h(t):
    return A.security_timeline(t.domain.predictions, t.domain.alerts, t.domain.audit_logs, AS_OF, "24h")


@query("security_timeline_30d", timeline_sql(30, "%Y-%m-%d"), P_A_L)
def security_timeline_30d(t):
    return A.security_timeline(t.domain.predictions, t.domain.alerts, t.domain.audit_logs, AS_OF, "30d")


@query(
    "timeline_union",
    """SELECT kind, count(*) AS events FROM (SELECT timestamp, 'prediction' AS kind FROM predictions
      UNION ALL SELECT timestamp, 'alert' FROM alerts UNION ALL SELECT timestamp, action FROM audit_logs) GROUP BY 1""",
    P_A_L,
)
def timeline_union(t):
    from pyspark.sql import functions as F

    d = t.domain
    return A.timeline_events(d.predictions, d.alerts, d.audit_logs).groupBy("kind").agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "audit_summary",
    f"SELECT count(*) AS total_events, {counters(*AUDIT, ("action = 'RATE_LIMIT_EXCEEDED'", "rate_limit_exceeded"))} FROM audit_logs",
    "audit_logs",
)
def audit_summary(t):
    return A.audit_summary(t.domain.audit_logs)


@query(
    "incident_summary",
    f"""SELECT count(*) AS total_incidents, {counters(
        *[(f"status = '{s}'", f"{s.lower()}_incidents") for s in V.INCIDENT_STATUSES],
        ("severity = 'CRITICAL'", "critical_incidents"), ("severity = 'HIGH'", "high_incidents"),
        (f"status = 'RESOLVED' AND resolved_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY", "recently_resolved"))}
    FROM incidents""",
    "incidents",
)
def incident_summary(t):
    return A.incident_summary(t.domain.incidents, AS_OF)


@query(
    "metrics_overview",
    f"""SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:00') AS bucket_time, count(severity) AS flows,
      count(severity) / 3600 AS flows_per_second, {counters(("status IN ('NEW', 'ACKNOWLEDGED')", "active_threats"),
      *[(f"severity = '{s}'", s.lower()) for s in V.SEVERITIES])}
    FROM (SELECT timestamp, NULL AS status, risk_level AS severity FROM predictions
      UNION ALL SELECT timestamp, status, NULL FROM alerts)
    WHERE timestamp BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND TIMESTAMP '{AS_OF}' GROUP BY 1""",
    "predictions alerts",
)
def metrics_overview(t):
    return A.metrics_overview(t.domain.predictions, t.domain.alerts, AS_OF)


@query(
    "inference_latency",
    """SELECT model_name, model_version, count(*) AS inferences, round(avg(inference_latency_ms), 4) AS average_inference_time_ms,
      max(inference_latency_ms) AS max_inference_time_ms FROM ml_predictions GROUP BY 1, 2""",
    "ml_predictions",
)
def inference_latency(t):
    return A.inference_latency(t.domain.ml_predictions)


@query(
    "high_critical_count",
    f"""SELECT count(*) AS fetched, {counters(("severity IN ('HIGH', 'CRITICAL')", "high_critical"))}
    FROM (SELECT * FROM alerts ORDER BY created_at DESC, id DESC LIMIT 50)""",
    "alerts",
)
def high_critical_count(t):
    return A.high_critical_count(t.domain.alerts, 50)


@query(
    "drift_status",
    """SELECT measure, round(sum((a - b) * ln(a / b)), 6) AS stability_index,
      CASE WHEN round(sum((a - b) * ln(a / b)), 6) < 0.1 THEN 'STABLE'
        WHEN round(sum((a - b) * ln(a / b)), 6) < 0.25 THEN 'MODERATE_SHIFT' ELSE 'DRIFT' END AS status
    FROM (SELECT measure, greatest(count(*) FILTER (WHERE late) / (SELECT count(*) FROM x WHERE late), 1e-4) AS a,
        greatest(count(*) FILTER (WHERE NOT late) / (SELECT count(*) FROM x WHERE NOT late), 1e-4) AS b
      FROM (SELECT 'class_share' AS measure, predicted_threat AS part, late FROM x
        UNION ALL SELECT 'score_bin', 'bin' || CAST(least(floor(anomaly_score * 10), 9) AS INTEGER), late FROM x) GROUP BY measure, part)
    GROUP BY measure""",
    "predictions",
    x="SELECT *, timestamp >= TIMESTAMP '2024-01-16 00:00:00' AS late FROM predictions",
)
def drift_status(t):
    return A.drift_status(t.domain.predictions, "2024-01-16 00:00:00")
