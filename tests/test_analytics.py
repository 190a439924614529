"""Counters, hunting, reports and cases on the hand-worked seeds."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from seeds import ALERT, INCIDENT, PREDICTION, T, ago, analytics, empty, hunting
from vigilflow.functions.timerange import resolve
from vigilflow.functions.triage import risk_band, risk_reasons
from vigilflow.operators import analytics as A, cases as C, hunting as H, reports as R, scoring

DAY = resolve("24h", T)


def test_overview(spark):
    p, a, l = analytics(spark)
    row = A.overview_kpis(p, a, l).first().asDict()
    wanted = dict(
        total_predictions=3, benign_predictions=2, malicious_predictions=1, anomaly_predictions=1, total_alerts=1, open_alerts=1,
        critical_alerts=0, high_alerts=1, medium_alerts=0, resolved_alerts=0, failed_logins=1, access_denied=0, rate_limit_events=1,
    )
    assert row == wanted
    nothing = A.overview_kpis(empty(p), empty(a), empty(l)).first().asDict()
    assert set(nothing.values()) == {0} and len(nothing) == 13


def test_distributions(spark):
    p, _, _ = analytics(spark)
    assert [tuple(r) for r in A.threat_distribution(p).collect()] == [("BENIGN", 2, 66.67), ("Port Scan", 1, 33.33)]
    assert [tuple(r) for r in A.severity_distribution(p).collect()] == [("CRITICAL", 0, 0.0), ("HIGH", 1, 33.33), ("MEDIUM", 0, 0.0), ("LOW", 2, 66.67)]
    assert [tuple(r) for r in A.severity_distribution(empty(p)).collect()] == [(s, 0, 0.0) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]


def test_top_sources(spark):
    p, _, _ = analytics(spark)
    rows = {r.source_ip: r for r in A.top_threat_sources(p).collect()}
    r = rows["198.51.100.5"]
    assert (r.prediction_count, r.malicious_count, r.highest_severity, r.most_common_threat, r.total_sources) == (1, 1, "HIGH", "Port Scan", 3)
    assert rows["192.168.1.10"].most_common_threat == "Benign"
    assert A.top_threat_sources(empty(p)).count() == 0


def test_timeline_counts_whole_range(spark):
    p, a, l = analytics(spark)
    rows = A.security_timeline(p, a, l, T + timedelta(hours=1), "24h").collect()
    assert [(r.bucket_time, r.predictions, r.alerts, r.failed_logins, r.rate_limit_events) for r in rows] == [("2026-03-01 12:00", 3, 1, 1, 1)]


@pytest.mark.parametrize("name, hours", [("1h", 1), ("last_24h", 24), ("7d", 168), ("LAST_30D ", 720), ("other", 24), (None, 24)])
def test_ranges(name, hours):
    window = resolve(name, T)
    assert window.end - window.start == timedelta(hours=hours)


@pytest.mark.parametrize("start, end", [(None, T), (T, T), (T, ago(days=1)), (ago(days=92), T)])
def test_bad_custom_ranges(start, end):
    with pytest.raises(ValueError):
        resolve("custom", T, start, end)


def test_custom_range_of_ninety_days():
    assert resolve("custom", T, ago(days=90), T).label == "Custom (2025-12-01 to 2026-03-01)"


def test_window_ends_belong_to_it(spark):
    df = spark.createDataFrame([(ago(hours=24),), (T,), (ago(hours=24, microseconds=1),)], "timestamp timestamp_ntz")
    assert df.filter(DAY.contains("timestamp")).count() == 2


def test_hunt(spark):
    p, a, i = hunting(spark)
    counts = H.query_counts(p, a, i, H.HuntFilters(), DAY).first()
    assert tuple(counts) == (4, 2, 1)
    wanted = H.HuntFilters(source_ip="198.51.100.11", destination_ip="10.0.0.5", threat_category="DDoS", severity="critical")
    assert {r.id for r in H.hunt_predictions(p, wanted, DAY).collect()} == {1, 2}
    scores = H.HuntFilters(min_anomaly_score=-1.0, max_anomaly_score=-0.5, min_confidence=0.9)
    assert H.match_predictions(p, scores, DAY).count() == 3
    assert H.match_predictions(p, H.HuntFilters(query_text="' OR 1=1 --"), DAY).count() == 0
    assert H.match_predictions(p, H.HuntFilters(query_text="ddos_loic"), DAY).count() == 2  # _ matches any character
    assert H.match_predictions(p, H.HuntFilters(query_text="\\"), DAY).count() == 0


def test_correlations(spark):
    p, _, i = hunting(spark)
    attacks = p.filter("intrusion_flag")
    rows = {r.correlation_type: r for r in H.correlations(attacks, i).collect()}
    net = rows["NETWORK_CONVERGENCE"]
    assert (net.event_count, net.confidence) == (3, "MEDIUM") and net.description.endswith("port(s): 80, 443.")
    assert rows["TEMPORAL_BURST"].event_count == 3 and " 3 minute " in rows["TEMPORAL_BURST"].description
    assert "INC-2026-000099" in rows["CASE_CORRELATION"].title
    assert H.burst_insights(p).count() == 0  # two hours apart
    assert H.source_bursts(p).first().event_count == 3


def test_source_profile(spark):
    p, a, i = hunting(spark)
    r = H.source_profile(p, a, i).filter("source_ip = '198.51.100.11'").first()
    assert (r.total_observations, r.first_seen, r.last_seen) == (6, ago(minutes=8), ago(minutes=4))
    assert (r.destination_ports, r.protocols) == ([80, 443], ["6"])
    threats = {(t.threat, t["count"]) for t in H.source_threats(p, a, i).filter("source_ip = '198.51.100.11'").collect()}
    assert threats == {("DDoS-LOIC", 3), ("PortScan", 2)}
    events = H.source_timeline(p, a, i, "198.51.100.11").collect()
    assert len(events) == 6 and events[0].event_type == "INCIDENT"
    assert events[1].description in ("Flow evaluated as DDoS-LOIC (CRITICAL risk, score -0.75).", "Security alert #1 (CRITICAL) triggered: DDoS-LOIC.")


def test_hunting_summary(spark):
    p, a, i = hunting(spark)
    assert H.hunting_summary(p, a, i).first().asDict() == dict(
        total_flows_investigated=4, total_threat_detections=3, unique_source_ips=2, total_active_alerts=2, total_open_incidents=1
    )


def test_hot_source_keeps_every_row(spark):
    """A third of all rows from one source: nothing is lost or cut."""
    p = spark.range(30_000).select(
        "id", F.lit(T).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "10.0.0.1").otherwise(F.concat(F.lit("10.1."), F.col("id") % 250, F.lit(".1"))).alias("source_ip"),
        F.lit("10.9.9.9").alias("destination_ip"), (F.col("id") % 500).cast("int").alias("destination_port"), F.lit("6").alias("protocol"),
        F.lit("DoS").alias("predicted_threat"), F.lit("HIGH").alias("risk_level"),
    )
    top = A.top_threat_sources(p, 1).first()
    assert (top.source_ip, top.prediction_count, top.total_sources) == ("10.0.0.1", 10_000, 251)
    net = H.network_convergence(p).filter("source_ip = '10.0.0.1'").first()
    assert net.event_count == 10_000 and net.ports == list(range(1, 500))
    assert H.source_destinations(p).filter("source_ip = '10.0.0.1'").count() == 15


def test_report(spark):
    p, a, i = hunting(spark)
    s = R.report_summary(p, a, i).first()
    assert (s.total_threats, s.threat_ratio_percent, s.alerts_by_severity, s.incidents_by_status) == (3, 75.0, {"CRITICAL": 1, "HIGH": 1}, {"INVESTIGATING": 1})
    texts = [r.finding for r in R.important_findings(R.report_summary(p, a, i), R.report_top_threats(p), R.report_top_sources(p)).collect()]
    assert texts == [
        "Observed 3 suspicious/anomalous flows out of 4 total evaluations (75.0% anomaly density).",
        "High-priority alert volume: 1 CRITICAL and 1 HIGH severity alerts triggered.",
        "SOC Incident Resolution Rate: 0.0% (0 resolved, 1 open/in-progress).",
        "Primary detected attack vector: 'DDoS-LOIC' with 2 matching event signatures.",
        "Most active source address: '198.51.100.11' with 3 associated ingress flows.",
    ]
    none = R.report_summary(empty(p), empty(a), empty(i))
    only = R.important_findings(none, R.report_top_threats(empty(p)), R.report_top_sources(empty(p))).collect()
    assert [r.finding for r in only] == ["Zero network flow evaluations were logged within this timeframe."]


TRIAGE = [
    (True, 0.85, False, 0.60, "CRITICAL"), (True, 0.85, False, 0.59, "HIGH"), (True, 0.70, False, 0.0, "HIGH"), (True, 0.69, False, 0.0, "MEDIUM"),
    (False, 0.9, True, 0.75, "MEDIUM"), (False, 0.9, True, 0.50, "MEDIUM"), (False, 0.9, False, 0.2, "LOW"),
]


def test_triage(spark):
    df = spark.createDataFrame(TRIAGE, "attack boolean, c double, anom boolean, s double, wanted string")
    rows = df.select("*", risk_band(F.col("attack"), F.col("c"), F.col("anom"), F.col("s")).alias("b")).collect()
    assert all(r.b.risk_level == r.wanted for r in rows)
    actions = [r.b.recommended_action for r in rows if r.wanted == "MEDIUM"]
    assert len(set(actions)) == 2
    p, _, _ = analytics(spark)
    alerts = scoring.alert_escalation(p.withColumn("recommended_action", F.lit("x"))).collect()
    assert [(r.prediction_id, r.alert_type, r.status) for r in alerts] == [(3, "NETWORK_INTRUSION", "NEW")]


def test_reasons(spark):
    p, _, _ = analytics(spark)
    texts = {r.id: r.t for r in p.select("id", risk_reasons().alias("t")).collect()}
    assert texts[1] == ["Target involves public web application service (port 443)", "Flow telemetry metrics conform to expected baseline benign traffic patterns"]
    assert len(texts[3]) == 5 and texts[3][0].startswith("Severe anomaly divergence (score: 0.880)")
    bare = p.limit(1).select(F.lit(0.1).alias("anomaly_score"), F.lit("DoS").alias("predicted_threat"), F.lit(0.6).alias("classification_confidence"),
                             F.lit(None).cast("int").alias("destination_port"), F.lit("LOW").alias("risk_level"), F.lit(True).alias("intrusion_flag"))
    assert bare.select(risk_reasons().alias("t")).first().t == ["Supervised Random Forest classified flow signature as 'DoS' attack vector"]


def case(i, key, status):
    return (i, key, "t", None, "HIGH", status, "DoS", "1.1.1.1", None, "lee", T, T, None, None, None, None)


def test_creation(spark):
    p, a, _ = hunting(spark)
    incidents = spark.createDataFrame([case(1, "INC-2026-000041", "OPEN"), case(2, "INC-2026-000007", "RESOLVED")], INCIDENT)
    links = spark.createDataFrame([(1, 1), (2, 2)], "incident_id long, alert_id long")
    users = spark.createDataFrame([(1, "kim", "ANALYST", True), (2, "out", "ANALYST", False), (3, "view", "VIEWER", True)], "id long, username string, role string, is_active boolean")
    asked = [
        (1, 1, None, None, None, " a ", None), (2, 2, None, None, None, "b", " kim "), (3, 2, None, None, None, "c", None), (4, None, 3, None, None, "d", None),
        (5, None, 99, None, None, "e", None), (6, 99, None, None, None, "f", None), (7, None, None, "bad", None, "g", None), (8, None, None, None, None, "h", "out"),
        (9, None, None, None, None, "i", "view"), (10, None, None, None, None, "j", "nobody"), (11, None, None, "low", "Own", "k", None),
    ]
    requests = spark.createDataFrame([(*r, T + timedelta(seconds=r[0])) for r in asked],
                                     "request_id long, alert_id long, prediction_id long, severity string, category string, title string, assigned_to string, created_at timestamp_ntz")
    ok, no = C.create_incidents(requests, incidents, links, a, p, users)
    made = {r.request_id: r for r in ok.collect()}
    assert set(made) == {2, 4, 11}
    assert [made[i].incident_key for i in (2, 4, 11)] == ["INC-2026-000042", "INC-2026-000043", "INC-2026-000044"]
    assert (made[2].severity, made[2].category, made[2].assigned_to, made[2].alert_prediction_id) == ("HIGH", "PortScan", "kim", 3)
    assert (made[11].severity, made[11].category, made[11].source_ip) == ("LOW", "Own", None)
    reasons = {r.request_id: r.reason for r in no.collect()}
    assert reasons == {1: "active incident exists", 3: "active incident exists", 5: "prediction not found", 6: "alert not found", 7: "invalid severity",
                       8: "inactive operator", 9: "viewer role", 10: "unknown operator"}


def test_keys_of_one_busy_instant(spark):
    """Thousands of cases in the same second still get gapless keys."""
    rows = spark.range(5000).select("id", F.lit(T).cast("timestamp_ntz").alias("created_at"))
    old = spark.createDataFrame([case(1, "INC-2026-000100", "OPEN")], INCIDENT)
    keys = [r.incident_key for r in C.number_cases(rows, old, ["created_at", "id"]).orderBy("id").collect()]
    assert keys == [f"INC-2026-{i:06d}" for i in range(101, 5101)]


def test_investigation(spark):
    p, a, _ = hunting(spark)
    audit = spark.range(30).select("id", F.lit(T).cast("timestamp_ntz").alias("timestamp"), F.lit("SEEN").alias("action"), F.lit("OK").alias("outcome"), F.lit("kim").alias("username"),
                                   F.lit("PREDICTION").alias("resource_type"), F.lit("1").alias("resource_id"))
    intel = spark.createDataFrame([("198.51.100.11", "MALICIOUS", 0.9, ["x"], "n")], "indicator string, reputation string, confidence double, categories array<string>, notes string")
    rows = {r.id: r for r in C.prediction_investigation(p, a, audit, intel).collect()}
    assert len(rows) == 4 and len(rows[1].related_audit) == 10 and rows[1].related_audit[0].id == 29
    assert (rows[1].alert_id, rows[1].reputation, rows[4].reputation, rows[4].found) == (1, "MALICIOUS", "UNKNOWN", False)
