"""Small in-code tables with answers worked out by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

T = datetime(2026, 3, 1, 12, 0, 0)

PREDICTION = """id long, timestamp timestamp_ntz, source_ip string, destination_ip string, source_port int, destination_port int, protocol string,
anomaly_label string, anomaly_score double, predicted_threat string, intrusion_flag boolean, classification_confidence double, risk_level string"""
ALERT = """id long, prediction_id long, timestamp timestamp_ntz, alert_type string, severity string, threat_label string, confidence double,
source_ip string, destination_ip string, status string"""
INCIDENT = """id long, incident_key string, title string, description string, severity string, status string, category string, source_ip string,
assigned_to string, created_by string, created_at timestamp_ntz, updated_at timestamp_ntz, acknowledged_at timestamp_ntz,
investigation_started_at timestamp_ntz, resolved_at timestamp_ntz, resolution_summary string"""
AUDIT = "id long, timestamp timestamp_ntz, action string, resource_type string, resource_id string, username string, ip_address string, request_method string"


def ago(**kw):
    return T - timedelta(**kw)


def hunting(spark):
    src = "198.51.100.11"
    p = [
        (1, ago(minutes=5), src, "10.0.0.5", 54321, 80, "6", "ANOMALY", -0.75, "DDoS-LOIC", True, 0.98, "CRITICAL"),
        (2, ago(minutes=7), src, "10.0.0.5", 54322, 80, "6", "ANOMALY", -0.80, "DDoS-LOIC", True, 0.95, "CRITICAL"),
        (3, ago(minutes=8), src, "10.0.0.5", 54323, 443, "6", "ANOMALY", -0.60, "PortScan", True, 0.92, "HIGH"),
        (4, ago(hours=2), "192.168.1.50", "10.0.0.1", 49152, 443, "6", "NORMAL", 0.45, "BENIGN", False, 0.99, "LOW"),
    ]
    a = [
        (1, 1, ago(minutes=5), "CRITICAL_INTRUSION", "CRITICAL", "DDoS-LOIC", 0.98, src, "10.0.0.5", "NEW"),
        (2, 3, ago(minutes=8), "NETWORK_INTRUSION", "HIGH", "PortScan", 0.92, src, "10.0.0.5", "ACKNOWLEDGED"),
    ]
    i = [
        (1, "INC-2026-000099", "DDoS case", "many flows", "CRITICAL", "INVESTIGATING", "DDoS-LOIC", src, "kim", "lee",
         ago(minutes=4), ago(minutes=2), None, None, None, None),
    ]
    return (
        spark.createDataFrame(p, PREDICTION),
        spark.createDataFrame(a, ALERT),
        spark.createDataFrame(i, INCIDENT),
    )


def analytics(spark):
    p = [
        (1, T, "192.168.1.10", "10.0.0.1", 1, 443, "6", "NORMAL", 0.15, "BENIGN", False, 0.98, "LOW"),
        (2, T, "192.168.1.11", "10.0.0.1", 1, 80, "6", "NORMAL", 0.20, "BENIGN", False, 0.95, "LOW"),
        (3, T, "198.51.100.5", "10.0.0.1", 1, 22, "6", "ANOMALOUS", 0.88, "Port Scan", True, 0.92, "HIGH"),
    ]
    a = [(1, 3, T, "NETWORK_INTRUSION", "HIGH", "Port Scan", 0.92, "198.51.100.5", "10.0.0.1", "NEW")]
    l = [
        (1, T, "LOGIN_FAILURE", "AUTH", None, "kim", "10.0.0.9", "POST"),
        (2, T, "RATE_LIMIT_EXCEEDED", "RATE_LIMIT", None, None, "10.0.0.9", "POST"),
    ]
    return spark.createDataFrame(p, PREDICTION), spark.createDataFrame(a, ALERT), spark.createDataFrame(l, AUDIT)


def empty(df):
    return df.filter(F.lit(False))
