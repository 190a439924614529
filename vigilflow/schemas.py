"""Column layouts of the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "predictions": """id long, timestamp timestamp_ntz, source_ip string, destination_ip string, source_port int,
        destination_port int, protocol string, flow_duration double, total_forward_packets long,
        total_backward_packets long, total_bytes long, anomaly_label string, anomaly_score double,
        raw_decision_score double, predicted_threat string, intrusion_flag boolean,
        classification_confidence double, risk_level string, recommended_action string, model_version string,
        raw_flow_data string, created_at timestamp_ntz""",
    "alerts": """id long, prediction_id long, timestamp timestamp_ntz, alert_type string, severity string,
        threat_label string, anomaly_score double, confidence double, source_ip string, destination_ip string,
        status string, recommended_action string, created_at timestamp_ntz, acknowledged_at timestamp_ntz,
        resolved_at timestamp_ntz""",
    "audit_logs": """id long, timestamp timestamp_ntz, username string, user_role string, action string,
        resource_type string, resource_id string, outcome string, ip_address string, request_method string,
        request_path string, status_code int, details string, created_at timestamp_ntz""",
    "incidents": """id long, incident_key string, title string, description string, severity string, status string,
        category string, source_ip string, assigned_to string, created_by string, created_at timestamp_ntz,
        updated_at timestamp_ntz, acknowledged_at timestamp_ntz, investigation_started_at timestamp_ntz,
        resolved_at timestamp_ntz, resolution_summary string""",
    "incident_alerts": "incident_id long, alert_id long",
    "incident_predictions": "incident_id long, prediction_id long",
    "incident_notes": "id long, incident_id long, author string, note string, created_at timestamp_ntz",
    "users": "id long, username string, role string, is_active boolean",
    "system_nodes": """id long, hostname string, ip_address string, environment string, criticality_level int,
        is_active boolean""",
    "traffic_records": """id string, captured_at timestamp_ntz, source_ip string, destination_ip string,
        source_port int, destination_port int, protocol string, duration_seconds double, total_packets long,
        total_bytes long, is_suspicious boolean""",
    "threat_events": """id string, traffic_record_id string, threat_type string, anomaly_score double,
        confidence_score double, severity string, status string, detected_at timestamp_ntz""",
    "ml_predictions": """id long, model_name string, model_version string, inference_latency_ms double,
        raw_prediction string, executed_at timestamp_ntz""",
}


def schema(entity: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[entity])


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Exactly the columns of the entity: cast, missing ones as NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(entity).fields
        ]
    )
