"""Risk level, recommended action, alert type and explanation as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import is_benign_name


def risk_band(attack: Column, confidence: Column, anomalous: Column, score: Column) -> Column:
    """struct(risk_level, recommended_action); the first rule that holds wins."""

    def band(level: str, action: str) -> Column:
        return F.struct(F.lit(level).alias("risk_level"), F.lit(action).alias("recommended_action"))

    return (
        F.when(attack & (confidence >= 0.85) & (score >= 0.60), band("CRITICAL", V.ACTION_CRITICAL))
        .when(attack & (confidence >= 0.70), band("HIGH", V.ACTION_HIGH))
        .when(attack | (anomalous & (score >= 0.75)), band("MEDIUM", V.ACTION_INSPECT))
        .when(anomalous, band("MEDIUM", V.ACTION_DRIFT))
        .otherwise(band("LOW", V.ACTION_LOW))
    )


def triage_summary() -> Column:
    return F.format_string(
        V.TRIAGE_TEXT,
        F.col("anomaly_label"),
        F.col("anomaly_score"),
        F.col("predicted_threat"),
        F.col("classification_confidence") * 100,
        F.col("risk_level"),
    )


def anomaly_interpretation(score: Column) -> Column:
    return F.format_string(V.ANOMALY_TEXT, score)


def alert_type(severity: Column) -> Column:
    kind = F.lit(None).cast("string")
    for level, name in V.ALERT_TYPES.items():
        kind = F.when(severity == level, F.lit(name)).otherwise(kind)
    return kind


def risk_reasons() -> Column:
    """Ordered list of sentences that explain one scored flow."""
    score, threat = F.col("anomaly_score"), F.col("predicted_threat")
    confidence = F.coalesce(F.col("classification_confidence"), F.lit(0.0))
    port, risk = F.col("destination_port"), F.upper(F.coalesce("risk_level", F.lit("LOW")))
    named = F.coalesce(threat != "", F.lit(False))
    attack = named & ~is_benign_name(threat)
    pct = confidence * 100
    divergence = F.when(score >= 0.70, F.format_string(V.REASON_SEVERE, score)).when(
        score >= 0.50, F.format_string(V.REASON_ELEVATED, score)
    )
    signature = F.when(attack, F.format_string(V.REASON_CLASS, threat))
    certainty = F.when(attack & (confidence >= 0.85), F.format_string(V.REASON_SURE, pct)).when(
        attack & (confidence < 0.50), F.format_string(V.REASON_UNSURE, pct)
    )
    service = (
        F.when(port.isin(V.REMOTE_ACCESS_PORTS), F.format_string(V.REASON_REMOTE, port))
        .when(port.isin(V.WEB_PORTS), F.format_string(V.REASON_WEB, port))
        .when(port == V.DNS_PORT, F.lit(V.REASON_DNS))
    )
    priority = F.when(risk.isin("CRITICAL", "HIGH"), F.format_string(V.REASON_RISK, risk))
    calm = F.when(~F.coalesce("intrusion_flag", F.lit(False)) & ~attack, F.lit(V.REASON_BENIGN))
    reasons = F.array_compact(F.array(divergence, signature, certainty, service, priority, calm))
    return F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(V.REASON_DEFAULT)))
