"""Security analytics: counters, distributions, timelines, top sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import (
    count_if,
    is_benign_name,
    percent_of,
    severity_of_rank,
    severity_rank,
)
from vigilflow.functions.timerange import literal, resolve


def one_row(*parts: DataFrame) -> DataFrame:
    """Side-by-side join of one-row counter frames, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stacked.columns])


def known_source(c: str = "source_ip") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def overview_kpis(predictions: DataFrame, alerts: DataFrame, audit: DataFrame) -> DataFrame:
    """13 counters: one conditional aggregate (one scan) per table."""
    benign, flagged = is_benign_name("predicted_threat"), F.col("intrusion_flag")
    flows = predictions.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        count_if(benign | ~flagged).alias("benign_predictions"),
        count_if(~benign & flagged).alias("malicious_predictions"),
        count_if(
            F.upper("anomaly_label").isin(V.ANOMALY_LABELS) | (F.col("anomaly_score") >= 0.5)
        ).alias("anomaly_predictions"),
    )
    warnings = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        count_if(F.col("status").isin(V.OPEN_ALERT_STATUSES)).alias("open_alerts"),
        *[count_if(F.col("severity") == s).alias(f"{s.lower()}_alerts") for s in V.SEVERITIES[:3]],
        count_if(F.col("status") == "RESOLVED").alias("resolved_alerts"),
    )
    return one_row(flows, warnings, audit.agg(*_audit_counters("rate_limit_events")))


def _audit_counters(rate_name: str) -> list[Column]:
    action = F.col("action")
    return [
        count_if(action == V.LOGIN_FAILURE).alias("failed_logins"),
        count_if(action == V.ACCESS_DENIED).alias("access_denied"),
        count_if(action == V.RATE_LIMIT_EXCEEDED).alias(rate_name),
    ]


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("total_events"), *_audit_counters("rate_limit_exceeded"))


def counts_with_share(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows and percentage per value; NULL is a value."""
    counts = df.groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t")).scalar()
    return counts.withColumn("percentage", percent_of(F.col("count"), total))


def threat_distribution(predictions: DataFrame) -> DataFrame:
    return counts_with_share(predictions, "predicted_threat", "category").orderBy(
        F.desc("count"), "category"
    )


def severity_distribution(predictions: DataFrame) -> DataFrame:
    """All four levels in fixed order, also those without rows.

    The levels are counted side by side in one aggregate and then turned into
    rows, so no join is needed for the missing ones.
    """
    level = F.upper("risk_level")
    wide = predictions.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(level == s).alias(s) for s in V.SEVERITIES],
    )
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("severity"), F.col(s).alias("count"), F.lit(-V.SEVERITY_RANK[s]).alias("o"))
            for s in V.SEVERITIES
        ]
    )
    return (
        wide.select("total", F.explode(rows).alias("r"))
        .orderBy("r.o")
        .select("r.severity", "r.count", percent_of(F.col("r.count"), F.col("total")).alias("percentage"))
    )


def source_activity(predictions: DataFrame) -> DataFrame:
    """One row per source: counts, worst severity, most common attack.

    Counted per (source, threat) first, so a source with a third of all rows
    reaches the second step as a handful of partial counts.
    """
    per_threat = (
        predictions.filter(known_source())
        .groupBy("source_ip", "predicted_threat")
        .agg(F.count(F.lit(1)).alias("n"), F.max(severity_rank("risk_level")).alias("rank"))
    )
    attack = F.coalesce(~is_benign_name("predicted_threat") & (F.col("predicted_threat") != ""), F.lit(False))
    # smallest (-n, name) = most frequent attack, ties to the smaller name
    mode = F.min(F.when(attack, F.struct((-F.col("n")).alias("o"), "predicted_threat")))
    return per_threat.groupBy("source_ip").agg(
        F.sum("n").alias("prediction_count"),
        F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0)).alias("malicious_count"),
        severity_of_rank(F.max("rank")).alias("highest_severity"),
        F.coalesce(mode["predicted_threat"], F.lit("Benign")).alias("most_common_threat"),
    )


def top_threat_sources(predictions: DataFrame, limit: int = 10) -> DataFrame:
    per_source = source_activity(predictions)
    total = per_source.agg(F.count(F.lit(1)).alias("t")).scalar()
    return (
        per_source.orderBy(F.desc("prediction_count"), "source_ip")
        .limit(limit)
        .withColumn("total_sources", total)
    )


def dominant_threat(predictions: DataFrame) -> DataFrame:
    return source_activity(predictions).select("source_ip", "most_common_threat")


def distinct_sources(predictions: DataFrame, approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return predictions.filter(known_source()).agg(counter("source_ip").alias("total_sources"))


def timeline_events(predictions: DataFrame, alerts: DataFrame, audit: DataFrame) -> DataFrame:
    """(timestamp, kind) of the three event tables under one schema."""
    return (
        predictions.select("timestamp", F.lit("prediction").alias("kind"))
        .unionByName(alerts.select("timestamp", F.lit("alert").alias("kind")))
        .unionByName(audit.select("timestamp", F.col("action").alias("kind")))
    )


def timeline_counters() -> list[Column]:
    kind = F.col("kind")
    return [
        count_if(kind == "prediction").alias("predictions"),
        count_if(kind == "alert").alias("alerts"),
        *_audit_counters_of_kind(),
    ]


def _audit_counters_of_kind() -> list[Column]:
    kind = F.col("kind")
    return [
        count_if(kind == V.LOGIN_FAILURE).alias("failed_logins"),
        count_if(kind == V.ACCESS_DENIED).alias("access_denied"),
        count_if(kind == V.RATE_LIMIT_EXCEEDED).alias("rate_limit_events"),
    ]


def bucket_shape(time_range: str) -> tuple[str, str]:
    """(truncation unit, text format): hours for 24h, days otherwise."""
    return ("hour", "yyyy-MM-dd HH:00") if time_range == "24h" else ("day", "yyyy-MM-dd")


def security_timeline(
    predictions: DataFrame, alerts: DataFrame, audit: DataFrame,
    as_of, time_range: str = "7d", limit: int = 50,
) -> DataFrame:
    """Counters per bucket since the start of the range; the last ``limit`` buckets."""
    window = resolve(time_range if time_range in ("24h", "30d") else "7d", as_of)
    unit, text = bucket_shape(time_range)
    recent = F.col("timestamp") >= literal(window.start)
    return (
        timeline_events(predictions.filter(recent), alerts.filter(recent), audit.filter(recent))
        .groupBy(F.date_trunc(unit, "timestamp").alias("bucket"))
        .agg(*timeline_counters())
        .orderBy(F.desc("bucket"))
        .limit(limit)
        .orderBy("bucket")
        .withColumn("bucket_time", F.date_format("bucket", text))
        .drop("bucket")
    )


def incident_summary(incidents: DataFrame, as_of) -> DataFrame:
    day_ago = literal(resolve("24h", as_of).start)
    status, severity = F.col("status"), F.col("severity")
    return incidents.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        *[count_if(status == s).alias(f"{s.lower()}_incidents") for s in V.INCIDENT_STATUSES],
        *[count_if(severity == s).alias(f"{s.lower()}_incidents") for s in V.SEVERITIES[:2]],
        count_if((status == "RESOLVED") & (F.col("resolved_at") >= day_ago)).alias("recently_resolved"),
    )


def metrics_overview(predictions: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """Per hour of the last day: flow rate, active threats, severity breakdown."""
    window = resolve("24h", as_of)
    flows = predictions.filter(window.contains("timestamp")).select(
        "timestamp", F.lit(None).cast("string").alias("status"), F.col("risk_level").alias("severity")
    )
    active = alerts.filter(window.contains("timestamp")).select(
        "timestamp", "status", F.lit(None).cast("string").alias("severity")
    )
    per_hour = (
        flows.unionByName(active)
        .groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
        .agg(
            F.count("severity").alias("flows"),
            count_if(F.col("status").isin(V.OPEN_ALERT_STATUSES)).alias("active_threats"),
            *[count_if(F.col("severity") == s).alias(s.lower()) for s in V.SEVERITIES],
        )
    )
    return per_hour.select(
        F.date_format("hour", "yyyy-MM-dd HH:00").alias("bucket_time"),
        "flows",
        (F.col("flows") / 3600).alias("flows_per_second"),
        "active_threats",
        *[s.lower() for s in V.SEVERITIES],
    )


def batch_result(scored: DataFrame) -> DataFrame:
    """Processed rows and anomalies per ingest batch."""
    return scored.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("processed_count"),
        count_if(F.col("is_suspicious")).alias("anomalies_detected"),
    )


def inference_latency(runs: DataFrame) -> DataFrame:
    ms = F.col("inference_latency_ms")
    return runs.groupBy("model_name", "model_version").agg(
        F.count(F.lit(1)).alias("inferences"),
        F.round(F.avg(ms), 4).alias("average_inference_time_ms"),
        F.max(ms).alias("max_inference_time_ms"),
    )


def high_critical_count(alerts: DataFrame, newest: int) -> DataFrame:
    page = alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    return page.agg(
        F.count(F.lit(1)).alias("fetched"),
        count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high_critical"),
    )


def drift_status(predictions: DataFrame, split_at, floor: float = 1e-4) -> DataFrame:
    """Population stability of class shares and score bins, before and after a date."""
    late = F.col("timestamp") >= literal(split_at)
    bins = F.concat(F.lit("bin"), F.least(F.floor(F.col("anomaly_score") * 10), F.lit(9)))
    parts = F.explode(
        F.array(
            F.struct(F.lit("class_share").alias("measure"), F.col("predicted_threat").alias("part")),
            F.struct(F.lit("score_bin").alias("measure"), bins.alias("part")),
        )
    )
    counts = (
        predictions.select(late.alias("late"), parts.alias("p"))
        .groupBy("p.measure", "p.part")
        .agg(count_if(~F.col("late")).alias("before"), count_if(F.col("late")).alias("after"))
    )
    totals = predictions.agg(count_if(~late).alias("before"), count_if(late).alias("after"))
    share = {
        side: F.greatest(
            F.coalesce(F.try_divide(F.col(side), totals.select(side).scalar()), F.lit(0.0)), F.lit(floor)
        )
        for side in ("before", "after")
    }
    shift = (share["after"] - share["before"]) * F.ln(share["after"] / share["before"])
    index = F.round(F.sum("shift"), 6)
    return (
        counts.select("measure", shift.alias("shift"))
        .groupBy("measure")
        .agg(index.alias("stability_index"))
        .withColumn(
            "status",
            F.when(F.col("stability_index") < 0.1, "STABLE")
            .when(F.col("stability_index") < 0.25, "MODERATE_SHIFT")
            .otherwise("DRIFT"),
        )
    )
