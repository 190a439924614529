"""Period reports: totals, findings, snapshots and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import all_of, count_if, is_threat, iso, or_default, percent_of
from vigilflow.functions.timerange import TimeRange
from vigilflow.operators.analytics import one_row
from vigilflow.operators.cases import link_counts
from vigilflow.operators.hunting import alert_items, incident_items, prediction_items, top_values
from vigilflow.operators.paging import like_pattern, page


def in_report(df: DataFrame, window: TimeRange, at: str, severity: tuple[str, str | None], category: tuple[str, str | None]) -> DataFrame:
    """Rows of the window with the wanted (column, value) of severity and category."""
    terms: list[Column] = [window.contains(at)]
    if severity[1]:
        terms.append(F.col(severity[0]) == severity[1].upper().strip())
    if category[1]:
        terms.append(F.lower(category[0]).like(like_pattern(category[1].lower().strip())))
    return df.filter(all_of(terms))


def report_predictions(df, window, severity=None, category=None) -> DataFrame:
    return in_report(df, window, "timestamp", ("risk_level", severity), ("predicted_threat", category))


def report_alerts(df, window, severity=None, category=None) -> DataFrame:
    return in_report(df, window, "timestamp", ("severity", severity), ("threat_label", category))


def report_incidents(df, window, severity=None, category=None) -> DataFrame:
    return in_report(df, window, "created_at", ("severity", severity), ("category", category))


def _counts_map(df: DataFrame, column: str) -> Column:
    """value -> rows as one map (a handful of levels); NULL counts as UNKNOWN."""
    per_value = df.groupBy(or_default(column, "UNKNOWN").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m")).scalar()


def report_summary(predictions: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Totals of frames that are already filtered to the report."""
    rows = F.count(F.lit(1))
    severity, status = F.col("severity"), F.col("status")
    totals = one_row(
        predictions.agg(rows.alias("total_predictions"), count_if(is_threat()).alias("total_threats")),
        alerts.agg(
            rows.alias("total_alerts"),
            count_if(severity == "CRITICAL").alias("critical_alerts"),
            count_if(severity == "HIGH").alias("high_alerts"),
        ),
        incidents.agg(rows.alias("total_incidents"), count_if(status == "RESOLVED").alias("resolved_incidents")),
    )
    return totals.select(
        "*",
        F.greatest(F.lit(0), F.col("total_incidents") - F.col("resolved_incidents")).alias("unresolved_incidents"),
        F.greatest(F.lit(0), F.col("total_predictions") - F.col("total_threats")).alias("benign_flows"),
        percent_of(F.col("total_threats"), F.col("total_predictions")).alias("threat_ratio_percent"),
        _counts_map(alerts, "severity").alias("alerts_by_severity"),
        _counts_map(incidents, "status").alias("incidents_by_status"),
    )


def report_top_threats(predictions: DataFrame, n: int = 10) -> DataFrame:
    named = predictions.select(or_default("predicted_threat", "Unknown").alias("predicted_threat"))
    return top_values(named, "predicted_threat", "threat", n)


def report_top_sources(predictions: DataFrame, n: int = 10) -> DataFrame:
    """Ten most frequent sources; the blank one takes a place but is not listed."""
    return top_values(predictions.filter(F.col("source_ip").isNotNull()), "source_ip", "source_ip", n).filter(
        F.col("source_ip") != ""
    )


def important_findings(summary: DataFrame, threats: DataFrame, sources: DataFrame) -> DataFrame:
    """Up to five sentences; a sentence is left out when its numbers are zero."""
    first_threat, first_source = (
        df.orderBy(F.desc("count"), F.asc(df.columns[0])).limit(1) for df in (threats, sources)
    )
    total, bad = F.col("total_predictions"), F.col("total_threats")
    cases, resolved = F.col("total_incidents"), F.col("resolved_incidents")
    percent = lambda a, b: F.try_divide(a * 100.0, b)
    wide = summary.select(
        "*",
        first_threat.select("threat").scalar().alias("threat"),
        first_threat.select("count").scalar().alias("threat_rows"),
        first_source.select("source_ip").scalar().alias("source"),
        first_source.select("count").scalar().alias("source_rows"),
    )
    sentences = F.array(
        F.when(total == 0, F.lit(V.FINDING_EMPTY)).otherwise(F.format_string(V.FINDING_DENSITY, bad, total, percent(bad, total))),
        F.when(
            (F.col("critical_alerts") > 0) | (F.col("high_alerts") > 0),
            F.format_string(V.FINDING_ALERTS, "critical_alerts", "high_alerts"),
        ),
        F.when(cases > 0, F.format_string(V.FINDING_RESOLUTION, percent(resolved, cases), resolved, F.col("unresolved_incidents"))),
        F.when(F.col("threat").isNotNull(), F.format_string(V.FINDING_VECTOR, "threat", "threat_rows")),
        F.when(F.col("source").isNotNull(), F.format_string(V.FINDING_SOURCE, "source", "source_rows")),
    )
    return wide.select(F.posexplode(F.array_compact(sentences)).alias("place", "finding"))


# --- snapshots --------------------------------------------------------------------


def snapshot(df: DataFrame, at: str, limit: int | None) -> DataFrame:
    return page(df, at, limit)


def prediction_snapshot(df: DataFrame, limit: int | None = 500) -> DataFrame:
    columns = ["id", "predicted_threat", "risk_level", "anomaly_score", "classification_confidence", "source_ip", "destination_ip", "timestamp"]
    return prediction_items(snapshot(df, "timestamp", limit)).select(*columns)


def alert_snapshot(df: DataFrame, limit: int | None = 500) -> DataFrame:
    rows = snapshot(df, "timestamp", limit)
    return alert_items(rows).join(rows.select("id", "acknowledged_at", "resolved_at"), "id")


def incident_snapshot(df: DataFrame, incident_alerts: DataFrame, incident_predictions: DataFrame, limit: int | None = 500) -> DataFrame:
    """Newest cases with their link counts; only links of those cases are counted."""
    rows = snapshot(df, "created_at", limit)
    ids = rows.select(F.col("id").alias("incident_id"))
    links = {
        "alerts_count": incident_alerts.join(ids, "incident_id", "left_semi"),
        "predictions_count": incident_predictions.join(ids, "incident_id", "left_semi"),
    }
    return link_counts(rows, links)


def incident_report_items(df, incident_alerts, incident_predictions, limit: int | None = 500) -> DataFrame:
    counted = incident_snapshot(df, incident_alerts, incident_predictions, limit)
    return counted.select(*incident_items(counted).columns, "resolved_at", "resolution_summary", "alerts_count", "predictions_count")


# --- export rows ------------------------------------------------------------------


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _number_text(c: str) -> Column:
    """Zero counts as missing, like every other empty value."""
    return F.when(F.col(c).isNull() | (F.col(c) == 0), "").otherwise(F.col(c).cast("string"))


def _time_text(c: str) -> Column:
    return F.coalesce(F.regexp_replace(iso(c), r"\.000000$", ""), F.lit(""))


def _score(c: str) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 4)


def predictions_export(df: DataFrame, limit: int | None = V.MAX_REPORT_ROWS) -> DataFrame:
    flag = F.when(F.col("intrusion_flag"), "True").when(~F.col("intrusion_flag"), "False").otherwise("")
    return snapshot(df, "timestamp", limit).select(
        F.col("id").alias("Prediction_ID"),
        _time_text("timestamp").alias("Timestamp_UTC"),
        _text("source_ip").alias("Source_IP"),
        _text("destination_ip").alias("Destination_IP"),
        _number_text("destination_port").alias("Destination_Port"),
        _text("protocol").alias("Protocol"),
        _text("predicted_threat").alias("Predicted_Threat"),
        flag.alias("Intrusion_Flag"),
        _score("anomaly_score").alias("Anomaly_Score"),
        _score("classification_confidence").alias("Classification_Confidence"),
        _text("risk_level").alias("Risk_Level"),
        _text("recommended_action").alias("Recommended_Action"),
    )


def alerts_export(df: DataFrame, limit: int | None = V.MAX_REPORT_ROWS) -> DataFrame:
    return snapshot(df, "timestamp", limit).select(
        F.col("id").alias("Alert_ID"),
        _number_text("prediction_id").alias("Prediction_ID"),
        _time_text("timestamp").alias("Timestamp_UTC"),
        _text("severity").alias("Severity"),
        _text("status").alias("Status"),
        _text("alert_type").alias("Alert_Type"),
        _text("threat_label").alias("Threat_Label"),
        _score("confidence").alias("Confidence"),
        _text("source_ip").alias("Source_IP"),
        _text("destination_ip").alias("Destination_IP"),
        _time_text("acknowledged_at").alias("Acknowledged_At"),
        _time_text("resolved_at").alias("Resolved_At"),
    )


def incidents_export(df: DataFrame, incident_alerts: DataFrame, incident_predictions: DataFrame, limit: int | None = V.MAX_REPORT_ROWS) -> DataFrame:
    return incident_snapshot(df, incident_alerts, incident_predictions, limit).select(
        F.col("id").alias("Incident_ID"),
        F.col("incident_key").alias("Incident_Key"),
        F.col("title").alias("Title"),
        F.col("severity").alias("Severity"),
        F.col("status").alias("Status"),
        _text("category").alias("Category"),
        _text("source_ip").alias("Source_IP"),
        _text("assigned_to").alias("Assigned_To"),
        F.col("created_by").alias("Created_By"),
        _time_text("created_at").alias("Created_At_UTC"),
        _time_text("acknowledged_at").alias("Acknowledged_At"),
        _time_text("investigation_started_at").alias("Investigation_Started_At"),
        _time_text("resolved_at").alias("Resolved_At"),
        _text("resolution_summary").alias("Resolution_Summary"),
        F.col("alerts_count").alias("Linked_Alerts_Count"),
        F.col("predictions_count").alias("Linked_Predictions_Count"),
    )


def audit_export(df: DataFrame, limit: int | None = V.MAX_REPORT_ROWS) -> DataFrame:
    """The details column is left out on purpose."""
    return snapshot(df, "timestamp", limit).select(
        F.col("id").alias("Audit_ID"),
        _time_text("timestamp").alias("Timestamp_UTC"),
        _text("username").alias("Username"),
        _text("user_role").alias("User_Role"),
        F.col("action").alias("Action"),
        F.col("resource_type").alias("Resource_Type"),
        _text("resource_id").alias("Resource_ID"),
        F.col("outcome").alias("Outcome"),
        _text("ip_address").alias("IP_Address"),
        _text("request_method").alias("Request_Method"),
        _text("request_path").alias("Request_Path"),
        _number_text("status_code").alias("Status_Code"),
    )


def json_export(dataset: str, items: DataFrame) -> DataFrame:
    """Items of one dataset as (dataset, item JSON) rows."""
    columns = [iso(c).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in items.dtypes]
    return items.select(F.lit(dataset).alias("dataset"), F.col("id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("item"))
