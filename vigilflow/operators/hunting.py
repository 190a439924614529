"""Threat hunting: filtered search, correlation, source profiles, history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import all_of, any_of, count_if, is_threat, or_default
from vigilflow.functions.timerange import TimeRange
from vigilflow.operators.analytics import known_source, one_row
from vigilflow.operators.paging import like_pattern, newest_per_group, page


@dataclass(frozen=True)
class HuntFilters:
    """Optional search terms; those left out do not restrict."""

    source_ip: str | None = None
    destination_ip: str | None = None
    source_port: int | None = None
    destination_port: int | None = None
    protocol: str | None = None
    threat_category: str | None = None
    severity: str | None = None
    risk_level: str | None = None
    min_anomaly_score: float | None = None
    max_anomaly_score: float | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    query_text: str | None = None
    alert_status: str | None = None
    incident_status: str | None = None


class _Terms:
    """Collects the conditions of the terms that are set."""

    def __init__(self):
        self.found: list[Column] = []

    def equal(self, column: str, value, upper: bool = False):
        if value is not None and value != "":
            value = value.strip() if isinstance(value, str) else value
            self.found.append(F.col(column) == (value.upper() if upper else value))
        return self

    def contains(self, column: str, value: str | None):
        if value:
            self.found.append(F.lower(column).like(like_pattern(value.lower().strip())))
        return self

    def between(self, column: str, low, high):
        if low is not None:
            self.found.append(F.col(column) >= low)
        if high is not None:
            self.found.append(F.col(column) <= high)
        return self

    def text(self, columns: list[str], value: str | None):
        if value:
            pattern = like_pattern(value.lower().strip())
            self.found.append(any_of([F.coalesce(F.lower(c).like(pattern), F.lit(False)) for c in columns]))
        return self


def match_predictions(df: DataFrame, f: HuntFilters, window: TimeRange) -> DataFrame:
    terms = (
        _Terms()
        .equal("source_ip", f.source_ip)
        .equal("destination_ip", f.destination_ip)
        .equal("source_port", f.source_port)
        .equal("destination_port", f.destination_port)
        .equal("protocol", f.protocol)
        .contains("predicted_threat", f.threat_category)
        .equal("risk_level", f.severity, upper=True)
        .equal("risk_level", f.risk_level, upper=True)
        .between("anomaly_score", f.min_anomaly_score, f.max_anomaly_score)
        .between("classification_confidence", f.min_confidence, f.max_confidence)
        .text(["predicted_threat", "anomaly_label", "source_ip", "destination_ip"], f.query_text)
    )
    return df.filter(window.contains("timestamp") & all_of(terms.found))


def match_alerts(df: DataFrame, f: HuntFilters, window: TimeRange) -> DataFrame:
    terms = (
        _Terms()
        .equal("source_ip", f.source_ip)
        .equal("destination_ip", f.destination_ip)
        .contains("threat_label", f.threat_category)
        .equal("severity", f.severity, upper=True)
        .equal("status", f.alert_status, upper=True)
        .text(["threat_label", "alert_type", "source_ip", "destination_ip"], f.query_text)
    )
    return df.filter(window.contains("timestamp") & all_of(terms.found))


def match_incidents(df: DataFrame, f: HuntFilters, window: TimeRange) -> DataFrame:
    terms = (
        _Terms()
        .equal("source_ip", f.source_ip)
        .contains("category", f.threat_category)
        .equal("severity", f.severity, upper=True)
        .equal("status", f.incident_status, upper=True)
        .text(["incident_key", "title", "description", "category"], f.query_text)
    )
    return df.filter(window.contains("created_at") & all_of(terms.found))


def prediction_items(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "timestamp", "source_ip", "destination_ip", "source_port", "destination_port", "protocol",
        or_default("predicted_threat", "BENIGN").alias("predicted_threat"),
        or_default("risk_level", "LOW").alias("risk_level"),
        F.round(or_default("anomaly_score", 0.0), 4).alias("anomaly_score"),
        F.round(or_default("classification_confidence", 0.0), 4).alias("classification_confidence"),
        F.coalesce("intrusion_flag", F.lit(False)).alias("intrusion_flag"),
    )


def alert_items(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "timestamp", "prediction_id", "severity", "status",
        or_default("alert_type", "SECURITY_ALERT").alias("alert_type"),
        or_default("threat_label", "Anomaly").alias("threat_label"),
        F.round(or_default("confidence", 0.0), 4).alias("confidence"),
        "source_ip", "destination_ip",
    )


def incident_items(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "incident_key", "title", "severity", "status", "category", "source_ip",
        "assigned_to", "created_at", "updated_at",
    )


def hunt_predictions(df, f: HuntFilters, window: TimeRange, limit: int | None = 50, offset: int = 0) -> DataFrame:
    found = match_predictions(df, f, window)
    return prediction_items(page(found, "timestamp", limit, offset))


def hunt_alerts(df, f: HuntFilters, window: TimeRange, limit: int | None = 50, offset: int = 0) -> DataFrame:
    found = match_alerts(df, f, window)
    return alert_items(page(found, "timestamp", limit, offset))


def hunt_incidents(df, f: HuntFilters, window: TimeRange, limit: int | None = 50, offset: int = 0) -> DataFrame:
    found = match_incidents(df, f, window)
    return incident_items(page(found, "created_at", limit, offset))


def query_counts(predictions, alerts, incidents, f: HuntFilters, window: TimeRange) -> DataFrame:
    rows = F.count(F.lit(1))
    return one_row(
        match_predictions(predictions, f, window).agg(rows.alias("total_predictions")),
        match_alerts(alerts, f, window).agg(rows.alias("total_alerts")),
        match_incidents(incidents, f, window).agg(rows.alias("total_incidents")),
    )


# --- correlation --------------------------------------------------------------


def _insight(kind: str, title: Column, text: Column, events: Column, confidence: Column) -> list[Column]:
    return [
        F.lit(kind).alias("correlation_type"),
        title.alias("title"),
        text.alias("description"),
        events.cast("long").alias("event_count"),
        confidence.alias("confidence"),
    ]


def network_convergence(found: DataFrame) -> DataFrame:
    """Sources with two or more hits, with the distinct ports they went for.

    Counted per (source, port) first: the list per source holds each port once,
    so it never exceeds the 65 536 port numbers.
    """
    per_port = found.filter(known_source()).groupBy("source_ip", "destination_port").agg(
        F.count(F.lit(1)).alias("n")
    )
    real_port = F.when(F.col("destination_port") != 0, F.col("destination_port"))
    return (
        per_port.groupBy("source_ip")
        .agg(F.sum("n").alias("event_count"), F.array_sort(F.collect_set(real_port)).alias("ports"))
        .filter(F.col("event_count") >= V.CONVERGENCE_HITS)
        .select(
            "source_ip",
            "event_count",
            "ports",
            F.when(F.col("event_count") >= V.CONVERGENCE_HIGH_HITS, "HIGH").otherwise("MEDIUM").alias("confidence"),
        )
    )


def convergence_insights(found: DataFrame) -> DataFrame:
    ports = F.when(F.size("ports") > 0, F.array_join("ports", ", ")).otherwise("N/A")
    return network_convergence(found).select(
        *_insight(
            "NETWORK_CONVERGENCE",
            F.format_string(V.CONVERGENCE_TITLE, "source_ip"),
            F.format_string(V.CONVERGENCE_TEXT, F.col("source_ip"), F.col("event_count"), ports),
            F.col("event_count"),
            F.col("confidence"),
        )
    )


def case_insights(incidents: DataFrame) -> DataFrame:
    newest = page(incidents, "created_at", V.CASE_INSIGHTS)
    return newest.select(
        *_insight(
            "CASE_CORRELATION",
            F.format_string(V.CASE_TITLE, "incident_key"),
            F.format_string(V.CASE_TEXT, "title", "severity", "status"),
            F.lit(1),
            F.lit("HIGH"),
        )
    )


def _span_seconds() -> Column:
    return F.timestamp_diff("MICROSECOND", F.col("first"), F.col("last")) / 1e6


def burst_insights(found: DataFrame) -> DataFrame:
    """One row when the whole result lies within ten minutes."""
    total = found.agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    span = _span_seconds()
    return (
        total.withColumn("span", span)
        .filter((F.col("n") >= V.BURST_HITS) & (F.col("span") > 0) & (F.col("span") <= V.BURST_SECONDS))
        .select(
            *_insight(
                "TEMPORAL_BURST",
                F.lit(V.BURST_TITLE),
                F.format_string(V.BURST_TEXT, F.col("n"), F.floor(F.col("span") / 60)),
                F.col("n"),
                F.lit("HIGH"),
            )
        )
    )


def correlations(predictions: DataFrame, incidents: DataFrame) -> DataFrame:
    """All insights over the whole filtered sets (pass a page to limit them to it)."""
    return (
        convergence_insights(predictions)
        .unionByName(case_insights(incidents))
        .unionByName(burst_insights(predictions))
    )


def source_bursts(found: DataFrame, seconds: int = V.BURST_SECONDS) -> DataFrame:
    """Per source and window of ten minutes: three or more hits, not all at one instant."""
    return (
        found.filter(known_source())
        .groupBy("source_ip", F.window("timestamp", f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        .filter((F.col("event_count") >= V.BURST_HITS) & (F.col("first") < F.col("last")))
        .select("source_ip", F.col("w.start").alias("window_start"), "event_count", _span_seconds().alias("span_seconds"))
    )


# --- summary ------------------------------------------------------------------


def hunting_summary(predictions: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    return one_row(
        predictions.agg(
            rows.alias("total_flows_investigated"), count_if(is_threat()).alias("total_threat_detections")
        ),
        predictions.filter(F.col("source_ip").isNotNull()).agg(
            F.count_distinct("source_ip").alias("unique_source_ips")
        ),
        alerts.agg(count_if(F.col("status").isin(V.OPEN_ALERT_STATUSES)).alias("total_active_alerts")),
        incidents.agg(count_if(F.col("status") != "RESOLVED").alias("total_open_incidents")),
    )


def top_values(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """The n most frequent values; ties go to the smaller value."""
    return (
        df.groupBy(F.col(column).alias(name))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_last(name))
        .limit(n)
    )


def top_threats(predictions: DataFrame, n: int = 5) -> DataFrame:
    return top_values(predictions.filter(F.col("predicted_threat") != V.BENIGN), "predicted_threat", "threat", n)


def top_sources(predictions: DataFrame, n: int = 5) -> DataFrame:
    return top_values(predictions.filter(F.col("source_ip").isNotNull()), "source_ip", "source_ip", n)


# --- source profile -----------------------------------------------------------


def _sightings(predictions: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return (
        predictions.filter(known_source())
        .select("source_ip", F.col("timestamp").alias("at"), F.lit("P").alias("entity"),
                or_default("predicted_threat", "BENIGN").alias("threat"), or_default("risk_level", "LOW").alias("severity"))
        .unionByName(
            alerts.filter(known_source()).select(
                "source_ip", F.col("timestamp").alias("at"), F.lit("A").alias("entity"),
                or_default("threat_label", "Anomaly").alias("threat"), or_default("severity", "UNKNOWN").alias("severity"))
        )
        .unionByName(
            incidents.filter(known_source()).select(
                "source_ip", F.col("created_at").alias("at"), F.lit("I").alias("entity"),
                nothing.alias("threat"), nothing.alias("severity"))
        )
    )


def source_profile(predictions: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """First and last sighting, observation count, ports and protocols per source."""
    seen = (
        _sightings(predictions, alerts, incidents)
        .groupBy("source_ip")
        .agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("total_observations"))
    )
    targets = (
        predictions.filter(known_source())
        .groupBy("source_ip", "destination_port", "protocol")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source_ip")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("destination_port") != 0, F.col("destination_port")))).alias("destination_ports"),
            F.array_sort(F.collect_set(F.when(F.col("protocol") != "", F.col("protocol")))).alias("protocols"),
        )
    )
    return seen.join(targets, "source_ip", "left")


def source_threats(predictions: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    seen = _sightings(predictions, alerts, incidents).filter(F.col("threat").isNotNull())
    return seen.groupBy("source_ip", "threat").agg(F.count(F.lit(1)).alias("count"))


def source_severities(predictions: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    seen = _sightings(predictions, alerts, incidents).filter(F.col("severity").isNotNull())
    return seen.groupBy("source_ip", "severity").agg(F.count(F.lit(1)).alias("count"))


def source_destinations(predictions: DataFrame, n: int = V.TOP_DESTINATIONS) -> DataFrame:
    """The n most contacted (address, port) pairs of every source."""
    pairs = (
        predictions.filter(known_source())
        .groupBy(
            "source_ip",
            or_default("destination_ip", "Unknown").alias("destination_ip"),
            F.coalesce("destination_port", F.lit(0)).alias("destination_port"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = [F.desc("count"), F.asc("destination_ip"), F.asc("destination_port")]
    return newest_per_group(pairs, ["source_ip"], order, n)


def first_seen_gap(predictions: DataFrame) -> DataFrame:
    return (
        predictions.filter(known_source())
        .groupBy("source_ip")
        .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        .select("source_ip", _span_seconds().alias("span_seconds"))
    )


def source_timeline(predictions: DataFrame, alerts: DataFrame, incidents: DataFrame, source_ip: str | None = None) -> DataFrame:
    """Flows, alerts and cases of a source (or of all) as one list of events."""
    mine = F.col("source_ip") == source_ip if source_ip else known_source()
    port = F.col("destination_port")
    target = F.when(port.isNotNull() & (port != 0), F.concat_ws(":", "destination_ip", port)).otherwise(F.col("destination_ip"))

    def event(df: DataFrame, kind: str, at: str, severity: str, destination: Column, text: Column) -> DataFrame:
        return df.filter(mine).select(
            F.col(at).alias("timestamp"), F.lit(kind).alias("event_type"), F.col(severity).alias("severity"),
            F.col("source_ip").alias("source"), destination.alias("destination"),
            F.lit(kind).alias("resource_type"), F.col("id").cast("string").alias("resource_id"), text.alias("description"),
        )

    events = (
        event(predictions, "PREDICTION", "timestamp", "risk_level", target,
              F.format_string(V.EVENT_FLOW_TEXT, "predicted_threat", "risk_level", "anomaly_score"))
        .unionByName(event(alerts, "ALERT", "timestamp", "severity", F.col("destination_ip"),
                           F.format_string(V.EVENT_ALERT_TEXT, "id", "severity", "threat_label")))
        .unionByName(event(incidents, "INCIDENT", "created_at", "severity", F.lit(None).cast("string"),
                           F.format_string(V.EVENT_INCIDENT_TEXT, "incident_key", "title")))
    )
    return events.orderBy(F.desc("timestamp")) if source_ip else events


# --- history ------------------------------------------------------------------

#: What a search can be given: its terms, its time range, its page.
HISTORY_FILTERS = (*HuntFilters.__dataclass_fields__, "time_range", "start_datetime", "end_datetime", "limit", "offset")


def history_entries(searches: DataFrame) -> DataFrame:
    """Summary line and filter JSON of remembered searches."""

    def part(prefix: str, column: str, suffix: str = "") -> Column:
        c = F.col(column)
        if column == "destination_port":
            given = c.isNotNull() & (c != 0)
        else:
            given = c.isNotNull() & (c != "")
        return F.when(given, F.concat(F.lit(prefix), c, F.lit(suffix)))

    label = F.lit(V.TIME_RANGES["24h"][1])
    for name, (_, text) in V.TIME_RANGES.items():
        label = F.when(F.col("time_range") == name, text).otherwise(label)
    summary = F.concat_ws(
        ", ",
        part("src:", "source_ip"),
        part("threat:", "threat_category"),
        part("sev:", "severity"),
        part("port:", "destination_port"),
        part("q:'", "query_text", "'"),
        label,
    )
    # every filter that was set; NULL ones are left out, so a search can be repeated as it was
    filters = F.to_json(F.struct(*[c for c in HISTORY_FILTERS if c in searches.columns]))
    return searches.select(
        "id", "timestamp", "username",
        F.substring(summary, 1, V.HISTORY_SUMMARY_CHARS).alias("filter_summary"),
        filters.alias("filters_json"),
        "result_count",
    )


def history_trim(history: DataFrame, keep: int = V.MAX_HISTORY_ROWS) -> DataFrame:
    order = [F.desc("timestamp"), F.desc("id")]
    return newest_per_group(history, ["username"], order, keep).drop("place")


def history_list(history: DataFrame, username: str, limit: int | None = 20) -> DataFrame:
    """Newest searches of one user; unreadable filter JSON becomes an empty map."""
    mine = history.filter(F.col("username") == username)
    filters = F.coalesce(
        F.from_json("filters_json", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    return page(mine, "timestamp", limit).select(
        "id", "timestamp", "username", "filter_summary", filters.alias("filters"), "result_count"
    )
