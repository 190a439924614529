"""Incident cases: links, details, timelines, creation, assignment, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import blank_as_null, iso, or_default
from vigilflow.functions.network import canonical_ip
from vigilflow.functions.skew import join_facts
from vigilflow.functions.triage import risk_reasons
from vigilflow.operators.paging import newest_per_group
from vigilflow.schemas import conform
from vigilflow.session import settle


#: Dates of an intelligence entry, as ISO text.
SEEN = ("first_seen", "last_seen")


def active(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("status").isin(V.ACTIVE_INCIDENT_STATUSES))


def active_incident_by_alert(incidents: DataFrame, incident_alerts: DataFrame) -> DataFrame:
    """(alert, case) for every alert that already belongs to an active case."""
    return incident_alerts.join(
        active(incidents).select(F.col("id").alias("incident_id"), "incident_key", "status"), "incident_id"
    ).select("alert_id", "incident_id", "incident_key", "status")


def free_requests(requests: DataFrame, incidents: DataFrame, incident_alerts: DataFrame) -> DataFrame:
    """Requests whose alert has no active case yet."""
    taken = active_incident_by_alert(incidents, incident_alerts).select("alert_id")
    return requests.join(taken, "alert_id", "left_anti")


def link_counts(incidents: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """One column per link table; each is counted per case before it is joined."""
    out = incidents
    for name, bridge in links.items():
        per_case = bridge.groupBy(F.col("incident_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(per_case, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def incident_linked_counts(incidents, incident_alerts, incident_predictions, incident_notes) -> DataFrame:
    return link_counts(
        incidents,
        {
            "alerts_count": incident_alerts,
            "predictions_count": incident_predictions,
            "notes_count": incident_notes,
        },
    )


def linked(bridge: DataFrame, key: str, entity: DataFrame) -> DataFrame:
    """Entity rows with the case they are linked to."""
    return bridge.join(entity.withColumnRenamed("id", key), key)


def detail_parts(
    incidents: DataFrame, alerts: DataFrame, predictions: DataFrame, notes: DataFrame,
    incident_alerts: DataFrame, incident_predictions: DataFrame,
) -> DataFrame:
    """The full contents of every case as (incident_id, part, item_id, item JSON).

    One row per linked item instead of one array per case: a case with a third
    of all alerts stays spread over the cluster.
    """

    def part(df: DataFrame, name: str, key: str, *columns: Column | str) -> DataFrame:
        return df.select(
            "incident_id", F.lit(name).alias("part"), F.col(key).alias("item_id"),
            F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("item"),
        )

    # cases are looked up by narrow rows: the texts, made last, are neither shuffled nor sorted
    known = incidents.select(F.col("id").alias("incident_id"))
    of_case = lambda df: df.join(known, "incident_id", "left_semi")
    existing = (
        part(linked(of_case(incident_alerts), "alert_id", alerts), "alert", "alert_id",
             "status", "severity", "threat_label", "anomaly_score", "confidence", iso("created_at").alias("created_at"))
        .unionByName(part(linked(of_case(incident_predictions), "prediction_id", predictions), "prediction", "prediction_id",
                          "predicted_threat", "risk_level", "anomaly_score", "classification_confidence", iso("timestamp").alias("timestamp")))
        .unionByName(part(of_case(notes), "note", "id", "incident_id", "author", "note", iso("created_at").alias("created_at")))
    )
    counts = {"alerts_count": incident_alerts, "predictions_count": incident_predictions, "notes_count": notes}
    head = link_counts(incidents, counts).withColumn("incident_id", F.col("id"))
    stamps = ("created_at", "updated_at", "acknowledged_at", "investigation_started_at", "resolved_at")
    return existing.unionByName(
        part(
            head, "incident", "id", "incident_key", "title", "description", "severity", "status", "category", "source_ip", "assigned_to",
            "created_by", *[iso(c).alias(c) for c in stamps], "resolution_summary", *counts,
        )
    )


def alert_with_prediction(alerts: DataFrame, predictions: DataFrame) -> DataFrame:
    extra = predictions.select(
        F.col("id").alias("prediction_id"), "anomaly_label", "predicted_threat", "destination_port", "protocol", "total_bytes"
    )
    return join_facts(alerts, extra, "prediction_id")


def audit_for_resource(audit: DataFrame, entity: DataFrame, resource_type: str | None, key: str = "id") -> DataFrame:
    """Audit rows of each entity; without a resource type ids of all kinds match."""
    rows = audit if resource_type is None else audit.filter(F.col("resource_type") == resource_type)
    ids = entity.select(F.col(key).alias("entity_id"), F.col(key).cast("string").alias("resource_id"))
    return rows.join(ids, "resource_id")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def asset_context(predictions: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select(
        F.col("ip_address").alias("destination_ip"), "hostname", "environment", "criticality_level"
    )
    return join_facts(predictions, known, "destination_ip")


# --- intelligence ---------------------------------------------------------------


def intel_enrich(df: DataFrame, column: str, intel: DataFrame, normalise: bool = False) -> DataFrame:
    """Reputation per indicator; a miss gives UNKNOWN, 0.0 and an empty list.

    Addresses meet in their canonical text on both sides; what is no address finds
    nothing.  ``normalise`` instead lower-cases and trims (domains and file
    hashes).  Of several entries of an indicator the first by its text counts.
    """
    canonical = (lambda c: F.lower(F.trim(c))) if normalise else canonical_ip
    facts = [*[c for c in ("reputation", "confidence", "categories", "notes") if c in intel.columns], *SEEN]
    known = intel.withColumns({c: F.lit(None).cast("string") for c in SEEN if c not in intel.columns})
    entries = (
        known.withColumn("_key", canonical(F.col("indicator"))).filter("_key IS NOT NULL")
        .groupBy("_key").agg(F.min_by(F.struct(*facts), "indicator").alias("_e"))
        .select("_key", F.lit(True).alias("_hit"), *[F.col(f"_e.{c}").alias(c if c not in SEEN else f"_{c}") for c in facts])
    )
    joined = join_facts(df.withColumn("_key", canonical(F.col(column))), entries, "_key")
    return joined.select(
        *df.columns,
        F.coalesce("_hit", F.lit(False)).alias("found"),
        F.lit(V.INTEL_SOURCE).alias("intel_source"),
        F.coalesce("reputation", F.lit(V.INTEL_UNKNOWN)).alias("reputation"),
        F.coalesce("confidence", F.lit(0.0)).alias("intel_confidence"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("intel_categories"),
        *[F.col(f"_{c}").alias(f"intel_{c}") for c in SEEN],
        F.when(F.col("_hit"), F.col("notes")).otherwise(V.INTEL_MISS_NOTE).alias("intel_notes"),
    )


def prediction_investigation(
    predictions: DataFrame, alerts: DataFrame, audit: DataFrame, intel: DataFrame, newest: int = V.TOP_AUDIT_ROWS
) -> DataFrame:
    """Scores, reasons, telemetry, first alert, newest audit rows and reputation of every prediction."""
    predictions, alerts = conform(predictions, "predictions"), conform(alerts, "alerts")
    of_alert = ("status", "severity", "alert_type", "threat_label", "anomaly_score", "confidence", "recommended_action", "created_at", "acknowledged_at", "resolved_at")
    first_alert = alerts.groupBy("prediction_id").agg(F.min_by(F.struct("id", *of_alert), "id").alias("a"))
    about = audit.filter(F.col("resource_type") == "PREDICTION")
    rows = newest_per_group(about, ["resource_id"], [F.desc("timestamp"), F.desc("id")], newest)
    # at most ``newest`` rows per list
    trail = rows.groupBy(F.col("resource_id").alias("_rid")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "id", "action", "outcome", "username", "timestamp"))),
            lambda r: F.struct(*[r[c].alias(c) for c in ("id", "action", "outcome", "username", "timestamp")]),
        ).alias("related_audit")
    )
    base = (
        predictions.withColumn("_rid", F.col("id").cast("string"))
        .join(first_alert.withColumnRenamed("prediction_id", "id"), "id", "left")
        .join(trail, "_rid", "left")
    )
    telemetry = (
        "destination_ip", "source_port", "destination_port", "protocol", "flow_duration", "total_forward_packets", "total_backward_packets", "total_bytes"
    )
    raw = F.col("raw_flow_data")
    is_object = F.coalesce(F.from_json(raw, "map<string, string>").isNotNull() & F.trim(raw).startswith("{"), F.lit(False))
    picked = base.select(
        "id", "timestamp", "predicted_threat", "risk_level", "anomaly_score", "classification_confidence", "intrusion_flag", "source_ip", *telemetry,
        F.when(is_object, raw).alias("raw_features"), risk_reasons().alias("risk_reasons"),
        F.col("a.id").alias("alert_id"), *[F.col(f"a.{c}").alias(c if c.startswith("alert") else f"alert_{c}") for c in of_alert],
        F.coalesce("related_audit", F.array().cast("array<struct<id:bigint,action:string,outcome:string,username:string,timestamp:timestamp_ntz>>")).alias("related_audit"),
    )
    return intel_enrich(picked, "source_ip", intel)


# --- creation and assignment ------------------------------------------------------


def check_assignee(requests: DataFrame, users: DataFrame, column: str = "assigned_to") -> DataFrame:
    """Adds ``assignee_problem``: NULL when the operator may take cases."""
    known = users.select(F.col("username").alias("_user"), "role", "is_active")
    named = requests.withColumn("_user", F.trim(F.col(column)))
    joined = join_facts(named, known.withColumn("_known", F.lit(True)), "_user")
    problem = (
        F.when(blank_as_null(column).isNull(), None)
        .when(F.col("_known").isNull(), "unknown operator")
        .when(~F.col("is_active"), "inactive operator")
        .when(F.upper("role") == "VIEWER", "viewer role")
    )
    return joined.withColumn("assignee_problem", problem).drop("_user", "_known", "role", "is_active")


def inherit(requests: DataFrame, alerts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Severity, category and source: request, else its alert, else its prediction."""
    a = alerts.select(
        F.col("id").alias("alert_id"), F.lit(True).alias("alert_found"), F.col("severity").alias("a_severity"),
        F.col("threat_label").alias("a_category"), F.col("source_ip").alias("a_source"),
        F.col("prediction_id").alias("alert_prediction_id"),
    )
    p = predictions.select(
        F.col("id").alias("prediction_id"), F.lit(True).alias("prediction_found"), F.col("risk_level").alias("p_severity"),
        F.col("predicted_threat").alias("p_category"), F.col("source_ip").alias("p_source"),
    )
    # spread by the numbers of a request, so that columns which nothing reads stay behind
    own = [c for c in ("request_id", "alert_id", "prediction_id") if c in requests.columns]
    both = join_facts(join_facts(requests, a, "alert_id", spread_by=own), p, "prediction_id", spread_by=own)
    found_alert = F.coalesce("alert_found", F.lit(False))
    found_prediction = F.coalesce("prediction_found", F.lit(False))

    def inherited(asked: str, from_alert: str, from_prediction: str, default: str) -> Column:
        return (
            F.when(blank_as_null(asked).isNotNull(), F.col(asked))
            .when(found_alert, F.col(from_alert))
            .when(found_prediction, F.col(from_prediction))
            .otherwise(default)
        )

    return both.select(
        *requests.columns,
        found_alert.alias("alert_found"),
        found_prediction.alias("prediction_found"),
        "alert_prediction_id",
        F.upper(inherited("severity", "a_severity", "p_severity", V.DEFAULT_SEVERITY)).alias("final_severity"),
        inherited("category", "a_category", "p_category", V.DEFAULT_CATEGORY).alias("final_category"),
        F.coalesce(blank_as_null("a_source"), blank_as_null("p_source")).alias("final_source"),
    )


def prediction_links(created: DataFrame) -> DataFrame:
    """Case-to-prediction links: the one asked for and the one behind the alert."""
    return (
        created.select("incident_key", "prediction_id")
        .unionByName(created.select("incident_key", F.col("alert_prediction_id").alias("prediction_id")))
        .filter(F.col("prediction_id").isNotNull())
        .distinct()
    )


def number_cases(requests: DataFrame, existing: DataFrame, order: list[str], at: str = "created_at") -> DataFrame:
    """``INC-YYYY-NNNNNN`` keys that continue after the highest key of each year.

    The rows are range-partitioned by the whole order (it ends in a unique
    column, so even one busy instant is split), written once, numbered inside
    each part, and each part starts after the rows of the parts before it.
    """
    spark = requests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        requests.withColumn("_year", F.year(at))
        .repartitionByRange(parts, "_year", *order)
        .withColumn("_part", F.spark_partition_id())
    )
    placed = settle(ranged, "case-numbers")
    counts = placed.groupBy("_year", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per part and year: at most ``parts`` rows per window
    before = Window.partitionBy("_year").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_year", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    key_form = r"^INC-(\d{4})-(\d+)$"
    used = (
        existing.select(
            F.regexp_extract("incident_key", key_form, 1).alias("y"), F.regexp_extract("incident_key", key_form, 2).alias("s")
        )
        .filter(F.col("y") != "")
        .groupBy(F.col("y").cast("int").alias("_year"))
        .agg(F.max(F.col("s").cast("long")).alias("_used"))
    )
    place = F.row_number().over(Window.partitionBy("_year", "_part").orderBy(*order))
    numbered = placed.withColumn("_place", place).join(starts, ["_year", "_part"]).join(used, "_year", "left")
    serial = F.coalesce("_used", F.lit(0)) + F.col("_start") + F.col("_place")
    key = F.format_string("INC-%d-%06d", "_year", serial)
    return numbered.withColumn("incident_key", key).drop("_year", "_part", "_place", "_start", "_used")


def create_incidents(
    requests: DataFrame, incidents: DataFrame, incident_alerts: DataFrame,
    alerts: DataFrame, predictions: DataFrame, users: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(accepted with keys, refused with a reason) for a batch of requests.

    Of several good requests for one alert only the first is accepted.
    """
    filled = check_assignee(inherit(requests, alerts, predictions), users)
    taken = active_incident_by_alert(incidents, incident_alerts).select("alert_id", F.lit(True).alias("_taken")).distinct()
    has_alert = F.col("alert_id").isNotNull()
    early = F.when(has_alert & ~F.col("alert_found"), "alert not found").when(F.col("_taken"), "active incident exists")
    late = (
        F.when(F.col("prediction_id").isNotNull() & ~F.col("prediction_found"), "prediction not found")
        .when(~F.col("final_severity").isin(V.SEVERITIES), "invalid severity")
        .otherwise(F.col("assignee_problem"))
    )
    place = F.struct("created_at", "request_id")
    judged = join_facts(filled, taken, "alert_id").withColumn("_early", early).withColumn("_late", late)
    # read for the firsts, the numbers and the refusals
    judged = settle(judged.drop("_taken"), "judged")
    good = F.col("_early").isNull() & F.col("_late").isNull()
    firsts = judged.filter(has_alert & good).groupBy("alert_id").agg(F.min(place).alias("_first"))
    reason = F.coalesce("_early", F.when(F.col("_first") < place, "active incident exists"), F.col("_late"))
    judged = (
        join_facts(judged, firsts, "alert_id")
        .withColumn("reason", reason)
        .drop("_first", "_early", "_late", "assignee_problem")
    )
    accepted = number_cases(judged.filter(F.col("reason").isNull()).drop("reason"), incidents, ["created_at", "request_id"])
    accepted = accepted.select(
        "request_id", "incident_key", F.trim("title").alias("title"), F.col("final_severity").alias("severity"),
        F.lit("OPEN").alias("status"), F.col("final_category").alias("category"), F.col("final_source").alias("source_ip"),
        F.trim("assigned_to").alias("assigned_to"), "alert_id", "prediction_id", "alert_prediction_id", "created_at",
    )
    return accepted, judged.filter(F.col("reason").isNotNull()).select("request_id", "alert_id", "reason")


def assign_incidents(incidents: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """Result of each (incident_id, assigned_to) request."""
    checked = check_assignee(requests, users)
    ids = incidents.select(F.col("id").alias("incident_id"), "incident_key")
    joined = checked.join(ids, "incident_id", "left")
    reason = F.when(F.col("incident_key").isNull(), "incident not found").otherwise(F.col("assignee_problem"))
    return joined.select(
        "incident_id", "incident_key", F.trim("assigned_to").alias("assigned_to"),
        reason.isNull().alias("accepted"), reason.alias("reason"),
    )


def append_notes(incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """Trimmed notes of existing cases; empty ones are refused."""
    ids = incidents.select(F.col("id").alias("incident_id"), F.lit(True).alias("_known"))
    # the whole-whitespace class, since a note may be line breaks only
    text = F.regexp_replace("note", r"^\s+|\s+$", "")
    joined = requests.join(ids, "incident_id", "left").withColumn("note", text)
    reason = F.when(F.col("_known").isNull(), "incident not found").when(F.col("note") == "", "empty note")
    return joined.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_known")


# --- timelines --------------------------------------------------------------------


def _lifecycle(incidents: DataFrame, entries: list[tuple[str, str, Column, Column]], keep: list[str] = ()) -> DataFrame:
    """One row per stamped lifecycle column, by a single pass over the cases."""
    stacked = F.array(
        *[
            F.struct(F.lit(kind).alias("event_type"), F.col(at).alias("timestamp"), actor.alias("actor"), text.alias("summary"))
            for kind, at, actor, text in entries
        ]
    )
    return (
        incidents.select(F.col("id").alias("incident_id"), *keep, F.explode(stacked).alias("e"))
        .select("incident_id", *keep, "e.*")
        .filter(F.col("timestamp").isNotNull())
    )


def incident_timeline(
    incidents: DataFrame, alerts: DataFrame, predictions: DataFrame, notes: DataFrame,
    incident_alerts: DataFrame, incident_predictions: DataFrame, audit: DataFrame, incident_id: int | None = None,
) -> DataFrame:
    """Everything that happened to a case (or to all cases)."""
    if incident_id is not None:
        incidents = incidents.filter(F.col("id") == incident_id)
    own = _lifecycle(
        incidents,
        [
            ("INCIDENT_CREATED", "created_at", F.col("created_by"), F.format_string(V.CASE_CREATED_TEXT, "incident_key", "severity")),
            ("INCIDENT_ACKNOWLEDGED", "acknowledged_at", or_default("assigned_to", "SOC Analyst"), F.lit(V.CASE_ACKNOWLEDGED_TEXT)),
            ("INVESTIGATION_STARTED", "investigation_started_at", or_default("assigned_to", "SOC Analyst"), F.lit(V.CASE_INVESTIGATION_TEXT)),
            ("INCIDENT_RESOLVED", "resolved_at", or_default("assigned_to", "SOC Lead"),
             F.format_string(V.CASE_RESOLVED_TEXT, or_default("resolution_summary", "Remediated"))),
        ],
    )
    ids = incidents.select(F.col("id").alias("incident_id"), F.col("created_at").alias("case_created_at"))

    def event(df: DataFrame, kind: Column, at: Column, actor: Column, text: Column) -> DataFrame:
        return df.select("incident_id", kind.alias("event_type"), at.alias("timestamp"), actor.alias("actor"), text.alias("summary"))

    engine = F.lit("DETECTION_ENGINE")
    note = F.col("note")
    note_text = F.when(
        F.length(note) > V.NOTE_PREVIEW_CHARS,
        F.format_string(V.CASE_NOTE_LONG_TEXT, F.substring(note, 1, V.NOTE_PREVIEW_CHARS)),
    ).otherwise(F.format_string(V.CASE_NOTE_TEXT, note))
    about = audit.filter(F.col("action").isin(V.INCIDENT_AUDIT_ACTIONS) & (F.col("resource_type") == "INCIDENT"))
    with_id = about.withColumn("incident_id", F.expr("try_cast(resource_id AS bigint)"))
    parts = [
        event(notes.join(ids, "incident_id"), F.lit("INCIDENT_NOTE_ADDED"), F.col("created_at"), F.col("author"), note_text),
        event(linked(incident_alerts, "alert_id", alerts).join(ids, "incident_id"), F.lit("LINKED_ALERT"),
              F.coalesce("created_at", "case_created_at"), engine,
              F.format_string(V.CASE_ALERT_TEXT, "alert_id", "threat_label", "severity")),
        event(linked(incident_predictions, "prediction_id", predictions).join(ids, "incident_id"), F.lit("LINKED_PREDICTION"),
              F.col("timestamp"), engine, F.format_string(V.CASE_PREDICTION_TEXT, "prediction_id", "predicted_threat", "risk_level")),
        event(with_id.join(ids, "incident_id"), F.col("action"), F.col("timestamp"), or_default("username", "SYSTEM"),
              F.format_string(V.CASE_AUDIT_TEXT, "action")),
    ]
    for p in parts:
        own = own.unionByName(p)
    return own.orderBy(F.desc("timestamp")) if incident_id is not None else own


def evidence_timeline(incidents: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The four lifecycle events of a case, as written into evidence, with the columns ``keep``."""
    return _lifecycle(
        incidents,
        [
            ("INCIDENT_CREATED", "created_at", F.col("created_by"), F.format_string(V.EVIDENCE_CREATED_TEXT, "incident_key")),
            ("INCIDENT_ACKNOWLEDGED", "acknowledged_at", F.coalesce(blank_as_null("assigned_to"), F.col("created_by")), F.lit(V.EVIDENCE_ACKNOWLEDGED_TEXT)),
            ("INVESTIGATION_STARTED", "investigation_started_at", or_default("assigned_to", "SOC Operator"), F.lit(V.EVIDENCE_INVESTIGATION_TEXT)),
            ("INCIDENT_RESOLVED", "resolved_at", or_default("assigned_to", "SOC Operator"),
             F.format_string(V.EVIDENCE_RESOLVED_TEXT, or_default("resolution_summary", "Completed."))),
        ],
        keep,
    )


# --- purge ------------------------------------------------------------------------


def purge_cascade(doomed: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What is left of each child table once the ``doomed`` parent ids are gone."""
    ids = doomed.select("id").distinct()
    return {
        name: child.join(ids.withColumnRenamed("id", key), key, "left_anti")
        for name, (child, key) in children.items()
    }
