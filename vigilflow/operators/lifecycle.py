"""Alert and incident status changes for batches of requests.

Both state machines only move forward, so the outcome follows from the first
request of each kind.  Those firsts are plain ``min`` aggregates, which combine
on the map side: an alert with a third of all requests never has to be folded
row by row in one task, and its requests are spread when the firsts are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.skew import join_facts, join_facts_spread
from vigilflow.session import settle

# Requests of one entity are applied in (requested_at, request_id) order.
PLACE = ["requested_at", "request_id"]


def _place() -> Column:
    return F.struct(*PLACE)


def _first(target: str, extra: Column | None = None) -> Column:
    wanted = F.col("target") == target
    if extra is not None:
        wanted = wanted & extra
    return F.min(F.when(wanted, _place()))


def _before(a: Column, b: Column) -> Column:
    """a comes before b; a missing b is the end of time, a missing a never."""
    return a.isNotNull() & (b.isNull() | (a < b))


def _prepared(requests: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    target = F.upper(F.trim("target"))
    status = entities.select(F.col("id").alias(key), F.upper("status").alias("initial"))
    # written once: the firsts and the joins below all read it
    return settle(join_facts(requests.withColumn("target", target), status, key), "requests")


def alert_transitions(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each request with ``accepted`` and the status it met (``status_before``).

    A RESOLVED request is accepted when it is the first one and the alert was
    still open; an ACKNOWLEDGED request when the alert was NEW and it precedes
    the accepted RESOLVED one.
    """
    r = _prepared(requests, alerts, "alert_id")
    firsts = r.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.when(F.first("initial").isin("NEW", "ACKNOWLEDGED"), _first("RESOLVED")).alias("resolved"),
        F.when(F.first("initial") == "NEW", _first("ACKNOWLEDGED")).alias("first_ack"),
    )
    firsts = firsts.withColumn(
        "acked", F.when(_before(F.col("first_ack"), F.col("resolved")), F.col("first_ack"))
    ).drop("first_ack")
    joined = join_facts_spread(r, firsts, "alert_id", "_n")
    here = _place()
    before = (
        F.when(F.col("resolved") < here, "RESOLVED").when(F.col("acked") < here, "ACKNOWLEDGED").otherwise(F.col("initial"))
    )
    accepted = F.coalesce((here == F.col("resolved")) | (here == F.col("acked")), F.lit(False))
    return joined.select(
        "request_id", "alert_id", "target", "requested_at", before.alias("status_before"), accepted.alias("accepted"),
        F.when(accepted, None)
        .when(F.col("initial").isNull(), "alert not found")
        .when(before == F.col("target"), "already in this status")
        .when(before == "RESOLVED", "terminal status")
        .otherwise("invalid transition")
        .alias("reason"),
    )


def alert_state(alerts: DataFrame, judged: DataFrame) -> DataFrame:
    """Final status and stamps of every alert after the accepted requests."""
    done = judged.filter("accepted").groupBy(F.col("alert_id").alias("id")).agg(
        F.max(F.when(F.col("target") == "ACKNOWLEDGED", F.col("requested_at"))).alias("new_ack"),
        F.max(F.when(F.col("target") == "RESOLVED", F.col("requested_at"))).alias("new_resolved"),
    )
    joined = alerts.join(done, "id", "left")
    status = (
        F.when(F.col("new_resolved").isNotNull(), "RESOLVED")
        .when(F.col("new_ack").isNotNull(), "ACKNOWLEDGED")
        .otherwise(F.col("status"))
    )
    return joined.select(
        "id", status.alias("status"),
        F.coalesce("new_ack", "acknowledged_at").alias("acknowledged_at"),
        F.coalesce("new_resolved", "resolved_at").alias("resolved_at"),
    )


def incident_transitions(requests: DataFrame, incidents: DataFrame) -> DataFrame:
    """Each request with ``accepted``, the status it met and a reason.

    A valid resolve request (summary of at least five characters) is accepted
    from any open status, so the first one ends the case.  Before it: the first
    ACKNOWLEDGED leaves OPEN, then the first CONTAINED after that, and the first
    INVESTIGATING in between.
    """
    r = _prepared(requests, incidents, "incident_id")
    summary = F.length(F.regexp_replace(F.coalesce("resolution_summary", F.lit("")), r"^\s+|\s+$", ""))
    r = r.withColumn("usable", (F.col("target") != "RESOLVED") | (summary >= V.MIN_RESOLUTION_LENGTH))
    initial = F.first("initial")
    end = r.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.when(initial != "RESOLVED", _first("RESOLVED", F.col("usable"))).alias("resolved"),
        F.when(initial == "OPEN", _first("ACKNOWLEDGED")).alias("first_ack"),
    )
    end = end.withColumn("acked", F.when(_before(F.col("first_ack"), F.col("resolved")), F.col("first_ack"))).drop("first_ack")
    # requests that meet an acknowledged (or later) case
    here = _place()
    known = join_facts_spread(r, end, "incident_id", "_n").drop("_n")
    open_now = (F.col("resolved").isNull()) | (here < F.col("resolved"))
    past_ack = F.when(F.col("initial") == "OPEN", F.col("acked") < here).otherwise(F.col("initial") != "RESOLVED")
    live = settle(known.withColumn("live", F.coalesce(open_now & past_ack, F.lit(False))), "requests")
    middle = live.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.when(F.first("initial").isin("OPEN", "ACKNOWLEDGED", "INVESTIGATING"), _first("CONTAINED", F.col("live"))).alias("contained"),
        F.when(F.first("initial").isin("OPEN", "ACKNOWLEDGED"), _first("INVESTIGATING", F.col("live"))).alias("first_inv"),
    )
    middle = middle.withColumn(
        "investigated", F.when(_before(F.col("first_inv"), F.col("contained")), F.col("first_inv"))
    ).drop("first_inv")
    joined = join_facts_spread(live, middle, "incident_id", "_n")
    before = (
        F.when(F.col("resolved") < here, "RESOLVED")
        .when(F.col("contained") < here, "CONTAINED")
        .when(F.col("investigated") < here, "INVESTIGATING")
        .when(F.col("acked") < here, "ACKNOWLEDGED")
        .otherwise(F.col("initial"))
    )
    accepted = F.lit(False)
    for at in ("resolved", "contained", "investigated", "acked"):
        accepted = accepted | F.coalesce(here == F.col(at), F.lit(False))
    allowed = F.lit(False)
    for start, targets in V.INCIDENT_TRANSITIONS.items():
        allowed = allowed | ((before == start) & F.col("target").isin(targets or [""]))
    return joined.select(
        "request_id", "incident_id", "target", "requested_at", before.alias("status_before"), accepted.alias("accepted"),
        F.when(accepted, None)
        .when(F.col("initial").isNull(), "incident not found")
        .when(before == F.col("target"), "already in this status")
        .when(before == "RESOLVED", "terminal status")
        .when(~allowed, "invalid transition")
        .otherwise("resolution summary required")
        .alias("reason"),
    )
