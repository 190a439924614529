"""Streaming forms of the operators, with watermarks and bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilflow import fixed_values as V
from vigilflow.functions.expr import count_if
from vigilflow.operators import fitting, forest, isolation, quality, scoring
from vigilflow.operators.analytics import known_source, timeline_counters
from vigilflow.operators.paging import newest_first
from vigilflow.streaming.runner import each_batch


# --- scoring -------------------------------------------------------------------------


def score_stream(flows: DataFrame, payload: str, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Validate, score and store: predictions, alerts, push events, quarantine.

    Every batch overwrites its own folders, so a restarted batch leaves the same
    rows; readers take finished batches only.  The source is read and judged once
    per batch: both parts are split from a written table, of which two are kept.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("reasons", quality.payload_reasons(payload))
        place = f"{path}/judged/slot={batch_id % 2}"
        judged.write.mode("overwrite").parquet(place)
        good, bad = quality.split_valid(batch.sparkSession.read.schema(judged.schema).parquet(place))
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")
        scoring.persist_scored(score(good), path, batch_id)

    each_batch(flows, store, checkpoint)


def predict_stream(
    payloads: DataFrame, payload: str, fields: T.StructType, params: fitting.FittedParams, anomaly: isolation.IsolationModel,
    threat: forest.ThreatModel, path: str, checkpoint: str,
) -> None:
    """Raw JSON payloads (``id``, ``timestamp``, text) through validation, features, both models and triage.

    ``fields`` are the flow columns read from a payload; missing ones are NULL
    and filled as in the fit, unknown ones ignored.  Refused payloads go to
    ``quarantine`` with their reasons, the others as in ``score_stream``; every flow
    is scored by the same plan as ``scoring.unified_predict`` in batch.
    """

    absent = {c: F.lit(None).cast("string") for c in ("source_ip", "destination_ip") if c not in fields.fieldNames()}

    def score(good: DataFrame) -> DataFrame:
        flows = good.select("id", "timestamp", F.from_json(payload, fields).alias("_flow")).select("id", "timestamp", "_flow.*").withColumns(absent)
        return scoring.unified_predict(flows, params, anomaly, threat, ["id", "timestamp", "source_ip", "destination_ip"])

    score_stream(payloads, payload, score, path, checkpoint)


def session_counters(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Running totals; the state is a single row."""
    nothing = F.lit(None).cast("string")
    both = predictions.select(F.lit("prediction").alias("kind"), nothing.alias("severity")).unionByName(
        alerts.select(F.lit("alert").alias("kind"), F.upper("severity").alias("severity"))
    )
    kind, severity = F.col("kind"), F.col("severity")
    return both.groupBy().agg(
        count_if(kind == "prediction").alias("predictions"),
        count_if(kind == "alert").alias("alerts"),
        count_if(severity == "HIGH").alias("high_alerts"),
        count_if(severity == "CRITICAL").alias("critical_alerts"),
    )


def dedup(events: DataFrame, key: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def keep_latest(events: DataFrame, path: str, checkpoint: str, at: str = "timestamp", rows: int = V.LIVE_FEED_ROWS) -> None:
    """The newest rows of the whole stream; the last two versions are kept, in turn, in two folders."""
    spark = events.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        merged = top(batch)
        if batch_id > 0:
            # the version before this batch, also when the batch is repeated
            before = spark.read.parquet(f"{path}/slot={(batch_id - 1) % 2}").filter(F.col("version") == batch_id - 1)
            merged = top(merged.unionByName(before.select(*batch.columns)))
        versioned = merged.withColumn("version", F.lit(batch_id).cast("long"))
        versioned.write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    def top(df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["id"]).orderBy(*newest_first(at)).limit(rows)

    each_batch(events, merge, checkpoint)


def read_latest(spark, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("v")).scalar()
    return versions.filter(F.col("version") == newest).drop("version", "slot")


# --- windows --------------------------------------------------------------------------


def request_identity() -> Column:
    return F.when(F.col("username").isNotNull(), F.concat(F.lit("user:"), "username")).otherwise(
        F.concat(F.lit("ip:"), "ip_address")
    )


def request_tier() -> Column:
    return (
        F.when(F.col("action").startswith("LOGIN"), "login")
        .when(F.col("resource_type") == "PREDICTION", "predict")
        .when(F.col("request_method") == "GET", "read")
        .otherwise("mutation")
    )


def rate_violations(requests: DataFrame, window: str = "1 minute", limits: dict[str, int] | None = None) -> DataFrame:
    """Identities over the limit of their tier in a fixed window.

    Counts combine map-side, so one noisy identity costs one row per task.
    """
    limit = F.lit(None).cast("int")
    for tier, n in (limits or V.RATE_LIMITS).items():
        limit = F.when(F.col("tier") == tier, n).otherwise(limit)
    tagged = requests.select("timestamp", request_identity().alias("identity"), request_tier().alias("tier"))
    return (
        tagged.groupBy(F.window("timestamp", window).alias("w"), "identity", "tier")
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
        .select(F.col("w.start").alias("window_start"), "identity", "tier", "requests")
    )


def brute_force_logins(audit: DataFrame, window: str = "1 minute", limit: int = V.RATE_LIMITS["login"]) -> DataFrame:
    """Failed logins per address and user above the login limit."""
    return (
        audit.filter(F.col("action") == V.LOGIN_FAILURE)
        .groupBy(F.window("timestamp", window).alias("w"), "ip_address", "username")
        .agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") > limit)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ip_address", "username", "failures")
    )


def bursts(found: DataFrame, window: str = "10 minutes", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Three or more hits of a source in a fixed, sliding or session window."""
    span = F.session_window("timestamp", gap) if gap else F.window("timestamp", window, slide)
    return (
        found.filter(known_source())
        .groupBy(span.alias("w"), "source_ip")
        .agg(F.count(F.lit(1)).alias("event_count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        .filter((F.col("event_count") >= V.BURST_HITS) & (F.col("first") < F.col("last")))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source_ip", "event_count")
    )


def timeline(events: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Counters of tagged (timestamp, kind) events per bucket."""
    return (
        events.groupBy(F.window("timestamp", bucket).alias("w"))
        .agg(*timeline_counters())
        .withColumn("window_start", F.col("w.start"))
        .withColumn("window_end", F.col("w.end"))
        .drop("w")
    )


# --- state -----------------------------------------------------------------------------


def alert_states(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Current status per alert from a stream of status requests.

    The state per alert is the first request of each kind, a plain aggregate:
    late or reordered requests lead to the same status as the batch operator.
    """
    known = alerts.select(F.col("id").alias("alert_id"), F.upper("status").alias("initial"))
    tagged = requests.withColumn("target", F.upper(F.trim("target"))).join(known, "alert_id")
    place = F.struct("requested_at", "request_id")
    firsts = tagged.groupBy("alert_id", "initial").agg(
        F.min(F.when(F.col("target") == "ACKNOWLEDGED", place)).alias("ack"),
        F.min(F.when(F.col("target") == "RESOLVED", place)).alias("resolved"),
    )
    return alert_status(firsts)


def alert_status(firsts: DataFrame) -> DataFrame:
    """Status and times per alert from its ``initial`` status and first requests, ``ack`` and ``resolved``."""
    resolved = F.when(F.col("initial").isin(V.OPEN_ALERT_STATUSES), F.col("resolved"))
    acked = F.when(
        (F.col("initial") == "NEW") & F.col("ack").isNotNull() & (resolved.isNull() | (F.col("ack") < resolved)), F.col("ack")
    )
    return firsts.select(
        "alert_id",
        F.when(resolved.isNotNull(), "RESOLVED").when(acked.isNotNull(), "ACKNOWLEDGED").otherwise(F.col("initial")).alias("status"),
        acked["requested_at"].alias("acknowledged_at"),
        resolved["requested_at"].alias("resolved_at"),
    )
