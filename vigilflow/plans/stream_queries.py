"""Registered queries: streams run to the end of their input, beside batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilflow.functions.expr import iso as spark_iso
from vigilflow.operators import analytics as A, scoring
from vigilflow.plans.case_queries import ALERT_REQUESTS, ALERT_WALK, alert_requests, register_walk
from vigilflow.plans import training
from vigilflow.plans.hunting_queries import texts
from vigilflow.plans.model_queries import flow_rows
from vigilflow.plans.registry import query
from vigilflow.plans.views_sql import iso
from vigilflow.session import scratch_path, settle
from vigilflow.streaming import jobs, runner

DELAY, DELAY_SQL = "10 minutes", "INTERVAL 10 MINUTE"


def stream(t):
    return runner.StreamTables(t.spark, t.folder)


def plain(df, *columns):
    """Event times back to zone-less ISO text."""
    return df.withColumns({c: spark_iso(F.col(c).cast("timestamp_ntz")) for c in columns})


@query(
    "stream_score",
    f"SELECT id, {iso('timestamp')} AS timestamp, predicted_threat, risk_level, recommended_action FROM predictions",
    "predictions",
)
def stream_score(t):
    path = scratch_path(t.spark, "stream-score")
    flows = stream(t).domain.predictions.drop("risk_level", "recommended_action")
    jobs.score_stream(flows, "raw_flow_data", scoring.risk_triage, path, f"{path}-checkpoint")
    rows = scoring.read_persisted(t.spark, path, "predictions")
    return texts(rows.select("id", "timestamp", "predicted_threat", "risk_level", "recommended_action"), "timestamp")


@query(
    "stream_predict",
    """SELECT flow_id AS id, accepted, NOT accepted AS quarantined, CASE WHEN accepted THEN true END AS same_class, CASE WHEN accepted THEN true END AS same_score, CASE WHEN accepted THEN true END AS same_level
    FROM (SELECT flow_id, isfinite(flow_bytes_per_s) AND coalesce(down_per_up_ratio, '') <> 'Infinity' AS accepted FROM flows)""",
    "flows",
)
def stream_predict(t):
    """Flows sent as JSON over several files, judged by models in the stream; beside each the batch answer."""
    spark = t.spark
    models = training.train(flow_rows(t), ["flow_id"])
    path = scratch_path(spark, "stream-predict")
    # rows may share a flow's id, so each is sent under a number of its own; payloads hold no colons
    flows = t.domain.flows.withColumns({"id": F.expr("concat(flow_id, '/', monotonically_increasing_id())"), "captured_at": F.date_format("captured_at", "yyyy-MM-dd")})
    flows = settle(flows, "flows")
    sent = flows.drop("id", "flow_id", "label")
    text = F.to_json(F.struct(*sent.columns)).alias("payload")
    # two batches, whose files are a task each: no fewer tasks than cores
    files = max(4, 2 * spark.sparkContext.defaultParallelism)
    flows.select("id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), text).repartition(files, "id").write.parquet(f"{path}/sent")
    live = spark.readStream.schema("id string, timestamp timestamp_ntz, payload string").option("maxFilesPerTrigger", files // 2).parquet(f"{path}/sent")
    jobs.predict_stream(live, "payload", sent.schema, models.params, models.anomaly, models.threat, f"{path}/out", f"{path}/checkpoint")
    stored = scoring.read_persisted(spark, f"{path}/out", "predictions").select("id", "predicted_threat", "anomaly_score", "risk_level", F.lit(True).alias("accepted"))
    refused = spark.read.parquet(f"{path}/out/quarantine").select("id", F.lit(True).alias("quarantined"))
    batch = scoring.unified_predict(flows, models.params, models.anomaly, models.threat, ["id", "flow_id"])
    batch = batch.select("id", "flow_id", F.col("predicted_threat").alias("threat"), F.col("anomaly_score").alias("score"), F.col("risk_level").alias("level"))
    both = batch.join(stored, "id", "left").join(refused, "id", "left")
    return both.select(
        F.col("flow_id").alias("id"), F.coalesce("accepted", F.lit(False)).alias("accepted"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"),
        (F.col("predicted_threat") == F.col("threat")).alias("same_class"), (F.col("anomaly_score") == F.col("score")).alias("same_score"),
        (F.col("risk_level") == F.col("level")).alias("same_level"),
    )


@query(
    "stream_counters",
    """SELECT (SELECT count(*) FROM predictions) AS predictions, (SELECT count(*) FROM alerts) AS alerts,
      (SELECT count(*) FROM alerts WHERE severity = 'HIGH') AS high_alerts, (SELECT count(*) FROM alerts WHERE severity = 'CRITICAL') AS critical_alerts""",
    "predictions alerts",
)
def stream_counters(t):
    d = stream(t).domain
    return runner.latest_versions(jobs.session_counters(d.predictions, d.alerts), [], "counters", "complete")


@query("stream_dedup", "SELECT id, risk_level FROM predictions", "predictions")
def stream_dedup(t):
    events = runner.event_time(stream(t).domain.predictions, "timestamp", "1 hour")
    twice = events.select("id", "timestamp", "risk_level", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return runner.appended(jobs.dedup(twice, "id").select("id", "risk_level"), "dedup")


@query(
    "stream_latest_20",
    f"SELECT id, {iso('timestamp')} AS timestamp, risk_level FROM predictions ORDER BY predictions.timestamp DESC, id DESC LIMIT 20",
    "predictions",
)
def stream_latest_20(t):
    path = scratch_path(t.spark, "latest")
    jobs.keep_latest(stream(t).domain.predictions.select("id", "timestamp", "risk_level"), path, f"{path}-checkpoint")
    return texts(jobs.read_latest(t.spark, path), "timestamp")


TIER = """CASE WHEN action LIKE 'LOGIN%' THEN 'login' WHEN resource_type = 'PREDICTION' THEN 'predict' WHEN request_method = 'GET' THEN 'read' ELSE 'mutation' END"""
LIMIT = "CASE tier WHEN 'login' THEN {login} WHEN 'predict' THEN 60 WHEN 'read' THEN 120 ELSE 30 END"


def rate_sql(bucket: str, login: int, closed: str = "") -> str:
    return f"""SELECT {iso('w')} AS window_start, identity, tier, count(*) AS requests FROM (
      SELECT {bucket} AS w, 'user:' || username AS identity, {TIER} AS tier FROM audit_logs) {closed} GROUP BY w, identity, tier HAVING count(*) > {LIMIT.format(login=login)}"""


@query("rate_violations", rate_sql("date_trunc('minute', timestamp)", 5), "audit_logs")
def rate_violations(t):
    return texts(jobs.rate_violations(t.domain.audit_logs), "window_start")


STRICT = {"login": 1, "predict": 60, "read": 120, "mutation": 30}


@query("rate_violations_strict", rate_sql("date_trunc('day', timestamp)", 1), "audit_logs")
def rate_violations_strict(t):
    return texts(jobs.rate_violations(t.domain.audit_logs, "1 day", STRICT), "window_start")


@query(
    "stream_rate_violations",
    rate_sql("date_trunc('day', timestamp)", 1, f"WHERE w + INTERVAL 1 DAY <= (SELECT max(timestamp) - {DELAY_SQL} FROM audit_logs)"),
    "audit_logs",
)
def stream_rate_violations(t):
    requests = runner.event_time(stream(t).domain.audit_logs, "timestamp", DELAY)
    return plain(runner.appended(jobs.rate_violations(requests, "1 day", STRICT), "rates"), "window_start")


def burst_sql(bucket: str, width: str) -> str:
    return f"""SELECT {iso('w')} AS window_start, {iso(f'w + INTERVAL {width}')} AS window_end, source_ip, count(*) AS event_count FROM (
      SELECT *, {bucket} AS w FROM predictions) WHERE source_ip <> '' AND w + INTERVAL {width} <= (SELECT max(timestamp) - {DELAY_SQL} FROM predictions)
      GROUP BY w, source_ip HAVING count(*) >= 3 AND min(timestamp) < max(timestamp)"""


@query("stream_burst", burst_sql("time_bucket(INTERVAL 6 HOUR, timestamp)", "6 HOUR"), "predictions")
def stream_burst(t):
    found = runner.event_time(stream(t).domain.predictions, "timestamp", DELAY)
    return plain(runner.appended(jobs.bursts(found, "6 hours"), "bursts"), "window_start", "window_end")


@query("stream_burst_sliding", burst_sql("time_bucket(INTERVAL 3 HOUR, timestamp) - to_hours(CAST(o AS INTEGER))", "6 HOUR").replace("FROM predictions)", "FROM predictions, (VALUES (0), (3)) v(o))", 1), "predictions")
def stream_burst_sliding(t):
    found = runner.event_time(stream(t).domain.predictions, "timestamp", DELAY)
    return plain(runner.appended(jobs.bursts(found, "6 hours", "3 hours"), "bursts"), "window_start", "window_end")


@query(
    "stream_burst_session",
    f"""SELECT {iso('first')} AS window_start, {iso('last + INTERVAL 2 HOUR')} AS window_end, source_ip, n AS event_count FROM (
      SELECT source_ip, session, min(timestamp) AS first, max(timestamp) AS last, count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY source_ip ORDER BY timestamp, id) AS session FROM (
          SELECT *, CASE WHEN timestamp < lag(timestamp) OVER (PARTITION BY source_ip ORDER BY timestamp, id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh
          FROM predictions WHERE source_ip <> '')) GROUP BY 1, 2)
    WHERE n >= 3 AND first < last AND last + INTERVAL 2 HOUR <= (SELECT max(timestamp) - {DELAY_SQL} FROM predictions)""",
    "predictions",
)
def stream_burst_session(t):
    found = runner.event_time(stream(t).domain.predictions, "timestamp", DELAY)
    return plain(runner.appended(jobs.bursts(found, gap="2 hours"), "bursts"), "window_start", "window_end")


def timeline_sql(unit: str) -> str:
    counted = lambda kind, name: f"count(*) FILTER (WHERE kind = '{kind}') AS {name}"
    return f"""SELECT {iso('w')} AS window_start, {iso(f'w + INTERVAL 1 {unit}')} AS window_end, {counted('prediction', 'predictions')}, {counted('alert', 'alerts')},
      {counted('LOGIN_FAILURE', 'failed_logins')}, {counted('ACCESS_DENIED', 'access_denied')}, {counted('RATE_LIMIT_EXCEEDED', 'rate_limit_events')}
    FROM (SELECT date_trunc('{unit}', timestamp) AS w, kind FROM (SELECT timestamp, 'prediction' AS kind FROM predictions
      UNION ALL SELECT timestamp, 'alert' FROM alerts UNION ALL SELECT timestamp, action FROM audit_logs))
    WHERE w + INTERVAL 1 {unit} <= (SELECT max(timestamp) - {DELAY_SQL} FROM alerts) GROUP BY w"""


def stream_timeline_of(t, bucket):
    d = stream(t).domain
    # one watermark over all three sources: the slowest decides what is closed
    parts = [runner.event_time(x, "timestamp", DELAY) for x in (d.predictions, d.alerts, d.audit_logs)]
    return plain(runner.appended(jobs.timeline(A.timeline_events(*parts), bucket), "timeline"), "window_start", "window_end")


@query("stream_timeline", timeline_sql("hour"), "predictions alerts audit_logs")
def stream_timeline(t):
    return stream_timeline_of(t, "1 hour")


@query("stream_timeline_daily", timeline_sql("day"), "predictions alerts audit_logs")
def stream_timeline_daily(t):
    return stream_timeline_of(t, "1 day")


def failures_sql(closed: str = "") -> str:
    return f"""SELECT {iso('w')} AS window_start, {iso('w + INTERVAL 1 DAY')} AS window_end, ip_address, username, count(*) AS failures
      FROM (SELECT *, date_trunc('day', timestamp) AS w FROM audit_logs WHERE action = 'LOGIN_FAILURE') {closed} GROUP BY w, ip_address, username HAVING count(*) > 1"""


@query("brute_force_logins", failures_sql(), "audit_logs")
def brute_force_logins(t):
    return texts(jobs.brute_force_logins(t.domain.audit_logs, "1 day", 1), "window_start", "window_end")


@query(
    "stream_brute_force_logins",
    failures_sql(f"WHERE w + INTERVAL 1 DAY <= (SELECT max(timestamp) - {DELAY_SQL} FROM audit_logs)"),
    "audit_logs",
)
def stream_brute_force_logins(t):
    audit = runner.event_time(stream(t).domain.audit_logs, "timestamp", DELAY)
    return plain(runner.appended(jobs.brute_force_logins(audit, "1 day", 1), "failures"), "window_start", "window_end")


@register_walk(
    "lifecycle_stream",
    f"""SELECT alert_id, arg_max(CASE WHEN accepted THEN target ELSE status_before END, n) AS status,
      {iso("max(requested_at) FILTER (WHERE accepted AND target = 'ACKNOWLEDGED')")} AS acknowledged_at,
      {iso("max(requested_at) FILTER (WHERE accepted AND target = 'RESOLVED')")} AS resolved_at
    FROM walk WHERE status_before IS NOT NULL GROUP BY 1""",
    "predictions alerts",
    {"requests": ALERT_REQUESTS, "steps": ALERT_WALK},
)
def lifecycle_stream(t):
    states = jobs.alert_states(alert_requests(stream(t)), t.domain.alerts)
    return texts(runner.latest_versions(states, ["alert_id"], "alert-states"), "acknowledged_at", "resolved_at")
