"""Registered queries: archiving, deleting, drift against a stored baseline, state with timers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from vigilflow.functions.timerange import literal
from vigilflow.operators import archive as A, drift as D, purge as P, retention as T
from vigilflow.plans.case_queries import ALERT_REQUESTS, ALERT_WALK, alert_requests, recursive, register_walk
from vigilflow.plans.hunting_queries import texts
from vigilflow.plans.registry import ORACLES, query
from vigilflow.plans.views_sql import iso
from vigilflow.session import scratch_path, settle
from vigilflow.sources.domain import AS_OF
from vigilflow.streaming import keyed_state

DAYS = 20


@query(
    "retention_archive",
    f"""SELECT run, CASE WHEN timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY THEN 'live' ELSE 'archive' END AS side, id, {iso('timestamp')} AS timestamp, action
    FROM audit_logs, (VALUES (1), (2)) AS v(run)""",
    "audit_logs",
)
def retention_archive(t):
    """The move run twice: after each run the live rows and the archived ones."""
    spark = t.spark
    root = scratch_path(spark, "retention")
    logs = t.domain.audit_logs.select("id", "timestamp", "action")
    T.write_by_month(logs, "timestamp", f"{root}/live")
    found = []
    for run in (1, 2):
        A.archive_expired(spark, f"{root}/live", f"{root}/archive", "timestamp", "id", AS_OF, DAYS)
        for side in ("live", "archive"):
            rows = A.read_months(spark, f"{root}/{side}", T.with_month(logs, "timestamp").schema)
            # written, as the second run changes the files
            found.append(settle(rows.select(F.lit(run).alias("run"), F.lit(side).alias("side"), "id", "timestamp", "action"), "months"))
    return texts(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]), "timestamp")


LINKS = {"incident_predictions": "prediction_id", "incident_alerts": "alert_id"}
PURGED = ("predictions", "alerts", *LINKS)


@query(
    "purge_graph",
    """SELECT 'predictions' AS kept_table, CAST(id AS VARCHAR) AS row_key FROM predictions WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.tab = 'predictions' AND g.id = predictions.id)
    UNION ALL SELECT 'alerts', CAST(id AS VARCHAR) FROM alerts WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.tab = 'alerts' AND g.id = alerts.id)"""
    + "".join(
        f""" UNION ALL SELECT '{name}', incident_id || '/' || {column} FROM {name}
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.tab = '{column.removesuffix('_id')}s' AND g.id = {name}.{column})"""
        for name, column in LINKS.items()
    ),
    "predictions alerts incident_predictions incident_alerts",
    refers="SELECT 'predictions' AS parent, prediction_id AS parent_id, 'alerts' AS child, id FROM alerts",
    gone="""SELECT 'predictions' AS tab, id FROM predictions WHERE timestamp < TIMESTAMP '2024-01-08 00:00:00'
    UNION SELECT r.child, r.id FROM gone g JOIN refers r ON r.parent = g.tab AND r.parent_id = g.id""",
)
def purge_graph(t):
    """What is left of four tables once a week of predictions goes with all that hangs on it."""
    d = t.domain
    tables = {name: getattr(d, name) for name in PURGED}
    kept = P.purge(tables, {"predictions": d.predictions.filter(F.col("timestamp") < literal("2024-01-08"))})
    rows = []
    for name, left in kept.items():
        key = F.concat_ws("/", F.col("incident_id").cast("string"), F.col(LINKS[name]).cast("string")) if name in LINKS else F.col("id").cast("string")
        rows.append(left.select(F.lit(name).alias("kept_table"), key.alias("row_key")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


ORACLES["purge_graph"] = recursive(ORACLES["purge_graph"])

FEATURES = """destination_port flow_duration total_fwd_packets total_backward_packets total_length_of_fwd_packets total_length_of_bwd_packets
syn_flag_count rst_flag_count flow_bytes_per_s urg_flag_count""".split()
SPLIT_DAY = "1995-06-01"
CELLS = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, captured_at >= DATE '{SPLIT_DAY}' AS late FROM flows" for c in FEATURES)


@query(
    "drift_baseline",
    """SELECT f.feature, s.stability_index,
      CASE WHEN s.stability_index IS NULL THEN 'NO_DATA' WHEN s.stability_index < 0.1 THEN 'STABLE' WHEN s.stability_index < 0.25 THEN 'MODERATE_SHIFT' ELSE 'DRIFT' END AS status
    FROM (SELECT DISTINCT feature FROM cells) f LEFT JOIN (
      SELECT feature, round(sum((a - b) * ln(a / b)), 6) AS stability_index FROM (
        SELECT feature, bin, greatest(count(*) FILTER (WHERE late) / any_value(after), 1e-4) AS a, greatest(count(*) FILTER (WHERE NOT late) / any_value(before), 1e-4) AS b
        FROM placed, (SELECT count(*) FILTER (WHERE late) AS after, count(*) FILTER (WHERE NOT late) AS before FROM cells WHERE feature = 'flow_duration') n GROUP BY feature, bin) GROUP BY feature) s
    ON s.feature = f.feature""",
    "flows",
    cells=CELLS,
    edges="""SELECT DISTINCT feature, unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM cells WHERE NOT late AND isfinite(v) GROUP BY feature""",
    placed="""SELECT c.feature, c.late, CASE WHEN c.v IS NULL OR isnan(c.v) THEN -1 ELSE (SELECT count(*) FROM edges e WHERE e.feature = c.feature AND e.edge < c.v) END AS bin FROM cells c""",
)
def drift_baseline(t):
    """The later flows against bins and shares that were fitted on the earlier ones, saved and read again."""
    flows = t.domain.flows.select("captured_at", *FEATURES)
    late = F.col("captured_at") >= F.lit(SPLIT_DAY).cast("date")
    path = scratch_path(t.spark, "baseline")
    D.fit_baseline(flows.filter(~late), FEATURES).save(t.spark, path)
    return D.drift(flows.filter(late), D.Baseline.load(t.spark, path))


SLICES = 6


def files_per_batch(files: int) -> int:
    """A slice has the more files the larger the input; with these a batch, there are no more batches than slices."""
    return max(2, -(-files // SLICES))


@register_walk(
    "lifecycle_keyed_state",
    f"""SELECT alert_id, arg_max(CASE WHEN accepted THEN target ELSE status_before END, n) AS status,
      {iso("max(requested_at) FILTER (WHERE accepted AND target = 'ACKNOWLEDGED')")} AS acknowledged_at,
      {iso("max(requested_at) FILTER (WHERE accepted AND target = 'RESOLVED')")} AS resolved_at
    FROM walk WHERE status_before IS NOT NULL AND alert_id IN (SELECT alert_id FROM requests WHERE target IN ('ACKNOWLEDGED', 'RESOLVED')) GROUP BY 1""",
    "predictions alerts",
    {"requests": ALERT_REQUESTS, "steps": ALERT_WALK},
)
def lifecycle_keyed_state(t):
    """The requests replayed as a stream, one slice of time after the other."""
    spark = t.spark
    sent = settle(alert_requests(t), "requests")
    first, last = sent.agg(F.min("requested_at"), F.max("requested_at")).first()
    path = scratch_path(spark, "sent")
    if first is None:
        sent.write.parquet(path)
    else:
        width = (last - first) / SLICES + timedelta(microseconds=1)
        for i in range(SLICES):
            begin, end = first + i * width, first + (i + 1) * width
            inside = (F.col("requested_at") >= literal(begin)) & (F.col("requested_at") < literal(end))
            sent.filter(inside).write.mode("append").parquet(path)
    files = len(spark.read.schema(sent.schema).parquet(path).inputFiles())
    live = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", files_per_batch(files)).parquet(path)
    # files of one slice come in any order, so no request is later than a slice is wide
    delay = f"{int((last - first).total_seconds() / SLICES) + 3600} seconds" if first else "1 hour"
    states = keyed_state.alert_states(live, t.domain.alerts, delay)
    return texts(states, "acknowledged_at", "resolved_at")
