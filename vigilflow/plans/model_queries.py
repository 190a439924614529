"""Registered queries: triage, models, evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from vigilflow import fixed_values as V
from vigilflow.operators import evaluation as E, forest, isolation, scoring
from vigilflow.plans import training
from vigilflow.plans.hunting_queries import texts
from vigilflow.plans.registry import query
from vigilflow.plans.views_sql import REASONS_SQL, fixed, iso
from vigilflow.session import scratch_path

# --- triage --------------------------------------------------------------------------


@query(
    "risk_triage",
    f"""SELECT id, risk_level, recommended_action, 'Flow evaluated: Anomaly=' || anomaly_label || ' (score ' || {fixed('anomaly_score', 2)} || '), Classification=''' || predicted_threat
      || ''' (est. prob ' || {fixed('classification_confidence * 100', 1)} || '%). Assigned Risk Level: ' || risk_level || '.' AS summary FROM predictions""",
    "predictions",
)
def risk_triage(t):
    return scoring.risk_triage(t.domain.predictions.drop("risk_level", "recommended_action")).select(
        "id", "risk_level", "recommended_action", "summary"
    )


@query(
    "alert_escalation",
    f"""SELECT id AS prediction_id, {iso('timestamp')} AS timestamp, CASE risk_level WHEN 'CRITICAL' THEN 'CRITICAL_INTRUSION' WHEN 'HIGH' THEN 'NETWORK_INTRUSION' ELSE 'ANOMALY_MONITORING' END AS alert_type,
      risk_level AS severity, predicted_threat AS threat_label, anomaly_score, classification_confidence AS confidence, source_ip, destination_ip, 'NEW' AS status, recommended_action
    FROM predictions WHERE risk_level <> 'LOW'""",
    "predictions",
)
def alert_escalation(t):
    return texts(scoring.alert_escalation(t.domain.predictions), "timestamp")




@query(
    "risk_reasons",
    REASONS_SQL,
    "predictions",
)
def risk_reasons(t):
    return scoring.explained(t.domain.predictions).select("id", F.array_join("risk_reasons", " | ").alias("reasons"))


@query(
    "persist_scored",
    """SELECT 'predictions' AS table_name, count(*) AS rows FROM predictions UNION ALL SELECT 'alerts', count(*) FROM alerts
    UNION ALL SELECT 'events', (SELECT count(*) FROM predictions) + (SELECT count(*) FROM alerts)""",
    "predictions alerts",
)
def persist_scored(t):
    path = scratch_path(t.spark, "scored")
    for _ in range(2):  # a repeated batch must not double its rows
        scoring.persist_scored(t.domain.predictions, path, 0)
    counts = [
        scoring.read_persisted(t.spark, path, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        for n in ("predictions", "alerts", "events")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


CASE_STEP = """SELECT 'incident_status_changed', {iso}, id, '{before}>{after}' FROM incidents WHERE {at} IS NOT NULL"""


def case_step(at, before, after):
    return CASE_STEP.format(iso=iso(at), before=before, after=after, at=at)


@query(
    "event_push",
    f"""SELECT 'prediction_created' AS event_type, {iso('timestamp')} AS timestamp, id, risk_level AS level FROM predictions
    UNION ALL SELECT 'alert_created', {iso('timestamp')}, id, severity || 'NEW' FROM alerts
    UNION ALL SELECT 'alert_acknowledged', {iso('acknowledged_at')}, id, severity || 'ACKNOWLEDGED' FROM alerts WHERE acknowledged_at IS NOT NULL
    UNION ALL SELECT 'alert_resolved', {iso('resolved_at')}, id, severity || 'RESOLVED' FROM alerts WHERE resolved_at IS NOT NULL
    UNION ALL SELECT 'incident_created', {iso('created_at')}, id, severity || 'OPEN' FROM incidents
    UNION ALL {case_step('acknowledged_at', 'OPEN', 'ACKNOWLEDGED')}
    UNION ALL {case_step('investigation_started_at', 'ACKNOWLEDGED', 'INVESTIGATING')}
    UNION ALL {case_step('resolved_at', 'INVESTIGATING', 'RESOLVED')}
    UNION ALL SELECT 'incident_note_added', {iso('created_at')}, incident_id, author FROM incident_notes""",
    "predictions alerts incidents incident_notes",
)
def event_push(t):
    d = t.domain
    events = (
        scoring.events_of(d.predictions, scoring.alert_escalation(d.predictions))
        .unionByName(scoring.status_events(d.alerts))
        .unionByName(scoring.incident_events(d.incidents, d.incident_notes))
    )
    fields = "id long, prediction_id long, alert_id long, incident_id long, risk_level string, severity string, status string, previous_status string, new_status string, author string"
    step = F.when(F.col("d.new_status").isNotNull(), F.concat_ws(">", "d.previous_status", "d.new_status"))
    level = F.when(F.col("d.severity").isNotNull(), F.concat("d.severity", "d.status"))
    return texts(
        events.withColumn("d", F.from_json("data", fields)).select(
            "event_type", "timestamp", F.coalesce("d.id", "d.incident_id", "d.alert_id", "d.prediction_id").alias("id"),
            F.coalesce(step, level, "d.risk_level", "d.author").alias("level"),
        ),
        "timestamp",
    )


@query(
    "audit_append",
    f"""SELECT id, action, CASE WHEN id % 3 = 0 THEN '{V.SCRUBBED_TEXT}' WHEN id % 3 = 1 THEN '{{"token": "[REDACTED]", "id": ' || id || '}}' ELSE details END AS details FROM audit_logs""",
    "audit_logs",
)
def audit_append(t):
    from vigilflow.sources.exports import append_audit

    path = scratch_path(t.spark, "audit")
    details = F.expr("""CASE WHEN id % 3 = 0 THEN concat('Bearer ', id) WHEN id % 3 = 1 THEN concat('{"token": "t', id, '", "id": ', id, '}') ELSE details END""")
    append_audit(t.domain.audit_logs.withColumn("details", details), path)
    return t.spark.read.parquet(path).select("id", "action", "details")


# --- models -----------------------------------------------------------------------------

VECTOR = [f"v{i}" for i in range(64)]


def vectors(t):
    """Embeddings as 64 numeric features."""
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("class"), "label").alias("label"),
        *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(VECTOR)],
    )


@query("isolation_forest_fit")
def isolation_forest_fit(t):
    model = isolation.fit(vectors(t), VECTOR, ["id"])
    return model.node_frame(t.spark)


@query("isolation_forest_score")
def isolation_forest_score(t):
    rows = vectors(t)
    scored = isolation.score(rows, isolation.fit(rows, VECTOR, ["id"]))
    return scored.select("id", "is_anomaly", "anomaly_label", "anomaly_score", "raw_decision_score", "anomaly_interpretation")


@query(
    "isolation_forest_invariants",
    "SELECT vec_id AS id, true AS in_range, true AS label_agrees, true AS boundary_agrees, true AS share_agrees FROM embeddings",
)
def isolation_forest_invariants(t):
    """What must hold for every scored row, whatever the random trees."""
    rows = vectors(t)
    scored = isolation.score(rows, isolation.fit(rows, VECTOR, ["id"]))
    share = scored.agg(F.avg(F.col("is_anomaly").cast("int")).alias("s")).scalar()
    score, raw = F.col("anomaly_score"), F.col("raw_decision_score")
    return scored.select(
        "id",
        score.between(0, 1).alias("in_range"),
        ((F.col("anomaly_label") == "ANOMALOUS") == F.col("is_anomaly")).alias("label_agrees"),
        (F.when(F.col("is_anomaly"), (score >= 0.5) & (raw <= 0)).otherwise((score <= 0.5) & (raw >= 0))).alias("boundary_agrees"),
        (F.abs(share - V.FOREST_CONTAMINATION) < 0.01).alias("share_agrees"),
    )


#: A small forest, node by node: tree, node, feature, threshold, left, right, size, depth.
SMALL_FOREST = [
    (0, 0, 0, 0.0, 1, 2, 8, 0),
    (0, 1, -1, 0.0, -1, -1, 5, 1),
    (0, 2, 1, 0.1, 3, 4, 3, 1),
    (0, 3, -1, 0.0, -1, -1, 1, 2),
    (0, 4, -1, 0.0, -1, -1, 2, 2),
    (1, 0, 1, -0.05, 1, 2, 8, 0),
    (1, 1, -1, 0.0, -1, -1, 1, 1),
    (1, 2, -1, 0.0, -1, -1, 7, 1),
]
MEAN_PATH = "CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1)::DOUBLE / {n} END"


@query(
    "isolation_forest_walk",
    f"""SELECT id, decision < 0 AS is_anomaly, CASE WHEN decision < 0 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS anomaly_label,
      round(least(greatest(0.5 - 2 * decision, 0), 1), 4) AS anomaly_score, round(decision, 4) AS raw_decision_score
    FROM (SELECT id, 0.5 - pow(2.0, -((d0 + {MEAN_PATH.format(n='n0')}) + (d1 + {MEAN_PATH.format(n='n1')})) / 2 / ({MEAN_PATH.format(n='8')})) AS decision FROM w)""",
    w="""SELECT vec_id AS id, CASE WHEN embedding[1] <= 0 THEN 1 ELSE 2 END AS d0, CASE WHEN embedding[1] <= 0 THEN 5 WHEN embedding[2] <= 0.1::DOUBLE THEN 1 ELSE 2 END AS n0,
      1 AS d1, CASE WHEN embedding[2] <= -0.05::DOUBLE THEN 1 ELSE 7 END AS n1 FROM embeddings""",
)
def isolation_forest_walk(t):
    """Scores by a known forest, so that every value can be held against SQL."""
    nodes = pd.DataFrame(SMALL_FOREST, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    model = isolation.IsolationModel(["v0", "v1"], nodes, 8)
    return isolation.score(vectors(t), model).select("id", "is_anomaly", "anomaly_label", "anomaly_score", "raw_decision_score")


@query("random_forest_fit")
def random_forest_fit(t):
    model = forest.fit(vectors(t), VECTOR, "label")
    return forest.feature_importance(t.spark, model)


@query("random_forest_score")
def random_forest_score(t):
    rows = vectors(t)
    scored = forest.score(rows, forest.fit(rows, VECTOR, "label"))
    return scored.select("id", "label", "predicted_threat", "intrusion_flag", "classification_confidence", F.to_json("class_probabilities").alias("class_probabilities"))


@query(
    "random_forest_invariants",
    "SELECT vec_id AS id, true AS sums_to_one, true AS confidence_is_largest, true AS flag_agrees, (SELECT count(DISTINCT label) FROM embeddings) AS classes FROM embeddings",
)
def random_forest_invariants(t):
    """What must hold for every classified row."""
    rows = vectors(t)
    scored = forest.score(rows, forest.fit(rows, VECTOR, "label"))
    shares = F.map_values("class_probabilities")
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    return scored.select(
        "id",
        (F.abs(total - 1) < 0.01).alias("sums_to_one"),
        (F.array_max(shares) == F.col("classification_confidence")).alias("confidence_is_largest"),
        (F.col("intrusion_flag") == (F.col("predicted_threat") != V.BENIGN)).alias("flag_agrees"),
        F.size(shares).cast("long").alias("classes"),
    )


#: Splits of a small classifier: tree, node, feature, threshold, left, right; the counts come from the rows.
SMALL_CLASSIFIER = [
    (0, 0, 0, 0.0, 1, 2),
    (0, 1, -1, 0.0, -1, -1),
    (0, 2, 1, 0.1, 3, 4),
    (0, 3, -1, 0.0, -1, -1),
    (0, 4, -1, 0.0, -1, -1),
    (1, 0, 1, -0.05, 1, 2),
    (1, 1, -1, 0.0, -1, -1),
    (1, 2, -1, 0.0, -1, -1),
]
LEAVES = """SELECT vec_id AS id, 'class' || label AS class, CASE WHEN embedding[1] <= 0 THEN 1 WHEN embedding[2] <= 0.1::DOUBLE THEN 3 ELSE 4 END AS a,
      CASE WHEN embedding[2] <= -0.05::DOUBLE THEN 1 ELSE 2 END AS b FROM embeddings"""


def small_classifier(t):
    nodes = pd.DataFrame(SMALL_CLASSIFIER, columns=["tree", "node", "feature", "threshold", "left", "right"])
    return forest.NodeForest(["v0", "v1"], [], nodes).refit(vectors(t), "label")


@query(
    "random_forest_walk",
    """SELECT x.id, c.class, round((coalesce(p.share, 0) + coalesce(q.share, 0)) / 2, 4) AS probability
    FROM x CROSS JOIN (SELECT DISTINCT class FROM x) c LEFT JOIN p ON p.a = x.a AND p.class = c.class LEFT JOIN q ON q.b = x.b AND q.class = c.class""",
    x=LEAVES,
    p="SELECT a, class, count(*) / sum(count(*)) OVER (PARTITION BY a) AS share FROM x GROUP BY a, class",
    q="SELECT b, class, count(*) / sum(count(*)) OVER (PARTITION BY b) AS share FROM x GROUP BY b, class",
)
def random_forest_walk(t):
    """Class probabilities by a known forest, refitted to all rows, so that every value can be held against SQL."""
    return small_classifier(t).score(vectors(t)).select("id", F.explode("class_probabilities").alias("class", "probability"))


@query(
    "random_forest_importance",
    """SELECT feature, round(value, 6) AS importance, round(sum(round(value, 6)) OVER (ORDER BY value DESC ROWS UNBOUNDED PRECEDING), 6) AS cumulative_importance
    FROM (SELECT 'v0' AS feature, (root - l1 - r) / (root - l1 - l3 - l4) / 2 AS value FROM g UNION ALL SELECT 'v1', (r - l3 - l4) / (root - l1 - l3 - l4) / 2 + 0.5::DOUBLE FROM g)""",
    x=LEAVES,
    n="""SELECT k, class, count(*) AS n FROM (SELECT 'root' AS k, class FROM x UNION ALL SELECT 'r', class FROM x WHERE a > 1 UNION ALL SELECT 'l' || a, class FROM x) GROUP BY k, class""",
    m="SELECT k, sum(n) - sum(n * n) / sum(n) AS m FROM n GROUP BY k",
    g="""SELECT max(m) FILTER (WHERE k = 'root') AS root, max(m) FILTER (WHERE k = 'r') AS r, max(m) FILTER (WHERE k = 'l1') AS l1,
      max(m) FILTER (WHERE k = 'l3') AS l3, max(m) FILTER (WHERE k = 'l4') AS l4 FROM m""",
)
def random_forest_importance(t):
    """Importances and their running sum from the nodes of the refitted forest."""
    model = small_classifier(t)
    return forest.node_importance(model.frame(t.spark), model.features).select("feature", "importance", "cumulative_importance")


IMPORTANCE = """SELECT event_type AS feature, round(count(*) / (SELECT count(*) FROM events), 6) AS importance FROM events GROUP BY 1"""


@query(
    "feature_importance",
    "SELECT feature, importance, round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING), 6) AS cumulative_importance FROM i",
    i=IMPORTANCE,
)
def feature_importance(t):
    total = t.events.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = t.events.groupBy(F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return forest.with_running_share(shares.select("feature", F.round(F.col("n") / total, 6).alias("importance")))


@query(
    "cumulative_importance",
    "SELECT feature, round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING), 6) AS cumulative_importance FROM i",
    i=IMPORTANCE,
)
def cumulative_importance(t):
    return feature_importance(t).select("feature", "cumulative_importance")


def flow_rows(t):
    """The flows; the day of capture is left to the reports."""
    return t.domain.flows.drop("captured_at")


@query("unified_predict")
def unified_predict(t):
    models = training.train(flow_rows(t), ["flow_id"])
    scored = scoring.unified_predict(t.domain.flows, models.params, models.anomaly, models.threat, ["flow_id", "source_ip", "destination_ip"])
    return scored.select(
        "flow_id", "anomaly_label", "anomaly_score", "predicted_threat", "classification_confidence", "risk_level", "recommended_action", "summary"
    )


@query("full_training_job")
def full_training_job(t):
    return training.train(flow_rows(t), ["flow_id"]).catalog(t.spark)


#: Raw labels of the dictionary, given in turn, and the class that each one names.
RAW_LABELS = {"Benign": "BENIGN", "DoS Hulk": "DoS", "PortScan": "Port Scan", "SSH-Patator": "Brute Force"}


def labelled_vectors(t):
    """The vectors under labels of several classes."""
    names = F.array(*[F.lit(x) for x in RAW_LABELS])
    own = t.embeddings.select(F.col("vec_id").alias("id"), F.get(names, (F.col("label") % len(RAW_LABELS)).cast("int")).alias("raw"))
    return vectors(t).join(own, "id").withColumn("label", F.col("raw")).drop("raw")


CLASS_SQL = f"({list(RAW_LABELS.values())!r})[label % {len(RAW_LABELS)} + 1]"


@query("model_catalog")
def model_catalog(t):
    rows = labelled_vectors(t)
    models = training.train(rows, ["id"])
    return models.catalog(t.spark)


@query(
    "model_catalog_counts",
    f"""SELECT '1.0.0' AS model_version, (SELECT count(*) - ceil(count(*) * 0.3::DOUBLE)::BIGINT FROM embeddings) AS train_samples, (SELECT ceil(count(*) * 0.3::DOUBLE)::BIGINT FROM embeddings) AS test_samples,
      true AS stratified, 64 AS total_features,
      (SELECT string_agg(DISTINCT class, ',' ORDER BY class) FROM (SELECT {CLASS_SQL} AS class FROM embeddings)) AS classes,
      150 AS anomaly_trees, 256 AS anomaly_sample, 0.05::DOUBLE AS anomaly_contamination, 100 AS classifier_trees, 16 AS classifier_depth, 42 AS random_state,
      (SELECT ceil(count(*) * 0.3::DOUBLE)::BIGINT FROM embeddings)::DOUBLE AS sample_count""",
)
def model_catalog_counts(t):
    """What of the catalog follows from the data and the settings."""
    return model_catalog(t).select(
        "model_version", "train_samples", "test_samples", "stratified", "total_features", "classes", "anomaly_trees", "anomaly_sample", "anomaly_contamination",
        "classifier_trees", "classifier_depth", "random_state", "sample_count",
    )


@query("model_artifacts", "SELECT vec_id AS id, true AS same_score, true AS same_class FROM embeddings")
def model_artifacts(t):
    """Saved and loaded models of several classes must score alike."""
    rows = labelled_vectors(t)
    models = training.train(rows, ["id"])
    path = scratch_path(t.spark, "models")
    models.save(t.spark, path)
    again = training.Models.load(t.spark, path)
    scores = lambda m: scoring.unified_predict(rows, m.params, m.anomaly, m.threat, ["id"])
    before = scores(models).select("id", F.col("anomaly_score").alias("a"), F.col("predicted_threat").alias("p"))
    joined = scores(again).join(before, "id")
    return joined.select("id", (F.col("anomaly_score") == F.col("a")).alias("same_score"), (F.col("predicted_threat") == F.col("p")).alias("same_class"))


# --- evaluation ---------------------------------------------------------------------------

PAIRS = "SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p FROM labels"
CLASSES = """SELECT c, count(*) FILTER (WHERE t = c) AS support, count(*) FILTER (WHERE p = c) AS guessed, count(*) FILTER (WHERE t = c AND p = c) AS hits
  FROM y, (SELECT t AS c FROM y UNION SELECT p FROM y) GROUP BY 1"""
SCORES = """SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc,
  CASE WHEN guessed + support > 0 THEN 2 * hits / (guessed + support) ELSE 0 END AS f FROM k"""
EVAL = {"y": PAIRS, "k": CLASSES, "m": SCORES}


def labelled(t):
    return t.labels.select("quality", "toxic")


@query(
    "classifier_metrics",
    """SELECT (SELECT round(count(*) FILTER (WHERE t = p) / count(*), 4) FROM y) AS accuracy, (SELECT count(*) FROM y) AS sample_count,
      round(avg(pr), 4) AS precision_macro, round(sum(pr * support) / sum(support), 4) AS precision_weighted, round(avg(rc), 4) AS recall_macro,
      round(sum(rc * support) / sum(support), 4) AS recall_weighted, round(avg(f), 4) AS f1_macro, round(sum(f * support) / sum(support), 4) AS f1_weighted FROM m""",
    **EVAL,
)
def classifier_metrics(t):
    return E.classifier_metrics(labelled(t), "quality", "toxic")


@query(
    "classification_report",
    """SELECT c AS name, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, support FROM m
    UNION ALL SELECT 'micro avg', round(sum(hits) / sum(guessed), 6), round(sum(hits) / sum(support), 6), round(2 * sum(hits) / (sum(guessed) + sum(support)), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
    **EVAL,
)
def classification_report(t):
    return E.classification_report(labelled(t), "quality", "toxic")


@query(
    "confusion_matrix",
    """SELECT c AS class, (SELECT count(*) FROM y WHERE t = c AND p = '0') AS "0", (SELECT count(*) FROM y WHERE t = c AND p = '1') AS "1" FROM k""",
    **EVAL,
)
def confusion_matrix(t):
    return E.confusion_matrix(labelled(t), "quality", "toxic")


@query("class_union", "SELECT t AS class FROM y UNION SELECT p FROM y", y=PAIRS)
def class_union(t):
    return E.class_union(E.confusion_counts(labelled(t), "quality", "toxic"))


@query(
    "anomaly_metrics",
    """SELECT count(*) AS total_samples, count(*) FILTER (WHERE a) AS flagged_anomalies, count(*) FILTER (WHERE NOT a) AS flagged_normal, round(count(*) FILTER (WHERE a) / count(*), 4) AS anomaly_rate,
      round(min(anomaly_score), 4) AS score_min, round(quantile_cont(anomaly_score, 0.5), 4) AS score_median, round(avg(anomaly_score), 4) AS score_mean, round(max(anomaly_score), 4) AS score_max
    FROM (SELECT anomaly_score, anomaly_label = 'ANOMALOUS' AS a FROM predictions)""",
    "predictions",
)
def anomaly_metrics(t):
    return E.anomaly_metrics(t.domain.predictions.withColumn("is_anomaly", F.col("anomaly_label") == "ANOMALOUS"))


@query(
    "anomaly_validation",
    """SELECT *, round(tp / (tp + fp), 4) AS anomaly_precision, round(tp / (tp + fn), 4) AS anomaly_recall, round(2 * tp / (2 * tp + fp + fn), 4) AS anomaly_f1, round(fp / (fp + tn), 4) AS false_alarm_rate
    FROM (SELECT count(*) FILTER (WHERE a AND i) AS tp, count(*) FILTER (WHERE a AND NOT i) AS fp, count(*) FILTER (WHERE NOT a AND NOT i) AS tn, count(*) FILTER (WHERE NOT a AND i) AS fn
      FROM (SELECT anomaly_label = 'ANOMALOUS' AS a, intrusion_flag AS i FROM predictions))""".replace("SELECT *,", "SELECT tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,"),
    "predictions",
)
def anomaly_validation(t):
    rows = t.domain.predictions.withColumn("is_anomaly", F.col("anomaly_label") == "ANOMALOUS")
    return E.anomaly_validation(rows, "intrusion_flag")


@query("eval_artifacts", """SELECT c AS class, (SELECT count(*) FROM y WHERE t = c AND p = '0') AS "0", (SELECT count(*) FROM y WHERE t = c AND p = '1') AS "1" FROM k""", **EVAL)
def eval_artifacts(t):
    path = scratch_path(t.spark, "evaluation")
    training.write_evaluation(
        path,
        confusion_matrix=E.confusion_matrix(labelled(t), "quality", "toxic"),
        classification_report=E.classification_report(labelled(t), "quality", "toxic"),
        model_metrics=E.classifier_metrics(labelled(t), "quality", "toxic"),
    )
    saved = t.spark.read.option("header", True).csv(f"{path}/confusion_matrix")
    return saved.select("class", F.col("0").cast("long").alias("0"), F.col("1").cast("long").alias("1"))
