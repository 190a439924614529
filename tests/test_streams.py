"""Streams over several files give the batch answers."""

import pytest
from pyspark.sql import functions as F

from vigilflow.functions.timerange import literal
from vigilflow.operators import lifecycle as L, scoring
from vigilflow.plans.case_queries import alert_requests
from vigilflow.session import scratch_path
from vigilflow.sources.tables import Tables
from vigilflow.streaming import jobs, runner

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    """The events in four files, by time."""
    path = scratch_path(spark, "events-split")
    events = Tables(spark, FOLDER).events
    step = events.count() / 4
    for i in range(4):  # one after the other: streams take the oldest file first
        part = events.filter((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


@pytest.fixture
def live(spark, split):
    return runner.StreamTables(spark, split)


@pytest.fixture
def batch(spark):
    return Tables(spark, FOLDER).domain


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counters(live, batch):
    got = runner.latest_versions(jobs.session_counters(live.domain.predictions, live.domain.alerts), [], "c", "complete").first()
    assert got.predictions == batch.predictions.count() and got.alerts == batch.alerts.count()


def test_dedup_across_files(live, batch):
    events = runner.event_time(live.domain.predictions, "timestamp", "1 hour").select("id", "timestamp", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    assert runner.appended(jobs.dedup(events, "id").select("id"), "d").count() == batch.predictions.count()


def test_latest(spark, live, batch):
    path = scratch_path(spark, "latest")
    jobs.keep_latest(live.domain.predictions.select("id", "timestamp"), path, f"{path}-c")
    got = {r.id for r in jobs.read_latest(spark, path).collect()}
    assert got == {r.id for r in batch.predictions.orderBy(F.desc("timestamp")).limit(20).collect()}


def test_closed_windows_equal_batch(live, batch):
    found = runner.event_time(live.domain.predictions, "timestamp", "1 hour")
    got = runner.appended(jobs.bursts(found, "2 days"), "b")
    last = batch.predictions.agg(F.max("timestamp")).first()[0]
    closed = jobs.bursts(batch.predictions, "2 days").filter(F.col("window_end") <= literal(last) - F.expr("interval 1 hour"))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    assert rows(got.withColumns(times)) == rows(closed) and closed.count() > 0


def test_alert_states_equal_batch_under_any_order(spark, live, batch):
    states = runner.latest_versions(jobs.alert_states(alert_requests(live), batch.alerts), ["alert_id"], "s")
    judged = L.alert_transitions(alert_requests(batch.t), batch.alerts)
    final = L.alert_state(batch.alerts.drop("acknowledged_at", "resolved_at").withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("acknowledged_at", "resolved_at")}), judged)
    wanted = final.join(states.select(F.col("alert_id").alias("id")), "id", "left_semi")
    assert rows(states) == rows(wanted.select("id", "status", "acknowledged_at", "resolved_at"))


def test_scoring_stream_and_replay(spark, live, batch):
    path = scratch_path(spark, "scored")
    flows = live.domain.predictions.drop("risk_level", "recommended_action").withColumn(
        "raw_flow_data", F.when(F.col("id") % 10 == 0, '{"x": "Infinity"}').otherwise(F.col("raw_flow_data"))
    )
    jobs.score_stream(flows, "raw_flow_data", scoring.risk_triage, path, f"{path}-c")
    good = batch.predictions.filter("id % 10 <> 0")
    stored = scoring.read_persisted(spark, path, "predictions")
    assert rows(stored.select("id", "risk_level")) == rows(good.select("id", "risk_level"))
    assert spark.read.parquet(f"{path}/quarantine").count() == batch.predictions.count() - good.count()
    alerts = scoring.read_persisted(spark, path, "alerts")
    assert rows(alerts.select("prediction_id", "severity")) == rows(good.filter("risk_level <> 'LOW'").select("id", "risk_level"))
    # the last batch again: the same rows, once
    last = stored.agg(F.max("batch_id")).first()[0]
    again = stored.filter(F.col("batch_id") == last).drop("batch_id")
    again = spark.createDataFrame(again.collect(), again.schema)
    scoring.persist_scored(again, path, last)
    assert scoring.read_persisted(spark, path, "predictions").count() == good.count()


def test_models_in_a_stream_equal_the_batch(spark):
    from test_flows import make_flows
    from vigilflow.plans import training

    raw = make_flows(spark, 240)
    models = training.train(raw, ["flow_id"], depth=4)
    sent = raw.drop("flow_id", "label")
    at = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("timestamp")
    rows_ = raw.select(F.col("flow_id").cast("string").alias("id"), at, F.to_json(F.struct(*sent.columns)).alias("payload"))
    odd = spark.createDataFrame([("n", None), ("t", "no json"), ("e", "{}"), ("x", '{"flow_duration": "abc"}')], "id string, payload string")
    path = scratch_path(spark, "models-live")
    rows_.unionByName(odd.withColumn("timestamp", at).select("id", "timestamp", "payload")).repartition(3).write.parquet(f"{path}/sent")
    live = spark.readStream.schema("id string, timestamp timestamp_ntz, payload string").option("maxFilesPerTrigger", 1).parquet(f"{path}/sent")
    jobs.predict_stream(live, "payload", sent.schema, models.params, models.anomaly, models.threat, f"{path}/out", f"{path}/c")
    stored = scoring.read_persisted(spark, f"{path}/out", "predictions")
    refused = {r.id: r.reasons for r in spark.read.parquet(f"{path}/out/quarantine").collect()}
    assert {"n", "t", "e", "x"} <= refused.keys() and all(refused.values())
    assert stored.count() + len(refused) == raw.count() + 4 and stored.select("batch_id").distinct().count() == 3
    batch = scoring.unified_predict(raw, models.params, models.anomaly, models.threat, ["flow_id"]).withColumn("id", F.col("flow_id").cast("string"))
    picked = ("id", "predicted_threat", "anomaly_score", "classification_confidence", "risk_level", "summary")
    assert rows(stored.select(*picked)) == rows(batch.filter(~F.col("id").isin(list(refused))).select(*picked))


def test_unfinished_batches_are_not_read(spark, batch):
    path = scratch_path(spark, "unfinished")
    scored = batch.predictions.limit(10)
    scoring.persist_scored(scored, path, 0)
    scored.write.parquet(f"{path}/predictions/batch_id=1")  # no marker
    assert scoring.read_persisted(spark, path, "predictions").count() == 10
