"""What travels between tasks: keys and digests, not texts."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_privacy_evidence import package
from test_evidence_tree import package as tree_package
from vigilflow.functions.skew import join_facts
from vigilflow.operators import cases, evidence as E, evidence_tree as HT
from vigilflow.plans import training, upkeep_queries
from vigilflow.session import scratch_path, settle


@pytest.fixture
def shuffled(spark):
    """No broadcast joins, so that the plans are those of large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def at(lines, word):
    return next(i for i, line in enumerate(lines) if word in line)


def test_items_are_written_after_their_case_is_found(shuffled):
    lines = plan(package(shuffled)[1]())
    assert at(lines, "StructsToJson") < at(lines, "LeftSemi")


def test_digests_are_dealt_out_before_they_are_listed(shuffled):
    incidents, items, _ = package(shuffled)
    lines = plan(E.evidence_hashes(incidents, items()))
    after = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert not any("partial_collect_list" in line for line in after)
    assert len([line for line in lines if "REPARTITION_BY_COL" in line]) == 2


def test_evidence_files_are_compressed(spark):
    incidents, items, _ = package(spark)
    path = scratch_path(spark, "evidence")
    E.write_evidence(incidents, items(), E.evidence_manifest(incidents, items(), "auditor"), path)
    saved = spark.read.json(f"{path}/items")
    assert all(f.endswith(".json.gz") for f in saved.inputFiles())
    assert saved.filter(F.col("part") == "incident_overview").first().incident_key == incidents.first().incident_key


def test_trees_are_stored_small(spark):
    incidents, items = tree_package(spark)
    found = HT.leaves(incidents, items)
    assert all(".zstd." in os.path.basename(f) for f in HT.nodes(found, HT.depths(found)).inputFiles())


def test_rows_without_a_key_are_spread(shuffled):
    rows = shuffled.range(6400).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.col("id").alias("n"), F.lit("x").alias("wide"))
    facts = shuffled.range(0, 6400, 20).select(F.col("id").alias("k"), F.lit("known").alias("fact"))
    joined = join_facts(rows, facts, "k", spread_by=["n"])
    keys = [line for line in plan(joined) if "Exchange hashpartitioning" in line]
    assert len(keys) == 2 and all("_salt" in line for line in keys)
    assert {(r["fact"], r["count"]) for r in joined.groupBy("fact").count().collect()} == {("known", 320), (None, 6080)}


def test_requests_are_judged_once(shuffled, monkeypatch):
    """The chain of look-ups is read three times, so it is written first."""
    written = []
    monkeypatch.setattr(cases, "settle", lambda df, name: written.append(name) or settle(df, name))
    created = datetime(2024, 1, 1)
    requests = shuffled.createDataFrame(
        [(1, 7, None, None, None, "a", None, created), (2, 7, None, None, None, "b", None, created), (3, 8, None, None, None, "c", None, created)],
        "request_id long, alert_id long, prediction_id long, severity string, category string, title string, assigned_to string, created_at timestamp_ntz",
    )
    alerts = shuffled.createDataFrame([(7, "HIGH", "DoS", "10.0.0.1", 1)], "id long, severity string, threat_label string, source_ip string, prediction_id long")
    predictions = shuffled.createDataFrame([], "id long, risk_level string, predicted_threat string, source_ip string")
    incidents = shuffled.createDataFrame([], "id long, incident_key string, status string")
    links = shuffled.createDataFrame([], "incident_id long, alert_id long")
    users = shuffled.createDataFrame([], "username string, role string, is_active boolean")
    accepted, refused = cases.create_incidents(requests, incidents, links, alerts, predictions, users)
    assert [(r.request_id, r.incident_key, r.severity) for r in accepted.collect()] == [(1, "INC-2024-000001", "HIGH")]
    assert {(r.request_id, r.reason) for r in refused.collect()} == {(2, "active incident exists"), (3, "alert not found")}
    assert written.index("judged") < written.index("case-numbers")


def test_duplicates_are_removed_once(spark, monkeypatch):
    raw = spark.createDataFrame([(float(i % 50), i % 7, "DoS" if i % 2 else "BENIGN") for i in range(400)], "flow_duration double, total_fwd_packets int, label string")
    written = []
    monkeypatch.setattr(training, "settle", lambda df, name: written.append(name) or settle(df, name))
    meta = training.dataset_metadata(raw, "flows", False).first()
    assert (meta.original_row_count, meta.processed_row_count, meta.duplicates_removed) == (400, 350, 50)
    matrix, _ = training.prepare_dataset(raw)
    assert matrix.count() == 350 and written == ["unique", "unique"]


@pytest.mark.parametrize("files", [0, 1, 8, 17, 400, 10_001])
def test_batches_do_not_grow_with_the_files(files):
    assert -(-files // upkeep_queries.files_per_batch(files)) <= upkeep_queries.SLICES
