"""Plans: pruned scans, pushed filters, one scan per table, no Python on hot paths."""

import re

import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry_point.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_reaches_the_scan(spark):
    text = plan(spark, "time_range_filter")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,.*LessThanOrEqual\(ts,", text)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_scans_read_only_what_they_need(spark):
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan(spark, "audit_summary")
    cases = plan(spark, "incident_summary")
    assert "o_orderdate" not in cases and "o_totalprice" not in cases


@pytest.mark.parametrize("name, scans", [("audit_summary", 1), ("overview_kpis", 3), ("severity_distribution", 1), ("profile_missing", 1)])
def test_one_scan_per_table(spark, name, scans):
    assert plan(spark, name).count("FileScan") == scans


@pytest.mark.parametrize("name", ["hunt_predictions", "predictions_page", "snapshot_top"])
def test_pages_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


HOT = """top_threat_sources security_timeline source_profile source_timeline incident_timeline incident_evidence alert_transitions incident_transitions
normalize_labels flow_rates one_hot risk_triage risk_reasons validate_flow_payload validate_ip prediction_investigation""".split()


@pytest.mark.parametrize("name", HOT)
def test_hot_paths_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_json_with_secrets_uses_python(spark):
    assert plan(spark, "scrub_details").count("ArrowEvalPython") == 1
    assert "Python" not in plan(spark, "scrub_text")
