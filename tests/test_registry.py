"""Registered queries beside their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_point
from check import rows_of
from vigilflow.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"
# one of each kind here; ALL_QUERIES=1 (or tools/check.py) runs every one
SOME = """top_threat_sources security_timeline hunt_predictions source_profile incident_linked_counts incident_create
alert_transitions incident_transitions report_summary incidents_csv incident_evidence clean_infinite flow_rates
robust_scale train_test_split profile_numeric classifier_metrics risk_reasons scrub_details stream_timeline""".split()
NAMES = sorted(entry_point.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Tables.NAMES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())
