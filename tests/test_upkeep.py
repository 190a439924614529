"""Archiving, deleting, versions of artifacts, stored baselines, state with timers, unique columns."""

import glob
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilflow.operators import archive, drift, profiling, purge, retention, versions
from vigilflow.session import scratch_path
from vigilflow.streaming import jobs, keyed_state

AS_OF = "2024-03-20 00:00:00"


@pytest.fixture
def logs(spark):
    days = spark.range(0, 110).withColumn("at", F.expr("timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ '2023-12-01 12:00:00')"))
    return days.select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("key"), "at")


def stored(spark, root, side, logs):
    rows = archive.read_months(spark, f"{root}/{side}", retention.with_month(logs, "at").schema)
    return sorted(r["key"] for r in rows.collect())


def test_archive_survives_a_break_and_repeats(spark, logs):
    root = scratch_path(spark, "archive")
    retention.write_by_month(logs, "at", f"{root}/live")
    cutoff = archive.expiry(AS_OF, 30)
    want_old = sorted(r["key"] for r in logs.collect() if r["at"] < cutoff.replace(tzinfo=None))
    want_new = sorted(set(r["key"] for r in logs.collect()) - set(want_old))
    assert want_old and want_new
    archive.copy_expired(spark, f"{root}/live", f"{root}/archive", "at", "key", cutoff)  # and then the job breaks off
    for _ in range(3):
        archive.archive_expired(spark, f"{root}/live", f"{root}/archive", "at", "key", AS_OF, 30)
        assert stored(spark, root, "archive", logs) == want_old
        assert stored(spark, root, "live", logs) == want_new
    # later the rest of the month of the cutoff joins what is archived of it
    archive.archive_expired(spark, f"{root}/live", f"{root}/archive", "at", "key", AS_OF, 22)
    assert len(stored(spark, root, "archive", logs)) == len(want_old) + 8
    archive.archive_expired(spark, f"{root}/live", f"{root}/archive", "at", "key", "2030-01-01 00:00:00", 1)
    assert stored(spark, root, "live", logs) == []
    assert stored(spark, root, "archive", logs) == sorted(want_old + want_new)
    assert archive.archive_expired(spark, f"{root}/live", f"{root}/archive", "at", "key", "2030-01-01 00:00:00", 1) == []


def test_a_broken_version_leaves_the_one_before(spark):
    root, types = scratch_path(spark, "versions"), {"a": "Numbers", "b": "Numbers"}

    def write(n, broken=False):
        def parts(folder):
            spark.range(n).write.parquet(f"{folder}/a")
            if broken:
                raise OSError("no space left")
            spark.range(n).write.parquet(f"{folder}/b")

        return parts

    with pytest.raises(FileNotFoundError):
        versions.current(spark, root, types)
    versions.publish(spark, root, types, write(3))
    with pytest.raises(OSError):
        versions.publish(spark, root, types, write(4, broken=True))
    assert spark.read.parquet(f"{versions.current(spark, root, types)}/b").count() == 3
    with pytest.raises(versions.BrokenVersion):
        versions.publish(spark, root, {**types, "c": "Numbers"}, write(5))
    assert spark.read.parquet(f"{versions.current(spark, root, types)}/a").count() == 3
    versions.publish(spark, root, types, write(6))
    folder = versions.current(spark, root, types)
    assert spark.read.parquet(f"{folder}/a").count() == 6
    assert [r["number"] for r in versions.history(spark, root).orderBy("number").collect()] == [1, 2]
    with pytest.raises(TypeError):
        versions.current(spark, root, {"a": "Numbers", "b": "Texts"})
    spark.range(1).write.mode("append").parquet(f"{folder}/b")
    with pytest.raises(versions.BrokenVersion, match="added"):
        versions.current(spark, root, types)


def test_a_changed_file_is_named(spark):
    root, types = scratch_path(spark, "versions"), {"a": "Numbers"}
    versions.publish(spark, root, types, lambda folder: spark.range(5).coalesce(1).write.parquet(f"{folder}/a"))
    folder = versions.current(spark, root, types)
    (file,) = glob.glob(f"{folder}/a/part-*")
    with open(file, "r+b") as f:
        f.seek(6)
        f.write(b"\xff")
    checksum = glob.glob(f"{folder}/a/.part-*.crc")
    for path in checksum:  # as on a store without checksums: an empty one is none
        open(path, "wb").close()
    try:
        versions.current(spark, root, types)
    except versions.BrokenVersion as e:
        assert "changed" in str(e)
    except Exception as e:  # the local file system's own checksum speaks first
        assert "hecksum" in str(e)
    else:
        raise AssertionError("a changed file was not seen")


def test_cascade_follows_cycles_and_empties_other_references(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "a": frame([(1, None), (2, 1), (3, 2), (4, None), (5, 5), (None, 1)], "id int, up int"),
        "b": frame([(10, 3, 1), (11, 4, 3), (12, None, 4), (12, None, 4)], "id int, a int, seen int"),
        "links": frame([(10, "x"), (11, "y"), (11, "y"), (None, "z")], "b int, name string"),
        "empty": frame([], "id int, a int"),
    }
    keys = [
        purge.ForeignKey("a", "up", "a"), purge.ForeignKey("b", "a", "a"), purge.ForeignKey("b", "seen", "a", cascade=False),
        purge.ForeignKey("links", "b", "b"), purge.ForeignKey("a", "up", "b"), purge.ForeignKey("empty", "a", "a"),
    ]
    kept = purge.purge(tables, {"a": frame([(1,), (1,), (None,)], "id int")}, keys)
    rows = {name: sorted(map(tuple, df.collect()), key=str) for name, df in kept.items()}
    assert rows == {
        "a": [(4, None), (5, 5)],
        "b": [(11, 4, None), (12, None, 4), (12, None, 4)],
        "links": [(11, "y"), (11, "y"), (None, "z")],
        "empty": [],
    }


def test_drift_of_every_feature(spark):
    nan, inf = float("nan"), float("inf")
    before = spark.createDataFrame([(float(i), 1.0, None) for i in range(100)], "`a.b` double, same double, none double")
    base = drift.fit_baseline(before, before.columns)
    path = scratch_path(spark, "baseline")
    base.save(spark, path)
    again = drift.Baseline.load(spark, path)
    assert again == base and len(base.edges["a.b"]) == 9 and base.edges["same"] == [1.0] and base.edges["none"] == []

    def status(df):
        return {r["feature"]: (r["stability_index"], r["status"]) for r in drift.drift(df, again).collect()}

    assert status(before) == {"a.b": (0.0, "STABLE"), "same": (0.0, "STABLE"), "none": (0.0, "STABLE")}
    later = spark.createDataFrame([(nan, 1.0, 5.0), (inf, 1.0, None), (-inf, 1.0, None), (None, 1.0, None)], before.schema)
    found = status(later)
    shares = {-1: (0.0, 0.5), 0: (0.1, 0.25), 9: (0.1, 0.25)} | {i: (0.1, 0.0) for i in range(1, 9)}
    floor = [(max(b, 1e-4), max(a, 1e-4)) for b, a in shares.values()]
    assert found["a.b"] == (pytest.approx(sum((a - b) * math.log(a / b) for b, a in floor), abs=2e-6), "DRIFT")
    assert found["same"] == (0.0, "STABLE") and found["none"][1] == "DRIFT"
    assert {s for _, s in status(before.limit(0)).values()} == {"NO_DATA"}
    assert status(before.drop("same"))["same"][1] == "DRIFT"
    empty = drift.fit_baseline(before.limit(0), before.columns)
    assert {r["status"] for r in drift.drift(before, empty).collect()} == {"NO_DATA"}


def test_state_levels_off_and_statuses_equal_the_aggregate(spark):
    days, each = 8, 40
    start = datetime(2024, 1, 1)
    path = scratch_path(spark, "requests")
    sent, number = [], 0
    for day in range(days):
        rows = []
        for i in range(each):
            alert = day * each + i
            at = start + timedelta(days=day, minutes=i)
            kinds = [("acknowledged ", 1), ("RESOLVED", 3), ("resolved", 5), ("new", 7)] if i % 4 else [("ACKNOWLEDGED", 2)]
            for kind, minutes in kinds:
                number += 1
                rows.append((number, alert, at + timedelta(minutes=minutes), kind))
            if day >= 3:  # requests for alerts whose state is gone, and for nobody
                number += 2
                rows += [(number - 1, alert - 3 * each, at, "RESOLVED"), (number, None, at, "RESOLVED")]
        rows += [(number + 1 + k, 10_000, start + timedelta(days=day, seconds=k), "ACKNOWLEDGED") for k in range(100)]
        number += 101
        frame = spark.createDataFrame(rows, "request_id long, alert_id long, requested_at timestamp_ntz, target string")
        frame.coalesce(1).write.mode("append").parquet(path)
        sent += rows
    alerts = spark.createDataFrame([(i, "NEW" if i % 5 else "resolved") for i in [*range(days * each), 10_000]], "id long, status string")
    live = spark.readStream.schema("request_id long, alert_id long, requested_at timestamp_ntz, target string").option("maxFilesPerTrigger", 1).parquet(path)
    progress, before = [], spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    found = keyed_state.alert_states(live, alerts, "1 hour", 3_600_000, progress)
    want = jobs.alert_states(spark.createDataFrame(sent, "request_id long, alert_id long, requested_at timestamp_ntz, target string"), alerts)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(found) == rows(want)
    sizes = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert len(sizes) >= days and max(sizes[days // 2 :]) < 3.2 * (2 * each + 1) and sizes[-1] < days * each
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_unique_columns_by_sketch_slice_and_count(spark):
    rows = spark.range(0, 5000, 1, 4).select(
        "id", (F.col("id") % 2).alias("two"), (F.col("id") % 4999).alias("almost"), F.when(F.col("id") != 7, F.col("id")).alias("one_null"),
        F.when(F.col("id") > 7, F.col("id")).alias("nulls"), F.floor(F.col("id") / 2).alias("pairs"), F.lit(1).alias("same"),
        F.when(F.col("id") < 3000, F.col("id")).otherwise(F.lit(0)).alias("hot"), F.lit(None).cast("string").alias("none"), F.col("id").cast("string").alias("a.b"),
    )
    for size in (100, 1000, 10**6):
        assert profiling.unique_columns(rows, size) == ["id", "one_null", "a.b"]
    assert profiling.unique_columns(rows.limit(0)) == []
    assert profiling.unique_columns(rows.filter("id = 7")) == ["id", "two", "almost", "one_null", "nulls", "pairs", "same", "hot", "none", "a.b"]
