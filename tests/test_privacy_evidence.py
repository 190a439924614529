import json

from pyspark.sql import functions as F

from seeds import AUDIT, T, hunting
from vigilflow.functions import privacy
from vigilflow.operators import evidence as E, reports as R, retention
from vigilflow.session import scratch_path
from vigilflow.sources import exports


def test_scrub(spark):
    nested = {"user": "kim", "Password": "x", "deep": {"access_token": "y", "list": [{"secret_key": 1, "n": 2.5}, None]}, "tokens": 3}
    rows = [json.dumps(nested), '{"a":1}', "Bearer abc", "harmless", None, '[{"jwt": "x"}]', '{"p\\u0061ssword": "x"}', "{broken password"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string")
    got = {r.i: r.s for r in privacy.scrub_json(df, "d").withColumnRenamed("d", "s").collect()}
    clean = json.loads(got[0])
    assert clean["Password"] == clean["deep"]["access_token"] == clean["deep"]["list"][0]["secret_key"] == "[REDACTED]"
    assert clean["user"] == "kim" and clean["deep"]["list"][0]["n"] == 2.5 and clean["tokens"] == 3
    assert got[1] == '{"a":1}' and got[3] == "harmless" and got[4] is None
    assert got[2] == got[7] == '{"note": "Sanitized unformatted detail"}'
    assert json.loads(got[5]) == [{"jwt": "[REDACTED]"}] and json.loads(got[6]) == {"password": "[REDACTED]"}


def package(spark):
    p, a, i = hunting(spark)
    a = a.withColumn("recommended_action", F.lit("block"))
    notes = spark.createDataFrame([(1, 1, "kim", "seen", T)], "id long, incident_id long, author string, note string, created_at timestamp_ntz")
    audit = spark.createDataFrame([(1, T, "INCIDENT_ASSIGNED", "INCIDENT", "1", "kim", "10.0.0.9", "POST"), (2, T, "OTHER", "ALERT", "1", "kim", "10.0.0.9", "POST")], AUDIT)
    audit = audit.withColumns({"user_role": F.lit("ADMIN"), "outcome": F.lit("SUCCESS"), "request_path": F.lit("/x")})
    links = spark.createDataFrame([(1, 1)], "incident_id long, alert_id long")
    plinks = spark.createDataFrame([(1, 1), (77, 2)], "incident_id long, prediction_id long")
    return i, lambda notes_=notes: E.evidence_items(i, a, p, notes_, links, plinks, audit), notes


def test_evidence(spark):
    incidents, items, notes = package(spark)
    m = E.evidence_manifest(incidents, items(), "auditor")
    row = m.first()
    assert (row.alerts_count, row.predictions_count, row.notes_count, row.timeline_count, row.audit_events_count) == (1, 1, 1, 1, 1)
    assert len(row.evidence_hash) == 64
    again = E.evidence_verify(m, incidents, items().repartition(5, F.rand())).first()
    assert again.intact
    forged = items(notes.withColumn("note", F.lit("changed")))
    assert not E.evidence_verify(m, incidents, forged).first().intact
    path = scratch_path(spark, "evidence")
    E.write_evidence(incidents, items(), m, path, per_case=True)
    saved = spark.read.json(f"{path}/items")
    assert {r.part for r in saved.collect()} == {"alerts", "predictions", "notes", "timeline", "audit_events", "incident_overview"}


def odd_package(spark):
    """Cases that come twice, links to unknown cases and to none, and one case with most items."""
    case = "id long, incident_key string, title string, severity string, status string, created_at timestamp_ntz, created_by string, assigned_to string, acknowledged_at timestamp_ntz, investigation_started_at timestamp_ntz, resolved_at timestamp_ntz, resolution_summary string"
    row = lambda i, key: (i, key, "t", "LOW", "OPEN", T, "kim", None, T if i == 2 else None, None, None, None)
    incidents = spark.createDataFrame([row(1, "I-1"), row(2, "I-2"), row(2, "I-2b"), row(3, "I-3"), row(None, "I-0")], case)
    _, items, _ = package(spark)
    of = lambda n, i, text: spark.range(n).select(F.lit(i).cast("long").alias("incident_id"), F.lit("notes").alias("part"), F.concat(F.lit(text), F.col("id") % (n - 1)).alias("item"))
    return incidents, items, of(400, 1, "a").unionByName(of(9, 2, "b")).unionByName(of(5, 77, "c")).unionByName(of(3, None, "d"))


def test_ordinary_cases_are_hashed_in_one_piece(spark, monkeypatch):
    """Hot cases dealt out by groups, others whole: the same hashes, and one row a case behind the second shuffle (F7, F8)."""
    incidents, _, items = odd_package(spark)
    sizes = items.groupBy("incident_id").agg(F.count(F.lit(1)).alias("rows"))
    every = sorted(map(repr, E.evidence_hashes(incidents, items).collect()))
    for limit in (0, 100, 10_000):
        monkeypatch.setattr(E, "HOT_ROWS", limit)
        assert sorted(map(repr, E.evidence_hashes(incidents, items, sizes).collect())) == every
    manifest = E.evidence_manifest(incidents, items, "auditor", sizes)
    assert sorted(r.incident_key for r in manifest.collect()) == ["I-1", "I-2", "I-2b", "I-3"]
    assert sum(r.intact for r in E.evidence_verify(manifest, incidents, items, sizes).collect()) == 4


def written(spark, path):
    return sorted(map(repr, spark.read.json(f"{path}/items").select("incident_id", "incident_key", "item", "part").collect()))


def test_keys_come_before_the_texts(spark):
    """Items with the key of their case are written as those that get it last; the manifest may follow the files (F5)."""
    p, a, _ = hunting(spark)
    a = a.withColumn("recommended_action", F.lit("block"))
    incidents, _, _ = odd_package(spark)
    notes = spark.createDataFrame([(n, n % 4 or None, "kim", f"seen {n}", T) for n in range(9)], "id long, incident_id long, author string, note string, created_at timestamp_ntz")
    audit = spark.createDataFrame([(n, T, "OTHER", "INCIDENT", r, "kim", "10.0.0.9", "POST") for n, r in enumerate(("1", "2", "9", "x", None))], AUDIT)
    audit = audit.withColumns({"user_role": F.lit("ADMIN"), "outcome": F.lit("SUCCESS"), "request_path": F.lit("/i")})
    ids = [r.id for r in p.select("id").limit(2).collect()]
    links = spark.createDataFrame([(c, i) for c in (1, 2, 9, None) for i in ids], "incident_id long, alert_id long")
    plinks = links.withColumnRenamed("alert_id", "prediction_id")
    items = lambda **o: E.evidence_items(incidents, a, p, notes, links, plinks, audit, **o)
    old, new = scratch_path(spark, "late"), scratch_path(spark, "early")
    E.write_evidence(incidents, items(), E.evidence_manifest(incidents, items(), "auditor"), old)
    sizes = E.case_sizes(notes, links, plinks, audit)
    E.write_evidence(incidents, items(keyed=True), E.evidence_manifest(incidents, items(unknown=True), "auditor", sizes), new)
    manifest = lambda path: sorted(map(repr, spark.read.json(f"{path}/manifest").collect()))
    assert written(spark, old) == written(spark, new) and len(written(spark, new)) > 20
    assert manifest(old) == manifest(new) and len(manifest(new)) == 4 and E.ids_repeat(incidents)
    incidents = incidents.filter("incident_key <> 'I-2b'")
    again, stored = scratch_path(spark, "late"), scratch_path(spark, "early")
    E.write_evidence(incidents, items(), E.evidence_manifest(incidents, items(), "auditor"), again)
    E.write_evidence(incidents, items(keyed=True), lambda rows: E.evidence_manifest(incidents, rows, "auditor", sizes), stored)
    assert written(spark, again) == written(spark, stored) and manifest(again) == manifest(stored) and not E.ids_repeat(incidents)


def test_csv_export(spark):
    p, _, _ = hunting(spark)
    odd = p.withColumns({"recommended_action": F.lit('say "no", twice'), "destination_ip": F.when(F.col("id") != 4, F.col("destination_ip"))})
    path = scratch_path(spark, "csv")
    exports.write_csv(R.predictions_export(odd).coalesce(1), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0].startswith("Prediction_ID,Timestamp_UTC,Source_IP") and len(lines) == 5
    assert lines[1].endswith('-0.75,0.98,CRITICAL,"say ""no"", twice"') and lines[1].startswith("1,2026-03-01T11:55:00,")
    assert ",192.168.1.50,,443," in lines[4]


def test_exports_leak_nothing(spark):
    _, _, _ = hunting(spark)
    audit = spark.createDataFrame([(1, T, "LOGIN_FAILURE", "AUTH", None, "kim", "10.0.0.9", "POST")], AUDIT)
    audit = audit.withColumns({"details": F.lit("password=x"), "user_role": F.lit("ADMIN"), "outcome": F.lit("FAILURE"), "request_path": F.lit("/login"), "status_code": F.lit(401)})
    out = R.audit_export(audit)
    text = [c for c, d in out.dtypes if d == "string"]
    assert sum(r.hits for r in privacy.leak_scan(out, text).collect()) == 0
    assert privacy.leak_scan(audit, ["details"]).agg(F.sum("hits")).first()[0] == 1


def test_audit_append_never_raises(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Bearer x")], "id int, details string")
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    assert exports.append_audit(rows, str(blocked / "below")) is False
    good = str(tmp_path / "audit")
    assert exports.append_audit(rows, good) and exports.append_audit(rows, good)
    assert spark.read.parquet(good).filter("details LIKE '%Sanitized%'").count() == 2


def test_retention(spark):
    df = spark.range(10).select("id", (F.lit(T).cast("timestamp_ntz") - F.expr("make_dt_interval(cast(id * 20 as int))")).alias("timestamp"))
    keep, archive = retention.retention_split(df, "timestamp", T)
    assert (keep.count(), archive.count()) == (5, 5)
    path = scratch_path(spark, "months")
    retention.write_by_month(df, "timestamp", path, "id")
    assert spark.read.parquet(path).filter("year = 2026 AND month = 2").count() == 1
