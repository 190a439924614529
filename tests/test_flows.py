"""Cleaning, labels, features, fitting, sources."""

import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilflow.operators import cleaning, features, fitting, profiling, quality, quantiles, telemetry
from vigilflow.operators.quantiles import exact_quantiles
from vigilflow.session import scratch_path
from vigilflow.sources import flows


@pytest.mark.parametrize(
    "raw, name",
    [(" Destination Port", "destination_port"), ("Flow Bytes/s", "flow_bytes_per_s"), (" Label ", "label"), ("Down/Up Ratio", "down_per_up_ratio"), ("a--b (x)", "a_b_x")],
)
def test_names(raw, name):
    assert cleaning.normalize_name(raw) == name


def test_clean(spark):
    df = spark.createDataFrame(
        [(80, 1000, "500.0"), (80, 1000, "500.0"), (443, 2000, "Infinity")], "`Destination Port` int, `Flow Duration` int, `Flow Bytes/s` string"
    )
    unique = cleaning.exact_dedup(cleaning.normalize_columns(df))
    cleaned, seen = cleaning.clean_infinite(unique)
    assert (seen.rows, seen.replacements) == (2, 1)
    assert dict(cleaned.dtypes)["flow_bytes_per_s"] == "double"
    assert sorted((r.flow_bytes_per_s is None, r.destination_port) for r in cleaned.collect()) == [(False, 80), (True, 443)]


def test_text_column_is_cast_only_when_every_value_is_a_number(spark):
    df = spark.createDataFrame([("Inf", "Inf"), ("1e3", "x"), (" -2.5 ", "3")], "a string, b string")
    cleaned, seen = cleaning.clean_infinite(df)
    assert dict(cleaned.dtypes) == {"a": "double", "b": "string"}
    assert seen.replacements == 2


LABELS = {
    "BENIGN": "BENIGN", "DoS Hulk": "DoS", "PortScan": "Port Scan", "SSH-Patator": "Brute Force", "Web Attack – XSS": "Web Attack",
    "abnormal": "BENIGN", "dos": "Other Attack", "DDoS LOIC": "DDoS", "Botnet": "Bot", " normal\t": "BENIGN", None: "Other Attack",
}


def test_labels(spark):
    df = spark.createDataFrame([(k, v) for k, v in LABELS.items()], "label string, wanted string")
    rows = cleaning.normalize_labels(df).collect()
    assert all(r.normalized_label == r.wanted for r in rows)
    assert all(r.is_intrusion == int(r.wanted != "BENIGN") for r in rows)


FLOW = """destination_port int, flow_duration double, total_fwd_packets double, total_backward_packets double,
total_length_of_fwd_packets double, total_length_of_bwd_packets double, syn_flag_count double"""


def test_features(spark):
    df = spark.createDataFrame([(80, 1e6, 10.0, 10.0, 1000.0, 5000.0, 1.0), (53, 5e5, 2.0, 2.0, 80.0, 160.0, 0.0)], FLOW)
    web, dns = features.engineer(df).orderBy(F.desc("destination_port")).collect()
    assert (web.total_packets, dns.total_packets) == (20, 4)
    assert (web.calc_flow_packets_per_s, dns.calc_flow_packets_per_s) == (20, 8)
    assert web.fwd_bwd_packet_ratio == pytest.approx(10 / 11) and dns.fwd_bwd_packet_ratio == pytest.approx(2 / 3)
    assert web.syn_ratio == pytest.approx(1 / 21) and dns.syn_ratio == 0
    assert web.port_category == dns.port_category == "well_known"


def test_features_without_inputs(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert features.engineer(df).columns == ["a", "b"]


@pytest.mark.parametrize("values", [[999, 1000, 1001], [1, 1002], [1, 1000, 1001, 5000], [500, 1600], [1001], [], [10, 2000, 2000]])
def test_duration_unit_is_the_median_rule(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "flow_duration double")
    wanted = bool(values) and float(np.median(values)) > 1000
    assert features.durations_are_microseconds(df) == wanted


def test_ports(spark):
    cases = {"80": "well_known", "1024": "registered", "49152": "dynamic", "70000": "unknown", "x": "unknown", "80.5": "unknown", None: "unknown"}
    df = spark.createDataFrame(list(cases.items()), "p string, w string")
    assert all(r.g == r.w for r in df.select("w", features.port_category("p").alias("g")).collect())


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    n = 3001
    pdf = pd.DataFrame(
        {"u": rng.random(n), "few": rng.integers(0, 4, n) * 1.0, "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 1e6, n)), "one": 3.0}
    )
    df = spark.createDataFrame(pdf).repartition(6)
    probs = [0, 0.0001, 0.25, 0.5, 0.75, 0.9999, 1]
    for limits in ((20_000,), (50,), (1,)):
        found = exact_quantiles(df, list(pdf.columns), probs, *limits)
        for c in pdf.columns:
            assert np.allclose(found[c], np.quantile(pdf[c], probs), rtol=1e-12)


def make_flows(spark, n=300):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "flow_id": [f"f{i}" for i in range(n)], "source_ip": "10.0.0.1", "destination_port": rng.choice([22, 80, 443, 50000], n),
            "flow_duration": rng.random(n) * 1e6, "total_fwd_packets": rng.integers(1, 100, n) * 1.0, "total_backward_packets": rng.integers(1, 100, n) * 1.0,
            "total_length_of_fwd_packets": rng.random(n) * 1e4, "total_length_of_bwd_packets": rng.random(n) * 1e4,
            "flow_bytes_per_s": np.where(rng.random(n) < 0.05, np.inf, rng.random(n)), "service": rng.choice(["a", "b", "c"], n), "constant": 1.0,
            "label": rng.choice(["BENIGN", "DoS Hulk", "PortScan"], n),
        }
    )
    df = spark.createDataFrame(pdf)
    return df.withColumn("flow_duration", F.when(F.col("total_fwd_packets") > 5, F.col("flow_duration")))


def test_fit_and_transform(spark):
    raw = make_flows(spark)
    params = fitting.fit(raw.drop("label"))
    assert {"flow_id", "source_ip", "constant"} <= set(params.removed)
    assert not any("label" in n for n in params.feature_names())
    path = scratch_path(spark, "params")
    params.save(spark, path)
    again = fitting.FittedParams.load(spark, path)
    assert again == params
    one = fitting.transform(raw, params, ["flow_id"]).orderBy("flow_id").toPandas()
    two = fitting.transform(raw.drop("service"), again, ["flow_id"]).orderBy("flow_id").toPandas()
    numbers = one[params.feature_names()].to_numpy()
    assert np.isfinite(numbers).all()
    num = [c for c in one.columns if c.startswith("num__")]
    assert one[num].equals(two[num])
    assert (two[f"cat__service_{params.categorical[0].mode if params.categorical[0].column == 'service' else params.categorical[1].mode}"] == 1).all()
    # robust scaling by hand for one column
    pdf = raw.toPandas()
    x = pdf["flow_duration"].astype(float)
    lo, hi = x.quantile(0.0001), x.quantile(0.9999)
    filled = x.fillna(x.median())
    wanted = (x.clip(lo, hi).fillna(x.median()) - x.median()) / (filled.quantile(0.75) - filled.quantile(0.25))
    assert np.allclose(one["num__flow_duration"], wanted.to_numpy()[np.argsort(pdf["flow_id"].to_numpy())])


def test_load_refuses_foreign_files(spark):
    with pytest.raises(TypeError):
        fitting.FittedParams.from_json('{"other": 1}')


def test_too_many_categories(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        fitting.fit_categories(df, ["c"], limit=20)


def test_split_is_exact_and_stable(spark):
    n = 2000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("label"))
    first = fitting.train_test_split(df, "label", ["id"]).toPandas()
    second = fitting.train_test_split(df.repartition(7), "label", ["id"]).toPandas()
    merged = first.merge(second, on="id")
    assert len(merged) == n and (merged.is_test_x == merged.is_test_y).all()
    assert first.is_test.sum() == math.ceil(n * 0.3)
    share = first.groupby("label").is_test.sum() - first.groupby("label").size() * 0.3
    assert share.abs().max() < 1
    plain = fitting.train_test_split(df.withColumn("label", F.when(F.col("id") == 1, "lone").otherwise("x")), "label", ["id"])
    assert plain.filter("is_test").count() == math.ceil(n * 0.3)


CSV = """# a comment line
# another
Destination Port, Flow Bytes/s, Label 
443, 10.5, BENIGN
80, Infinity, DoS Hulk
80, Infinity, DoS Hulk
22, , SSH-Patator
"""


def test_csv_source(spark, tmp_path):
    (tmp_path / "b.csv").write_text(CSV)
    (tmp_path / "a.csv").write_text(CSV)
    files, sample = flows.discover(spark, str(tmp_path), "none")
    assert [f.rsplit("/", 1)[-1] for f in files] == ["a.csv", "b.csv"] and not sample
    assert flows.discover(spark, str(tmp_path / "missing"), "x.csv") == (["x.csv"], True)
    df = flows.read_flow_csv(spark, files)
    assert df.columns == ["Destination Port", "Flow Bytes/s", "Label"]
    assert df.count() == 8
    assert df.filter(F.col("Flow Bytes/s") == float("inf")).count() == 4
    assert flows.read_flow_csv(spark, files[0], max_rows=2).count() == 2
    meta = flows.load_metadata(df, False).orderBy("file_name").collect()
    assert [(r.file_name, r.raw_row_count, r.raw_column_count) for r in meta] == [("a.csv", 4, 3), ("b.csv", 4, 3)]


def test_json_batches(spark, tmp_path):
    record = {"captured_at": "2026-01-01T00:00:00Z", "source_ip": "10.0.0.1", "destination_ip": "10.0.0.2", "source_port": 1, "destination_port": 80,
              "protocol": "TCP", "duration_seconds": 1.5, "total_packets": 3}
    nested = {"batch_id": "b", "records": [{**record, "flags": {"syn": 2, "ack": 1}}, {**record, "syn_flag_count": 9, "is_suspicious": True}]}
    (tmp_path / "x.json").write_text(json.dumps(nested, indent=1))
    rows = flows.read_json_batches(spark, str(tmp_path), multi_line=True).orderBy("syn_flag_count").collect()
    assert [(r.syn_flag_count, r.ack_flag_count, r.rst_flag_count, r.total_bytes, r.is_suspicious) for r in rows] == [(2, 1, 0, 0, False), (9, 0, 0, 0, True)]


PAYLOADS = {
    "{}": ["empty payload"], '{"a": null}': ["no attributes"], '{"Flow Duration": NaN}': ["NaN or infinity"], '{"x": "-Infinity"}': ["NaN or infinity"],
    '{"flow duration": "abc"}': ["not a number"], '{"note": "abc_1.2 -"}': [], '{"a$b": 1}': ["invalid field name"], '{"__x": 1}': ["invalid field name"],
    '{"x": [1]}': ["nested value"], '{"x": "a;b"}': ["disallowed text"], '{"Flow Duration": 12.5, "Protocol": 6}': [], "[]": ["not a JSON object"],
}


def test_payloads(spark):
    df = spark.createDataFrame(list(PAYLOADS.items()), "payload string, wanted array<string>")
    for r in df.select("payload", "wanted", quality.payload_reasons("payload").alias("got")).collect():
        assert r.got == r.wanted, r.payload
    good, bad = quality.validate_payloads(df, "payload")
    assert good.count() + bad.count() == len(PAYLOADS)


def test_telemetry_aliases(spark):
    df = spark.createDataFrame([({"Source IP": "1.1.1.1", "destination port": "80.7", "Total Fwd Packets": "x", "total_length_of_fwd_packets": "5"},)], "m map<string,string>")
    r = df.select(*telemetry.telemetry_of_map("m")).first()
    assert (r.source_ip, r.destination_port, r.total_forward_packets, r.total_bytes) == ("1.1.1.1", 80, None, 5)
    wide = spark.createDataFrame([(None, "2.2.2.2", 7)], "source_ip string, `Src IP` string, `Total Bytes` int")
    r = wide.select(*telemetry.telemetry_of_frame(wide)).first()
    assert (r.source_ip, r.total_bytes) == ("2.2.2.2", 7)


def test_profile_rules(spark):
    df = spark.createDataFrame([(i, None if i % 3 else 1.0, 5, "x" if i else "Inf") for i in range(12)], "id int, gap double, same int, t string")
    stats = profiling.column_stats(df)
    assert {r.column_name for r in profiling.profile_constant(stats).collect()} == {"same"}
    problems = {(r.column_name, r.reason.split(" ")[0]) for r in profiling.profile_problems(stats).collect()}
    assert problems == {("same", "Constant"), ("gap", "Severe"), ("t", "Contains")}
    assert [r.column_name for r in profiling.profile_identifiers(df).collect()] == ["id"]
    assert profiling.profile_overview(df.union(df)).first().duplicate_count == 12


def test_the_jvm_compiles_the_feature_matrix(spark, capsys):
    """Methods over 8000 bytes stay interpreted: one expression a column made the matrix several times slower (F1, F3, F6)."""
    from vigilflow.plans import training

    numbers = [F.when(F.col("id") % (i + 3) != 0, F.col("id") * (i + 1.5)).alias(f"n{i}") for i in range(30)]
    flows = spark.range(300).select(*numbers, F.when(F.col("id") % 2 == 0, "BENIGN").otherwise("DoS Hulk").alias("label"))
    matrix, params = training.prepare_dataset(flows)
    matrix.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(params.numeric) == 30 and sizes and max(sizes) < 8000


def test_pivots_are_counted_by_look_up(spark):
    """Rows below and up to a pivot as comparisons give them, with copies, infinities, NaN and NULL (F6)."""
    values = [1.0, 1.0, 2.5, -0.0, 0.0, float("inf"), float("-inf"), float("nan"), None, 7.0]
    df = spark.createDataFrame([(v, None) for v in values], "`a.b` double, none double").repartition(3)
    pivots = [float("-inf"), 0.0, 1.0, 3.0, float("inf"), float("nan")]
    counts = quantiles._counts(df, {"a.b": pivots, "none": [1.0]})
    checks = [F.count(F.when(c, 1)) for p in pivots for c in (F.col("`a.b`") < F.lit(p), F.col("`a.b`") <= F.lit(p))]
    row = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).first())
    assert [n for p in pivots for n in counts["a.b", p]] == row and counts["none", 1.0] == (0, 0)


def test_a_payload_is_read_once(spark, capsys):
    """Every rule read the JSON of a payload anew (F2)."""
    spark.createDataFrame([("{}",)], "p string").select(quality.payload_reasons("p").alias("r")).explain("simple")
    assert capsys.readouterr().out.count("from_json") == 1
