"""Registered queries: flow sources, cleaning, features, fitting, profiling, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import iso as spark_iso
from vigilflow.functions.timerange import literal
from vigilflow.operators import analytics as A, cleaning, encoding, features, fitting, paging as P, profiling, quality, telemetry
from vigilflow.plans.registry import query
from vigilflow.plans.views_sql import fixed, iso, pct
from vigilflow.session import scratch_path
from vigilflow.sources import exports, flows as S

TOTAL_PACKETS = "(coalesce(total_fwd_packets, 0) + coalesce(total_backward_packets, 0))"
TOTAL_BYTES = "(coalesce(total_length_of_fwd_packets, 0) + coalesce(total_length_of_bwd_packets, 0))"
# flow_duration is in microseconds in these tables
SECONDS = "(greatest(flow_duration, 1e-6) / 1e6::DOUBLE)"
PORT_TIER = """CASE WHEN destination_port BETWEEN 0 AND 1023 THEN 'well_known' WHEN destination_port BETWEEN 1024 AND 49151 THEN 'registered'
  WHEN destination_port BETWEEN 49152 AND 65535 THEN 'dynamic' ELSE 'unknown' END"""


# --- sources -------------------------------------------------------------------------


def flow_file(t):
    """The flow view written as raw CSV with dirty headers."""
    path = scratch_path(t.spark, "flow-csv")
    named = t.domain.flows.select(
        F.col("flow_id").alias("Flow ID"), F.col("destination_port").alias("Destination Port"), F.col("flow_duration").alias("Flow Duration"),
        F.col("flow_bytes_per_s").alias("Flow Bytes/s"), F.col("total_backward_packets").alias("Total Backward Packets"), F.col("label").alias("Label"),
    )
    exports.write_csv(named, path)
    return path


def csv_flows(t):
    header = ["Flow ID", "Destination Port", "Flow Duration", "Flow Bytes/s", "Total Backward Packets", "Label"]
    return S.read_flow_csv(t.spark, flow_file(t), S.flow_schema(header, ("label", "flow_id")))


@query(
    "flow_csv_scan",
    """SELECT flow_id AS "Flow ID", CAST(destination_port AS DOUBLE) AS "Destination Port", flow_duration AS "Flow Duration", CAST(flow_bytes_per_s AS VARCHAR) AS "Flow Bytes/s",
      total_backward_packets AS "Total Backward Packets", trim(label) AS "Label" FROM flows""",
    "flows",
)
def flow_csv_scan(t):
    rate = F.col("Flow Bytes/s")
    text = F.when(rate == float("inf"), "inf").when(rate == float("-inf"), "-inf").otherwise(rate.cast("string"))
    return csv_flows(t).withColumn("Flow Bytes/s", text)


@query("raw_file_discovery", "SELECT count(*) AS flows, count(DISTINCT flow_id) AS flow_ids, false AS is_sample FROM flows", "flows")
def raw_file_discovery(t):
    files, is_sample = S.discover(t.spark, flow_file(t), "none")
    df = S.read_flow_csv(t.spark, files, S.flow_schema(["Flow ID", "Destination Port", "Flow Duration", "Flow Bytes/s", "Total Backward Packets", "Label"], ("label", "flow_id")))
    return df.agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("Flow ID").alias("flow_ids")).withColumn("is_sample", F.lit(is_sample))


@query("load_metadata", "SELECT count(*) AS raw_row_count, 6 AS raw_column_count, true AS sizes_known FROM flows", "flows")
def load_metadata(t):
    meta = S.load_metadata(csv_flows(t), False)
    return meta.agg(
        F.sum("raw_row_count").alias("raw_row_count"), F.max("raw_column_count").alias("raw_column_count"),
        (F.min("file_size_bytes") > 0).alias("sizes_known"),
    )


def json_batches(t):
    """Events as ingest documents of at most one hundred records each."""
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 256).alias("source_ip"),
        F.lit("192.168.0.1").alias("destination_ip"),
        (F.col("event_id") % 60000).cast("int").alias("source_port"),
        F.lit(443).alias("destination_port"),
        F.lit("TCP").alias("protocol"),
        F.col("value").alias("duration_seconds"),
        F.col("event_id").alias("total_packets"),
        F.when(F.col("event_id") % 2 == 0, F.struct((F.col("event_id") % 5).alias("syn"), F.lit(1).alias("ack"))).alias("flags"),
        F.when(F.col("event_id") % 2 == 1, (F.col("event_id") % 7).cast("int")).alias("syn_flag_count"),
        (F.col("event_type") == "error").alias("is_suspicious"),
    )
    batches = t.events.groupBy(F.expr("concat('batch-', event_id div 100)").alias("batch_id")).agg(F.collect_list(record).alias("records"))
    path = scratch_path(t.spark, "batches")
    batches.write.json(path)
    return S.read_json_batches(t.spark, path)


@query(
    "json_batch_ingest",
    """SELECT 'batch-' || event_id // 100 AS batch_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS captured_at, '10.0.0.' || user_id % 256 AS source_ip,
      CAST(event_id % 60000 AS INTEGER) AS source_port, value AS duration_seconds, event_id AS total_packets, 0::BIGINT AS total_bytes,
      CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE event_id % 7 END AS INTEGER) AS syn_flag_count, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS ack_flag_count,
      event_type = 'error' AS is_suspicious FROM events""",
)
def json_batch_ingest(t):
    return json_batches(t).select(
        "batch_id", F.to_timestamp("captured_at").cast("string").alias("captured_at"), "source_ip", "source_port", "duration_seconds", "total_packets",
        "total_bytes", "syn_flag_count", "ack_flag_count", "is_suspicious",
    )


@query(
    "batch_result",
    "SELECT 'batch-' || event_id // 100 AS batch_id, count(*) AS processed_count, count(*) FILTER (WHERE event_type = 'error') AS anomalies_detected FROM events GROUP BY 1",
)
def batch_result(t):
    return A.batch_result(json_batches(t))


LABELLED_SQL = """SELECT flows.* EXCLUDE (captured_at), CASE trim(label) WHEN 'BENIGN' THEN 'BENIGN' WHEN 'Benign' THEN 'BENIGN' WHEN 'abnormal' THEN 'BENIGN' WHEN 'DoS Hulk' THEN 'DoS'
      WHEN 'PortScan' THEN 'Port Scan' WHEN 'SSH-Patator' THEN 'Brute Force' WHEN 'Web Attack – XSS' THEN 'Web Attack' WHEN 'DDoS LOIC' THEN 'DDoS' WHEN 'Botnet' THEN 'Bot' ELSE 'Other Attack' END AS normalized_label,
      CASE WHEN trim(label) IN ('BENIGN', 'Benign', 'abnormal') THEN 0 ELSE 1 END AS is_intrusion FROM flows"""
SCALED = ("flow_duration", "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets")


def scaled_sql(c: str) -> str:
    """A column clipped, filled and scaled by the statistics of its own row set."""
    return f"""(least(greatest(coalesce({c}, {c}_m), CASE WHEN {c} IS NULL THEN {c}_m ELSE {c}_lo END), CASE WHEN {c} IS NULL THEN {c}_m ELSE {c}_hi END) - {c}_m)
      / coalesce(nullif({c}_q3 - {c}_q1, 0), 1)"""


FIT_SQL = ", ".join(
    f"(SELECT median({c}) FROM u) AS {c}_m, (SELECT quantile_cont({c}, 0.0001) FROM u) AS {c}_lo, (SELECT quantile_cont({c}, 0.9999) FROM u) AS {c}_hi, "
    f"(SELECT quantile_cont(coalesce({c}, (SELECT median({c}) FROM u)), 0.25) FROM u) AS {c}_q1, (SELECT quantile_cont(coalesce({c}, (SELECT median({c}) FROM u)), 0.75) FROM u) AS {c}_q3"
    for c in SCALED
)


@query(
    "processed_dataset",
    f"""SELECT normalized_label, is_intrusion, count(*) AS rows, {", ".join(f"round(sum({scaled_sql(c)}), 3) AS num__{c}" for c in SCALED)},
      sum(CASE WHEN s = 'A' THEN 1.0::DOUBLE ELSE 0 END) AS cat__service_A, sum(CASE WHEN s = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS cat__service_R
    FROM (SELECT *, coalesce(service, (SELECT service FROM u WHERE service IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 1)) AS s FROM (SELECT DISTINCT * FROM l)), f GROUP BY 1, 2""",
    "flows",
    l=LABELLED_SQL,
    u="SELECT DISTINCT * EXCLUDE (label, normalized_label, is_intrusion) FROM l",
    f=f"SELECT {FIT_SQL}",
)
def processed_dataset(t):
    from vigilflow.plans import training

    path = scratch_path(t.spark, "processed")
    training.write_processed(t.domain.flows.drop("captured_at"), path)
    matrix = t.spark.read.parquet(path)
    sums = [F.round(F.sum(f"num__{c}"), 3).alias(f"num__{c}") for c in SCALED] + [F.sum(c).alias(c) for c in ("cat__service_A", "cat__service_R")]
    return matrix.groupBy("normalized_label", "is_intrusion").agg(F.count(F.lit(1)).alias("rows"), *sums)


METADATA_SQL = """SELECT 'flows' AS dataset_name, false AS is_sample_dataset, (SELECT count(*) FROM flows) AS original_row_count, n AS processed_row_count,
      17 AS original_column_count, (SELECT count(*) FROM flows) - n AS duplicates_removed,
      (SELECT count(*) FROM flows WHERE isinf(flow_bytes_per_s)) + (SELECT count(*) FROM flows WHERE down_per_up_ratio = 'Infinity') AS infinite_values_imputed,
      'destination_ip,flow_id,source_ip,urg_flag_count' AS removed_columns, 'calc_avg_packet_size,calc_flow_bytes_per_s,calc_flow_packets_per_s,fwd_bwd_byte_ratio,fwd_bwd_packet_ratio,port_category,rst_ratio,syn_ratio,total_bytes,total_packets' AS engineered_features,
      'calc_avg_packet_size,calc_flow_bytes_per_s,calc_flow_packets_per_s,destination_port,down_per_up_ratio,flow_bytes_per_s,flow_duration,fwd_bwd_byte_ratio,fwd_bwd_packet_ratio,protocol,rst_flag_count,rst_ratio,syn_flag_count,syn_ratio,total_backward_packets,total_bytes,total_fwd_packets,total_length_of_bwd_packets,total_length_of_fwd_packets,total_packets' AS fitted_numerical_features, 'port_category,service' AS fitted_categorical_features,
      (SELECT string_agg(label || '=' || c || '/' || round(100.0 * c / (SELECT count(*) FROM flows) + 1e-9, 2), ';' ORDER BY label) FROM (SELECT label, count(*) AS c FROM flows GROUP BY 1)) AS label_distribution
    FROM (SELECT count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (captured_at) FROM flows))"""


def metadata(t):
    from vigilflow.plans import training

    meta = training.dataset_metadata(t.domain.flows.drop("captured_at"), "flows", False)
    text = lambda c: F.array_join(F.array_sort(c), ",")
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"]["count"], F.lit("/"), e["value"]["percentage"])
    return meta.select(
        "dataset_name", "is_sample_dataset", "original_row_count", "processed_row_count", "original_column_count", "duplicates_removed", "infinite_values_imputed",
        text(F.map_keys("removed_columns")).alias("removed_columns"),
        *[text(c).alias(c) for c in ("engineered_features", "fitted_numerical_features", "fitted_categorical_features")],
        F.array_join(F.transform(F.array_sort(F.map_entries("label_distribution")), entry), ";").alias("label_distribution"),
    )


@query("pipeline_metadata", METADATA_SQL, "flows")
def pipeline_metadata(t):
    """The governance record, field by field."""
    return metadata(t)


@query(
    "dataset_metadata",
    """SELECT (SELECT count(*) FROM flows) AS original_row_count, (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (captured_at) FROM flows)) AS processed_row_count,
      17 AS original_column_count, (SELECT count(*) FROM flows WHERE isinf(flow_bytes_per_s)) + (SELECT count(*) FROM flows WHERE down_per_up_ratio = 'Infinity') AS infinite_values_imputed,
      'destination_ip,flow_id,source_ip,urg_flag_count' AS removed_columns""",
    "flows",
)
def dataset_metadata(t):
    return metadata(t).select("original_row_count", "processed_row_count", "original_column_count", "infinite_values_imputed", "removed_columns")


# --- cleaning ---------------------------------------------------------------------------


@query(
    "normalize_columns",
    "SELECT flow_id, CAST(destination_port AS DOUBLE) AS destination_port, flow_duration, total_backward_packets, trim(label) AS label FROM flows",
    "flows",
)
def normalize_columns(t):
    return cleaning.normalize_columns(csv_flows(t)).drop("flow_bytes_per_s")


@query(
    "clean_infinite",
    """SELECT flow_id, CASE WHEN isinf(flow_bytes_per_s) THEN NULL ELSE flow_bytes_per_s END AS flow_bytes_per_s,
      CASE WHEN down_per_up_ratio = 'Infinity' THEN NULL ELSE CAST(down_per_up_ratio AS DOUBLE) END AS down_per_up_ratio, service FROM flows""",
    "flows",
)
def clean_infinite(t):
    cleaned, _ = cleaning.clean_infinite(t.domain.flows)
    return cleaned.select("flow_id", "flow_bytes_per_s", "down_per_up_ratio", "service")


@query(
    "infinite_report",
    """SELECT 'flow_bytes_per_s' AS column_name, count(*) AS infinite FROM flows WHERE isinf(flow_bytes_per_s)
    UNION ALL SELECT 'down_per_up_ratio', count(*) FROM flows WHERE down_per_up_ratio = 'Infinity'""",
    "flows",
)
def infinite_report(t):
    return cleaning.infinite_report(t.domain.flows)


@query(
    "exact_dedup",
    "SELECT DISTINCT source_ip, destination_port, protocol, service, label FROM flows",
    "flows",
)
def exact_dedup(t):
    return cleaning.exact_dedup(t.domain.flows.select("source_ip", "destination_port", "protocol", "service", "label"))


@query(
    "normalize_labels",
    """SELECT flow_id, trim(label) AS original_label, CASE trim(label) WHEN 'BENIGN' THEN 'BENIGN' WHEN 'Benign' THEN 'BENIGN' WHEN 'abnormal' THEN 'BENIGN' WHEN 'DoS Hulk' THEN 'DoS'
      WHEN 'PortScan' THEN 'Port Scan' WHEN 'SSH-Patator' THEN 'Brute Force' WHEN 'Web Attack – XSS' THEN 'Web Attack' WHEN 'DDoS LOIC' THEN 'DDoS' WHEN 'Botnet' THEN 'Bot' ELSE 'Other Attack' END AS normalized_label,
      CASE WHEN trim(label) IN ('BENIGN', 'Benign', 'abnormal') THEN 0 ELSE 1 END AS is_intrusion FROM flows""",
    "flows",
)
def normalize_labels(t):
    return cleaning.normalize_labels(t.domain.flows.select("flow_id", "label"))


@query("drop_identifiers", "SELECT captured_at IS NOT NULL AS seen, destination_port, protocol, service, label, count(*) AS n FROM flows GROUP BY ALL", "flows")
def drop_identifiers(t):
    flows = t.domain.flows
    kept = flows.drop(*cleaning.identifier_columns(flows))
    assert not {"flow_id", "source_ip", "destination_ip"} & set(kept.columns)
    return kept.groupBy(F.col("captured_at").isNotNull().alias("seen"), "destination_port", "protocol", "service", "label").agg(F.count(F.lit(1)).alias("n"))


@query("drop_constant_columns", "SELECT 'urg_flag_count' AS column_name, (SELECT count(*) FROM flows WHERE urg_flag_count <> 0) AS other_values", "flows")
def drop_constant_columns(t):
    flows = t.domain.flows
    names = cleaning.constant_columns(flows)
    wide = flows.agg(*[F.count(F.when(F.col(c) != 0, 1)).alias(c) for c in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("other_values")) for c in names])).alias("r")).select("r.*")


PAYLOAD_SQL = """SELECT event_id, CASE event_id % 4
    WHEN 0 THEN MAP {'source_ip': '10.0.0.1', 'Source Port': '80.9', 'Total Bytes': CAST(value AS VARCHAR)}
    WHEN 1 THEN MAP {'SOURCE IP': '10.0.0.2', 'src_port': 'x', 'Total Length of Fwd Packets': CAST(event_id AS VARCHAR)}
    WHEN 2 THEN MAP {'src_ip': '10.0.0.3', 'duration': CAST(value AS VARCHAR), 'total_length_of_bwd_packets': '7.5'}
    ELSE MAP {'Flow Duration': 'fast', 'Protocol': '6'} END AS m FROM events"""


def payload_maps(t):
    value, key = F.col("value").cast("string"), F.col("event_id").cast("string")

    def entry(*kv):
        return F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])

    chosen = (
        F.when(F.col("event_id") % 4 == 0, entry("source_ip", "10.0.0.1", "Source Port", "80.9", "Total Bytes", value))
        .when(F.col("event_id") % 4 == 1, entry("SOURCE IP", "10.0.0.2", "src_port", "x", "Total Length of Fwd Packets", key))
        .when(F.col("event_id") % 4 == 2, entry("src_ip", "10.0.0.3", "duration", value, "total_length_of_bwd_packets", "7.5"))
        .otherwise(entry("Flow Duration", "fast", "Protocol", "6"))
    )
    return t.events.select("event_id", chosen.alias("m"))


@query(
    "extract_telemetry",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '10.0.0.2' WHEN 2 THEN '10.0.0.3' END AS source_ip, NULL::VARCHAR AS destination_ip,
      CASE WHEN event_id % 4 = 3 THEN '6' END AS protocol, CASE WHEN event_id % 4 = 0 THEN 80::BIGINT END AS source_port, NULL::BIGINT AS destination_port,
      NULL::BIGINT AS total_forward_packets, NULL::BIGINT AS total_backward_packets, CASE WHEN event_id % 4 = 2 THEN value END AS flow_duration,
      CASE event_id % 4 WHEN 0 THEN CAST(trunc(value) AS BIGINT) WHEN 1 THEN event_id WHEN 2 THEN 7 END AS total_bytes FROM events""",
)
def extract_telemetry(t):
    return payload_maps(t).select("event_id", *telemetry.telemetry_of_map("m"))


@query(
    "safe_casts",
    "SELECT doc_id, TRY_CAST(trunc(TRY_CAST(piece AS DOUBLE)) AS BIGINT) AS whole, TRY_CAST(piece AS DOUBLE) AS number FROM (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN source ELSE CAST(n_chars / 4 AS VARCHAR) END AS piece FROM documents)",
)
def safe_casts(t):
    piece = F.when(F.col("n_chars") % 3 == 0, F.col("source")).otherwise((F.col("n_chars") / 4).cast("string"))
    return t.documents.select("doc_id", telemetry.safe_int(piece).alias("whole"), telemetry.safe_double(piece).alias("number"))


@query(
    "total_bytes_rule",
    f"SELECT flow_id, coalesce(CAST(trunc(CASE WHEN protocol = 17 THEN flow_duration END) AS BIGINT), CAST(trunc(coalesce(total_fwd_packets, 0)) AS BIGINT) + CAST(trunc(total_length_of_bwd_packets) AS BIGINT)) AS total_bytes FROM flows",
    "flows",
)
def total_bytes_rule(t):
    direct = F.when(F.col("protocol") == 17, F.col("flow_duration"))
    total = telemetry.total_bytes(direct, F.col("total_fwd_packets"), F.col("total_length_of_bwd_packets"))
    return t.domain.flows.select("flow_id", total.alias("total_bytes"))


@query(
    "compact_flow_json",
    """SELECT event_id, CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'value': value, 'props': props}) AS VARCHAR) AS raw_flow_data FROM events""",
)
def compact_flow_json(t):
    return t.events.select("event_id", telemetry.compact_flow_json(t.events).alias("raw_flow_data"))


@query("drop_target_columns", "SELECT * EXCLUDE (label, captured_at, flow_bytes_per_s) FROM flows", "flows")
def drop_target_columns(t):
    return cleaning.drop_target_columns(t.domain.flows).drop("captured_at", "flow_bytes_per_s")


@query(
    "default_projection",
    f"""SELECT id, coalesce(threat, 'BENIGN') AS predicted_threat, coalesce(risk, 'LOW') AS risk_level, round(coalesce(score, 0.0), 4) AS anomaly_score, round(classification_confidence, 4) AS classification_confidence
    FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN predicted_threat END AS threat, CASE WHEN id % 5 <> 0 THEN risk_level END AS risk, CASE WHEN id % 7 <> 0 THEN anomaly_score END AS score FROM predictions)""",
    "predictions",
)
def default_projection(t):
    from vigilflow.operators.hunting import prediction_items

    gaps = t.domain.predictions.withColumns(
        {
            "predicted_threat": F.expr("CASE WHEN id % 3 <> 0 THEN predicted_threat END"),
            "risk_level": F.expr("CASE WHEN id % 5 <> 0 THEN risk_level END"),
            "anomaly_score": F.expr("CASE WHEN id % 7 <> 0 THEN anomaly_score END"),
        }
    )
    return prediction_items(gaps).select("id", "predicted_threat", "risk_level", "anomaly_score", "classification_confidence")


# --- features -----------------------------------------------------------------------------


def feature(name: str, key: str, sql: str):
    @query(key, f"SELECT flow_id, {sql} AS {name} FROM flows", "flows")
    def run(t):
        return features.engineer(t.domain.flows).select("flow_id", name)


feature("total_packets", "total_packets", TOTAL_PACKETS)
feature("total_bytes", "total_bytes", TOTAL_BYTES)
feature("fwd_bwd_packet_ratio", "packet_ratio", "total_fwd_packets / (total_backward_packets + 1.0::DOUBLE)")
feature("fwd_bwd_byte_ratio", "byte_ratio", "total_length_of_fwd_packets / (total_length_of_bwd_packets + 1.0::DOUBLE)")
feature("syn_ratio", "syn_ratio", f"coalesce(syn_flag_count, 0) / ({TOTAL_PACKETS} + 1.0::DOUBLE)")
feature("rst_ratio", "rst_ratio", f"coalesce(rst_flag_count, 0) / ({TOTAL_PACKETS} + 1.0::DOUBLE)")
feature("calc_avg_packet_size", "avg_packet_size", f"{TOTAL_BYTES} / ({TOTAL_PACKETS} + 1.0::DOUBLE)")
feature("port_category", "port_category", PORT_TIER)


@query(
    "flow_rates",
    f"""SELECT flow_id, CASE WHEN flow_duration IS NOT NULL THEN {TOTAL_PACKETS} / {SECONDS} END AS calc_flow_packets_per_s,
      CASE WHEN flow_duration IS NOT NULL THEN {TOTAL_BYTES} / {SECONDS} END AS calc_flow_bytes_per_s FROM flows""",
    "flows",
)
def flow_rates(t):
    rates = ["calc_flow_packets_per_s", "calc_flow_bytes_per_s"]
    return features.engineer(t.domain.flows).select("flow_id", *rates)


@query(
    "protocol_name",
    "SELECT id, CASE protocol WHEN '6' THEN 'TCP (6)' WHEN '17' THEN 'UDP (17)' END AS protocol_name FROM predictions",
    "predictions",
)
def protocol_name(t):
    return t.domain.predictions.select("id", features.protocol_name("protocol").alias("protocol_name"))


@query(
    "protocol_code",
    "SELECT id, CASE protocol WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 END AS protocol_code FROM traffic_records",
    "traffic_records",
)
def protocol_code(t):
    return t.domain.traffic_records.select("id", features.protocol_code("protocol").alias("protocol_code"))


@query(
    "conn_per_destination",
    "SELECT flow_id, destination_ip, count(*) OVER (PARTITION BY destination_ip) AS connections FROM flows",
    "flows",
)
def conn_per_destination(t):
    rows = t.domain.flows.select("flow_id", "destination_ip")
    return features.with_connection_frequency(rows).select("flow_id", "destination_ip", "connections")


@query(
    "severity_score",
    "SELECT p.id, round(classification_confidence * 0.4::DOUBLE + anomaly_score * 0.3::DOUBLE + coalesce(criticality_level, 2) / 4 * 0.3::DOUBLE, 6) AS severity_score FROM predictions p LEFT JOIN system_nodes n ON n.ip_address = p.destination_ip",
    "predictions system_nodes",
)
def severity_score(t):
    return features.severity_score(t.domain.predictions, t.domain.system_nodes).select("id", "severity_score")


# --- fitting --------------------------------------------------------------------------------

FIT_COLUMNS = ["flow_duration", "total_fwd_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets"]


def outer(f: str) -> str:
    return " UNION ALL ".join(f.format(c=c) for c in FIT_COLUMNS)


BOUNDS = outer("SELECT '{c}' AS column_name, quantile_cont({c}, 0.0001) AS lo, quantile_cont({c}, 0.9999) AS hi, quantile_cont({c}, 0.5) AS med FROM flows")


@query(
    "quantile_bounds",
    "SELECT column_name, round(lo, 6) AS low, round(hi, 6) AS high FROM b WHERE hi > lo",
    "flows",
    b=BOUNDS,
)
def quantile_bounds(t):
    found = fitting.quantile_bounds(t.domain.flows, FIT_COLUMNS)
    rows = [(c, round(lo, 6), round(hi, 6)) for c, (lo, hi) in found.items()]
    return t.spark.createDataFrame(rows, "column_name string, low double, high double")


@query(
    "clip",
    "SELECT flow_id, round(least(greatest(total_length_of_fwd_packets, lo), hi), 6) AS clipped FROM flows JOIN b ON column_name = 'total_length_of_fwd_packets'",
    "flows",
    b=BOUNDS,
)
def clip(t):
    flows = t.domain.flows
    low, high = fitting.quantile_bounds(flows, ["total_length_of_fwd_packets"])["total_length_of_fwd_packets"]
    return flows.select("flow_id", F.round(fitting.clip(F.col("total_length_of_fwd_packets"), low, high), 6).alias("clipped"))


FILLED = outer("SELECT flow_id, '{c}' AS column_name, coalesce({c}, (SELECT med FROM b WHERE column_name = '{c}')) AS x FROM flows")
SCALES = "SELECT column_name, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg(x) AS mean, stddev_pop(x) AS std FROM f GROUP BY 1"


def long_form(df, prefix=""):
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(f"{prefix}{c}", 6).alias("value")) for c in FIT_COLUMNS])
    return df.select("flow_id", F.explode(cells).alias("x")).select("flow_id", "x.*")


def numeric_params(t, scaler):
    params = fitting.FittedParams(numeric=fitting.fit_numeric(t.domain.flows.select(*FIT_COLUMNS), FIT_COLUMNS, scaler))
    for p in params.numeric:
        p.low = p.high = None  # scaling alone, without clipping
    return params


@query("median_impute", "SELECT flow_id, column_name, round(x, 6) AS value FROM f", "flows", b=BOUNDS, f=FILLED)
def median_impute(t):
    params = {p.column: p.median for p in numeric_params(t, "robust").numeric}
    return long_form(t.domain.flows.select("flow_id", *[F.coalesce(c, F.lit(params[c])).alias(c) for c in FIT_COLUMNS]))


@query(
    "robust_scale",
    "SELECT flow_id, f.column_name, round((x - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) AS value FROM f JOIN s ON s.column_name = f.column_name",
    "flows",
    b=BOUNDS,
    f=FILLED,
    s=SCALES,
)
def robust_scale(t):
    return scaled(t, "robust")


@query(
    "standard_scale",
    "SELECT flow_id, f.column_name, round((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS value FROM f JOIN s ON s.column_name = f.column_name",
    "flows",
    b=BOUNDS,
    f=FILLED,
    s=SCALES,
)
def standard_scale(t):
    return scaled(t, "standard")


def scaled(t, scaler):
    params = numeric_params(t, scaler)
    return long_form(t.domain.flows.select("flow_id", *fitting.feature_columns(params)), "num__")


@query(
    "mode_impute",
    "SELECT flow_id, coalesce(service, (SELECT service FROM flows WHERE service IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 1)) AS service FROM flows",
    "flows",
)
def mode_impute(t):
    (params,) = fitting.fit_categories(t.domain.flows, ["service"])
    return t.domain.flows.select("flow_id", F.coalesce("service", F.lit(params.mode)).alias("service"))


@query(
    "one_hot",
    """SELECT flow_id, CASE WHEN s = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat__service_A, CASE WHEN s = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat__service_N, CASE WHEN s = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat__service_R
    FROM (SELECT flow_id, CASE WHEN protocol = 17 THEN 'new' ELSE coalesce(service, (SELECT service FROM flows WHERE service IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 1)) END AS s FROM flows)""",
    "flows",
)
def one_hot(t):
    flows = t.domain.flows
    params = fitting.FittedParams(categorical=fitting.fit_categories(flows, ["service"]))
    unseen = flows.withColumn("service", F.when(F.col("protocol") == 17, "new").otherwise(F.col("service")))
    return unseen.select("flow_id", *fitting.feature_columns(params))


WIDE = ["service", "destination_ip", "day"]
WIDE_SQL = "SELECT flow_id, service, destination_ip, strftime(captured_at, '%Y-%m-%d') AS day FROM flows"
INDEX_SQL = """SELECT column_name, value, count(*) AS rows, row_number() OVER (ORDER BY place, value) - 1 AS index
      FROM (SELECT unnest([{'place': 1, 'column_name': 'service', 'value': service}, {'place': 2, 'column_name': 'destination_ip', 'value': destination_ip}, {'place': 3, 'column_name': 'day', 'value': day}], recursive := true) FROM wide)
      WHERE value IS NOT NULL GROUP BY place, column_name, value"""
MODES_SQL = "SELECT column_name, value AS mode, count(*) OVER (PARTITION BY column_name) AS categories FROM i QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, value) = 1"


def wide_rows(t):
    """Category columns of thousands of values, the day of capture among them."""
    return t.domain.flows.select("flow_id", "service", "destination_ip", F.date_format("captured_at", "yyyy-MM-dd").alias("day"))


@query("category_index", "SELECT column_name, value, rows, index FROM i", "flows", wide=WIDE_SQL, i=INDEX_SQL)
def category_index(t):
    return encoding.fit_index(wide_rows(t), WIDE)


@query("category_modes", "SELECT column_name, mode, categories FROM m", "flows", wide=WIDE_SQL, i=INDEX_SQL, m=MODES_SQL)
def category_modes(t):
    return encoding.modes(encoding.fit_index(wide_rows(t), WIDE))


@query(
    "one_hot_sparse",
    """SELECT flow_id, (SELECT count(*) FROM i) AS size, concat_ws(',', a.index, b.index, c.index) AS indices
    FROM (SELECT flow_id, coalesce(service, (SELECT mode FROM m WHERE column_name = 'service')) AS s, coalesce(destination_ip, (SELECT mode FROM m WHERE column_name = 'destination_ip')) AS d,
      CASE WHEN service = 'N' THEN 'new' ELSE coalesce(day, (SELECT mode FROM m WHERE column_name = 'day')) END AS y FROM wide) w
    LEFT JOIN i a ON a.column_name = 'service' AND a.value = s LEFT JOIN i b ON b.column_name = 'destination_ip' AND b.value = d LEFT JOIN i c ON c.column_name = 'day' AND c.value = y""",
    "flows",
    wide=WIDE_SQL,
    i=INDEX_SQL,
    m=MODES_SQL,
)
def one_hot_sparse(t):
    rows = wide_rows(t)
    unseen = rows.withColumn("day", F.when(F.col("service") == "N", "new").otherwise(F.col("day")))
    found = encoding.encode(unseen, encoding.fit_index(rows, WIDE), WIDE)
    return found.select("flow_id", "categories.size", F.array_join(F.transform("categories.indices", lambda x: x.cast("string")), ",").alias("indices"))


@query(
    "split_numeric_categorical",
    """SELECT kind, count(*) AS columns, (SELECT count(*) FROM flows) AS rows FROM (SELECT CASE WHEN data_type IN ('VARCHAR', 'TIMESTAMP') THEN 'categorical' ELSE 'numeric' END AS kind
      FROM (VALUES ('VARCHAR'), ('TIMESTAMP'), ('VARCHAR'), ('VARCHAR'), ('INTEGER'), ('INTEGER'), ('DOUBLE'), ('DOUBLE'), ('DOUBLE'), ('DOUBLE'), ('DOUBLE'), ('DOUBLE'), ('DOUBLE'), ('DOUBLE'), ('DOUBLE'), ('VARCHAR'), ('VARCHAR'), ('VARCHAR')) v(data_type)) GROUP BY 1""",
    "flows",
)
def split_numeric_categorical(t):
    flows = t.domain.flows
    numeric, categorical = fitting.split_columns(flows)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(len(c)).cast("long").alias("columns")) for k, c in (("numeric", numeric), ("categorical", categorical))])
    return flows.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(kinds).alias("k"), "rows").select("k.*", "rows")


@query("align_schema", "SELECT flow_duration, NULL::DOUBLE AS flow_iat_mean, service, NULL::VARCHAR AS vlan, count(*) AS n FROM flows GROUP BY ALL", "flows")
def align_schema(t):
    wanted = fitting.FittedParams(
        numeric=[fitting.NumericParams(c, None, None, 0.0, 0.0, 1.0) for c in ("flow_duration", "flow_iat_mean")],
        categorical=[fitting.CategoryParams(c, "x", ["x"]) for c in ("service", "vlan")],
    )
    aligned = fitting.align(t.domain.flows, wanted)
    return aligned.groupBy(*aligned.columns).agg(F.count(F.lit(1)).alias("n"))


SPLIT = """SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY mark, event_id) <= quota AS is_test FROM (
      SELECT event_id, event_type AS stratum, md5('42|' || event_id) AS mark FROM events) JOIN q ON q.label = stratum"""
QUOTA = """SELECT label, CAST(floor(n * 0.30::DOUBLE) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(n * 0.30::DOUBLE - floor(n * 0.30::DOUBLE), 9) DESC, label)
      <= (SELECT ceil(count(*) * 0.30::DOUBLE) FROM events) - sum(floor(n * 0.30::DOUBLE)) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)"""


@query("train_test_split", "SELECT event_id, event_type, is_test FROM (SELECT event_id, stratum AS event_type, is_test FROM s)", q=QUOTA, s=SPLIT)
def train_test_split(t):
    rows = t.events.select("event_id", "event_type")
    return fitting.train_test_split(rows, "event_type", ["event_id"])


@query(
    "fit_on_train_only",
    """SELECT event_id, is_test, round((value - m) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) AS scaled FROM events JOIN s USING (event_id),
      (SELECT quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events JOIN s USING (event_id) WHERE NOT is_test)""",
    q=QUOTA,
    s=SPLIT,
)
def fit_on_train_only(t):
    rows = fitting.train_test_split(t.events.select("event_id", "event_type", "value"), "event_type", ["event_id"])
    params = fitting.FittedParams(numeric=fitting.fit_numeric(rows.filter("NOT is_test"), ["value"]))
    params.numeric[0].low = params.numeric[0].high = None
    return rows.select("event_id", "is_test", *fitting.feature_columns(params)).select(
        "event_id", "is_test", F.round("num__value", 6).alias("scaled")
    )


# --- profiling ---------------------------------------------------------------------------------


@query(
    "profile_overview",
    f"""SELECT row_count, 18 AS column_count, row_count - u AS duplicate_count, {pct('(row_count - u)', 'row_count')} AS duplicate_percentage
    FROM (SELECT (SELECT count(*) FROM flows) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM flows)) AS u)""",
    "flows",
)
def profile_overview(t):
    return profiling.profile_overview(t.domain.flows)


@query(
    "profile_missing",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM flows)')} AS percentage FROM flows WHERE {c} IS NULL" for c in ("flow_duration", "total_fwd_packets", "service")),
    "flows",
)
def profile_missing(t):
    return profiling.profile_missing(profiling.column_stats(t.domain.flows))


@query(
    "profile_infinite",
    """SELECT 'flow_bytes_per_s' AS column_name, count(*) AS count FROM flows WHERE isinf(flow_bytes_per_s)
    UNION ALL SELECT 'down_per_up_ratio', count(*) FROM flows WHERE down_per_up_ratio = 'Infinity'""",
    "flows",
)
def profile_infinite(t):
    return profiling.profile_infinite(profiling.column_stats(t.domain.flows))


@query("profile_constant", "SELECT 'urg_flag_count' AS column_name FROM flows HAVING count(DISTINCT urg_flag_count) = 1", "flows")
def profile_constant(t):
    return profiling.profile_constant(profiling.column_stats(t.domain.flows))


@query(
    "profile_identifiers",
    "SELECT unnest(CASE WHEN count(*) = count(DISTINCT event_id) AND count(*) = count(DISTINCT ts) THEN ['event_id', 'ts'] ELSE ['event_id'] END) AS column_name FROM events",
)
def profile_identifiers(t):
    return profiling.profile_identifiers(t.events)


@query(
    "profile_problems",
    f"""SELECT 'urg_flag_count' AS column_name, '{V.PROBLEM_CONSTANT}' AS reason
    UNION ALL SELECT 'gap', 'Severe missing rate (' || {fixed("100.0 * count(*) / (SELECT count(*) FROM flows)", 1)} || '%)' FROM flows WHERE protocol <> 17
    UNION ALL SELECT 'flow_bytes_per_s', 'Contains ' || count(*) || ' infinite values (e.g. divide-by-zero)' FROM flows WHERE isinf(flow_bytes_per_s)
    UNION ALL SELECT 'down_per_up_ratio', 'Contains ' || count(*) || ' infinite values (e.g. divide-by-zero)' FROM flows WHERE down_per_up_ratio = 'Infinity'""",
    "flows",
)
def profile_problems(t):
    gappy = t.domain.flows.withColumn("gap", F.when(F.col("protocol") == 17, F.col("flow_id")))
    return profiling.profile_problems(profiling.column_stats(gappy))


@query(
    "profile_labels",
    f"SELECT label, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM flows)')} AS percentage FROM flows GROUP BY 1",
    "flows",
)
def profile_labels(t):
    return profiling.profile_labels(t.domain.flows)


@query(
    "label_breakdown",
    f"SELECT service, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM flows)')} AS percentage FROM flows GROUP BY 1",
    "flows",
)
def label_breakdown(t):
    return A.counts_with_share(t.domain.flows, "service", "service")


TEXT_COLUMNS = ["flow_id", "source_ip", "destination_ip", "down_per_up_ratio", "service"]


@query(
    "profile_categorical",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM flows WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values FROM flows"
        for c in TEXT_COLUMNS
    ),
    "flows",
)
def profile_categorical(t):
    return profiling.profile_categorical(t.domain.flows).withColumn("sample_values", F.array_join("sample_values", ","))


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, round(min(x), 3) AS min, round(quantile_cont(x, 0.5), 3) AS median, round(max(x), 3) AS max FROM (SELECT CASE WHEN NOT isinf(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END AS x FROM flows)"
        for c in ["destination_port", "protocol", "flow_duration", "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets",
                  "total_length_of_bwd_packets", "syn_flag_count", "rst_flag_count", "flow_bytes_per_s", "urg_flag_count"]
    ),
    "flows",
)
def profile_numeric(t):
    return profiling.profile_numeric(t.domain.flows)


# --- quality ----------------------------------------------------------------------------------

PAYLOAD = """CASE event_id % 10 WHEN 0 THEN '{}' WHEN 1 THEN '{"Flow Duration": null}' WHEN 2 THEN '{"Flow Duration": " NaN "}' WHEN 3 THEN '{"bad<key": 1}'
  WHEN 4 THEN '{"__proto": 1}' WHEN 5 THEN '{"Protocol": {"a": 1}}' WHEN 6 THEN '{"port_category": "a;b"}' WHEN 7 THEN '{"Flow Duration": "abc"}' WHEN 8 THEN 'no json' ELSE props END"""
REASONS = """CASE event_id % 10 WHEN 0 THEN 'empty payload' WHEN 1 THEN 'no attributes' WHEN 2 THEN 'NaN or infinity' WHEN 3 THEN 'invalid field name' WHEN 4 THEN 'invalid field name'
  WHEN 5 THEN 'nested value' WHEN 6 THEN 'disallowed text' WHEN 7 THEN 'not a number' WHEN 8 THEN 'not a JSON object' ELSE '' END"""


@query("validate_flow_payload", f"SELECT event_id, {REASONS} AS reasons FROM events")
def validate_flow_payload(t):
    return t.events.select("event_id", F.array_join(quality.payload_reasons(F.expr(PAYLOAD)), ", ").alias("reasons"))


@query(
    "check_constraints",
    """SELECT 'traffic' AS entity, id, 'destination_port out of range' AS reasons FROM traffic_records WHERE destination_port > 65535
    UNION ALL SELECT 'threat', id, 'severity not allowed' FROM threat_events WHERE severity = 'SEVERE'
    UNION ALL SELECT 'alert', CAST(id AS VARCHAR), 'severity not allowed' FROM alerts WHERE severity = 'LOW'
    UNION ALL SELECT 'audit', CAST(id AS VARCHAR), 'action not allowed' FROM audit_logs WHERE action LIKE '%UNKNOWN%'
    UNION ALL SELECT 'incident', CAST(id AS VARCHAR), 'status not allowed' FROM incidents WHERE status = 'CLOSED'""",
    "predictions alerts traffic_records threat_events audit_logs incidents",
)
def check_constraints(t):
    d = t.domain
    parts = []
    checks = {
        "traffic": (d.traffic_records, quality.traffic_rules()),
        "threat": (d.threat_events, quality.threat_rules()),
        "alert": (d.alerts, quality.security_alert_rules()),
        "audit": (d.audit_logs, quality.audit_rules()),
        "incident": (d.incidents, quality.incident_rules()),
    }
    for name, (df, rules) in checks.items():
        _, bad = quality.split_valid(quality.check_constraints(df, rules))
        parts.append(bad.select(F.lit(name).alias("entity"), F.col("id").cast("string").alias("id"), F.array_join("reasons", ", ").alias("reasons")))
    return reduce(lambda a, b: a.unionByName(b), parts)


ADDRESS = """CASE event_id % 8 WHEN 0 THEN '10.0.' || user_id % 300 || '.1' WHEN 1 THEN '10.01.0.1' WHEN 2 THEN ' 192.168.0.' || user_id % 256 || ' ' WHEN 3 THEN 'FE80::' || user_id
  WHEN 4 THEN '2001:0DB8:0:0:0:0:0:' || user_id WHEN 5 THEN '1::2::3' WHEN 6 THEN '::ffff:10.0.0.' || user_id % 256 ELSE event_type END"""


@query(
    "validate_ip",
    f"""SELECT event_id, {ADDRESS} AS address, canonical_ip, canonical_ip IS NOT NULL AS is_valid_ip FROM (SELECT *, CASE event_id % 8
      WHEN 0 THEN CASE WHEN user_id % 300 < 256 THEN '10.0.' || user_id % 300 || '.1' END WHEN 2 THEN '192.168.0.' || user_id % 256
      WHEN 3 THEN CASE WHEN user_id > 9999 THEN NULL WHEN user_id = 0 THEN 'fe80::' ELSE 'fe80::' || user_id END
      WHEN 4 THEN CASE WHEN user_id > 9999 THEN NULL WHEN user_id = 0 THEN '2001:db8::' ELSE '2001:db8::' || user_id END
      WHEN 6 THEN '::ffff:10.0.0.' || user_id % 256 END AS canonical_ip FROM events)""",
)
def validate_ip(t):
    rows = t.events.select("event_id", F.expr(ADDRESS).alias("address"))
    return quality.validate_ip(rows, "address")


@query(
    "traffic_query",
    f"""SELECT id, {iso('captured_at')} AS captured_at, source_ip, destination_port, protocol FROM traffic_records WHERE protocol = 'UDP' AND destination_port = 443
      AND captured_at >= TIMESTAMP '1999-01-01 00:00:00' ORDER BY traffic_records.captured_at DESC, id DESC LIMIT 100""",
    "traffic_records",
)
def traffic_query(t):
    found = t.domain.traffic_records.filter(
        P.equal_filters(protocol="UDP", destination_port=443) & (F.col("captured_at") >= literal("1999-01-01"))
    )
    rows = P.page(found.select("id", "captured_at", "source_ip", "destination_port", "protocol"), "captured_at", 100)
    return rows.withColumn("captured_at", spark_iso("captured_at"))


@query(
    "threats_query",
    f"""SELECT t.id, threat_type, severity, status, {iso('detected_at')} AS detected_at, r.destination_ip, r.destination_port FROM threat_events t JOIN traffic_records r ON r.id = t.traffic_record_id
      WHERE severity = 'HIGH' AND threat_type = 'PortScan' AND r.source_ip = '10.0.0.7' ORDER BY t.detected_at DESC, t.id DESC LIMIT 200""",
    "threat_events traffic_records",
)
def threats_query(t):
    records = t.domain.traffic_records.filter(F.col("source_ip") == "10.0.0.7").select(
        F.col("id").alias("traffic_record_id"), "destination_ip", "destination_port"
    )
    found = t.domain.threat_events.filter(P.equal_filters(severity="HIGH", threat_type="PortScan"))
    rows = P.page(found.join(records, "traffic_record_id"), "detected_at", 200)
    return rows.select("id", "threat_type", "severity", "status", spark_iso("detected_at").alias("detected_at"), "destination_ip", "destination_port")
