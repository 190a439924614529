"""The security entities, as views over the given tables.

Every view is a projection of one scan (plus a dimension join where a column
lives elsewhere), so filters and column lists reach the parquet files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.functions.triage import alert_type, risk_band
from vigilflow.sources.tables import Tables

AS_OF = "2024-01-31 00:00:00"
PORTS = [21, 22, 23, 53, 80, 443, 445, 3389, 4444, 8080, 49200]
CATEGORIES = ["DoS", "Port Scan", "Brute Force", "Web Attack", "Infiltration"]
CASE_SPREAD_SECONDS = 30 * 24 * 3600


def ip_of(number: str) -> Column:
    """An address in 10.0.0.0/8 for a non-negative number."""
    return F.expr(
        f"concat('10.', {number} div 65536 % 256, '.', {number} div 256 % 256, '.', {number} % 256)"
    )


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_value(column: str, mapping: dict[str, str], other: Column | str) -> Column:
    chosen = other if isinstance(other, Column) else F.lit(other)
    for key, value in reversed(mapping.items()):
        chosen = F.when(F.col(column) == key, value).otherwise(chosen)
    return chosen


class Domain:
    def __init__(self, tables: Tables):
        self.t = tables

    @cached_property
    def predictions(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        base = self.t.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("timestamp"),
            F.expr("CASE WHEN event_id % 97 = 13 THEN NULL WHEN event_id % 101 = 7 THEN '' ELSE 'x' END").alias("src"),
            ip_of("user_id").alias("ip"),
            F.expr("concat('192.168.0.', event_id % 20)").alias("destination_ip"),
            F.expr("cast(1024 + event_id % 60000 as int)").alias("source_port"),
            k.alias("k"),
            "event_type",
            F.least(F.col("value") / 100, F.lit(1.0)).alias("anomaly_score"),
            "value",
            "event_id",
            "props",
        )
        threat = _by_value(
            "event_type",
            {"click": "Port Scan", "purchase": "Web Attack", "error": "DoS"},
            "BENIGN",
        )
        scored = base.select(
            "id",
            "timestamp",
            F.when(F.col("src") == "x", F.col("ip")).otherwise(F.col("src")).alias("source_ip"),
            "destination_ip",
            "source_port",
            _pick(PORTS, F.col("k") % 11).alias("destination_port"),
            F.when(F.col("k") % 2 == 0, "6").otherwise("17").alias("protocol"),
            (F.col("value") * 1000).alias("flow_duration"),
            F.col("k").cast("long").alias("total_forward_packets"),
            (F.col("event_id") % 40).alias("total_backward_packets"),
            (F.col("k") * 64 + F.col("event_id") % 1500).cast("long").alias("total_bytes"),
            F.when(F.col("anomaly_score") >= 0.5, "ANOMALOUS").otherwise("NORMAL").alias("anomaly_label"),
            "anomaly_score",
            ((0.5 - F.col("anomaly_score")) / 2).alias("raw_decision_score"),
            threat.alias("predicted_threat"),
            (threat != "BENIGN").alias("intrusion_flag"),
            (F.col("k") / 100).alias("classification_confidence"),
            F.col("props").alias("raw_flow_data"),
        )
        band = risk_band(
            F.col("intrusion_flag"),
            F.col("classification_confidence"),
            F.col("anomaly_label") == "ANOMALOUS",
            F.col("anomaly_score"),
        )
        return (
            scored.withColumn("band", band)
            .select(
                *[c for c in scored.columns if c != "raw_flow_data"],
                F.col("band.risk_level").alias("risk_level"),
                F.col("band.recommended_action").alias("recommended_action"),
                F.lit("1.0.0").alias("model_version"),
                "raw_flow_data",
                F.col("timestamp").alias("created_at"),
            )
        )

    @cached_property
    def alerts(self) -> DataFrame:
        status = _pick(["NEW", "ACKNOWLEDGED", "RESOLVED"], F.col("id") % 3)
        return self.predictions.filter(F.col("risk_level") != "LOW").select(
            "id",
            F.col("id").alias("prediction_id"),
            "timestamp",
            alert_type(F.col("risk_level")).alias("alert_type"),
            F.col("risk_level").alias("severity"),
            F.col("predicted_threat").alias("threat_label"),
            "anomaly_score",
            F.col("classification_confidence").alias("confidence"),
            "source_ip",
            "destination_ip",
            status.alias("status"),
            "recommended_action",
            "created_at",
            F.when(F.col("id") % 3 != 0, F.expr("created_at + interval 10 minutes")).alias("acknowledged_at"),
            F.when(F.col("id") % 3 == 2, F.expr("created_at + interval 2 hours")).alias("resolved_at"),
        )

    @cached_property
    def audit_logs(self) -> DataFrame:
        about_case = F.col("event_id") % 4 == 2
        action = _by_value(
            "event_type",
            {"error": "LOGIN_FAILURE", "click": "ACCESS_DENIED", "purchase": "RATE_LIMIT_EXCEEDED"},
            F.when(F.col("event_type") == "signup", F.when(about_case, "INCIDENT_ASSIGNED").otherwise("LOGIN_SUCCESS"))
            .otherwise(F.when(about_case, "INCIDENT_STATUS_CHANGED").otherwise("ANALYTICS_VIEWED")),
        )
        return self.t.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("user"), F.col("user_id")).alias("username"),
            _pick(["ADMIN", "ANALYST", "VIEWER"], F.col("user_id") % 3).alias("user_role"),
            action.alias("action"),
            _pick(["PREDICTION", "ALERT", "INCIDENT", "AUTH"], F.col("event_id") % 4).alias("resource_type"),
            F.col("event_id").cast("string").alias("resource_id"),
            _by_value("event_type", {"error": "FAILURE", "click": "DENIED", "purchase": "DENIED"}, "SUCCESS").alias("outcome"),
            ip_of("user_id").alias("ip_address"),
            F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("request_method"),
            F.concat(F.lit("/api/v1/"), "event_type").alias("request_path"),
            _by_value("event_type", {"error": "401", "click": "403", "purchase": "429"}, "200").cast("int").alias("status_code"),
            F.col("props").alias("details"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def incidents(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        offset = F.expr(f"make_dt_interval(0, 0, 0, o_orderkey * 7919 % {CASE_SPREAD_SECONDS})")
        base = self.t.orders.select(
            F.col("o_orderkey").alias("id"),
            "o_custkey",
            (start + offset).alias("created_at"),
            _by_value("o_orderpriority", {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}, "LOW").alias("severity"),
            F.when(F.col("o_orderstatus") == "F", "RESOLVED")
            .when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 4 == 0, "CONTAINED").otherwise("INVESTIGATING"))
            .otherwise(F.when(F.col("o_orderkey") % 3 == 0, "ACKNOWLEDGED").otherwise("OPEN"))
            .alias("status"),
            _pick(CATEGORIES, F.col("o_custkey") % 5).alias("category"),
        )
        started = F.col("status").isin("INVESTIGATING", "CONTAINED", "RESOLVED")
        resolved = F.col("status") == "RESOLVED"
        staged = base.select(
            "*",
            F.when(F.col("status") != "OPEN", F.expr("created_at + interval 15 minutes")).alias("acknowledged_at"),
            F.when(started, F.expr("created_at + interval 1 hour")).alias("investigation_started_at"),
            F.when(resolved, F.expr("created_at + make_dt_interval(0, 2 + cast(o_custkey % 72 as int), 0, 0)")).alias("resolved_at"),
        )
        return staged.select(
            "id",
            F.format_string("INC-2024-%06d", F.col("id") + 1).alias("incident_key"),
            F.concat(F.lit("Case "), "category", F.lit(" #"), "id").alias("title"),
            F.concat(F.lit("Observed by customer "), "o_custkey").alias("description"),
            "severity",
            "status",
            "category",
            ip_of("o_custkey").alias("source_ip"),
            F.when(F.col("o_custkey") % 5 != 0, F.format_string("Customer#%09d", "o_custkey")).alias("assigned_to"),
            F.concat(F.lit("analyst"), F.col("o_custkey") % 7).alias("created_by"),
            "created_at",
            F.coalesce("resolved_at", "investigation_started_at", "acknowledged_at", "created_at").alias("updated_at"),
            "acknowledged_at",
            "investigation_started_at",
            "resolved_at",
            F.when(resolved & (F.col("id") % 4 != 0), F.concat(F.lit("Blocked "), ip_of("o_custkey"))).alias("resolution_summary"),
        )

    @cached_property
    def incident_alerts(self) -> DataFrame:
        return self.t.lineitem.select(
            F.col("l_orderkey").alias("incident_id"), F.col("l_partkey").alias("alert_id")
        ).distinct()

    @cached_property
    def incident_predictions(self) -> DataFrame:
        return self.t.lineitem.select(
            F.col("l_orderkey").alias("incident_id"), F.col("l_suppkey").alias("prediction_id")
        ).distinct()

    @cached_property
    def incident_notes(self) -> DataFrame:
        at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.expr(
            "make_dt_interval(0, 0, cast(turn as int), conv_id)"
        )
        return self.t.conversations.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("incident_id"),
            F.col("role").alias("author"),
            F.col("text").alias("note"),
            at.alias("created_at"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.t.customer.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("username"),
            _by_value("c_mktsegment", {"HOUSEHOLD": "VIEWER", "MACHINERY": "ADMIN"}, "ANALYST").alias("role"),
            (F.col("c_acctbal") > 0).alias("is_active"),
        )

    @cached_property
    def system_nodes(self) -> DataFrame:
        return self.t.supplier.select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("hostname"),
            F.expr("concat('192.168.', s_suppkey div 256 % 256, '.', s_suppkey % 256)").alias("ip_address"),
            _pick(["production", "staging", "internal_dmz"], F.col("s_nationkey") % 3).alias("environment"),
            (F.col("s_nationkey") % 4 + 1).alias("criticality_level"),
            (F.col("s_acctbal") > 0).alias("is_active"),
        )

    @cached_property
    def threat_intel(self) -> DataFrame:
        places = self.t.nation.join(
            self.t.region, self.t.nation.n_regionkey == self.t.region.r_regionkey
        ).select("n_nationkey", "n_name", "r_name")
        rows = self.t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.select(
            ip_of("s_suppkey").alias("indicator"),
            F.when(F.col("s_acctbal") < 0, "MALICIOUS").when(F.col("s_acctbal") < 3000, "SUSPICIOUS").otherwise("BENIGN").alias("reputation"),
            ((F.col("s_suppkey") % 100) / 100).alias("confidence"),
            F.array("n_name", "r_name").alias("categories"),
            F.concat(F.lit("Reported by "), "s_name").alias("notes"),
            F.format_string("2024-01-%02dT00:00:00Z", F.col("s_suppkey") % 28 + 1).alias("first_seen"),
            F.format_string("2024-02-%02dT00:00:00Z", F.col("s_suppkey") % 28 + 1).alias("last_seen"),
        )

    @cached_property
    def flows(self) -> DataFrame:
        """Raw labelled flows with the usual defects: gaps, infinities, odd labels."""
        label = (
            F.when(F.col("l_linenumber") == 7, _pick(["abnormal", "dos", "DDoS LOIC", "Botnet"], F.col("l_partkey") % 4))
            .when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "BENIGN").otherwise("DoS Hulk"))
            .when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "F", "PortScan").otherwise(" Benign "))
            .otherwise(F.when(F.col("l_linestatus") == "F", "SSH-Patator").otherwise("Web Attack – XSS"))
        )
        rate = F.when(F.col("l_partkey") % 50 == 0, F.lit(float("inf"))).when(
            F.col("l_partkey") % 50 == 1, F.lit(float("-inf"))
        ).otherwise(F.col("l_extendedprice"))
        return self.t.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("flow_id"),
            F.col("l_shipdate").alias("captured_at"),
            ip_of("l_suppkey").alias("source_ip"),
            F.expr("concat('192.168.0.', l_partkey % 20)").alias("destination_ip"),
            F.when(F.col("l_partkey") % 97 == 0, 70000).otherwise(_pick(PORTS, F.col("l_partkey") % 11)).alias("destination_port"),
            F.when(F.col("l_partkey") % 3 == 0, 17).otherwise(6).alias("protocol"),
            F.when(F.col("l_discount") > 0, F.col("l_partkey") * 1000.0).alias("flow_duration"),
            F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("total_fwd_packets"),
            F.col("l_linenumber").cast("double").alias("total_backward_packets"),
            F.col("l_extendedprice").alias("total_length_of_fwd_packets"),
            (F.col("l_quantity") * 40.0).alias("total_length_of_bwd_packets"),
            F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(1.0)).alias("syn_flag_count"),
            F.when(F.col("l_linestatus") == "O", F.lit(1.0)).otherwise(F.lit(0.0)).alias("rst_flag_count"),
            rate.alias("flow_bytes_per_s"),
            F.lit(0.0).alias("urg_flag_count"),
            F.when(F.col("l_partkey") % 40 == 0, "Infinity").otherwise(F.col("l_discount").cast("string")).alias("down_per_up_ratio"),
            F.when(F.col("l_suppkey") % 10 != 0, F.col("l_returnflag")).alias("service"),
            label.alias("label"),
        )

    @cached_property
    def traffic_records(self) -> DataFrame:
        return self.t.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
            F.col("l_shipdate").alias("captured_at"),
            ip_of("l_suppkey").alias("source_ip"),
            F.expr("concat('192.168.0.', l_partkey % 20)").alias("destination_ip"),
            F.expr("cast(1024 + l_orderkey % 60000 as int)").alias("source_port"),
            F.when(F.col("l_partkey") % 97 == 0, 70000).otherwise(_pick(PORTS, F.col("l_partkey") % 11)).alias("destination_port"),
            F.when(F.col("l_partkey") % 3 == 0, "UDP").otherwise("TCP").alias("protocol"),
            (F.col("l_partkey") / 1000).alias("duration_seconds"),
            (F.col("l_quantity") + F.col("l_linenumber")).cast("long").alias("total_packets"),
            F.floor("l_extendedprice").cast("long").alias("total_bytes"),
            (F.col("l_returnflag") != "A").alias("is_suspicious"),
        )

    @cached_property
    def threat_events(self) -> DataFrame:
        return self.t.lineitem.filter(F.col("l_returnflag") != "A").select(
            F.concat_ws("-", F.lit("t"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("traffic_record_id"),
            F.when(F.col("l_returnflag") == "N", "PortScan").otherwise("BruteForce").alias("threat_type"),
            (F.col("l_quantity") / 50).alias("anomaly_score"),
            (F.col("l_discount") * 10).alias("confidence_score"),
            F.when(F.col("l_linenumber") == 6, "SEVERE").otherwise(
                _pick(["LOW", "MEDIUM", "HIGH", "CRITICAL"], F.col("l_linenumber") % 4)
            ).alias("severity"),
            _pick(["DETECTED", "INVESTIGATING", "MITIGATED", "DISMISSED"], F.col("l_partkey") % 4).alias("status"),
            F.col("l_shipdate").alias("detected_at"),
        )

    @cached_property
    def ml_predictions(self) -> DataFrame:
        return self.t.events.select(
            F.col("event_id").alias("id"),
            _pick(["isolation_forest", "threat_classifier"], F.col("event_id") % 2).alias("model_name"),
            _pick(["1.0.0", "1.1.0"], F.col("user_id") % 2).alias("model_version"),
            F.col("value").alias("inference_latency_ms"),
            F.col("event_type").alias("raw_prediction"),
            F.col("ts").alias("executed_at"),
        )

    @cached_property
    def hunt_history(self) -> DataFrame:
        """One remembered search per event; each search names some of its filters."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.t.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("user"), F.col("user_id")).alias("username"),
            F.when(F.col("event_id") % 2 == 0, ip_of("user_id")).alias("source_ip"),
            F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("threat_category"),
            F.when(F.col("event_id") % 5 == 0, "HIGH").alias("severity"),
            F.when(F.col("event_id") % 7 == 0, _pick(PORTS, k % 11)).alias("destination_port"),
            F.when(F.col("event_id") % 11 == 0, F.repeat(F.col("event_type"), 50)).alias("query_text"),
            F.when(F.col("event_id") % 13 == 0, "17").alias("protocol"),
            F.when(F.col("event_id") % 4 == 1, k / 100).alias("min_confidence"),
            F.when(F.col("event_id") % 6 == 5, "NEW").alias("alert_status"),
            F.lit("24h").alias("time_range"),
            F.lit(50).alias("limit"),
            F.lit(0).alias("offset"),
            k.cast("long").alias("result_count"),
        )
