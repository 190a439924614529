"""Behavioural flow features; each is added only when its inputs exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import count_if
from vigilflow.functions.skew import join_facts, join_facts_spread


def find_column(df: DataFrame, what: str) -> str | None:
    """The first candidate name present, ignoring case and blanks."""
    present = {c.lower().replace(" ", "_"): c for c in df.columns}
    return next((present[n] for n in V.FEATURE_INPUTS[what] if n in present), None)


def port_category(port: Column | str) -> Column:
    number = (F.col(port) if isinstance(port, str) else port).try_cast("int")
    return (
        F.when(number.between(0, 1023), "well_known")
        .when(number.between(1024, 49151), "registered")
        .when(number.between(49152, 65535), "dynamic")
        .otherwise("unknown")
    )


def durations_are_microseconds(df: DataFrame) -> bool:
    """Whether the median duration exceeds 1000; exact and in one pass.

    The median lies above the mark when more than half of the values do; with
    exactly half it is the middle of the two values next to the mark.
    """
    name = find_column(df, "duration")
    if name is None:
        return False
    d = F.greatest(F.col(name).cast("double"), F.lit(V.MIN_DURATION))
    d = F.when(F.col(name).isNotNull() & ~F.isnan(d), d)
    mark = V.MICROSECOND_MEDIAN
    row = df.select(d.alias("d")).agg(
        F.count("d").alias("n"),
        count_if(F.col("d") > mark).alias("above"),
        F.max(F.when(F.col("d") <= mark, F.col("d"))).alias("low"),
        F.min(F.when(F.col("d") > mark, F.col("d"))).alias("high"),
    ).first()
    if not row["n"] or row["above"] * 2 < row["n"]:
        return False
    return row["above"] * 2 > row["n"] or (row["low"] + row["high"]) / 2 > mark


def engineer(df: DataFrame, microseconds: bool | None = None) -> DataFrame:
    """Adds totals, rates, ratios, mean packet size and port tier.

    ``microseconds`` is the duration unit decided at fit; left out, it is taken
    from this frame.
    """
    inputs = {k: find_column(df, k) for k in V.FEATURE_INPUTS}
    zero = F.lit(0.0)

    def col(what: str) -> Column:
        return F.col(inputs[what])

    def filled(what: str) -> Column:
        return F.coalesce(col(what), zero)

    def add(name: str, *needs: str, blockers: tuple[str, ...] = ()):
        def attach(make):
            nonlocal df
            if all(inputs[n] for n in needs) and not {name, *blockers} & set(df.columns):
                df = df.withColumn(name, make())

        return attach

    add("total_packets", "fwd_packets", "bwd_packets")(lambda: filled("fwd_packets") + filled("bwd_packets"))
    add("total_bytes", "fwd_bytes", "bwd_bytes")(lambda: filled("fwd_bytes") + filled("bwd_bytes"))
    inputs.update({k: find_column(df, k) for k in ("packets", "bytes")})

    if inputs["duration"] and inputs["packets"]:
        if microseconds is None:
            microseconds = durations_are_microseconds(df)
        floor = F.greatest(col("duration").cast("double"), F.lit(V.MIN_DURATION))
        seconds = F.when(col("duration").isNotNull(), floor / 1e6 if microseconds else floor)
        add("calc_flow_packets_per_s", "packets", blockers=("flow_packets_s",))(lambda: col("packets") / seconds)
        add("calc_flow_bytes_per_s", "bytes", blockers=("flow_bytes_s",))(lambda: col("bytes") / seconds)

    add("fwd_bwd_packet_ratio", "fwd_packets", "bwd_packets")(lambda: _over(col("fwd_packets"), col("bwd_packets")))
    add("fwd_bwd_byte_ratio", "fwd_bytes", "bwd_bytes")(lambda: _over(col("fwd_bytes"), col("bwd_bytes")))
    add("syn_ratio", "syn", "packets")(lambda: _over(filled("syn"), filled("packets")))
    add("rst_ratio", "rst", "packets")(lambda: _over(filled("rst"), filled("packets")))
    add("calc_avg_packet_size", "bytes", "packets", blockers=("average_packet_size",))(
        lambda: _over(col("bytes"), col("packets"))
    )
    add("port_category", "destination_port")(lambda: port_category(inputs["destination_port"]))
    return df


def _over(a: Column, b: Column) -> Column:
    """a / (b + 1); a negative count of -1 gives NULL instead of an error."""
    return F.try_divide(a, b + F.lit(1.0))


def engineered_names(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in before.columns]


def protocol_name(c: Column | str) -> Column:
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    loud = F.upper(text)
    return (
        F.when(text.isNull(), "UNKNOWN")
        .when(loud.isin("6", "TCP"), "TCP (6)")
        .when(loud.isin("17", "UDP"), "UDP (17)")
        .when(loud.isin("1", "ICMP"), "ICMP (1)")
        .otherwise(text)
    )


def protocol_code(c: Column | str) -> Column:
    name = F.upper(F.trim(c))
    return F.when(name == "TCP", 6).when(name == "UDP", 17).when(name == "ICMP", 1)


def connections_per_destination(flows: DataFrame, destination: str = "destination_ip") -> DataFrame:
    """Flows per destination host.  An aggregate, not a window: a busy host is
    counted map-side and never gathered in one task."""
    return flows.groupBy(destination).agg(F.count(F.lit(1)).alias("connections"))


def with_connection_frequency(flows: DataFrame, destination: str = "destination_ip") -> DataFrame:
    counts = connections_per_destination(flows, destination)
    return join_facts_spread(flows, counts, destination, "connections")


def severity_score(predictions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted confidence, outlier degree and asset criticality (0..1)."""
    w_conf, w_outlier, w_asset = V.SEVERITY_WEIGHTS
    asset = nodes.select(F.col("ip_address").alias("destination_ip"), "criticality_level")
    joined = join_facts(predictions, asset, "destination_ip")
    score = (
        F.col("classification_confidence") * w_conf
        + F.col("anomaly_score") * w_outlier
        + F.coalesce(F.col("criticality_level"), F.lit(2)) / 4 * w_asset
    )
    return joined.withColumn("severity_score", F.round(score, 6))
