"""Telemetry of a scored flow from raw fields with aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.operators.cleaning import is_numeric


def _key(name: str) -> str:
    return name.lower().replace(" ", "_")


def alias_value(payload: Column, aliases: list[str]) -> Column:
    """From a string map: per alias the exact key, else any key equal to it when
    case and blanks are ignored."""
    loose = F.transform_keys(
        F.map_filter(payload, lambda k, v: v.isNotNull()), lambda k, v: F.regexp_replace(F.lower(k), " ", "_")
    )
    tries: list[Column] = []
    for alias in aliases:
        tries += [F.try_element_at(payload, F.lit(alias)), F.try_element_at(loose, F.lit(_key(alias)))]
    return F.coalesce(*tries)


def alias_column(df: DataFrame, aliases: list[str]) -> Column | None:
    """The same for a frame with one column per field."""
    by_key: dict[str, list[str]] = {}
    for c in df.columns:
        by_key.setdefault(_key(c), []).append(c)
    names: list[str] = []
    for alias in aliases:
        names += [c for c in ([alias] if alias in df.columns else []) + by_key.get(_key(alias), []) if c not in names]
    return F.coalesce(*[F.col(f"`{n}`") for n in names]) if names else None


def safe_double(c: Column) -> Column:
    return F.btrim(c.cast("string")).try_cast("double")


def safe_int(c: Column) -> Column:
    """Whole part of a number, NULL for anything else (also NaN and infinity)."""
    return safe_double(c).try_cast("bigint")


def total_bytes(direct: Column, forward: Column, backward: Column) -> Column:
    """The given total, else forward + backward with a missing side as zero."""
    either = forward.isNotNull() | backward.isNotNull()
    both = F.coalesce(safe_int(forward), F.lit(0)) + F.coalesce(safe_int(backward), F.lit(0))
    return F.when(direct.isNotNull(), safe_int(direct)).when(either, both)


def extract_telemetry(get) -> list[Column]:
    """The stored columns; ``get(aliases)`` finds one raw field."""
    raw = {name: get(aliases) for name, aliases in V.TELEMETRY_ALIASES.items()}
    raw = {n: c if c is not None else F.lit(None).cast("string") for n, c in raw.items()}
    return [
        *[raw[n].cast("string").alias(n) for n in ("source_ip", "destination_ip", "protocol")],
        *[safe_int(raw[n]).alias(n) for n in ("source_port", "destination_port", "total_forward_packets", "total_backward_packets")],
        safe_double(raw["flow_duration"]).alias("flow_duration"),
        total_bytes(raw["total_bytes"], raw["fwd_bytes"], raw["bwd_bytes"]).alias("total_bytes"),
    ]


def telemetry_of_map(payload: str) -> list[Column]:
    return extract_telemetry(lambda aliases: alias_value(F.col(payload), aliases))


def telemetry_of_frame(df: DataFrame) -> list[Column]:
    return extract_telemetry(lambda aliases: alias_column(df, aliases))


def compact_flow_json(df: DataFrame, first: int = V.COMPACT_JSON_FIELDS) -> Column:
    """JSON of those of the first fields that hold plain values."""
    plain = [c for c, d in df.dtypes[:first] if is_numeric(d) or d == "string"]
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in plain]))
