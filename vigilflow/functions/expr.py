"""Small column helpers used everywhere."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from vigilflow import fixed_values as V


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def iso(ts: Column | str) -> Column:
    """ISO text with microseconds; does not depend on the session zone for NTZ."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def count_if(condition: Column) -> Column:
    """Rows where the condition is true, as a partial (map-side) aggregate."""
    return F.count(F.when(condition, F.lit(1)))


def blank_as_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def or_default(c: Column | str, default) -> Column:
    """NULL, empty text and zero all fall back, like a truthiness test."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(default, str):
        c = blank_as_null(c)
    return F.coalesce(c, F.lit(default))


def severity_rank(c: Column | str) -> Column:
    """4 for CRITICAL down to 1 for LOW; anything else ranks as LOW."""
    c = F.upper(c)
    ranked = F.lit(1)
    for name in reversed(V.SEVERITIES):
        ranked = F.when(c == name, V.SEVERITY_RANK[name]).otherwise(ranked)
    return ranked


def severity_of_rank(c: Column) -> Column:
    named = F.lit("LOW")
    for name in reversed(V.SEVERITIES):
        named = F.when(c == V.SEVERITY_RANK[name], name).otherwise(named)
    return named


def is_benign_name(c: Column | str) -> Column:
    return F.upper(c) == V.BENIGN


def is_threat(threat="predicted_threat", flag="intrusion_flag", score="anomaly_score") -> Column:
    """Intrusion flag, negative score or a class other than BENIGN.

    Each test is made NULL-safe so that one missing field hides no threat.
    """
    return (
        F.coalesce(F.col(flag), F.lit(False))
        | F.coalesce(F.col(score) < 0, F.lit(False))
        | F.coalesce(F.col(threat) != V.BENIGN, F.lit(False))
    )


def percent_of(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, 0.0 for an empty whole.

    Decimal arithmetic keeps ties exact.
    """
    part, whole = part.cast("decimal(20,0)"), whole.cast("decimal(20,0)")
    share = F.try_divide(F.lit(100) * part, whole)
    return F.coalesce(F.round(share, digits).cast("double"), F.lit(0.0))


def literal_map(mapping: dict) -> Column:
    """A small fixed dictionary as a map literal (no join needed)."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
