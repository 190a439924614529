"""Removal of secrets from audit details, and a scan for leaked ones."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigilflow import fixed_values as V
from vigilflow.functions.expr import count_if

LEAK_PATTERNS = {
    "bearer": r"(?i)bearer [a-z0-9._\-]+",
    "password": r"(?i)password",
    "token": r"(?i)token",
    "jwt": r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
}


def scrub_text(c: Column | str) -> Column:
    """Text that mentions a secret becomes a fixed note."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(c)
    hit = F.lit(False)
    for word in V.FORBIDDEN_TEXT:
        hit = hit | low.contains(word)
    return F.when(hit, V.SCRUBBED_TEXT).otherwise(c)


_SECRET_KEYS, _REDACTED = frozenset(V.FORBIDDEN_KEYS), V.REDACTED


def _redact(value):
    if isinstance(value, dict):
        return {k: _REDACTED if k.lower() in _SECRET_KEYS else _redact(v) for k, v in value.items()}
    return [_redact(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def _redact_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(_redact(json.loads(t)), ensure_ascii=False), na_action="ignore")


def _json_rules(c: Column) -> tuple[Column, Column]:
    """Whether a text is a JSON object or list, and whether it may name a forbidden key."""
    is_json = F.try_parse_json(c).isNotNull() & F.ltrim(c).rlike(r"^[\[{]")
    return F.coalesce(is_json, F.lit(False)), F.coalesce(c.rlike('(?i)"(' + "|".join(V.FORBIDDEN_KEYS) + ')"\\s*:') | c.contains("\\u"), F.lit(False))


def scrub_json(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the values below forbidden keys in a column's JSON, at any depth, as ``[REDACTED]``.

    Rows are told apart first, so only JSON that names a forbidden key goes
    through Python; all other JSON stays as it is.  Text that is not JSON
    follows the text rule.
    """
    c = F.col(f"`{column}`")
    is_json, names_secret = _json_rules(c)
    redacted = df.filter(is_json & names_secret).withColumn(column, _redact_json(c))
    plain = df.filter(~(is_json & names_secret)).withColumn(column, F.when(is_json, c).otherwise(scrub_text(c)))
    return plain.unionByName(redacted)


def leak_scan(df: DataFrame, columns: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows that match each secret pattern in each column, in one pass."""
    patterns = patterns or LEAK_PATTERNS
    cells = [(c, name, F.col(c).rlike(p)) for c in columns for name, p in patterns.items()]
    wide = df.agg(*[count_if(hit).alias(f"n{i}") for i, (_, _, hit) in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("pattern"), F.col(f"n{i}").alias("hits"))
            for i, (c, name, _) in enumerate(cells)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")
