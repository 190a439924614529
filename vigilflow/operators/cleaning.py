"""Raw flow hygiene: names, duplicates, infinities, labels, unusable columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import count_if, literal_map

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
WHITESPACE = " \t\n\r\f\v"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_numeric(dtype: str) -> bool:
    return dtype.startswith(NUMERIC)


def is_floating(dtype: str) -> bool:
    return dtype in ("float", "double")


def normalize_name(name: str) -> str:
    """Snake case: blanks and dashes to ``_``, a slash to ``_per_``."""
    name = re.sub(r"[- ]", "_", name.strip().lower().replace("/", "_per_"))
    return re.sub(r"_{2,}", "_", re.sub(r"\W", "", name, flags=re.ASCII)).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    names = [normalize_name(c) for c in df.columns]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"columns collide after normalising: {sorted(twice)}")
    return df.toDF(*names)


def is_infinite(column: str, dtype: str) -> Column:
    """±Inf as a number, or one of the words for it; false for NULL."""
    c = F.col(f"`{column}`")
    if is_floating(dtype):
        hit = F.abs(c) == float("inf")
    elif dtype == "string":
        hit = c.isin(V.INFINITY_WORDS)
    else:
        return F.lit(False)
    return F.coalesce(hit, F.lit(False))


def is_missing(column: str, dtype: str) -> Column:
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if is_floating(dtype) else c.isNull()


@dataclass
class Hygiene:
    """What a cleaning pass found."""

    rows: int
    infinite: dict[str, int]
    unreadable: dict[str, int] = field(default_factory=dict)

    @property
    def replacements(self) -> int:
        return sum(self.infinite.values())

    @property
    def to_cast(self) -> list[str]:
        """Text columns with infinity words whose other values are all numbers."""
        return [c for c, n in self.infinite.items() if n and self.unreadable.get(c) == 0]


def inspect_infinite(df: DataFrame) -> Hygiene:
    """Counts per column in one pass over the data."""
    found = {c: is_infinite(c, d) for c, d in df.dtypes if is_floating(d) or d == "string"}
    # a pattern, since a failing cast costs an exception per row
    bad_text = {
        c: F.col(f"`{c}`").isNotNull() & ~found[c] & ~F.col(f"`{c}`").rlike(NUMBER)
        for c, d in df.dtypes
        if d == "string"
    }
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_if(hit).alias(f"i{i}") for i, hit in enumerate(found.values())],
        *[count_if(hit).alias(f"u{i}") for i, hit in enumerate(bad_text.values())],
    ).first()
    return Hygiene(
        row["rows"],
        {c: row[f"i{i}"] for i, c in enumerate(found)},
        {c: row[f"u{i}"] for i, c in enumerate(bad_text)},
    )


def replace_infinite(df: DataFrame, cast: list[str] = ()) -> DataFrame:
    """±Inf (and NaN) to NULL; ``cast`` columns become double."""

    def clean(column: str, dtype: str) -> Column:
        c = F.col(f"`{column}`")
        if is_floating(dtype):
            c = F.when(F.abs(c) < float("inf"), c)  # NaN is the largest number
        elif dtype == "string":
            c = F.when(~c.isin(V.INFINITY_WORDS), c)
        if column in cast:
            c = c.cast("double")
        return c.alias(column)

    return df.select(*[clean(c, d) for c, d in df.dtypes])


def clean_infinite(df: DataFrame) -> tuple[DataFrame, Hygiene]:
    seen = inspect_infinite(df)
    return replace_infinite(df, seen.to_cast), seen


def exact_dedup(df: DataFrame) -> DataFrame:
    """Equal rows once, NULLs compare equal.  Duplicates meet map-side first, so
    many copies of one row travel as one row per task."""
    return df.distinct()


def infinite_report(df: DataFrame) -> DataFrame:
    """Replaced values per column (only columns that have some)."""
    cells = {c: is_infinite(c, d) for c, d in df.dtypes if is_floating(d) or d == "string"}
    wide = df.agg(*[count_if(hit).alias(f"n{i}") for i, hit in enumerate(cells.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("infinite")) for i, c in enumerate(cells)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").filter("infinite > 0")


# --- labels -------------------------------------------------------------------


def label_column(df: DataFrame, candidates: list[str] | None = None) -> str | None:
    return next((c for c in (candidates or V.LABEL_COLUMNS) if c in df.columns), None)


def original_label(c: Column | str) -> Column:
    return F.coalesce(F.btrim(c, F.lit(WHITESPACE)), F.lit("nan"))


def normalized_label(c: Column | str) -> Column:
    """Dictionary match, else the first dictionary key the text contains."""
    text = F.lower(original_label(c))
    contained = F.lit(V.OTHER_ATTACK)
    for key, name in reversed(V.LABEL_CLASSES.items()):
        contained = F.when(text.contains(key), name).otherwise(contained)
    return F.coalesce(F.try_element_at(literal_map(V.LABEL_CLASSES), text), contained)


def normalize_labels(df: DataFrame) -> DataFrame:
    """Replaces the label column by original, normalised and binary labels."""
    name = label_column(df)
    if name is None:
        return df
    return (
        df.withColumn("original_label", original_label(name))
        .withColumn("normalized_label", normalized_label(name))
        .withColumn("is_intrusion", (F.col("normalized_label") != V.BENIGN).cast("int"))
        .drop(name)
    )


def drop_target_columns(df: DataFrame) -> DataFrame:
    return df.drop(*V.SCORING_TARGET_COLUMNS)


# --- unusable columns ---------------------------------------------------------


def identifier_columns(df: DataFrame, patterns: list[str] | None = None) -> list[str]:
    return [c for c in df.columns if any(p in c.lower() for p in (patterns or V.IDENTIFIER_PATTERNS))]


def constant_flags(df: DataFrame) -> list[Column]:
    """Per column: at most one distinct value, where NULL counts as a value.

    Smallest = largest and no gaps, or nothing but gaps: an exact test that
    needs no distinct count.
    """
    flags = []
    for i, (c, d) in enumerate(df.dtypes):
        value = F.when(~is_missing(c, d), F.col(f"`{c}`"))
        gaps = count_if(is_missing(c, d))
        flags.append(((gaps == F.count(F.lit(1))) | ((gaps == 0) & (F.min(value) == F.max(value)))).alias(f"c{i}"))
    return flags


def constant_columns(df: DataFrame) -> list[str]:
    row = df.agg(*constant_flags(df)).first()
    return [c for i, c in enumerate(df.columns) if row[i]]


def removed_columns(df: DataFrame) -> dict[str, str]:
    """Columns a model must not see, with the reason."""
    reasons = {c: V.DROP_REASON_IDENTIFIER for c in identifier_columns(df)}
    rest = df.drop(*reasons)
    reasons.update({c: V.DROP_REASON_CONSTANT for c in constant_columns(rest)})
    return {c: reasons[c] for c in df.columns if c in reasons}
