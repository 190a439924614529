"""Dataset inspection: one wide aggregate, then one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.expr import count_if, percent_of
from vigilflow.operators.analytics import counts_with_share
from vigilflow.operators.cleaning import constant_flags, is_infinite, is_missing, is_numeric, label_column
from vigilflow.operators.fitting import category_counts
from vigilflow.operators.quantiles import exact_quantiles

#: Rows of the hash slice that is searched for repeated values.
SLICE_ROWS = 1_000_000


def _as_rows(wide: DataFrame, columns: list[str], **per_column) -> DataFrame:
    """Turns aggregates named ``<prefix><i>`` into one row per column."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"{p}{i}").alias(n) for n, p in per_column.items()])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select("rows", F.explode(rows).alias("r")).select("rows", "r.*")


def column_stats(df: DataFrame) -> DataFrame:
    """Per column: rows, missing, infinite, constant flag (one scan for all)."""
    missing = [count_if(is_missing(c, d)).alias(f"m{i}") for i, (c, d) in enumerate(df.dtypes)]
    infinite = [count_if(is_infinite(c, d)).alias(f"i{i}") for i, (c, d) in enumerate(df.dtypes)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *missing, *infinite, *constant_flags(df))
    return _as_rows(wide, df.columns, missing="m", infinite="i", constant="c")


def profile_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows and their share."""
    rows = df.agg(F.count(F.lit(1)).alias("row_count"))
    unique = df.distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        rows.withColumn("column_count", F.lit(len(df.columns)))
        .withColumn("duplicate_count", F.col("row_count") - unique)
        .withColumn("duplicate_percentage", percent_of(F.col("duplicate_count"), F.col("row_count")))
    )


def profile_missing(stats: DataFrame) -> DataFrame:
    return stats.filter("missing > 0").select(
        "column_name", F.col("missing").alias("count"), percent_of(F.col("missing"), F.col("rows")).alias("percentage")
    )


def profile_infinite(stats: DataFrame) -> DataFrame:
    return stats.filter("infinite > 0").select("column_name", F.col("infinite").alias("count"))


def profile_constant(stats: DataFrame) -> DataFrame:
    return stats.filter("constant").select("column_name")


def profile_problems(stats: DataFrame) -> DataFrame:
    share = F.round(F.col("missing").cast("decimal(20,0)") * 100 / F.col("rows").cast("decimal(20,0)"), 1)
    reasons = F.array(
        F.when(F.col("constant"), V.PROBLEM_CONSTANT),
        F.when(F.col("missing") > F.col("rows") * 0.5, F.format_string(V.PROBLEM_MISSING, share.cast("double"))),
        F.when(F.col("infinite") > 0, F.format_string(V.PROBLEM_INFINITE, "infinite")),
    )
    return stats.select("column_name", F.explode(F.array_compact(reasons)).alias("reason"))


def _most_frequent(cells: DataFrame) -> dict[int, int]:
    """Rows of the most frequent value per column number of ``i, v``; one row per column reaches the driver."""
    counts = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    return {r["i"]: r["n"] for r in counts.groupBy("i").agg(F.max("n").alias("n")).collect()}


def unique_columns(df: DataFrame, slice_rows: int = SLICE_ROWS) -> list[str]:
    """Columns with a different value in every row (one NULL is a value too).

    One scan sketches how many values every column has.  Columns with clearly fewer
    values than rows, or with two missing ones, cannot be unique; as a sketch is no proof, a repeat is
    looked for among the values of one hash slice, some ``slice_rows`` rows.  Only
    the others, and those without a repeat there, are counted in full, so the
    rows shuffled follow the columns that may be unique.
    """
    texts = [F.when(~is_missing(c, d), F.col(f"`{c}`").cast("string")) for c, d in df.dtypes]
    sketch = [F.approx_count_distinct(v, 0.02).alias(f"d{i}") for i, v in enumerate(texts)]
    known = df.agg(F.count(F.lit(1)).alias("rows"), *sketch, *[F.count(v).alias(f"k{i}") for i, v in enumerate(texts)]).first()
    rows, open_ = known["rows"], [i for i in range(len(texts)) if known["rows"] - known[f"k{i}"] <= 1]

    def cells(chosen: list[int]) -> DataFrame:
        made = F.array(*[F.struct(F.lit(i).alias("i"), texts[i].alias("t")) for i in chosen])
        return df.select(F.explode(made).alias("x")).select("x.i", "x.t")

    def digest(found: DataFrame) -> DataFrame:
        return found.select("i", F.sha2("t", 256).alias("v"))

    fewer = [i for i in open_ if known[f"d{i}"] < 0.85 * known[f"k{i}"]]
    slices = rows // max(slice_rows, 1)
    if fewer and slices > 1:
        part = F.pmod(F.xxhash64("t"), F.lit(slices)) == 0
        repeated = {i for i, n in _most_frequent(digest(cells(fewer).filter(part))).items() if n > 1}
        open_ = [i for i in open_ if i not in repeated]
    if not open_:
        return []
    largest = _most_frequent(digest(cells(open_)))
    return [c for i, c in enumerate(df.columns) if largest.get(i) == 1]


def profile_identifiers(df: DataFrame) -> DataFrame:
    """Unique columns of frames with more than ten rows, and telling names."""
    named = {c for c in df.columns if any(p in c.lower() for p in V.PROFILE_IDENTIFIER_PATTERNS)}
    unique = set(unique_columns(df)) if df.limit(11).count() > 10 else set()
    hits = [(c,) for c in df.columns if c in named | unique]
    return df.sparkSession.createDataFrame(hits, "column_name string")


def profile_labels(df: DataFrame, label: str | None = None) -> DataFrame:
    name = label if label in df.columns else label_column(df, V.PROFILE_LABEL_COLUMNS)
    if name is None:
        raise ValueError("no label column")
    return counts_with_share(df, name, "label")


def profile_categorical(df: DataFrame, samples: int = 5) -> DataFrame:
    """Distinct values and the first few of them, per text column."""
    label = label_column(df, V.PROFILE_LABEL_COLUMNS)
    columns = [c for c, d in df.dtypes if d == "string" and c != label]
    counts = category_counts(df, columns)
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    first = counts.withColumn("place", place).filter(F.col("place") <= samples)
    shown = first.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    return counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count")).join(shown, "column_name")


def profile_numeric(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, min, median, max of finite values, three digits."""
    columns = [(c, d) for c, d in df.dtypes if is_numeric(d) and d != "boolean"]
    names = [c for c, _ in columns]
    finite = df.select(
        *[F.when(~is_missing(c, d) & ~is_infinite(c, d), F.col(f"`{c}`")).cast("double").alias(c) for c, d in columns]
    )
    medians = exact_quantiles(finite, names, [0.5])

    def measure(f, i: int, c: str, p: str) -> Column:
        return F.round(f(f"`{c}`"), 3).alias(f"{p}{i}")

    wide = finite.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            measure(f, i, c, p)
            for i, c in enumerate(names)
            for p, f in (("a", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max))
        ],
        *[F.round(F.lit(medians[c][0]).cast("double"), 3).alias(f"d{i}") for i, c in enumerate(names)],
    )
    return _as_rows(wide, names, mean="a", std="s", min="l", median="d", max="h").drop("rows")
