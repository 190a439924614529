"""Fit statistics once, apply them as plain expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilflow import fixed_values as V
from vigilflow.operators import cleaning, features
from vigilflow.operators.quantiles import between, exact_quantiles, order_statistics, quantile_ranks
from vigilflow.session import settle

MAX_CATEGORIES = 1_000


@dataclass
class NumericParams:
    column: str
    low: float | None
    high: float | None
    median: float
    center: float
    scale: float


@dataclass
class CategoryParams:
    column: str
    mode: str
    categories: list[str]


@dataclass
class FittedParams:
    """Everything ``transform`` needs; small, and saved as JSON."""

    numeric: list[NumericParams] = field(default_factory=list)
    categorical: list[CategoryParams] = field(default_factory=list)
    removed: dict[str, str] = field(default_factory=dict)
    engineered: list[str] = field(default_factory=list)
    cast: list[str] = field(default_factory=list)
    microseconds: bool = False
    rows: int = 0
    duplicates: int = 0
    infinite: int = 0

    def feature_names(self) -> list[str]:
        return [f"num__{p.column}" for p in self.numeric] + [
            f"cat__{p.column}_{v}" for p in self.categorical for v in p.categories
        ]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "FittedParams":
        data = json.loads(text)
        unknown = set(data) - set(cls.__dataclass_fields__)
        if unknown:
            raise TypeError(f"not fitted parameters: {sorted(unknown)}")
        data["numeric"] = [NumericParams(**p) for p in data["numeric"]]
        data["categorical"] = [CategoryParams(**p) for p in data["categorical"]]
        return cls(**data)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "params string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedParams":
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0].strip())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.column, "numeric", p.low, p.high, p.median, p.scale, None, None) for p in self.numeric]
        rows += [(p.column, "categorical", None, None, None, None, p.mode, p.categories) for p in self.categorical]
        return spark.createDataFrame(
            rows,
            "column_name string, kind string, low double, high double, median double, scale double, mode string, categories array<string>",
        )


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    numeric = [c for c, d in df.dtypes if cleaning.is_numeric(d)]
    return numeric, [c for c in df.columns if c not in numeric]


def quantile_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Clip bounds of the columns whose outer quantiles differ."""
    found = exact_quantiles(df, columns, list(V.CLIP_QUANTILES))
    return {c: (lo, hi) for c, (lo, hi) in found.items() if lo is not None and hi > lo}


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """NULL stays NULL."""
    if low is None:
        return c
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, rows), counted map-side over one unpivoted scan."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    )
    return df.select(cells.alias("x")).select("x.*").filter("value IS NOT NULL").groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("rows")
    )


def fit_categories(df: DataFrame, columns: list[str], limit: int = MAX_CATEGORIES) -> list[CategoryParams]:
    """Most frequent value (ties to the smaller) and all values, sorted.

    Every value becomes a column, so more than ``limit`` of them is an error,
    checked before anything is fetched; ``encoding`` takes columns of any number.
    """
    if not columns:
        return []
    counts = settle(category_counts(df, columns), "categories")
    sizes = {r["column_name"]: r["n"] for r in counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = [c for c, n in sizes.items() if n > limit]
    if wide:
        raise ValueError(f"more than {limit} categories in {wide}: drop or group them first")
    rows = counts.groupBy("column_name").agg(
        F.min(F.struct((-F.col("rows")).alias("o"), "value")).alias("m"), F.array_sort(F.collect_list("value")).alias("values")
    )
    found = {r["column_name"]: CategoryParams(r["column_name"], r["m"]["value"], list(r["values"])) for r in rows.collect()}
    return [found[c] for c in columns if c in found]


def _ranks_once(df: DataFrame, columns: list[str]) -> tuple[dict[str, list[float | None]], dict[str, list[float | None]]]:
    """Clip bounds with the median of the raw values, and quartiles of the median-filled ones, from one selection.

    Filling puts as many medians as there are NULLs behind the lower middle
    value, so the rank of a filled value follows from its rank among the raw ones.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    total, sizes = row["n"], {c: row[f"n{i}"] for i, c in enumerate(columns)}
    outer_probs = [V.CLIP_QUANTILES[0], 0.5, V.CLIP_QUANTILES[1]]

    def raw_rank(c: str, rank: int) -> int | None:
        """Of the value at a rank among the filled values; None for a filled-in one."""
        middle = quantile_ranks(sizes[c], 0.5)[0]
        if rank <= middle:
            return rank
        return None if rank <= middle + total - sizes[c] else rank - (total - sizes[c])

    wanted = {
        c: {r for p in outer_probs for r in quantile_ranks(n, p)}
        | {r for p in (0.25, 0.75) for k in quantile_ranks(total, p) if (r := raw_rank(c, k)) is not None}
        for c, n in sizes.items() if n
    }
    values = order_statistics(df, wanted, sizes)
    outer, quartiles = {}, {}
    for c, n in sizes.items():
        outer[c] = [between(*[values[c, r] for r in quantile_ranks(n, p)], n, p) if n else None for p in outer_probs]
        filled = lambda k, c=c: outer[c][1] if (r := raw_rank(c, k)) is None else values[c, r]
        quartiles[c] = [between(*map(filled, quantile_ranks(total, p)), total, p) if n else None for p in (0.25, 0.75)]
    return outer, quartiles


def fit_numeric(df: DataFrame, columns: list[str], scaler: str = "robust") -> list[NumericParams]:
    """Bounds and medians of the raw values; scale of the median-filled values."""
    if not columns:
        return []
    outer, quartiles = _ranks_once(df, columns)
    medians = {c: m for c, (_, m, _) in outer.items() if m is not None}
    if scaler == "robust":
        scales = {c: (medians[c], quartiles[c][1] - quartiles[c][0]) for c in medians}
    else:
        filled = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)).alias(c) for c, m in medians.items()])
        row = filled.agg(*[f(f"`{c}`") for c in medians for f in (F.avg, F.stddev_pop)]).first()
        scales = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(medians)}
    params = []
    for c, m in medians.items():
        lo, _, hi = outer[c]
        bounds = (lo, hi) if hi > lo else (None, None)
        center, scale = scales[c]
        params.append(NumericParams(c, *bounds, m, center, scale or 1.0))
    return params


def fit(raw: DataFrame, scaler: str = "robust", drop: list[str] = ()) -> FittedParams:
    """Learns all parameters from training rows (without target columns).

    Columns named in ``drop`` tell rows apart but are no features.

    The cleaned, de-duplicated rows are written once to the shared scratch
    folder; every later pass is a column-pruned scan of that copy.
    """
    named = cleaning.normalize_columns(raw)
    seen = cleaning.inspect_infinite(named)
    unique = cleaning.exact_dedup(named)
    cleaned = settle(cleaning.replace_infinite(unique, seen.to_cast), "fit")
    rows = cleaned.count()
    micro = features.durations_are_microseconds(cleaned)
    enriched = features.engineer(cleaned, micro)
    removed = cleaning.removed_columns(enriched)
    kept = enriched.drop(*removed, *drop)
    numeric, categorical = split_columns(kept)
    return FittedParams(
        numeric=fit_numeric(kept, numeric, scaler),
        categorical=fit_categories(kept, categorical),
        removed=removed,
        engineered=features.engineered_names(cleaned, enriched),
        cast=seen.to_cast,
        microseconds=micro,
        rows=rows,
        duplicates=seen.rows - rows,
        infinite=seen.replacements,
    )


def align(df: DataFrame, params: FittedParams) -> DataFrame:
    """Exactly the fitted columns: missing ones as NULL, extra ones dropped."""
    wanted = [(p.column, "double") for p in params.numeric] + [(p.column, "string") for p in params.categorical]
    return df.select(
        *[(F.col(f"`{c}`").cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted]
    )


def prepare(raw: DataFrame, params: FittedParams) -> DataFrame:
    """Named, cleaned and enriched rows with the fitted unit and casts."""
    named = cleaning.normalize_columns(raw)
    cleaned = cleaning.replace_infinite(named, [c for c in params.cast if c in named.columns])
    return features.engineer(cleaned, params.microseconds)


def feature_columns(params: FittedParams) -> list[Column]:
    """Scaled numbers and one-hot categories, as expressions."""
    columns = [
        ((F.coalesce(clip(F.col(f"`{p.column}`").cast("double"), p.low, p.high), F.lit(p.median)) - p.center) / p.scale).alias(
            f"num__{p.column}"
        )
        for p in params.numeric
    ]
    for p in params.categorical:
        value = F.coalesce(F.col(f"`{p.column}`").cast("string"), F.lit(p.mode))
        columns += [F.when(value == v, 1.0).otherwise(0.0).alias(f"cat__{p.column}_{v}") for v in p.categories]
    return columns


def scaled_numbers(params: FittedParams) -> Column:
    """The numbers clipped, filled and scaled, in one array.

    One function for all of them: an expression a column makes a method that the JVM no longer compiles.
    """
    values = F.array(*[F.col(f"`{p.column}`").cast("double") for p in params.numeric])
    fitted = F.array(*[F.struct(*[F.lit(getattr(p, k)).cast("double").alias(k) for k in ("low", "high", "median", "center", "scale")]) for p in params.numeric])

    def scaled(v: Column, p: Column) -> Column:
        inside = F.when(v < p["low"], p["low"]).otherwise(F.when(v > p["high"], p["high"]).otherwise(v))
        return (F.coalesce(inside, p["median"]) - p["center"]) / p["scale"]

    return F.zip_with(values, fitted, scaled)


def transform(raw: DataFrame, params: FittedParams, keep: list[str] = ()) -> DataFrame:
    """The model-ready feature columns, after the ``keep`` columns of the input.

    Projections over the scan: no shuffle, no Python, batch and stream alike.
    """
    enriched = prepare(raw, params)
    missing = [(p.column, "double") for p in params.numeric] + [(p.column, "string") for p in params.categorical]
    for c, t in missing:
        if c not in enriched.columns:
            enriched = enriched.withColumn(c, F.lit(None).cast(t))
    texts = [F.coalesce(F.col(f"`{p.column}`").cast("string"), F.lit(p.mode)).alias(f"_text{i}") for i, p in enumerate(params.categorical)]
    numbers = [scaled_numbers(params).alias("_scaled")] if params.numeric else []
    filled = enriched.select(*keep, *texts, *numbers)
    columns = [F.get("_scaled", F.lit(i)).alias(f"num__{p.column}") for i, p in enumerate(params.numeric)]
    for i, p in enumerate(params.categorical):
        columns += [(F.col(f"_text{i}") == v).cast("double").alias(f"cat__{p.column}_{v}") for v in p.categories]
    return filled.select(*keep, *columns)


# --- train / test split -----------------------------------------------------------


def test_quota(sizes: DataFrame, share: float) -> DataFrame:
    """Test rows per class: whole shares, then the largest remainders until the
    total is reached (a handful of class rows)."""
    total = sizes.agg(F.ceil(F.sum("_n") * share).alias("t")).scalar()
    exact = F.col("_n") * F.lit(share)
    whole = sizes.withColumn("_whole", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    missing = total - whole.agg(F.sum("_whole").alias("w")).scalar()
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.asc("_label")))
    return whole.select("_label", (F.col("_whole") + F.when(place <= missing, 1).otherwise(0)).alias("_quota"))


def train_test_split(
    df: DataFrame, label: str, key: list[str], share: float = V.TEST_SHARE, seed: int = V.SEED
) -> DataFrame:
    """Adds ``is_test``: exact shares per class, stable under any partitioning.

    Rows are ordered by a seeded hash of their key.  Counts per (class, hash
    prefix) show in which of 65 536 slices a class reaches its quota; only that
    slice has to be ranked, so a class with most rows is never sorted as a whole.
    Stratified when every class has two rows, plain otherwise.
    """
    mark = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    # a struct is never NULL, so rows without label are a class like others in every join
    marked = df.withColumn("_label", F.struct(F.col(label))).withColumn("_mark", mark).withColumn("_slice", F.substring("_mark", 1, 4))
    slices = settle(marked.groupBy("_label", "_slice").agg(F.count(F.lit(1)).alias("_rows")), "slices")
    smallest = slices.groupBy("_label").agg(F.sum("_rows").alias("_n")).agg(F.min("_n")).first()[0] or 0
    if smallest < 2:
        everything = F.struct(F.lit("all").alias(label))
        marked = marked.withColumn("_label", everything)
        slices = slices.withColumn("_label", everything).groupBy("_label", "_slice").agg(F.sum("_rows").alias("_rows"))
    until = Window.partitionBy("_label").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    quota = test_quota(slices.groupBy("_label").agg(F.sum("_rows").alias("_n")), share)
    plan = (
        slices.withColumn("_before", F.coalesce(F.sum("_rows").over(until), F.lit(0)))
        .join(quota, "_label")
        .withColumn("_take", F.col("_quota") - F.col("_before"))
        .withColumn("_whole", F.col("_take") >= F.col("_rows"))
    )
    plan = settle(plan.select("_label", "_slice", "_take", "_whole"), "split-plan")
    placed = marked.join(plan, ["_label", "_slice"])
    at_edge = ~F.col("_whole") & (F.col("_take") > 0)
    decided = placed.filter(~at_edge).withColumn("is_test", F.col("_whole"))
    # only the one slice per class in which the quota is reached gets ranked
    rank = F.row_number().over(Window.partitionBy("_label", "_slice").orderBy("_mark", *key))
    edge = placed.filter(at_edge).withColumn("is_test", rank <= F.col("_take"))
    return decided.unionByName(edge).drop("_label", "_mark", "_slice", "_take", "_whole")
