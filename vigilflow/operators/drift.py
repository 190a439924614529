"""Drift against a stored baseline: bins and shares frozen with the model."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilflow.operators.quantiles import exact_quantiles

#: Bin of values that are NULL or NaN.
MISSING = -1
#: The share an empty bin is taken to have.
FLOOR = 1e-4


def _bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``feature, bin, n``: one scan, counts combine before the shuffle, which has a row per feature and bin.

    A value's bin is the number of edges below it, so an edge belongs to the bin
    under it; infinities fall into the outer bins.
    """

    def place(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double")
        above = reduce(lambda a, b: a + b, [(value > e).cast("int") for e in edges[c]], F.lit(0))
        return F.when(value.isNull() | F.isnan(value), F.lit(MISSING)).otherwise(above)

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("bin")) for c in edges])
    return df.select(F.explode(cells).alias("x")).groupBy("x.feature", "x.bin").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Baseline:
    """Per feature: inner bin edges, ascending, and the rows that each bin held at fit time."""

    edges: dict[str, list[float]]
    counts: dict[str, dict[int, int]]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, [float(e) for e in self.edges[c]], self.counts[c]) for c in sorted(self.edges)]
        return spark.createDataFrame(rows, "feature string, edges array<double>, counts map<int,bigint>")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Baseline":
        # one row per fitted feature
        rows = spark.read.parquet(path).select("feature", "edges", "counts").collect()
        return cls({r["feature"]: list(r["edges"]) for r in rows}, {r["feature"]: dict(r["counts"]) for r in rows})


def fit_baseline(df: DataFrame, features: list[str], bins: int = 10) -> Baseline:
    """Edges at the exact quantiles of each feature's finite values; equal edges count once.

    A feature without finite values has no edges, and an empty table no counts.
    """
    if not features:
        return Baseline({}, {})
    double = {c: F.col(f"`{c}`").cast("double") for c in features}
    finite = df.select(*[F.when(F.abs(x) < float("inf"), x).alias(c) for c, x in double.items()])
    found = exact_quantiles(finite, features, [i / bins for i in range(1, bins)])
    edges = {c: sorted({float(v) for v in found[c] if v is not None}) for c in features}
    counts: dict[str, dict[int, int]] = {c: {} for c in features}
    for r in _bins(df, edges).collect():  # at most bins + 1 rows per feature
        counts[r["feature"]][r["bin"]] = r["n"]
    return Baseline(edges, counts)


def drift(df: DataFrame, baseline: Baseline, floor: float = FLOOR) -> DataFrame:
    """Per feature of the baseline the population stability index of ``df``, and its status.

    A feature that ``df`` lacks is wholly missing there.  Without rows, now or in
    the baseline, there is no index and the status is ``NO_DATA``.
    """
    spark = df.sparkSession
    have = {c: c for c in df.columns}
    now = df.select(*[F.col(f"`{c}`").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in baseline.edges]) if baseline.edges else df
    then = [(c, b, n) for c, known in baseline.counts.items() for b, n in known.items()]
    before = spark.createDataFrame(then, "feature string, bin int, before bigint")
    empty = spark.createDataFrame([], "feature string, bin int, after bigint")
    after = _bins(now, baseline.edges).withColumnRenamed("n", "after") if baseline.edges else empty
    both = before.join(after, ["feature", "bin"], "full_outer").fillna(0, ["before", "after"])
    # each feature sees every row, so its bins add up to the table
    totals = both.groupBy("feature").agg(F.sum("before").alias("all_before"), F.sum("after").alias("all_after"))

    def share(side: str) -> Column:
        return F.greatest(F.try_divide(F.col(side), F.col(f"all_{side}")), F.lit(floor))

    shift = (share("after") - share("before")) * F.ln(share("after") / share("before"))
    known = (F.col("all_before") > 0) & (F.col("all_after") > 0)
    index = both.join(totals, "feature").groupBy("feature").agg(F.round(F.sum(F.when(known, shift)), 6).alias("stability_index"))
    named = spark.createDataFrame([(c,) for c in baseline.edges], "feature string")
    value = F.col("stability_index")
    status = F.when(value.isNull(), "NO_DATA").when(value < 0.1, "STABLE").when(value < 0.25, "MODERATE_SHIFT").otherwise("DRIFT")
    return named.join(index, "feature", "left").withColumn("status", status)
