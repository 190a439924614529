"""Category columns of any number of values: an index table and sparse rows.

``fitting.feature_columns`` writes one column per value, which suits a few
hundred.  Here the values stay in a table (column, value, index) and a row gets the
positions of its ones, looked up by joins, so nothing grows on the driver or in
the plan with the number of values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigilflow.functions.skew import join_facts
from vigilflow.operators.fitting import category_counts
from vigilflow.session import settle


def fit_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, value, rows, index`` of every value, as a written table.

    The index counts from 0 through the columns as given, and within a column by
    value.  Values are range-partitioned by that order and numbered part by part;
    each part starts after the rows of the parts before it.  NULL is no value.
    """
    spark = df.sparkSession
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name"))
    order = ["place", "value"]
    counted = category_counts(df, columns).withColumn("place", place)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(counted.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "categories")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered = placed.withColumn("own", own).join(F.broadcast(starts), "part")
    return settle(numbered.select("column_name", "value", "rows", (F.col("start") + F.col("own") - 1).alias("index")), "category-index")


def modes(index: DataFrame) -> DataFrame:
    """``column_name, mode, categories``: the most frequent value, of equally frequent ones the smaller, and how many there are."""
    best = index.groupBy("column_name").agg(F.min(F.struct((-F.col("rows")).alias("order"), "value")).alias("best"), F.count(F.lit(1)).alias("categories"))
    return best.select("column_name", F.col("best.value").alias("mode"), "categories")


def impute(df: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of the columns filled with their mode; a column without any value stays as it is."""
    known = {r["column_name"]: r["mode"] for r in modes(index).collect()}  # a row per column
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(known[c])) for c in columns if c in known}
    return df.withColumns(filled)


def encode(df: DataFrame, index: DataFrame, columns: list[str], into: str = "categories") -> DataFrame:
    """Adds ``into``, ``struct<size, indices>``: the width of the one-hot row and the positions of its ones, in order.

    Missing values count as their column's mode; a value that was not there at
    the fit has no position.  ``df`` keeps its rows and columns, so repeated rows
    stay.  A column's values are broadcast if Spark finds them small, and looked
    up by a shuffle otherwise.
    """
    size = index.count()
    rows = impute(df, index, columns)
    names = []
    for i, c in enumerate(columns):
        key, found = f"_value{i}", f"_index{i}"
        facts = index.filter(F.col("column_name") == c).select(F.col("value").alias(key), F.col("index").alias(found))
        rows = join_facts(rows.withColumn(key, F.col(f"`{c}`").cast("string")), facts, key)
        names.append(found)
    positions = F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<long>")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(F.lit(size).cast("long").alias("size"), positions.alias("indices")).alias(into))
