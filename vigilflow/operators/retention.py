"""Keeping, archiving and laying out history by date."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.timerange import literal, resolve


def retention_split(df: DataFrame, at: str, as_of, days: int = V.AUDIT_RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to archive)."""
    cutoff = literal(resolve("1h", as_of).end - timedelta(days=days))
    return df.filter(F.col(at) >= cutoff), df.filter(F.col(at) < cutoff)


def with_month(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("year", F.year(at)).withColumn("month", F.month(at))


def write_by_month(df: DataFrame, at: str, path: str, skip_key: str | None = None, mode: str = "append") -> None:
    """Parquet partitioned by year and month.

    The rebalance lets AQE cut a busy month into files of the advisory size and
    merge quiet ones; sorting by ``skip_key`` lets readers skip row groups.
    """
    placed = with_month(df, at).hint("rebalance", F.col("year"), F.col("month"))
    if skip_key:
        placed = placed.sortWithinPartitions("year", "month", skip_key)
    placed.write.mode(mode).partitionBy("year", "month").parquet(path)
