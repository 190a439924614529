"""Moving expired rows of a table laid out by year and month into an archive of the same layout.

The move has two steps, each of which may be repeated: expired rows are written
into the archive's months by dynamic partition overwrite, then they leave the live
table.  A job that breaks off between them, or within one, is simply run again.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilflow import fixed_values as V
from vigilflow.functions.timerange import literal, resolve
from vigilflow.session import settle

MONTH = ["year", "month"]


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def _write_months(rows: DataFrame, path: str) -> None:
    """Replaces exactly the months that ``rows`` holds; a busy month is cut into files of the advisory size."""
    placed = rows.hint("rebalance", *[F.col(c) for c in MONTH])
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(path)


def _in_months(months: list[tuple[int, int]]):
    """A filter on the partition columns alone, so other months are not listed for reading."""
    return (F.col("year") * 12 + F.col("month")).isin([y * 12 + m for y, m in months])


def expiry(as_of, days: int = V.AUDIT_RETENTION_DAYS) -> datetime:
    return resolve("1h", as_of).end - timedelta(days=days)


def copy_expired(spark: SparkSession, live: str, archive: str, at: str, key: str, cutoff: datetime) -> list[tuple[int, int]]:
    """Writes the rows before ``cutoff`` into the archive; the months they are of.

    Archived rows of those months stay, but for those whose key is among the expired
    ones: they were moved by a run that broke off.  ``key`` is unique and not NULL;
    rows without a time do not expire.
    """
    rows = spark.read.parquet(live)
    edge = cutoff.year * 12 + cutoff.month
    expired = rows.filter(F.col("year") * 12 + F.col("month") <= edge).filter(F.col(at) < literal(cutoff))
    expired = settle(expired, "expired")
    months = sorted((r["year"], r["month"]) for r in expired.select(*MONTH).distinct().collect())  # months, not rows
    if not months:
        return []
    merged = expired
    if _exists(spark, archive):
        stored = spark.read.schema(rows.schema).parquet(archive).filter(_in_months(months))
        merged = settle(expired.unionByName(stored.join(expired.select(key), key, "left_anti")), "archive")
    _write_months(merged, archive)
    return months


def remove_expired(spark: SparkSession, live: str, at: str, cutoff: datetime, months: list[tuple[int, int]]) -> None:
    """Takes the rows before ``cutoff`` out of ``months``: whole months as folders, the month of the cutoff by rewriting it."""
    if not months:
        return
    rows = spark.read.parquet(live)
    stay = settle(rows.filter(_in_months(months)).filter(F.col(at).isNull() | (F.col(at) >= literal(cutoff))), "kept")
    partly = {(r["year"], r["month"]) for r in stay.select(*MONTH).distinct().collect()}
    if partly:
        _write_months(stay, live)
    for year, month in months:
        if (year, month) not in partly:
            files, folder = _file_system(spark, f"{live.rstrip('/')}/year={year}/month={month}")
            files.delete(folder, True)
    spark.catalog.refreshByPath(live)


def archive_expired(spark: SparkSession, live: str, archive: str, at: str, key: str, as_of, days: int = V.AUDIT_RETENTION_DAYS) -> list[tuple[int, int]]:
    """Moves rows older than ``days`` into the archive; the months that rows were moved out of.

    Running it again with the same ``as_of`` moves nothing.  If every row expires the
    live folder stays, without months.
    """
    cutoff = expiry(as_of, days)
    if not _has_months(spark, live):
        return []
    months = copy_expired(spark, live, archive, at, key, cutoff)
    remove_expired(spark, live, at, cutoff, months)
    return months


def _has_months(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return False
    return any(s.getPath().getName().startswith("year=") and len(files.listStatus(s.getPath())) for s in files.listStatus(target))


def read_months(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a folder laid out by month; none if it has no month."""
    return spark.read.schema(schema).parquet(path) if _has_months(spark, path) else spark.createDataFrame([], schema)
