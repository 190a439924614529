"""Table readers: parquet folders by default, JDBC as an option."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str,
) -> DataFrame:
    """A relational table, split into key ranges so that no single task reads it all."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = (
            reader.option("partitionColumn", key)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.options(**options).load()


class Tables:
    """The given tables of one folder, each read once and only when asked for."""

    NAMES = (
        "region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations"
    ).split()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._read = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = read_table(self.spark, self.folder, name)
        return self._read[name]

    @cached_property
    def domain(self):
        from vigilflow.sources.domain import Domain

        return Domain(self)
