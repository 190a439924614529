"""Registration of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilflow.plans.views_sql import with_views
from vigilflow.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", **ctes: str):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``views`` names the domain views the oracle ``sql`` reads.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql, **ctes)
        return fn

    return register
