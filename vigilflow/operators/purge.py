"""Deleting rows with everything that hangs on them, along a graph of foreign keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from vigilflow.session import settle


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to the ``id`` of ``parent``; without ``cascade`` it is emptied, not followed."""

    child: str
    column: str
    parent: str
    cascade: bool = True


#: What hangs on what among the stored entities.
KEYS = [
    ForeignKey("alerts", "prediction_id", "predictions"),
    ForeignKey("incident_predictions", "prediction_id", "predictions"),
    ForeignKey("incident_alerts", "alert_id", "alerts"),
    ForeignKey("incident_alerts", "incident_id", "incidents"),
    ForeignKey("incident_predictions", "incident_id", "incidents"),
    ForeignKey("incident_notes", "incident_id", "incidents"),
]


def doomed_ids(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], keys: list[ForeignKey] = KEYS) -> dict[str, DataFrame]:
    """Ids to delete per table that has an ``id``: the ``doomed`` ones and all that refers to them, level by level.

    A level joins each child with the ids that its parents lost in the level before,
    and keeps those not yet known, so cycles and self references come to an end.
    Every level is a written table; it ends when a level finds nothing.
    References that are NULL hang on nothing.
    """
    gone: dict[str, DataFrame] = {}
    level = {name: settle(ids.select("id").filter("id IS NOT NULL").distinct(), "purge") for name, ids in doomed.items()}
    while level:
        for name, ids in level.items():
            gone[name] = gone[name].unionByName(ids) if name in gone else ids
        found: dict[str, DataFrame] = {}
        for k in keys:
            if not k.cascade or k.parent not in level or k.child not in tables or "id" not in tables[k.child].columns:
                continue
            child = tables[k.child].select("id", F.col(k.column).alias("parent")).filter("id IS NOT NULL")
            ids = child.join(level[k.parent].withColumnRenamed("id", "parent"), "parent", "left_semi").select("id")
            found[k.child] = found[k.child].unionByName(ids) if k.child in found else ids
        level = {}
        for name, ids in found.items():
            fresh = ids.distinct()
            fresh = settle(fresh.join(gone[name], "id", "left_anti") if name in gone else fresh, "purge")
            if not fresh.isEmpty():
                level[name] = fresh
    return gone


def purge(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], keys: list[ForeignKey] = KEYS) -> dict[str, DataFrame]:
    """Every table without the rows that have to go.

    Tables without ``id``, as links are, lose the rows that refer to deleted ones;
    references of keys without ``cascade`` become NULL.  Rows are never merged, so
    repeated ones stay repeated.
    """
    gone = doomed_ids(tables, doomed, keys)
    kept = {}
    for name, rows in tables.items():
        left = rows.join(gone[name], "id", "left_anti") if name in gone else rows
        for k in keys:
            if k.child != name or k.parent not in gone:
                continue
            ids = gone[k.parent].select(F.col("id").alias(k.column))
            if k.cascade:
                left = left.join(ids, k.column, "left_anti")
            else:
                marked = left.join(ids.withColumn("_gone", F.lit(True)), k.column, "left")
                left = marked.withColumn(k.column, F.when(F.col("_gone").isNull(), F.col(k.column))).drop("_gone")
        kept[name] = left.select(*rows.columns)
    return kept
