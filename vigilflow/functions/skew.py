"""Joins of many rows with one-row-per-key facts that survive hot and missing keys.

Spark broadcasts the facts when they are small.  When they are not, both sides
are shuffled by key, and all rows of a hot key, or all rows without a key, would
meet in one task.  AQE splits such tasks only if nothing above the join needs
the key's partitioning; the helpers here do not depend on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.session import settle

HOT_SHARE = 0.001  # by counting, at most 1 / HOT_SHARE keys can be hot
NULL_SALTS = 64


def row_salt(df: DataFrame, salts: Column | int = NULL_SALTS) -> Column:
    """A number below ``salts`` from the row's own values, the same when a task is repeated."""
    plain = [f"`{c}`" for c, d in df.dtypes if not d.startswith(("map", "variant", "array<map", "struct<"))]
    return F.pmod(F.xxhash64(*plain), salts if isinstance(salts, Column) else F.lit(salts))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "left", spread_by: list[str] | None = None) -> DataFrame:
    """Left join; rows without a key are spread over many tasks, by the columns ``spread_by`` or by all.

    All columns must travel to be hashed, also those that nothing reads later: name some where rows are wide.
    Hot keys are left to AQE, which splits them where nothing above the join needs
    the key's partitioning; where something does, use ``join_facts_spread``.
    """
    salted = rows.withColumn("_salt", F.when(F.col(key).isNull(), row_salt(rows.select(*spread_by) if spread_by else rows)).otherwise(F.lit(0).cast("long")))
    # always 0, but no literal: the planner would take a literal out of the join's keys, and all rows without a key would meet in one task
    return salted.join(facts.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1))), [key, "_salt"], how).drop("_salt")


def key_salts(share: Column, partitions: int) -> Column:
    """Parts into which a key with this share of the rows is cut: four times as many as would fill the partitions alike."""
    return F.greatest(F.lit(1), F.ceil(share * (4 * partitions))).cast("long")


def join_facts_spread(rows: DataFrame, facts: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """The same, and rows of hot keys are spread too; their facts are copied.

    ``size`` names the column of the facts that counts the rows of each key.  A
    key is hot above a thousandth of all rows, so the list of hot keys that is
    broadcast has at most a thousand entries; a key is cut into the more parts
    the more rows it has.  The facts are written once: their total, the hot keys
    and the copies come from that table.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = settle(facts, "facts")
    total = F.lit(facts.agg(F.sum(size)).first()[0] or 1)
    is_hot = F.coalesce(F.col(size) > total * HOT_SHARE, F.lit(False))
    parts = F.when(is_hot, key_salts(F.col(size) / total, partitions)).otherwise(F.lit(1).cast("long"))
    hot = facts.filter(is_hot & F.col(key).isNotNull()).select(key, parts.alias("_parts"))
    marked = rows.join(F.broadcast(hot), key, "left")
    place = row_salt(rows, F.coalesce("_parts", F.lit(NULL_SALTS).cast("long")))
    salted = marked.withColumn("_salt", F.when(F.col("_parts").isNotNull() | F.col(key).isNull(), place).otherwise(F.lit(0).cast("long"))).drop("_parts")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
