"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilflow.session import settle

#: Rows of a lookup table up to which it may be broadcast (a row has a few numbers, so some tens of MB).
BROADCAST_ROWS = 500_000

#: Documents handed to Python at once; texts are long, so far fewer than Spark's default.
BATCH_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the rows per Arrow batch, so that a batch of long texts fits in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str | Column) -> DataFrame:
    """The id as ``doc_id`` (long), the text as ``text`` (null becomes empty) and the named columns, nothing else."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        *more,
    )


def lookup(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` marked for broadcast if it has at most ``limit`` rows, else as it is, for a shuffled join."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def label_split(id_column: Column, parts: int, held: int) -> Column:
    """True for the held-out rows: crc32 of the id as text, modulo ``parts``, equals ``held``; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == held, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(a, b)``; component: the smallest node reachable.

    Contraction: every node moves to the first of its closed neighbourhood, by
    id in even rounds (a star vanishes at once) and by a hash in odd rounds (so
    that chains shrink by a constant share whatever their ids), until no edge is
    left.  Each round is a written table; nothing is gathered in a task: the
    neighbourhood is a map-side minimum, and the joins look up one row per node.
    Null ends and loops are ignored; repeated edges count once.
    """
    level = settle(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    moves, turn = [], 0
    while not level.isEmpty():
        rank = F.col("b") if turn % 2 == 0 else F.xxhash64("b", F.lit(turn))
        own = F.col("a") if turn % 2 == 0 else F.xxhash64("a", F.lit(turn))
        both = level.unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), F.col("b").alias("to"))).alias("m"))
        move = settle(
            first.select(
                F.col("a").alias("node"),
                F.when(F.struct(own.alias("rank"), F.col("a").alias("to")) < F.col("m"), F.col("a")).otherwise(F.col("m.to")).alias("to"),
            ),
            "moves",
        )
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        level = settle(
            level.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        turn += 1
    if not moves:
        return level.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = moves[-1]
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    roots = settle(roots, "roots")
    names = roots.groupBy("to").agg(F.min("node").alias("lowest"))
    return roots.join(names, "to").select("node", F.least("lowest", "to").alias("component"))
