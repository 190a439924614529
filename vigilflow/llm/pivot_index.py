"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order.  Two
vectors are candidates if enough of those pivots are shared; they meet in the
inverted lists of the pivots, and their cosine is verified there.

The lists are kept by combinations of ``shared`` pivots: the vectors of one list
are those whose count of shared pivots reaches it.  A pair that shares more meets in
several lists and counts only in the first of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, functions as F

from vigilflow.llm.common import components, small_batches
from vigilflow.session import settle

#: Vectors among which pivots are chosen, at most; pivots; nearest pivots of a vector; pivots that candidates share.
SAMPLE, PIVOTS, NEAREST, SHARED = 4000, 192, 6, 2
#: Vectors of a list compared in one piece; longer lists are cut into blocks and compared block by block.
BLOCK = 512
#: Fewer pivots than this tell nothing apart: all vectors then share one list.
LEAST_PIVOTS = 12


@dataclass
class Pivots:
    """Unit vectors by dimension."""

    points: dict[int, np.ndarray]
    nearest: int
    shared: int


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; not finite or zero ones become 0."""
    x = np.asarray(vectors, np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0, keepdims=True)
        x = x / top
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0.0)


def choose_pivots(sample: list[list[float]], pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> Pivots:
    """Farthest-first traversal of the sample, by dimension: pivots as far from each other as the sample lets them be."""
    by: dict[int, list[list[float]]] = {}
    for vector in sample:
        by.setdefault(len(vector), []).append(vector)
    points = {}
    for size, vectors in by.items():
        x = unit(np.array(vectors, np.float64))
        x = x[np.abs(x).sum(axis=1) > 0]
        if not len(x):
            continue
        chosen = [0]
        near = x @ x[0]
        while len(chosen) < min(pivots, len(x)) and near.min() < 0.999:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        if len(chosen) >= LEAST_PIVOTS:
            points[size] = x[chosen]
    return Pivots(points, nearest, shared)


def fit(vectors: DataFrame, vector_column: str = "embedding", id_column: str = "vec_id", sample: int = SAMPLE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> Pivots:
    """Chooses pivots from the ``sample`` vectors whose ids come first by a hash."""
    first = vectors.filter(_usable(vector_column)).orderBy(F.xxhash64(id_column, F.lit(5)), F.xxhash64(vector_column)).limit(sample)
    return choose_pivots([r[0] for r in first.select(F.col(vector_column).cast("array<double>")).collect()], pivots, nearest, shared)


def _usable(column: str):
    value = F.col(column)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return value.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))


def describe(nodes: DataFrame, model: Pivots) -> DataFrame:
    """Adds ``pivots``, the numbers of each vector's nearest pivots by distance, and ``lists``, the keys of its lists."""
    known = nodes.sparkSession.sparkContext.broadcast((model.points, model.nearest, model.shared))  # ``pivots`` unit vectors for each dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points_by, nearest, shared = known.value
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.array([len(v) for v in vectors])
            orders: list[list[int]] = [[]] * len(sizes)
            for size, points in points_by.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    x = unit(np.array(vectors.take(pa.array(at)).flatten()).reshape(len(at), size))
                    order = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :nearest]
                    for i, o in zip(at.tolist(), order.tolist(), strict=True):
                        orders[i] = o
            lists = [[f"{n}:" + ",".join(map(str, c)) for c in combinations(sorted(o), shared)] if o else [f"{n}:"] for n, o in zip(sizes.tolist(), orders, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(orders, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.string()))], [*batch.schema.names, "pivots", "lists"]
            )

    fields = ", ".join(f"{n} {t}" for n, t in nodes.dtypes)
    return nodes.mapInArrow(run, f"{fields}, pivots array<int>, lists array<string>")


def _first_here(pivots: list[list[int]], key: str) -> np.ndarray | None:
    """Whether a list is the first in which a pair meets: whether the pivots it shares up to the list's last are just the list's."""
    names = key.split(":")[1]
    if not names:
        return None
    own = [int(n) for n in names.split(",")]
    has = np.zeros((len(pivots), own[-1] + 1), np.float32)
    for i, near in enumerate(pivots):
        has[i, [p for p in near if p <= own[-1]]] = 1
    return (has @ has.T) == len(own)


def compare(members: pa.Table, cosine: float) -> pa.Table:
    """Verifies a block or a pair of blocks of one list.

    Gives each vector the copies that it links with here, and a hub: the smallest
    node of its component here.  One row per vector, however many links there are.
    """
    node = members.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    members, node = members.take(pa.array(order)), node[order]
    vectors = members.column("embedding").combine_chunks()
    x = unit(np.array(vectors.flatten()).reshape(len(node), -1))
    linked = (x @ x.T) >= cosine
    np.fill_diagonal(linked, False)
    low, high = members.column("low")[0].as_py(), members.column("high")[0].as_py()
    if low != high:  # pairs within a block belong to the block's own turn
        side = members.column("block").to_numpy()
        linked &= side[:, None] != side[None, :]
    if linked.any():
        first = _first_here(members.column("pivots").to_pylist(), members.column("list")[0].as_py())
        if first is not None:
            linked &= first
    hub, some = np.arange(len(node)), linked.any(axis=1)
    counts = linked @ members.column("copies").to_numpy()
    while some.any():
        best = np.minimum(hub, np.where(linked, hub[None, :], len(node)).min(axis=1))
        best = best[best]
        if (best == hub).all():
            break
        hub = best
    keep = np.flatnonzero(some)
    return pa.table({"node": pa.array(node[keep], pa.int64()), "n": pa.array(counts[keep], pa.int64()), "hub": pa.array(node[hub[keep]], pa.int64())})


def near_duplicates(
    vectors: DataFrame, model: Pivots, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = 0.95, block: int = BLOCK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    n_links: other rows whose cosine is at least ``cosine``, among the candidates
    of the index; component_id: the smallest id reachable by links, itself
    included; kept: whether it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing.  Only vectors of one length are compared.  Equal vectors are one
    node with a number of copies, so groups of copies cost no pairs.  Rows without
    id link like others but name no component (null if no row there has an
    id).  Rows that repeat an id are rows like others; ``kept`` is true for all of
    them if it is for one.  Other columns are not read.  No rows: no rows.
    """
    small_batches(vectors.sparkSession, 4000)
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.when(_usable(vector_column), F.col(vector_column)).alias("embedding"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = ["h1", "h2"]
    hashed = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "row")
    lean = settle(hashed.select("vec_id", "row", F.col("embedding").isNotNull().alias("usable"), *keys), "rows")
    nodes = (
        hashed.filter("embedding is not null").groupBy(keys)
        .agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lowest"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    described = settle(describe(nodes, model), "described")
    postings = described.select("node", "embedding", "copies", "pivots", F.explode("lists").alias("list"))
    # at most one row per combination of pivots, whatever the input
    sizes = described.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    cut = (
        postings.join(F.broadcast(sizes), "list")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "pivots", "embedding")
    )
    met = settle(cut.groupBy("list", "low", "high").applyInArrow(lambda t: compare(t, cosine), "node long, n long, hub long"), "met")
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(met.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    named = settle(
        described.select("node", "copies", "lowest", *keys).join(counts, "node", "left").join(joined, "node", "left")
        .select(*keys, "copies", "lowest", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component")),
        "named",
    )
    lowest = settle(named.groupBy("component").agg(F.min("lowest").alias("component_id")), "lowest")
    facts = settle(named.join(lowest, "component").select(*keys, (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"), "facts")
    found = lean.filter("usable").join(facts, keys, "left").select("vec_id", "n_links", "component_id")
    alone = lean.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
