"""Exact quantiles of many columns at any size.

A distributed selection.  Each wanted order statistic lives in an open interval
between two values whose ranks are known.  A pass takes pivots inside the
interval from a bounded sketch (``percentile_approx``) and counts the rows below
and up to each pivot: either a pivot is the answer (so values with many copies
are settled at once) or the interval shrinks.  Only when few rows are left in it
are they read.  No shuffle of rows, and no task holds more than a sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.session import settle

ACCURACY = 2_000
MARGIN = 2 / ACCURACY
READ_BATCH = 50


@dataclass
class _Rank:
    """The value at one zero-based rank of a column."""

    column: str
    rank: int
    end: int  # rows below the upper bound
    low: float | None = None
    high: float | None = None
    below: int = 0  # rows up to the lower bound
    value: float | None = None

    @property
    def inside(self) -> int:
        return self.end - self.below

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def apply(self, pivot: float, less: int, up_to: int) -> None:
        if less <= self.rank < up_to:
            self.value = pivot
        elif up_to <= self.rank and up_to >= self.below:
            self.low, self.below = pivot, up_to
        elif self.rank < less <= self.end:
            self.high, self.end = pivot, less


def _values(interval: tuple) -> Column:
    column, low, high = interval
    c = F.col(f"`{column}`").cast("double")
    if low is not None and high is not None:
        return F.when((c > low) & (c < high), c)
    if low is not None:
        return F.when(c > low, c)
    return F.when(c < high, c) if high is not None else c


def _by_interval(ranks: list[_Rank]) -> dict[tuple, list[_Rank]]:
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        groups.setdefault(r.interval, []).append(r)
    return groups


def column_sizes(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Non-NULL values per column."""
    counted = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: counted[i] for i, c in enumerate(columns)}


def order_statistics(df: DataFrame, wanted: dict[str, set[int]], sizes: dict[str, int], read_limit: int = 20_000) -> dict[tuple[str, int], float]:
    """The values at the wanted zero-based ranks among the non-NULL values of each column.

    All columns and ranks are narrowed together, until at most ``read_limit``
    rows are left in an interval, which are read, at most ``READ_BATCH`` intervals
    at a time.  The columns are written once, so passes scan numbers only.
    """
    ranks = {(c, r): _Rank(c, r, sizes[c]) for c, rs in wanted.items() for r in rs}
    if not ranks:
        return {}
    columns = sorted(wanted)
    numbers = settle(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), "numbers")
    while unsettled := [r for r in ranks.values() if r.value is None]:
        few = [r for r in unsettled if r.inside <= read_limit]
        many = [r for r in unsettled if r.inside > read_limit]
        if few:
            _read(numbers, few)
        if many:
            _narrow(numbers, many)
    return {k: r.value for k, r in ranks.items()}


def quantile_ranks(n: int, prob: float) -> tuple[int, int]:
    """The two ranks between which a quantile of ``n`` values lies."""
    position = prob * (n - 1)
    return math.floor(position), math.ceil(position)


def between(first: float, second: float, n: int, prob: float) -> float:
    position = prob * (n - 1)
    return first + (second - first) * (position - math.floor(position))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], read_limit: int = 20_000) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-NULL values per column."""
    if not columns:
        return {}
    sizes = column_sizes(df, columns)
    wanted = {c: {r for p in probs for r in quantile_ranks(n, p)} for c, n in sizes.items() if n}
    values = order_statistics(df, wanted, sizes, read_limit)

    def quantile(c: str, p: float) -> float | None:
        n = sizes[c]
        return between(*[values[c, r] for r in quantile_ranks(n, p)], n, p) if n else None

    return {c: [quantile(c, p) for p in probs] for c in columns}


def _read(df: DataFrame, ranks: list[_Rank]) -> None:
    """Fetches intervals of at most ``read_limit`` rows, some per job."""
    groups = list(_by_interval(ranks).items())
    for start in range(0, len(groups), READ_BATCH):
        batch = groups[start : start + READ_BATCH]
        row = df.agg(*[F.sort_array(F.collect_list(_values(k))).alias(f"v{i}") for i, (k, _) in enumerate(batch)]).first()
        for i, (_, members) in enumerate(batch):
            for r in members:
                r.value = row[i][r.rank - r.below]


def _narrow(df: DataFrame, ranks: list[_Rank]) -> None:
    groups = _by_interval(ranks)
    sketches = []
    for interval, members in groups.items():
        near = [(r.rank + 0.5 - r.below) / r.inside for r in members]
        shares = {min(1.0, max(0.0, s + d)) for s in near for d in (-MARGIN, 0.0, MARGIN)}
        sketches.append(F.percentile_approx(_values(interval), sorted(shares), ACCURACY))
    found = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()
    pivots: dict[str, set[float]] = {}
    for (column, _, _), values in zip(groups, found):
        pivots.setdefault(column, set()).update(values)
    for (column, pivot), (less, up_to) in _counts(df, {c: sorted(v, key=lambda x: (x != x, x)) for c, v in pivots.items()}).items():
        for r in ranks:
            if r.column == column and r.value is None:
                r.apply(pivot, less, up_to)


def _counts(df: DataFrame, pivots: dict[str, list[float]]) -> dict[tuple[str, float], tuple[int, int]]:
    """Rows below and up to each pivot, in one pass: a value is looked up among the pivots, not compared with each.

    A task gives one row per column and pivot.
    """
    columns = list(pivots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((2, len(v) + 1), dtype=np.int64) for c, v in pivots.items()}
        for batch in batches:
            for i, c in enumerate(columns):
                values = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                for side, row in zip(("right", "left"), sums[c]):  # the first pivot above a value, and that not below it; NaN is the largest
                    row += np.bincount(np.searchsorted(pivots[c], values, side), minlength=len(row))
        for i, c in enumerate(columns):
            less, up_to = sums[c].cumsum(axis=1)[:, :-1]
            place = np.arange(len(less))
            yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(len(less), i), pa.int32()), "p": pa.array(place, pa.int32()), "less": pa.array(less), "up_to": pa.array(up_to)})

    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    found = numbers.mapInArrow(count, "c int, p int, less long, up_to long").groupBy("c", "p").agg(F.sum("less").alias("less"), F.sum("up_to").alias("up_to"))
    return {(columns[r["c"]], pivots[columns[r["c"]]][r["p"]]): (r["less"], r["up_to"]) for r in found.collect()}
