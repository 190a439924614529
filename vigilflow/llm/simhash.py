"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  By the pigeonhole principle two fingerprints
within the distance agree in some segment up to a small radius, so each one looks
up small Hamming balls around its segments in a table of all segments and
verifies the complete distance of what it finds.

A table entry that many fingerprints share would give pairs by the square.  Its
fingerprints and those that look it up are linked in another exact way: all
fingerprints within half the distance of a common centre are linked with each
other, and any two linked ones have such a centre, so grouping by the centres of
their balls gives the same components with rows in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import components, lookup, small_batches, texts_of
from vigilflow.session import settle

BITS = 64
#: Rows of shingle hashes whose bits are counted at once: a bound on memory for very long texts.
CHUNK = 1 << 15
#: Fingerprints of a table entry up to which pairs are verified one by one; larger entries go by centres.  A
#: fingerprint costs up to so many candidates there, and 2081 rows (distance 4) by centres.
CAP = 256


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """The bits set in over half the XXH64 of the text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: only A-Z, and exactly the six ASCII blanks
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, n - shingle + 1)
    cuts = map(slice, starts[:m].tolist(), ends[min(shingle, n) - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(whole.__getitem__, cuts), repeat(seed)), "<u8", m)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, m, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > m, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    texts = texts_of(docs, id_column, text_column).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def segments(rows: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment for a table of ``rows`` fingerprints.

    As many segments as keep an entry's values about as many as the rows, at least
    two.  With m segments and distance = m * r + a, the first a + 1 are searched
    to radius r, the others to r - 1: two fingerprints beyond that everywhere
    differ in more than ``distance`` bits.
    """
    m = max(2, min(distance + 1, BITS // max(1, rows.bit_length())))
    radius, rest = divmod(distance, m)
    wide = [BITS // m + (i >= m - BITS % m) for i in range(m)]
    found = [(sum(wide[:i]), wide[i], radius if i <= rest else radius - 1) for i in range(m)]
    return [s for s in found if s[2] >= 0]


def _entries(segment: tuple[int, int, int], number: int, ball: bool) -> Column:
    """Keys of a fingerprint's segment, or of the Hamming ball around it: the segment's number and a value."""
    first, bits, radius = segment
    value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
    flips = [sum(1 << b for b in c) for w in range(radius + 1) for c in combinations(range(bits), w)] if ball else [0]
    keys = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: value.bitwiseXOR(x))
    return F.transform(keys, lambda v: F.struct(F.lit(number).alias("segment"), v.alias("value")))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _around(prints: DataFrame, weight: int) -> list[DataFrame]:
    """``(fp, centre)`` for the centres that differ in exactly 0, 1, .. ``weight`` bits."""
    levels = [prints.select("fp", F.col("fp").alias("centre"), F.lit(-1).alias("last"))]
    for _ in range(weight):
        more = levels[-1].filter(F.col("last") < BITS - 1).select("fp", "centre", F.explode(F.sequence(F.col("last") + 1, F.lit(BITS - 1))).alias("last"))
        levels.append(more.select("fp", F.expr("centre ^ shiftleft(1L, last)").alias("centre"), "last"))
    return [level.select("fp", "centre") for level in levels]


def _by_centres(prints: DataFrame, distance: int) -> DataFrame:
    """Star edges that give the components of ``prints`` linked at ``distance`` or fewer bits.

    Two are linked if a centre lies within half the distance of both (for an odd
    distance: within its lower half of one and its upper half of the other).  A
    centre has at most as many members as its ball has points, whatever the input.
    """
    half = distance // 2
    levels = _around(prints, distance - half)
    inner = levels[0].select("*", F.lit(True).alias("inner"))
    for w, level in enumerate(levels[1:], 1):
        inner = inner.unionByName(level.select("*", F.lit(w <= half).alias("inner")))
    hubs = inner.groupBy("centre").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.collect_list("fp").alias("members"))
    stars = hubs.filter((F.size("members") > 1) & F.col("hub").isNotNull()).select("hub", F.explode("members").alias("fp"))
    return stars.filter("hub <> fp").select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct()


def links(prints: DataFrame, distance: int = 4, cap: int = CAP) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of the distinct ``fp`` linked at ``distance`` or fewer bits.

    All linked pairs, but among the fingerprints around table entries of more than
    ``cap`` only star edges of the same components.
    """
    cuts = segments(prints.count(), distance)
    table = prints.select("fp", F.explode(F.concat(*[_entries(s, i, False) for i, s in enumerate(cuts)])).alias("entry"))
    probes = prints.select("fp", F.explode(F.concat(*[_entries(s, i, True) for i, s in enumerate(cuts)])).alias("entry"))
    table, probes = (x.select("fp", "entry.segment", "entry.value") for x in (table, probes))
    key = ["segment", "value"]
    full = settle(table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select(key), "full")
    if full.isEmpty():
        rare, hot = table, None
    else:
        rare = table.join(lookup(full), key, "left_anti")
        hot = settle(probes.join(lookup(full), key, "left_semi").select("fp").distinct(), "hot")
    met = probes.join(rare.withColumnRenamed("fp", "other"), key).filter(F.col("fp") != F.col("other"))
    near = met.filter(_apart("fp", "other") <= distance).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    return near if hot is None else near.unionByName(_by_centres(hot, distance))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42, cap: int = CAP
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; component_id: the smallest id reachable by links, itself included.

    Fingerprints link at ``distance`` or fewer differing bits.  Words are runs of
    non-blank characters, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; a null, empty or blank text has fingerprint 0, linked like any
    other.  A row without id takes the component of its fingerprint (null if no
    row there has an id) and names none; rows that repeat an id are rows like others.
    Very long texts are read whole.  Other columns are not read.  No rows: no rows.
    """
    rows = settle(fingerprints(docs, id_column, text_column, shingle, seed), "fingerprints")
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    joined = components(links(prints.select("fp"), distance, cap)).withColumnRenamed("node", "fp")
    linked = settle(prints.join(joined, "fp"), "linked")
    lowest = settle(linked.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    named = linked.join(lowest, "component").select("fp", "lowest")
    named = settle(prints.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
