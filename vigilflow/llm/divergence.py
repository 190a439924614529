"""How far the sources of a language differ in their words: single-pass in-memory indexing.

Every task indexes its documents in memory, term by source, until the block is
full; a full block is written as a run sorted by term, in a segment for each hash
slot.  The runs of each slot are merged by a heap into frequencies.  Pairs of sources get the sum that
terms seen in neither of them give, and corrections streamed from the terms seen in
one or both.

All arithmetic is on whole numbers.  With count c of a term in a group of N
occurrences of the V kept terms, p = 1 + floor(10^9 (c + 1) / (N + V)); the
distance of p from q is floor((p - q)^2 / q).
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow.llm.common import lookup
from vigilflow.session import settle

#: Postings (term, source) of a block in memory, after which it is written.
POSTINGS = 400_000
#: Hash slots of a run, at least and at most: one for so many documents.
LEAST_SLOTS, MOST_SLOTS, SLOT_DOCS = 256, 1 << 16, 10_000
#: Chunks in which pairs are summed up, at least, and postings of one, about.
LEAST_CHUNKS, CHUNK_ROWS = 32, 400_000
#: Sources of a block: pairs are summed block by block.
SOURCES = 256
#: Parts in which a group's terms are ranked first, so that a group with most of the rows is not ranked by one task.
SALTS = 64

#: Terms are runs of ASCII letters and of all characters beyond ASCII; A-Z count as a-z.
_AS_TERMS = bytes(i if i >= 128 or chr(i).islower() else i + 32 if chr(i).isupper() else 32 for i in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_AS_TERMS).split()


class Block:
    """Postings in memory: occurrences by language, source and term, and documents by language and term."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, Counter]] = {}
        self.docs: dict[str, Counter] = {}
        self.size = 0

    def add(self, lang: str, source: str, found: list[bytes]) -> None:
        of_source = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before = len(of_source)
        of_source.update(found)
        self.size += len(of_source) - before
        self.docs.setdefault(lang, Counter()).update(set(found))

    def segments(self, slots: int) -> Iterator[tuple]:
        """Per language and slot: the terms in order (a blank between), and, coded, their documents and postings."""
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            place = {t: i for i, t in enumerate(terms)}
            sources = list(self.counts[lang])
            held = [self.counts[lang][s] for s in sources]
            of = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in held)])
            code = np.repeat(np.arange(len(held)), [len(c) for c in held])
            n = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(c.values(), np.int64, len(c)) for c in held)])
            slot = np.fromiter((xxhash.xxh64_intdigest(t) % slots for t in terms), np.int64, len(terms))
            seen = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
            by_slot = np.argsort(slot, kind="stable")
            order = np.lexsort((of, slot[of]))
            of, code, n = of[order], code[order], n[order]
            postings = np.bincount(of, minlength=len(terms))
            cuts = [0, *(np.flatnonzero(np.diff(slot[by_slot])) + 1).tolist(), len(terms)]
            begin = 0
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    own = by_slot[i:j]
                    end = begin + int(postings[own].sum())
                    coded = np.concatenate([seen[own], postings[own], code[begin:end], n[begin:end]]).astype("<i8").tobytes()
                    yield lang, int(slot[own[0]]), j - i, end - begin, sources, b" ".join(map(terms.__getitem__, own.tolist())), pa.compress(coded, "zstd", asbytes=True)
                    begin = end


_RUN = "lang string, slot long, n long, postings long, sources array<string>, terms binary, coded binary"


def _as_batch(segments: list[tuple]) -> pa.RecordBatch:
    lang, slot, n, postings, sources, terms, coded = zip(*segments, strict=True)
    columns = [
        pa.array(lang, pa.string()), pa.array(slot, pa.int64()), pa.array(n, pa.int64()), pa.array(postings, pa.int64()), pa.array(sources, pa.list_(pa.string())),
        pa.array(terms, pa.binary()), pa.array(coded, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "slot", "n", "postings", "sources", "terms", "coded"])


def _keyed(docs: DataFrame, lang_column: str, source_column: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"))]


def index_runs(
    docs: DataFrame, slots: int, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", postings: int = POSTINGS
) -> DataFrame:
    """The runs of all blocks, a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                block.add(lang, source, terms(text.as_py()))
                if block.size >= postings:
                    yield _as_batch(list(block.segments(slots)))
                    block = Block()
        if block.size:
            yield _as_batch(list(block.segments(slots)))

    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(*_keyed(docs, lang_column, source_column), text).mapInArrow(run, _RUN)


def merge_runs(slot: pa.Table, least_docs: int) -> pa.Table:
    """The frequencies of a slot from its runs, by a heap of the runs' heads."""
    runs, docs, postings, codes, counts, begin = [], [], [], [], [], 0
    numbers: dict[str, int] = {}
    for n, size, sources, terms, coded in zip(*(slot.column(c).to_pylist() for c in ("n", "postings", "sources", "terms", "coded")), strict=True):
        raw = np.frombuffer(pa.decompress(coded, 16 * (n + size), "zstd", asbytes=True), "<i8")
        runs.append(zip(terms.split(b" "), range(begin, begin + n), strict=True))
        begin += n
        docs.append(raw[:n])
        postings.append(raw[n : 2 * n])
        codes.append(np.array([numbers.setdefault(s, len(numbers)) for s in sources])[raw[2 * n : 2 * n + size]])
        counts.append(raw[2 * n + size :])
    docs, postings, codes, counts = map(np.concatenate, (docs, postings, codes, counts))
    term_of, found = np.zeros(begin, np.int64), []
    before = None
    for term, at in heapq.merge(*runs):
        if term != before:
            found.append(term)
            before = term
        term_of[at] = len(found) - 1
    seen = np.zeros(len(found), np.int64)
    np.add.at(seen, term_of, docs)
    of = np.repeat(term_of, postings)
    keep = seen[of] >= least_docs
    key, at = np.unique(of[keep] * len(numbers) + codes[keep], return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, at, counts[keep])
    own, source = np.divmod(key, max(len(numbers), 1))
    kept, sizes = np.unique(own, return_counts=True)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    names = pa.array(list(numbers), pa.string()).take(pa.array(source))
    lang = slot.column("lang")[0].as_py()
    return pa.table(
        [
            pa.array([lang] * len(kept), pa.string()), pa.array([found[i] for i in kept.tolist()], pa.binary()).cast(pa.string()), pa.array(seen[kept], pa.int64()),
            pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(sums, pa.int64())),
        ],
        names=["lang", "term", "docs", "sources", "counts"],
    )


def frequencies(
    docs: DataFrame, least_docs: int = 3, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", postings: int = POSTINGS
) -> DataFrame:
    """``lang, term, docs, sources, counts`` of every term in at least ``least_docs`` documents of its language, as a written table."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, docs.count() // SLOT_DOCS))
    runs = settle(index_runs(docs, slots, text_column, lang_column, source_column, postings), "runs")
    merged = runs.groupBy("lang", "slot").applyInArrow(lambda t: merge_runs(t, least_docs), "lang string, term string, docs long, sources array<string>, counts array<long>")
    return settle(merged, "frequencies")


def _shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """p of each count; in two steps, for 10^9 (c + 1) may pass 64 bits."""
    first, rest = np.divmod((counts + 1) * 100_000, total + size)
    return 1 + first * 10_000 + rest * 10_000 // (total + size)


def _share(count: str, total: str, size: str) -> str:
    first = f"(({count} + 1) * 100000)"
    return f"(1 + ({first} div ({total} + {size})) * 10000 + ({first} % ({total} + {size})) * 10000 div ({total} + {size}))"


def pair_sums(groups: pa.Table, postings: pa.Table) -> pa.Table:
    """The summed distances of all ordered pairs of sources of one or two blocks, over the terms of one chunk.

    Pairs within a block belong to the block's own turn.  The first chunk adds what
    all kept terms give as if no source had them; every chunk corrects its own terms.
    """
    names, totals, side = groups.column("source").to_pylist(), groups.column("total").to_pylist(), groups.column("block").to_numpy()
    size, low, high, chunk = (groups.column(c)[0].as_py() for c in ("size", "low", "high", "chunk"))
    coded = postings.column("term").combine_chunks().dictionary_encode()
    n_terms, place = len(coded.dictionary), {n: i for i, n in enumerate(names)}
    counts = np.zeros((len(names), n_terms), np.int64)
    counts[[place[s] for s in postings.column("source").to_pylist()], coded.indices.to_numpy()] = postings.column("n").to_numpy()
    out = []
    if size:
        none = np.array([_shares(np.zeros(1, np.int64), t, size)[0] for t in totals])
        shares = np.stack([_shares(c, t, size) for c, t in zip(counts, totals, strict=True)])
        for i, name in enumerate(names):
            away = np.maximum(none[i] - none, none - none[i]) ** 2 // none
            sums = ((shares[i] - shares) ** 2 // shares).sum(axis=1) - away * n_terms + (away * size if chunk == 0 else 0)
            out += [(name, other, int(v)) for j, (other, v) in enumerate(zip(names, sums, strict=True)) if j != i and (low == high or side[i] != side[j])]
    elif chunk == 0:
        out = [(a, b, 0) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and (low == high or side[i] != side[j])]
    source, item, value = zip(*out, strict=True) if out else ([],) * 3
    lang = groups.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(out), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def audit(
    docs: DataFrame, least_docs: int = 3, top: int = 200, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
    postings: int = POSTINGS, block: int = SOURCES,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language, by its distance from the
    source.  Part ``term``: the kept terms that the source has more often than its
    language, by their distance, the first ``top``.  Rank 1 is the largest value,
    of equal ones the smaller item.

    Null text, language and source are empty ones.  Sources whose documents have
    no kept term, and languages without kept terms, still have their pairs (all
    terms at count 0; value 0 without terms).  Rows that repeat are documents
    each.  Texts of any length are read whole.  Other columns are not read.  No
    rows: no rows.
    """
    kept = frequencies(docs, least_docs, text_column, lang_column, source_column, postings)
    each = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("in_lang"), F.explode(F.arrays_zip("sources", "counts")).alias("p")).select(
        "lang", "term", "in_lang", F.col("p.sources").alias("source"), F.col("p.counts").alias("n")
    )
    sums = settle(each.groupBy("lang", "source").agg(F.sum("n").alias("total")), "totals")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    every = docs.select(*_keyed(docs, lang_column, source_column)).distinct()
    groups = settle(
        every.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size")),
        "groups",
    )
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    groups = settle(groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks")), "groups")
    met = settle(each.join(lookup(groups), ["lang", "source"]), "postings")
    return _pairs(groups, met).unionByName(_terms(met, top))


def _pairs(groups: DataFrame, met: DataFrame) -> DataFrame:
    chunks = max(LEAST_CHUNKS, -(-met.count() // CHUNK_ROWS))
    key = ["lang", "chunk", "low", "high"]

    def of_pairs(frame: DataFrame, chunk: Column) -> DataFrame:
        """Every row once for each block that its own block is paired with."""
        each = frame.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    chunk = F.pmod(F.xxhash64("term"), chunks)
    left = of_pairs(groups, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    left = left.select(*key, "source", "total", "size", "block")
    right = of_pairs(met, chunk).select(*key, "source", "n", "term")
    parts = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(pair_sums, "lang string, source string, item string, value long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(met: DataFrame, top: int) -> DataFrame:
    p, q = F.expr(_share("n", "total", "size")), F.expr(_share("in_lang", "lang_total", "size"))
    valued = met.withColumn("p", p).withColumn("q", q).filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    some = Window.partitionBy("lang", "source", "salt").orderBy(*order)
    first = valued.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("r", F.row_number().over(some)).filter(F.col("r") <= top)
    whole = Window.partitionBy("lang", "source").orderBy(*order)
    ranked = first.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(whole))
    return ranked.filter(F.col("rank") <= top)
