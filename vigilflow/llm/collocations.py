"""Phrases of words that stand together more often than chance, per language.

Phrases are counted by a multikey three-way quicksort of suffix pointers: the
suffixes of all pieces of text, cut after the longest phrase, are parted by their
first word, equal ones by the next, and so on.  The size of an equal part is the
count of the phrase that its suffixes begin with; parts below the least count are
left unsorted.

Suffixes are routed by their leading words, so that all suffixes that begin with a
phrase meet in one bucket.  They travel in blocks: the distinct suffixes that a
batch of texts has in a bucket, as numbers of a word list, with their counts.

Before that, words and pairs of neighbouring words are counted by hash.  A hash
whose count is below the least one has no frequent pair, so no suffix goes on over
such a pair.  These filters hold back rows only, never a frequent phrase.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from vigilflow.llm.common import lookup
from vigilflow.session import settle

#: Words of a phrase, at least and at most, and its least count.
SHORTEST, LONGEST, LEAST = 2, 5, 100
#: Phrases returned of a language.
TOP = 2000
#: Bits of the filter of frequent words, and least and most of that of frequent pairs, which has one for eight words:
#: fixed bounds whatever the input.  Slots of pairs that are summed up together, and rows of them.
FILTER_BITS, LEAST_SLOTS, MOST_SLOTS, CHUNK, FAN = 1 << 22, 1 << 20, 1 << 28, 18, 256
#: Distinct words that a task counts or remembers before it lets go of them; words of texts put into blocks together.
REMEMBERED, TOGETHER = 300_000, 2_000_000
#: Suffixes of a bucket, about, and the number from which it is parted once more; parts of a bucket that is.
BUCKET, OVERFULL, PARTS = 2_000_000, 8_000_000, 64
#: Fewer suffixes than this are no burden, however uneven the buckets are.
LEAST_FULL = 50_000
MOST_BUCKETS = 1 << 16

#: A-Z as a-z, ends of pieces as line ends, tabs as blanks.
_AS_WORDS = bytes(10 if chr(i) in ".,;:!?\n\v\f\r" else 32 if i == 9 else i + 32 if 65 <= i < 91 else i for i in range(256))
#: Stands for the end of a piece; no byte of UTF-8.
_END = b"\xff"


def words(text: bytes) -> list[bytes]:
    """The words of a text, with ``_END`` between its pieces."""
    return [w for w in text.translate(_AS_WORDS).replace(b"\n", b" \xff ").split(b" ") if w]


def _named(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text")
    )


def word_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang, word, n`` of every word, as a written table."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            counter.pop(_END, None)
            columns = [pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()).cast(pa.string()), pa.array(list(counter.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counts.setdefault(lang, Counter()).update(words(text.as_py()))
                if sum(map(len, counts.values())) > REMEMBERED:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    counted = _named(docs, text_column, lang_column).mapInArrow(run, "lang string, word string, n long")
    return settle(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def hash_of(lang: str, word: bytes) -> int:
    """64 bits of a word of a language, as Spark's ``xxhash64(lang, word)`` gives them, unsigned."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42))


def frequent_filter(frequent: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hash that a frequent word has: a word without its bit is not frequent.

    A few others pass; they cost rows, not results, for phrases are counted.
    """
    places = frequent.select(F.pmod(F.xxhash64("lang", "word"), F.lit(bits)).cast("int").alias("place")).distinct().toPandas()["place"]
    found = np.zeros(bits, bool)
    found[places.to_numpy(np.int64)] = True
    return np.packbits(found)


class Numbers(dict):
    """Numbers the words of a language as they are met; -1 for those that the filter holds back and for the ends of pieces."""

    def __init__(self, lang: str, frequent: np.ndarray):
        super().__init__({_END: -1})
        self.lang, self.frequent, self.words, self.hashes = lang, frequent, [], []

    def __missing__(self, word: bytes) -> int:
        h = hash_of(self.lang, word)
        place = (h - (1 << 64) if h >> 63 else h) % (len(self.frequent) * 8)
        if not self.frequent[place >> 3] >> (7 - (place & 7)) & 1:
            self[word] = -1
        else:
            self[word] = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        return self[word]


def _passes(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    place = place.astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def suffixes(ids: np.ndarray, goes_on: np.ndarray, longest: int) -> np.ndarray:
    """The suffixes of two or more words, each cut after ``longest`` words; -1 beyond its end.

    ``goes_on`` says of each word whether a phrase may go on from it to the next.
    """
    begin = np.flatnonzero(goes_on)
    rows = np.full((len(begin), longest), -1, ids.dtype)
    padded, alive = np.concatenate([ids, np.full(longest, -1, ids.dtype)]), np.ones(len(begin), bool)
    goes_on = np.concatenate([goes_on, np.zeros(longest, bool)])
    rows[:, 0] = ids[begin]
    for k in range(1, longest):
        alive &= goes_on[begin + k - 1]
        rows[alive, k] = padded[begin[alive] + k]
    return rows


def distinct(rows: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes of a bucket put together, in order of their bucket and words."""
    order = np.lexsort((*rows.T[::-1], bucket))
    rows, counts, bucket = rows[order], counts[order], bucket[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1) | (bucket[1:] != bucket[:-1]))) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(counts, at) if len(at) else counts, bucket[at]


def mixed(hashes: np.ndarray, depth: int) -> np.ndarray:
    """One hash of the first ``depth`` words of each row of word hashes (0 where a suffix has ended)."""
    found = np.full(len(hashes), depth, np.uint64)
    for k in range(depth):
        found = (found ^ hashes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


_BLOCK = "lang string, bucket long, rows long, words array<binary>, coded binary"


def _blocks(lang: str, listed: np.ndarray, rows: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    """A row for each bucket: its suffixes as numbers of its own word list, column by column, and their counts, compressed."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            used, own = np.unique(rows[i:j], return_inverse=True)
            own = own.reshape(j - i, -1).astype(np.int32)
            if used[0] < 0:  # the end stays -1
                used, own = used[1:], own - 1
            coded = pa.compress(np.ascontiguousarray(np.column_stack([own, counts[i:j].astype(np.int32), (counts[i:j] >> 32).astype(np.int32)]).T).tobytes(), "zstd", asbytes=True)
            yield lang, int(bucket[i]), j - i, listed[used].tolist(), coded


def _opened(rows: int, coded: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    columns = np.frombuffer(pa.decompress(coded, rows * (longest + 2) * 4, "zstd", asbytes=True), np.int32).reshape(longest + 2, rows)
    return columns[:longest].T, columns[longest].astype(np.uint32).astype(np.int64) | columns[longest + 1].astype(np.int64) << 32


def _as_batch(blocks: list[tuple]) -> pa.RecordBatch:
    lang, bucket, rows, listed, coded = zip(*blocks, strict=True)
    columns = [pa.array(lang, pa.string()), pa.array(bucket, pa.int64()), pa.array(rows, pa.int64()), pa.array(listed, pa.list_(pa.binary())), pa.array(coded, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "rows", "words", "coded"])


def _numbered(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[tuple[Numbers, np.ndarray]]:
    """The words of texts of a language as numbers in a row, -1 between texts: about ``TOGETHER`` words of all languages at a time."""
    numbers: dict[str, Numbers] = {}
    held: dict[str, list[np.ndarray]] = {}
    waiting, end = 0, np.array([-1], np.int32)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            own = numbers.get(lang)
            if own is None:
                own = numbers[lang] = Numbers(lang, frequent)
            found = words(text.as_py())
            held.setdefault(lang, []).extend((np.fromiter(map(own.__getitem__, found), np.int32, len(found)), end))
            waiting += len(found)
            if waiting >= TOGETHER:
                for name, texts in held.items():
                    yield numbers[name], np.concatenate(texts)
                held, waiting = {}, 0
                if sum(map(len, numbers.values())) > REMEMBERED:
                    numbers = {}
    for name, texts in held.items():
        yield numbers[name], np.concatenate(texts)


def _pairs(numbers: Numbers, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a frequent word has a frequent one behind it, and the hashes of those pairs."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    hashes = np.array(numbers.hashes, np.uint64)
    return at, mixed(np.stack([hashes[ids[at]], hashes[ids[at + 1]]], axis=1), 2)


def _slots_coded(slots: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    return len(slots), pa.compress(slots.astype(np.int32).tobytes() + counts.astype(np.int64).tobytes(), "zstd", asbytes=True)


def _slots_summed(part: pa.Table) -> np.ndarray:
    total = np.zeros(1 << CHUNK, np.int64)
    for n, coded in zip(part.column("n").to_pylist(), part.column("coded").to_pylist(), strict=True):
        raw = pa.decompress(coded, 12 * n, "zstd", asbytes=True)
        total[np.frombuffer(raw, np.int32, n)] += np.frombuffer(raw, np.int64, n, 4 * n)
    return total


_SLOTS = "chunk long, part long, n long, coded binary"


def pair_filter(docs: DataFrame, frequent: np.ndarray, slots: int, least: int, text_column: str = "text", lang_column: str = "lang") -> np.ndarray:
    """A bit for each slot, a hash of two neighbouring words, whose pairs stand ``least`` times or more in all.

    Counts are summed up chunk by chunk of slots, by at most ``FAN`` rows at a time.
    """
    given = docs.sparkSession.sparkContext.broadcast(frequent)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for numbers, ids in _numbered(batches, given.value):
            place, counts = np.unique(_pairs(numbers, ids)[1] % np.uint64(slots), return_counts=True)
            place = place.astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(place >> CHUNK)) + 1).tolist(), len(place)]
            rows = [(int(place[i]) >> CHUNK, part, *_slots_coded(place[i:j] & (1 << CHUNK) - 1, counts[i:j])) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]
            part += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["chunk", "part", "n", "coded"])

    def some(part: pa.Table) -> pa.Table:
        total = _slots_summed(part)
        place = np.flatnonzero(total)
        n, coded = _slots_coded(place, total[place])
        return pa.table({"chunk": [part.column("chunk")[0].as_py()], "part": [part.column("part")[0].as_py()], "n": [n], "coded": [coded]})

    def bits(part: pa.Table) -> pa.Table:
        return pa.table({"chunk": [part.column("chunk")[0].as_py()], "bits": [np.packbits(_slots_summed(part) >= least).tobytes()]})

    parts = settle(_named(docs, text_column, lang_column).mapInArrow(run, _SLOTS), "pairs")
    most = lambda: parts.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while (rows := most()) > FAN:
        spread = F.pmod(F.xxhash64("coded"), F.lit(-(-rows // (FAN // 2)))).alias("part")
        parts = settle(parts.select("chunk", spread, "n", "coded").groupBy("chunk", "part").applyInArrow(some, _SLOTS), "pairs")
    found = np.zeros(-(-slots >> CHUNK) << CHUNK - 3, np.uint8)
    for chunk, own in parts.groupBy("chunk").applyInArrow(bits, "chunk long, bits binary").toLocalIterator():  # at most MOST_SLOTS bits
        found[chunk << CHUNK - 3 : chunk + 1 << CHUNK - 3] = np.frombuffer(own, np.uint8)
    return found


def routed(
    docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, slots: int, buckets: int, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST
) -> DataFrame:
    """The blocks of all texts, bucketed by the first two words of their suffixes."""
    given = docs.sparkSession.sparkContext.broadcast((frequent, pairs))  # of bounded sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, pairs = given.value
        for numbers, ids in _numbered(batches, frequent):
            at, hashes = _pairs(numbers, ids)
            goes_on, bucket = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            goes_on[at], bucket[at] = _passes(pairs, hashes % np.uint64(slots)), (hashes >> np.uint64(20)) % np.uint64(buckets)
            rows = suffixes(ids, goes_on, longest)
            if len(rows):
                yield _as_batch(list(_blocks(numbers.lang, np.array(numbers.words, object), *distinct(rows, np.ones(len(rows), np.int64), bucket[goes_on]))))

    return _named(docs, text_column, lang_column).mapInArrow(run, _BLOCK)


def parted(blocks: DataFrame, depth: int, longest: int = LONGEST, parts: int = PARTS) -> DataFrame:
    """Blocks of smaller buckets, by the first ``depth`` words of their suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch.to_pylist():
                rows, counts = _opened(block["rows"], block["coded"], longest)
                hashes = np.array([*(hash_of(block["lang"], w) for w in block["words"]), 0], np.uint64)
                part = (mixed(hashes[rows[:, :depth]], depth) % np.uint64(parts)).astype(np.int64)
                out += _blocks(block["lang"], np.array(block["words"], object), *distinct(rows, counts, block["bucket"] * parts + part))
            if out:
                yield _as_batch(out)

    return blocks.mapInArrow(run, _BLOCK)


def sorted_counts(rows: np.ndarray, counts: np.ndarray, least: int, whole: int, shortest: int = SHORTEST) -> Iterator[tuple[int, int, int]]:
    """(row, words, count) of the phrases that suffixes begin with: its first so many words stand so often.

    Pointers are parted three ways by the word at the current depth, against that of
    a middle pointer; equal ones go on at the next depth.  Parts of fewer than
    ``least`` suffixes are abandoned, but above depth ``whole``, where the suffixes of a
    phrase may be in other buckets too.
    """
    stack = [(np.arange(len(rows)), 0)]
    while stack:
        at, depth = stack.pop()
        floor = least if depth >= whole else 1
        column = rows[at, depth]
        some = np.sort(column[:: max(1, len(column) // 9)])
        pivot = some[len(some) // 2]
        same = column == pivot
        for side in (column < pivot, column > pivot):
            part = at[side]
            if len(part) and counts[part].sum() >= floor:
                stack.append((part, depth))
        if pivot < 0:  # ended suffixes go no deeper
            continue
        equal = at[same]
        total = int(counts[equal].sum())
        if total < (least if depth + 1 >= whole else 1):
            continue
        if depth + 1 >= shortest:
            yield int(equal[0]), depth + 1, total
        if depth + 1 < rows.shape[1]:
            stack.append((equal, depth + 1))


def count_bucket(bucket: pa.Table, least: int, whole: int, longest: int = LONGEST) -> pa.Table:
    """``lang, phrase, size, n`` of the phrases of a bucket: exact from ``whole`` words on, its share of the shorter ones."""
    numbers: dict[bytes, int] = {}
    rows, counts = [], []
    for n, listed, coded in zip(*(bucket.column(c).to_pylist() for c in ("rows", "words", "coded")), strict=True):
        own, often = _opened(n, coded, longest)
        place = np.array([*(numbers.setdefault(w, len(numbers)) for w in listed), -1], np.int32)
        rows.append(place[own])
        counts.append(often)
    rows, counts, texts = np.concatenate(rows), np.concatenate(counts), list(numbers)
    found = list(sorted_counts(rows, counts, least, whole))
    phrases = [b" ".join(texts[i] for i in rows[r, :size]) for r, size, _ in found]
    lang = bucket.column("lang")[0].as_py()
    return pa.table(
        [pa.array([lang] * len(found), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([s for _, s, _ in found], pa.int32()), pa.array([n for *_, n in found], pa.int64())],
        names=["lang", "phrase", "size", "n"],
    )


def _counter(least: int, whole: int, longest: int) -> Callable[[pa.Table], pa.Table]:
    return lambda bucket: count_bucket(bucket, least, whole, longest)


def phrase_counts(
    docs: DataFrame, counted: DataFrame, least: int = LEAST, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST, bucket: int = BUCKET, overfull: int = OVERFULL
) -> DataFrame:
    """``lang, phrase, size, n`` of every phrase of 2 to ``longest`` words that stands ``least`` times or more, as a written table.

    A bucket that holds far more suffixes than the others, as one common pair of words
    gives it, is parted by one more leading word, and again if need be; at last by
    whole suffixes, of which equal ones are one row of a block.  The shares that its
    parts have of the shorter phrases are summed up.
    """
    spark = docs.sparkSession
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket)))
    frequent = frequent_filter(counted.filter(F.col("n") >= least))
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (total // 8).bit_length()))
    pairs = pair_filter(docs, frequent, slots, least, text_column, lang_column)
    blocks = settle(routed(docs, frequent, pairs, slots, buckets, text_column, lang_column, longest), "blocks")
    key, found, most = ["lang", "bucket"], [], None
    for depth in range(2, longest + 1):
        sizes = settle(blocks.groupBy(key).agg(F.sum("rows").alias("held")), "sizes")
        if most is None:
            most = min(overfull, max(LEAST_FULL, 4 * (sizes.agg(F.sum("held")).first()[0] or 0) // buckets))
        full = settle(sizes.filter(F.col("held") > most).select(key), "full")
        last = depth == longest or full.isEmpty()
        whole = blocks if last else blocks.join(lookup(full), key, "left_anti")
        found.append(whole.groupBy(key).applyInArrow(_counter(least, depth, longest), "lang string, phrase string, size int, n long"))
        if last:
            break
        blocks = settle(parted(blocks.join(lookup(full), key, "left_semi"), depth + 1, longest), "blocks")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return settle(every.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language.

    a is the count of the phrase, n that of all words of the language; of all cuts of
    the phrase the one of the lowest score floor(1000 a n / (l r)) counts, l and r
    being the counts of its two parts, of equal ones the first.  Phrases that stand
    no more often than a longer one around them are dropped.  By score, then by
    count, then by their bytes.

    A null text is an empty one, a null language ``und``.  Phrases do not cross ends
    of pieces.  Repeated rows count each.  Texts of any length are read whole.
    Other columns are not read.  No rows, or no phrase: no rows.
    """
    counted = word_counts(docs, text_column, lang_column)
    phrases = phrase_counts(docs, counted, least, text_column, lang_column, longest)
    known = phrases.select("lang", "phrase", "n").unionByName(counted.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n"))
    around = phrases.filter("size > 2").withColumn("w", F.split("phrase", " ")).select(
        "lang", F.explode(F.array(F.array_join(F.slice("w", 1, F.col("size") - 1), " "), F.array_join(F.slice("w", 2, F.col("size") - 1), " "))).alias("phrase"), F.col("n").alias("longer")
    )
    longest_around = settle(around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), "around")
    own = phrases.join(longest_around, ["lang", "phrase"], "left").filter("longer is null or longer < n").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = own.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("rest")
    )
    left = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    sums = lookup(settle(counted.groupBy("lang").agg(F.sum("n").alias("n")), "sums"))
    whole = lambda c: f"cast({c} as decimal(19,0))"  # noqa: E731  products pass 64 bits
    score = F.expr(f"cast(({whole('a')} * {whole('n')} * 1000BD) div ({whole('l')} * {whole('r')}) as long)")
    scored = settle(cuts.join(left, ["lang", "first"]), "firsts").join(right, ["lang", "rest"]).join(sums, "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
