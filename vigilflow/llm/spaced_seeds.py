"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words under its ones are
hashed, those under its zeros are ignored, so that a substituted word breaks few
seeds.  Seeds of benchmark items and of documents meet in a join; around every
hit the two texts are compared word by word along the hit's diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import lookup, texts_of
from vigilflow.session import settle

#: Five words each; the two masks share no pair of offsets beyond their ends, so one substitution rarely breaks both.
MASKS = ("1101011", "11100011")
#: Words compared around a hit, and the share of them that must be equal.
WINDOW, SHARE = 15, 0.8


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _offsets(mask: str) -> list[int]:
    if not mask or mask[0] != "1" or mask[-1] != "1" or set(mask) - {"0", "1"}:
        raise ValueError("a mask is a text of 0 and 1 that begins and ends with 1")
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(tokens: Column, masks: tuple[str, ...]) -> Column:
    """An array over the masks of arrays of hashes; the hash at i is that of the seed whose first word is i."""

    def of(number: int, mask: str) -> Column:
        starts = F.size(tokens) - len(mask)
        at = lambda i: F.xxhash64(F.lit(number), *[F.get(tokens, i + k) for k in _offsets(mask)])
        return F.when(starts >= 0, F.transform(F.sequence(F.lit(0), F.greatest(starts, F.lit(0))), at)).otherwise(F.array().cast("array<long>"))

    return F.array(*[of(n, m) for n, m in enumerate(masks)])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE,
) -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, words, matches``: the best window of every verified overlap.

    One row for each document, item and diagonal (position in the document less
    position in the item) on which a seed hits and some ``window`` aligned words,
    or all words of a shorter item, have at least ``share`` of them equal; of equally
    good windows the first.  Words beyond the document's ends are not equal.

    Null and empty texts have no words and no overlap; so have items with fewer words
    than the shortest mask.  Rows without id are compared like others, but the
    overlaps of all such documents are put together, as are those of rows that
    repeat an id.  Repeated items give the same rows once.  Columns other than
    the named ones are not read.  No rows on one side: no rows.
    """
    masks = tuple(masks)
    items = benchmark.select(
        F.col(item_column).cast("long").alias("item_id"), words(F.coalesce(F.col(item_text_column).cast("string"), F.lit(""))).alias("item_words")
    ).distinct()
    wanted = settle(
        items.select("item_id", "item_words", F.explode(_seeds(F.col("item_words"), masks)).alias("hashes"))
        .select("item_id", "item_words", F.posexplode("hashes").alias("item_pos", "seed")),
        "item_seeds",
    )
    texts = texts_of(docs, id_column, text_column)
    tokens = texts.select("doc_id", words(F.col("text")).alias("tokens"))
    seeds = tokens.select("doc_id", F.explode(_seeds(F.col("tokens"), masks)).alias("hashes")).select(
        "doc_id", F.posexplode("hashes").alias("doc_pos", "seed")
    )
    places = lookup(wanted.select("seed", "item_id", "item_pos").distinct())
    diagonals = (
        seeds.join(places, "seed")
        .select("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"))
        .distinct()
    )
    return _verified(settle(diagonals, "diagonals"), texts, items, window, share)


def _verified(diagonals: DataFrame, texts: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """Compares document and item along each diagonal; rows as ``overlaps`` returns them."""
    same = lambda a, b: a.eqNullSafe(b)
    size = F.size("item_words")
    wide = F.least(F.lit(window), size)
    # only documents with hits are read once more and cut into words
    touched = lookup(diagonals.select("doc_id").distinct())
    tokens = texts.alias("t").join(touched.alias("h"), same(F.col("t.doc_id"), F.col("h.doc_id")), "left_semi")
    tokens = tokens.select("doc_id", words(F.col("text")).alias("tokens"))
    asked = diagonals.alias("d").join(lookup(items).alias("i"), same(F.col("d.item_id"), F.col("i.item_id"))).select("d.*", "i.item_words")
    found = asked.alias("a").join(tokens.alias("t"), same(F.col("a.doc_id"), F.col("t.doc_id"))).select("a.*", "t.tokens")
    equal = F.transform(
        F.col("item_words"),
        lambda w, i: F.when(
            (i + F.col("diagonal") >= 0) & F.coalesce(F.get("tokens", i + F.col("diagonal")) == w, F.lit(False)), 1
        ).otherwise(0),
    )
    # sums[i] is the number of equal words among the first i
    sums = F.aggregate(
        "equal", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )
    counts = F.transform(F.sequence(F.lit(0), size - F.col("wide")), lambda i: F.get("sums", i + F.col("wide")) - F.get("sums", i))
    best = F.array_max("counts")
    return (
        found.filter(size > 0)
        .select("doc_id", "item_id", "diagonal", "item_words", wide.alias("wide"), equal.alias("equal"))
        .withColumn("sums", sums)
        .withColumn("counts", counts)
        .filter(best >= F.col("wide") * share)
        .select(
            "doc_id", "item_id",
            (F.col("diagonal") + F.array_position("counts", best) - 1).cast("long").alias("doc_start"),
            (F.array_position("counts", best) - 1).cast("long").alias("item_start"),
            F.col("wide").cast("long").alias("words"), best.cast("long").alias("matches"),
        )
        .distinct()
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_items, n_overlaps, best_share`` of every document with a verified overlap; options as in ``overlaps``."""
    return overlaps(docs, benchmark, **options).groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.count(F.lit(1)).alias("n_overlaps"),
        F.round(F.max(F.col("matches") / F.col("words")), 6).alias("best_share"),
    )
