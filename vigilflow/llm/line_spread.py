"""Removal of cross-site boilerplate lines by their distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it stands on; sketches
merge by aggregation.  Only lines whose estimate is near the threshold are
counted exactly.  Lines on ``min_sites`` or more sites are taken out of all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import lookup, texts_of
from vigilflow.session import settle

#: log2 of the registers of a sketch, and the relative distance from the threshold within which lines are
#: counted exactly: over six standard errors of such a sketch (1.04 / sqrt(2^12) = 1.6 %).
LG_K, MARGIN = 12, 0.1
#: Words from which a line counts as long: two sites hardly write the same one on their own.
LONG_WORDS = 40


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bare(line: Column) -> Column:
    """The line without outer blanks, tabs, carriage returns, form feeds and vertical tabs."""
    return F.btrim(line, F.lit(" \t\r\f\v"))


def line_key(line: Column) -> Column:
    """128 bits of the line without outer white space: two XXH64 under different seeds."""
    line = bare(line)
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _lines(texts: DataFrame, *more: str, least_words: int = 0) -> DataFrame:
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"), *more).filter(bare(F.col("line")) != "")
    if least_words:
        lines = lines.filter((F.length("line") >= 2 * least_words - 1) & (F.size(F.split(bare(F.col("line")), r"\s+")) >= least_words))
    return lines.select(line_key(F.col("line")).alias("key"), *more).select("key.h1", "key.h2", *more)


def spread_lines(docs: DataFrame, min_sites: int, text_column: str = "text", site_column: str = "source", lg_k: int = LG_K, margin: float = MARGIN, least_words: int = 0) -> DataFrame:
    """Keys ``(h1, h2)`` of the lines of at least ``least_words`` words that stand on at least ``min_sites`` sites; null is no site."""
    texts = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.col(site_column).cast("string").alias("site"))
    lines = _lines(texts, "site", least_words=least_words).filter(F.col("site").isNotNull())
    sketched = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    # a line cannot stand on more sites than it has occurrences
    spread = settle(
        sketched.filter(F.col("n") >= min_sites)
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - margin)),
        "spread",
    )
    far = spread.filter(F.col("sites") > min_sites * (1 + margin)).select("h1", "h2")
    near = spread.filter(F.col("sites") <= min_sites * (1 + margin)).select("h1", "h2")
    exact = (
        lines.join(lookup(near), ["h1", "h2"], "left_semi")
        .distinct()  # map-side first: a line arrives as few rows of each site
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
        .filter(F.col("sites") >= min_sites).select("h1", "h2")
    )
    return settle(far.unionByName(exact), "spread")


def remove_spread_lines(
    docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source",
    lg_k: int = LG_K, margin: float = MARGIN, carry: tuple[str, ...] = (), long_sites: int | None = None, long_words: int = LONG_WORDS,
) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` for every row, the text without the lines on ``min_sites`` or more sites.

    With ``long_sites``, lines of at least ``long_words`` words are taken out from that many sites on.
    The columns named in ``carry`` come along in a struct column ``carried``, where no name can clash.

    Lines are equal if they are so without outer white space; blank lines are kept.
    A null text is an empty one (one blank line).  A null site counts for no
    line, but lines of such rows are removed like others.  Repeated rows and rows
    without id are treated each for itself.  Texts of any length are read whole.
    Other columns are not read.  No rows: no rows.
    """
    spread = spread_lines(docs, min_sites, text_column, site_column, lg_k, margin)
    if long_sites is not None:
        spread = spread.unionByName(spread_lines(docs, long_sites, text_column, site_column, lg_k, margin, long_words)).distinct()
    texts = texts_of(docs, id_column, text_column, *([F.struct(*[F.col(_quoted(c)).alias(c) for c in carry]).alias("carried")] if carry else []))
    # by the text's own hash, not by id: rows without or with a shared id are no matter, and a copied text is looked up once
    name = F.struct(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    hits = (
        _lines(texts.select("text", name.alias("t")).select("text", "t.t1", "t.t2"), "t1", "t2")
        .join(lookup(spread), ["h1", "h2"], "left_semi")
        .groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    )
    hits = settle(hits, "hits")  # a plain shuffle on both sides of the next join, whose hot texts Spark can then split
    named = texts.withColumn("t", name).select("*", "t.t1", "t.t2").join(hits, ["t1", "t2"], "left")
    lines = F.split("text", "\n")
    keep = F.filter(lines, lambda line: (bare(line) == "") | ~F.array_contains(F.col("gone"), line_key(line)))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(keep)
    return named.select(
        "doc_id",
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(kept)).alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        *(["carried"] if carry else []),
    )
