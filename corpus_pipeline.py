"""From raw documents to token ids: five stages, each on what the one before it kept.

Every stage is a function of (spark, docs, sf_dir).  ``docs`` has the columns of
``documents`` (doc_id, text, lang, source, n_chars, and any others); all stages but
the last return them.  ``run`` writes what a stage returns as Parquet and gives
the next one the table read again, so a lost executor costs no earlier stage.

In all stages a null text is an empty one, and texts are read whole.  Rows without
id or with a repeated one are rows like others, judged each by its own text;
of equal rows the near-duplicate stage keeps one.  Empty tables give empty tables.
Column names may hold dots; columns beside doc_id, text and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilflow.llm import line_crf, line_spread, piece_viterbi, simhash, spaced_seeds
from vigilflow.llm.common import lookup
from vigilflow.llm.queries import GOOD, MODEL
from vigilflow.session import scratch_path, settle
from vigilflow.sources.tables import read_table

#: Sources from which a long line is boilerplate: fewer than shorter lines need, for a passage on a dozen documents may
#: stand on half as many sources if one has most rows, but more than the small groups of copied documents reach, of
#: which the near-duplicate stage shall keep one whole.
LONG_SITES = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores at least ``GOOD``; it learns from labelled documents that are not held out."""
    model = line_crf.fit(docs, read_table(spark, sf_dir, "labels"), parts=4, held=2)
    return line_crf.keep_good(docs, model, GOOD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on ten or more sources, or, if long, on ``LONG_SITES``; ``n_chars`` is counted anew."""
    other = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = line_spread.remove_spread_lines(docs, carry=other, long_sites=LONG_SITES)
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[made[c].alias(c) if c in made else F.col("carried").getField(c).alias(c) for c in docs.columns])


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows under a number of their own, and that column's name; written, for a task that runs again may number them otherwise."""
    key = "row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return settle(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints the row with the smallest id, then the smallest hash of its text.

    Rows are judged one by one: an id that rows share links nothing.  Rows without
    id come after all others.
    """
    rows, key = _with_key(docs)
    found = simhash.near_duplicates(rows, id_column=key, shingle=4, distance=4)
    groups = found.select(F.col("doc_id").alias("copy"), F.col("component_id").alias("group"))
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    known = settle(
        rows.select(F.col(key).alias("copy"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), text, F.col(key)).alias("place")).join(groups, "copy"), "groups"
    )
    first = settle(known.groupBy("group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "firsts")
    gone = settle(known.join(lookup(first), "group").filter("place <> first").select("copy"), "copies")
    return rows.join(lookup(gone), rows[key] == gone["copy"], "left_anti").drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text has no verified overlap with a benchmark item, whatever their ids."""
    rows, key = _with_key(docs)
    found = spaced_seeds.contaminated(rows, read_table(spark, sf_dir, "benchmark"), id_column=key)
    leaks = lookup(settle(found.select(F.col("doc_id").alias("leak")), "leaks"))
    return rows.join(leaks, rows[key] == leaks["leak"], "left_anti").drop(key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """``doc_id, n_ids, ids, text`` of every row: its ids and the text decoded from them."""
    return piece_viterbi.encode_and_decode(docs, piece_viterbi.load(model_path))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", tokens),
]

#: Trained scores, XXH64 fingerprints and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
