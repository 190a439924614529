"""Registered queries of this package: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilflow.llm import (
    collocations, divergence, licenses, line_crf, line_spread, piece_viterbi, pivot_index, pu_toxicity, rule_ledger, secret_links, simhash, spaced_seeds, warc,
)
from vigilflow.llm.common import label_split
from vigilflow.llm.sql import ORACLES  # noqa: F401
from vigilflow.session import scratch_path
from vigilflow.sources.tables import read_table


#: The vocabulary file; on another machine give its path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Scores from which a document counts as good, and as toxic.
GOOD, TOXIC = 0.7, 0.5


def _judged(scored: DataFrame, parts: int, held: int, least: float) -> DataFrame:
    return scored.select(
        "doc_id", label_split(F.col("doc_id"), parts, held).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def op1_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = line_crf.fit(docs, read_table(spark, folder, "labels"), parts=4, held=2)
    return _judged(line_crf.score(docs, model), 4, 2, GOOD)


def op2_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    return secret_links.digest(secret_links.scan(read_table(spark, folder, "documents")))


def op3_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    return line_spread.remove_spread_lines(read_table(spark, folder, "documents"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a folder per source, thousand and hundred; ids ending in 0 are licence files,
    the more zeros the higher."""
    n = F.col("doc_id")
    thousand, hundred = F.floor(n / 1000).cast("string"), F.floor(n / 100).cast("string")
    path = (
        F.when(n % 1000 == 0, F.concat_ws("/", "source", F.concat(F.lit("LICENSE."), n.cast("string"))))
        .when(n % 100 == 0, F.concat_ws("/", "source", thousand, F.lit("LICENSE")))
        .when(n % 10 == 0, F.concat_ws("/", "source", thousand, hundred, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", thousand, hundred, F.concat(n.cast("string"), F.lit(".txt"))))
    )
    return docs.select("doc_id", "text", path.alias("path"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(document_paths(read_table(spark, folder, "documents")))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"), shingle=4, distance=4, seed=42)
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op6_pu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = pu_toxicity.fit(docs, read_table(spark, folder, "labels"), parts=5, held=0)
    return _judged(pu_toxicity.score(docs, model), 5, 0, TOXIC)


def op7_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return pivot_index.near_duplicates(vectors, pivot_index.fit(vectors), cosine=0.95)


def op8_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return spaced_seeds.overlaps(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op9_piece_viterbi(spark: SparkSession, folder: str, model_path: str = MODEL) -> DataFrame:
    return piece_viterbi.encode_and_decode(read_table(spark, folder, "documents"), piece_viterbi.load(model_path))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.write_archive(read_table(spark, folder, "pages"), scratch_path(spark, "archive"))
    return warc.read_archive(spark, path).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read_table(spark, folder, "documents"))


def op12_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return rule_ledger.verdicts(rule_ledger.ledger(read_table(spark, folder, "documents")))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


QUERIES = {
    "op1_line_crf": op1_line_crf,
    "op2_secret_links": op2_secret_links,
    "op3_line_spread": op3_line_spread,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_pu_toxicity": op6_pu_toxicity,
    "op7_pivot_index": op7_pivot_index,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_piece_viterbi": op9_piece_viterbi,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_rule_ledger": op12_rule_ledger,
    "op13_collocations": op13_collocations,
}
