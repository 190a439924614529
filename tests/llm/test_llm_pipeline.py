"""The pipeline's stages against plain versions of their decisions, and awkward rows."""

import corpus_pipeline
import numpy as np
import pytest
from frames import AWKWARD, documents
from pyspark.sql import functions as F

from vigilflow.llm import piece_viterbi, spaced_seeds

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi"
BASE = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    good = [(i, f"A plain sentence number {i} about subject {i * 7}.\nShared footer line.", f"s{i % 12}") for i in range(100, 160)]
    bad = [(i, "$$$ ### @@@ !!\n" * 5, "s1") for i in range(200, 230)]
    more = [(300, ITEM, "s2"), (301, "some words first " + ITEM.replace(" eta ", " x "), "s3"), (302, good[0][1], "s4"), (303, good[0][1].upper(), "s4")]
    rows = good + bad + more + AWKWARD
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(name, spark, docs, folder):
    return next(f for n, f in corpus_pipeline.STAGES if f.__name__ == name)(spark, docs, folder)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        found = f(spark, docs, folder)
        assert found.columns == docs.columns
        assert [t for _, t in found.dtypes] == [t for _, t in docs.dtypes]


def test_quality_rejects_bad_and_keeps_good(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in stage("quality", spark, docs, folder).select("doc_id").collect()}
    assert set(range(100, 160)) <= kept and not kept & set(range(200, 230))


def test_lines_take_out_the_footer(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in stage("lines", spark, docs, folder).filter("doc_id between 100 and 159").collect()}
    assert len(rows) == 60 and all("footer" not in r.text and r.n_chars == len(r.text) and r.text.startswith("A plain") for r in rows.values())


def test_lines_take_out_long_passages_despite_a_hot_source(spark, folder):
    """A passage of 60 words in 12 documents, a third of them of one source; a text copied to three sources stays whole."""
    passage = " ".join(f"passage{i}" for i in range(60))
    copied = " ".join(f"copied{i}" for i in range(60))
    sources = ["hot"] * 4 + ["s1", "s2", "s3", "s4", "s5", "s1", "s2", "s3"]
    rows = [(i, f"Own line {i}.\n{passage}\nA short line.", s) for i, s in enumerate(sources)] + [(20 + i, copied, f"s{i}") for i in range(3)]
    found = {r.doc_id: r.text for r in stage("lines", spark, documents(spark, rows), folder).collect()}
    assert found == {i: f"Own line {i}.\nA short line." for i in range(12)} | {20 + i: copied for i in range(3)}


def test_one_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r.doc_id for r in stage("near_duplicates", spark, docs, folder).select("doc_id").collect()]
    assert 100 in kept and 302 not in kept and 303 not in kept and kept.count(6) == 1 and 3 not in kept
    assert kept.count(None) == 1  # the row without id and text is a copy of empty ones


def test_rows_that_share_an_id_are_judged_each_for_itself(spark, folder):
    """Unlike texts of one id stay both; of equal ones the smallest id, then the smallest hash, whatever the order."""
    other = "quite another text of many words that has nothing in common with the first one at all"
    rows = [(7, ITEM, "a"), (7, other, "b"), (None, ITEM, "c"), (None, ITEM.upper(), "c"), (None, "alone without an id here and now", "d"), (None, "alone without an id here and now", "e")]
    for given in (rows, rows[::-1]):
        kept = [(r.doc_id, r.text) for r in stage("near_duplicates", spark, documents(spark, given), folder).collect()]
        assert sorted(kept, key=str) == sorted([(7, ITEM), (7, other), (None, "alone without an id here and now")], key=str)


def test_columns_of_any_name_are_carried(spark, folder):
    docs = documents(spark, [(i, f"Own line {i}.\nShared footer line.", f"s{i}") for i in range(12)]).withColumn("a.b", F.lit(1)).withColumn("c.d e", F.lit("x"))
    for name in ("lines", "near_duplicates", "decontaminate", "quality"):
        found = stage(name, spark, docs, folder)
        assert found.columns == docs.columns
        if name == "lines":
            assert {(r.text[:8], r["a.b"], r["c.d e"]) for r in found.collect()} == {("Own line", 1, "x")}


def test_leaks_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r.doc_id for r in stage("decontaminate", spark, docs, folder).select("doc_id").collect()]
    assert 300 not in kept and 301 not in kept and len(kept) == docs.count() - 2


def test_leaks_go_by_row_not_by_id(spark, folder):
    rows = [(None, ITEM, "a"), (None, "clean words without an id", "b"), (7, "first " + ITEM, "c"), (7, "clean words of the same id", "d"), (8, "other clean words", "e")]
    docs = documents(spark, rows)
    kept = [(r.doc_id, r.text) for r in stage("decontaminate", spark, docs, folder).collect()]
    assert sorted(kept, key=str) == sorted([rows[i][:2] for i in (1, 3, 4)], key=str)


def test_run_equals_the_stages_one_by_one(spark, folder):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect() if r.doc_id is not None}
    assert set(range(101, 160)) <= set(rows) and not {300, 301, 302} & set(rows)
    pieces = piece_viterbi.load("/opt/tokenizers/piece_bpe_32k.model")
    assert all(piece_viterbi.decode_ids(np.array(r.ids), np.array([r.n_ids]), pieces) == [r.text] for r in rows.values())
    assert all("footer" not in r.text for i, r in rows.items() if 100 <= i < 160)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_the_given_tables(spark):
    """Kept documents hold no verified overlap, and no two of them the same text."""
    folder = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, folder)
    texts = [r.text for r in found.collect()]
    assert len(texts) == len(set(texts)) > 100
    assert spaced_seeds.contaminated(found, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
