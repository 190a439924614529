"""Line CRF and positive-unlabelled learning: against plain versions, held-out accuracy, awkward rows."""

import itertools
import math
import zlib

import numpy as np
import pytest
from frames import AWKWARD, documents

from vigilflow.llm import line_crf, pu_toxicity, queries
from vigilflow.llm.common import label_split

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 2])
    emission = rng.normal(size=(7, 2))
    transition = rng.normal(size=(2, 2))
    good, pairs, log_z = line_crf.marginals(emission, transition, counts)
    at, expected, expected_pairs, total = 0, [], np.zeros((2, 2)), 0.0
    for n in counts:
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            s = sum(emission[at + i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False))
            weights[path] = math.exp(s)
        z = sum(weights.values())
        total += math.log(z)
        expected += [sum(w for p, w in weights.items() if p[i]) / z for i in range(n)]
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                expected_pairs[a, b] += w / z
        at += n
    assert np.allclose(good, expected) and np.allclose(pairs, expected_pairs) and math.isclose(log_z, total)


def test_line_features_of_each_text_alone_and_in_a_batch():
    texts = ["One.\n\nTWO!! $$$\nOne.", "", "x" * 3000, "a\n"]
    own, length, counts = line_crf.line_features(texts)
    assert counts.tolist() == [4, 1, 1, 2] and length.tolist() == [4, 0, 9, 4, 0, 3000, 1, 0]
    for text, part in zip(texts, np.split(own, np.cumsum(counts)[:-1]), strict=True):
        assert np.allclose(line_crf.line_features([text])[0], part)


def test_transitions_follow_neighbours():
    """A doubtful line among bad ones is judged worse than among good ones."""
    middle = lambda score: line_crf.marginals(np.array([[0.0, score], [0.0, 0.0], [0.0, score]]), np.eye(2), np.array([3]))[0][1]
    assert middle(3) > 0.6 and middle(-3) < 0.4


def test_chains_learn_documents():
    texts = ["\n".join(["A plain sentence of words."] * 5), "\n".join(["$$$ ### @@@ %%% ^^^"] * 5)] * 20
    own, length, counts = line_crf.line_features(texts)
    labels = np.array([1, 0] * 20)
    model = line_crf.calibrate(line_crf.fit_chains(own, counts, labels), own, length, counts, labels)
    assert model.documents([texts[0]])[0] > 0.9 and model.documents([texts[1]])[0] < 0.1


@pytest.mark.parametrize("name,label,parts,held,least", [("op1_line_crf", "quality", 4, 2, 0.95), ("op6_pu_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, parts, held, least):
    found = queries.QUERIES[name](spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % parts == held) and 0 <= r.score <= 1 for i, r in rows.items())
    known = [(rows[r.doc_id], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held_out = [(r.predicted, y) for r, y in known if r.held_out]
    assert len(held_out) > 40 and sum(p == y for p, y in held_out) / len(held_out) >= least


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = label_split(labels["doc_id"], 5, 0)
    other = labels.withColumn("toxic", (held & (labels["toxic"] == 0) | ~held & (labels["toxic"] == 1)).cast("int"))
    assert pu_toxicity.fit(docs, labels, steps=20).weights == pu_toxicity.fit(docs, other, steps=20).weights


def test_corrected_risk_finds_positives_among_unlabelled():
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(200)] + ["nasty"]
    text = lambda toxic: [*rng.choice(200, 20, replace=False), *([200] if toxic else [])]
    texts = [text(True) for _ in range(80)] + [text(i % 5 == 0) for i in range(400)]
    kinds = np.array([1] * 80 + [0] * 400)
    model = pu_toxicity.fit_features(kinds, np.array([len(t) for t in texts]), np.concatenate(texts), names, 0.2)
    assert model.score("nasty w1 w2") > 0.5 > model.score("w1 w2")


def test_fit_numbers_features_and_follows_the_size_of_the_sample(spark, monkeypatch):
    """The fit on numbered features is the one that runs; a word in six of sixty texts is learned."""
    docs = documents(spark, [(i, f"plain words of text {i} here" + (" vile" if i < 6 else ""), "a") for i in range(60)])
    labels = spark.createDataFrame([(i, 1, int(i < 6)) for i in range(60)], "doc_id long, quality int, toxic int")
    calls, fit_features = [], pu_toxicity.fit_features
    monkeypatch.setattr(pu_toxicity, "fit_features", lambda *a: calls.append(a) or fit_features(*a))
    model = pu_toxicity.fit(docs, labels, parts=60, held=61)
    assert len(calls) == 1 and calls[0][2].dtype == np.int32 and "plain" in calls[0][3]
    assert model.weights["vile"] > 0 and model.score("plain words vile") > model.score("plain words")


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (2, 0, None), (None, 1, 1), (5, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    crf = line_crf.fit(docs, labels, steps=5)
    pu = pu_toxicity.fit(docs, labels, steps=5)
    for module, model in ((line_crf, crf), (pu_toxicity, pu)):
        rows = module.score(docs, model).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in AWKWARD)
        assert all(0 <= r.score <= 1 for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r.score)
        assert by[2] == by[3] and by[6][0] == by[6][1]  # null is the empty text; repeated rows score alike
        assert module.score(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = documents(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in line_crf.score(docs, line_crf.fit(docs, none)).collect()} == {1.0}
    assert {r.score for r in pu_toxicity.score(docs, pu_toxicity.fit(docs, none)).collect()} == {0.0}
    assert line_crf.keep_good(docs, line_crf.fit(docs, none), 0.7).count() == len(AWKWARD)
