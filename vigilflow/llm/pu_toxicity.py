"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over word presence learns from confirmed toxic texts and from
unlabelled ones.  Its risk takes the class prior's share of positives out of the
unlabelled part; where that estimate falls below zero, the step goes the other
way, so that the model cannot drive it negative by overfitting.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigilflow.llm.common import label_split, small_batches, texts_of
from vigilflow.session import settle

#: The training sample: confirmed toxic and unlabelled documents, at most; known features of a document that may be in it.
POSITIVES, UNLABELLED, FEATURES_EACH = 3000, 6000, 10_000
#: Features known to the model, at most, and the share of the sampled texts in which one must stand, in two at least; features handled at once.
VOCABULARY, LEAST_SHARE = 100_000, 1 / 900
BLOCK = 500_000
STEPS, RATE, SPARSE = 300, 0.05, 0.08
#: First letters of a word that are features beside the whole word: inflected forms share a stem.
STEMS = (4, 6, 8)
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """The distinct words, lower-cased runs of letters, and (marked by a hyphen) their stems."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) >= n} for n in STEMS))


@dataclass
class Linear:
    """Weights by feature; ``constant`` replaces the score where there was nothing to learn from."""

    weights: dict[str, float]
    bias: float
    constant: float | None = None

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        found = sorted(features_of(text) & self.weights.keys())  # in a fixed order, for equal sums
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(map(self.weights.__getitem__, found)), -50, 50))))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit_features(kinds: np.ndarray, counts: np.ndarray, columns: np.ndarray, names: list[str], prior: float, steps: int = STEPS, rate: float = RATE, sparse: float = SPARSE) -> Linear:
    """Minimises prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss.

    ``kinds`` is 1 for the confirmed texts P and 0 for the unlabelled U, ``counts``
    the number of each text's features, ``columns`` their numbers in a row.  Adam on
    the whole sample, with a penalty on the weights' absolute values.
    """
    is_positive = kinds == 1
    ends = np.cumsum(counts)
    cuts = np.searchsorted(ends, np.arange(BLOCK, int(counts.sum()) + BLOCK, BLOCK)).tolist() if len(counts) else []
    # texts and their features by blocks, so that a step's arrays stay small on the driver
    parts = list(zip([0, *cuts], [*cuts, len(counts)], strict=True))
    blocks = [(counts[i:j], columns[ends[i] - counts[i] : ends[j - 1]]) for i, j in parts if j > i]
    positives, others = max(int(is_positive.sum()), 1), max(int((~is_positive).sum()), 1)
    # about the noise of a useless feature's slope
    penalty = sparse * prior / np.sqrt(positives)
    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), theta[c], len(n)) for n, c in blocks]) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        negative = _softplus(z[~is_positive]).sum() / others - prior * _softplus(z[is_positive]).sum() / positives
        # slopes of the risk's two parts by z
        plus = np.where(is_positive, prior * (p - 1) / positives, 0.0)
        minus = np.where(is_positive, -prior * p / positives, p / others)
        gap = plus + minus if negative >= 0 else -minus
        slope, at = np.append(np.zeros(len(names)), gap.sum()), 0
        for n, c in blocks:
            slope[:-1] += np.bincount(c, np.repeat(gap[at : at + len(n)], n), len(names))
            at += len(n)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        pace = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta = theta - pace * first / (1 - 0.9**step)
        # the step of the absolute weights' penalty: small ones become 0, or long texts would gather thousands of them
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - pace[:-1] * penalty, 0)
    return Linear({w: float(v) for w, v in zip(names, theta[:-1], strict=True) if abs(v) > 1e-3}, float(theta[-1]))


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, parts: int, held: int, positives: int, unlabelled: int) -> tuple[float | None, DataFrame]:
    """The share of toxic documents among the labelled ones, and the sampled texts with their kind, as a written table."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(~label_split(F.col("doc_id"), parts, held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
    # confirmed toxic texts may be in this sample too: it stands for the whole corpus
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id")).filter("doc_id is not null")
    ids = ids.filter(~label_split(F.col("doc_id"), parts, held)).distinct()
    others = ids.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("kind"))
    chosen = F.broadcast(toxic.unionByName(others))  # bounded by the two limits
    texts = texts_of(docs, id_column, text_column).join(chosen, "doc_id").select("kind", "text")
    return known.agg(F.avg("toxic")).first()[0], settle(texts, "sample")


def _vocabulary(sample: DataFrame) -> list[str]:
    """The features that stand in the most sampled texts."""
    least = max(2, round(sample.count() * LEAST_SHARE))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = Counter(f for t in frame["text"] for f in features_of(t))
            yield pd.DataFrame({"feature": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    counted = sample.mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(VOCABULARY)
    return [r.feature for r in top.select("feature").toLocalIterator()]


def fit(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, id_column: str = "doc_id", text_column: str = "text", parts: int = 5, held: int = 0,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, steps: int = STEPS,
) -> Linear:
    """Learns from bounded samples: documents labelled toxic (``labels``: doc_id, toxic) and documents whatever their label.

    Neither sample holds held-out documents.  ``prior`` is the share of toxic
    documents; if it is not given, their share among the labelled ones that are not
    held out.  Without toxic or without other documents the score is constant: 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    share, sample = _sample(docs, labels, id_column, text_column, parts, held, positives, unlabelled)
    prior = share if prior is None else prior
    if not prior or prior >= 1:
        return Linear({}, 0.0, 0.0)
    names = _vocabulary(sample)
    given = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # at most VOCABULARY features

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = given.value
        for frame in frames:
            found = [sorted(numbers[f] for f in features_of(t) & numbers.keys()) for t in frame["text"]]
            # as bytes, for the driver gathers them
            yield pd.DataFrame({"kind": frame["kind"], "features": [np.array(f, np.int32).tobytes() if len(f) <= FEATURES_EACH else None for f in found]})

    got = sample.mapInPandas(number, "kind int, features binary").toPandas().dropna()
    got = got.sort_values(["kind", "features"], kind="stable")  # the same sums however the sample arrived
    kinds = got["kind"].to_numpy()
    if not (kinds == 1).any() or not (kinds == 0).any():
        return Linear({}, 0.0, 0.0)
    counts = (got["features"].str.len() // 4).to_numpy(np.int64)
    columns = np.frombuffer(b"".join(got["features"]), np.int32)
    return fit_features(kinds, counts, columns, names, float(prior), steps)


def score(docs: DataFrame, model: Linear, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: 0 to 1, higher for texts more likely toxic.

    Null is scored as the empty text, by the model's bias alone.  Rows without
    id or with a repeated one are scored like others.  Texts of any length are
    scored whole.  Other columns are not read.  No rows: no rows.
    """
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": np.array([model.score(t) for t in frame["text"]], float)})

    return texts_of(docs, id_column, text_column).mapInPandas(run, "doc_id long, score double")
