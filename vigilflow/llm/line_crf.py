"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of its own and of its
neighbours; the chain's transitions tie neighbouring labels.  The
length-weighted mean of the forward-backward marginals, put on the scale of the
documents' labels by a logistic curve, is the document's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilflow.llm.common import label_split, small_batches, texts_of

#: The training sample: documents of each label, and lines of a document that may be in it, at most.
SAMPLE, SAMPLE_LINES = 3000, 400
#: Gradient steps, their length, and the weight of the squared parameters.
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

UPPER, LOWER, DIGIT, BLANK, STOP, MARK, SYMBOL, OTHER = range(8)


def char_classes() -> np.ndarray:
    """Class of every code point below 2^16; what lies above counts as the last one."""
    table = np.full(1 << 16, OTHER, np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c.isupper():
            table[code] = UPPER
        elif c.isalpha():
            table[code] = LOWER
        elif c.isdigit():
            table[code] = DIGIT
        elif c.isspace():
            table[code] = BLANK
        elif c in ".!?…":
            table[code] = STOP
        elif c in ",;:'\"()-’“”«»¿¡":
            table[code] = MARK
        elif code < 128:
            table[code] = SYMBOL
    return table


#: Made once, and sent along with the functions that read it.
CHAR_CLASSES = char_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the lines' lengths, and the number of lines of each text (one at least)."""
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    big = "\n".join(texts) + "\n"
    codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = CHAR_CLASSES[np.minimum(codes, (1 << 16) - 1)]
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = ends - starts
    add = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)  # noqa: E731  every stretch has its line end
    per = [add(kind == c) for c in range(8)]
    per[BLANK] = per[BLANK] - 1
    blank = kind == BLANK
    after_blank = np.concatenate(([True], blank[:-1]))
    before_blank = np.concatenate((blank[1:], [True]))
    words = add(~blank & after_blank)
    odd_ends = add((kind == SYMBOL) & before_blank)
    shouts = add((codes == 33) & before_blank & np.concatenate(([False], codes[:-1] == 33)))
    last = kind[np.maximum(ends - 1, 0)]
    distinct, repeats, same = np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends))
    lines, at = big.split("\n"), 0
    for n in counts.tolist():
        own = lines[at : at + n]
        seen = Counter(own) if n > 1 else {}
        for i, line in enumerate(own, at):
            if line:
                distinct[i] = len(set(line.split()))
                if n > 1:
                    repeats[i] = seen[line] > 1
                    same[i] = i > at and own[i - at - 1] == line
        at += n
    chars, w = np.maximum(length, 1), np.maximum(words, 1)
    rates = [per[c] / chars for c in (UPPER, DIGIT, BLANK, STOP, MARK, SYMBOL, OTHER)]
    own = np.stack(
        [
            *rates, np.log1p(length), np.log1p(words), np.minimum((length - per[BLANK]) / w, 40) / 10, odd_ends / w, shouts / w,
            distinct / w, (last == STOP) & (length > 0), per[UPPER] / np.maximum(per[UPPER] + per[LOWER], 1), repeats, same, length == 0,
        ],
        axis=1,
    ).astype(np.float32)
    return own, length, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero beyond the text), and flags for the first and last line."""
    first = np.zeros(len(own), bool)
    last = np.zeros(len(own), bool)
    ends = np.cumsum(counts)
    first[ends - counts], last[ends - 1] = True, True
    before = np.vstack([np.zeros_like(own[:1]), own[:-1]])
    after = np.vstack([own[1:], np.zeros_like(own[:1])])
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None]]).astype(np.float32)


def _padded(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position from 0: which texts (longest first) have a line there, as their number, and those lines' places."""
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    return [(n := int(np.searchsorted(-sizes, -t, side="left")), begin[:n] + t) for t in range(int(sizes[0]) if len(sizes) else 0)]


def marginals(emission: np.ndarray, transition: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of all lines P(good); the expected transitions (2, 2) per line pair summed up; the texts' summed log partition.

    ``emission`` has a row (bad, good) of scores per line.  Forward and backward
    run over all texts at once, one step per line position.
    """
    steps = _padded(counts)
    forward = np.zeros_like(emission)
    backward = np.zeros_like(emission)
    state = None
    for n, at in steps:
        if state is None:
            state = emission[at]
        else:
            state = np.logaddexp(state[:n, :1] + transition[0], state[:n, 1:] + transition[1]) + emission[at]
        forward[at] = state
    for t in range(len(steps) - 2, -1, -1):
        n, at = steps[t + 1]
        now = emission[at] + backward[at]
        backward[steps[t][1][:n]] = np.logaddexp(transition[:, 0] + now[:, :1], transition[:, 1] + now[:, 1:])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((2, 2))
    for t in range(len(steps) - 1):
        n, at = steps[t + 1]
        came = steps[t][1][:n]
        for i in range(2):
            for j in range(2):
                pairs[i, j] += np.exp(forward[came, i] + transition[i, j] + emission[at, j] + backward[at, j] - total[at]).sum()
    log_z = float(total[steps[0][1]].sum()) if steps else 0.0
    return good, pairs, log_z


@dataclass
class LineCrf:
    """Parameters; ``constant`` replaces the score where there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    constant: float | None = None
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(good) of every line."""
        x = (with_neighbours(own, counts) - self.mean) / self.scale
        score = x @ self.weights[:-1] + self.weights[-1]
        emission = np.stack([np.zeros(len(score)), score], axis=1)
        return marginals(emission, self.transition, counts)[0]

    def documents(self, texts: list[str]) -> np.ndarray:
        """Scores of texts: the calibrated ``means``."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.0)
        return 1 / (1 + np.exp(-(self.slope * _logit(self.means(*line_features(texts))) + self.shift)))

    def means(self, own: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The length-weighted mean of each text's line marginals; blank texts count their lines alike."""
        good = self.lines(own, counts)
        begin = np.cumsum(counts) - counts
        all_chars = np.repeat(np.add.reduceat(length, begin), counts)
        weight = np.where(all_chars > 0, length, 1).astype(float)
        return np.clip(np.add.reduceat(weight * good, begin) / np.add.reduceat(weight, begin), 0.0, 1.0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibrate(model: LineCrf, own: np.ndarray, length: np.ndarray, counts: np.ndarray, labels: np.ndarray, share: float = 0.5) -> LineCrf:
    """Sets slope and shift by logistic regression of document labels on the logit of the mean (Newton); good ones weigh ``share``."""
    x = np.stack([_logit(model.means(own, length, counts)), np.ones(len(labels))], axis=1)
    weight = np.where(labels == 1, share / max((labels == 1).sum(), 1), (1 - share) / max((labels == 0).sum(), 1))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ theta)))
        slope = x.T @ (weight * (p - labels)) + 1e-3 * (theta - [1.0, 0.0])
        theta = theta - np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(2), slope)
    if np.isfinite(theta).all() and theta[0] > 0:
        model.slope, model.shift = map(float, theta)
    return model


def fit_chains(own: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> LineCrf:
    """Maximum conditional likelihood of line labels, those of their documents; Adam on the whole sample.

    Labels count by the inverse of their share of lines, so that neither prevails by its number.
    """
    x = with_neighbours(own, counts)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0).astype(np.float32)
    x = ((x - mean) / scale).astype(np.float64)
    y = np.repeat(labels, counts).astype(float)
    # the likelihood is a sum over documents; each label's documents together weigh the same
    of_line = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    groups = [(labels == v) for v in (0, 1)]
    places = [np.repeat(g, counts) for g in groups]
    theta = np.zeros(x.shape[1] + 1 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score = x @ theta[:-5] + theta[-5]
        transition = theta[-4:].reshape(2, 2)
        good = np.zeros(len(y))
        slope_t = np.zeros((2, 2))
        for v, (docs, rows) in enumerate(zip(groups, places, strict=True)):
            if not docs.any():
                continue
            emission = np.stack([np.zeros(int(rows.sum())), score[rows]], axis=1)
            good[rows], pairs, _ = marginals(emission, transition, counts[docs])
            true = np.zeros((2, 2))
            true[v, v] = (counts[docs] - 1).sum()
            slope_t += (pairs - true) * (0.5 / max(rows.sum(), 1))
        gap = (good - y) * of_line
        slope = np.concatenate([x.T @ gap, [gap.sum()], slope_t.ravel()]) + ridge * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineCrf(mean.astype(np.float32), scale, theta[:-4], theta[-4:].reshape(2, 2))


def known_labels(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """``(doc_id, label)`` of the ids labelled 0 or 1 that are not held out; of several labels of an id the smallest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return known.filter(~label_split(F.col("doc_id"), parts, held)).groupBy("doc_id").agg(F.min("label").alias("label"))


def training_sample(known: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of each label, the first by a hash of the id."""
    chosen = [known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample) for v in (0, 1)]
    return chosen[0].unionByName(chosen[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int = 4, held: int = 2, sample: int = SAMPLE, steps: int = STEPS
) -> LineCrf:
    """Learns from a bounded sample of labelled documents (``labels``: doc_id, quality) that are not held out.

    With labels of one kind only, or none, the score is constant: that label, or 1.
    """
    small_batches(docs.sparkSession)
    known = known_labels(labels, "quality", parts, held)
    # at most twice ``sample`` rows by construction, so they may go to every task
    chosen = F.broadcast(training_sample(known, sample))
    texts = texts_of(docs, id_column, text_column).join(chosen, "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = frame[frame["text"].str.count("\n") < SAMPLE_LINES]
            if len(keep):
                own, length, counts = line_features(keep["text"].tolist())
                cut = lambda a: [x.tobytes() for x in np.split(a, np.cumsum(counts)[:-1])]
                yield pd.DataFrame({"label": keep["label"].to_numpy(), "n": counts, "own": cut(own), "length": cut(length.astype(np.int64))})

    got = texts.select("text", "label").mapInPandas(run, "label int, n long, own binary, length binary").toPandas()
    kinds = set(got["label"])
    if len(kinds) < 2:
        return LineCrf(*[np.zeros(0)] * 4, constant=float(kinds.pop()) if kinds else 1.0)
    got = got.sort_values(["label", "n", "own"], kind="stable")  # the same sums however the sample arrived
    counts, kind = got["n"].to_numpy(np.int64), got["label"].to_numpy()
    own = np.frombuffer(b"".join(got["own"]), np.float32).reshape(int(counts.sum()), -1)
    length = np.frombuffer(b"".join(got["length"]), np.int64)
    share = known.agg(F.avg("label")).first()[0]
    return calibrate(fit_chains(own, counts, kind, steps), own, length, counts, kind, share)


def score(docs: DataFrame, model: LineCrf, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: 0 to 1, higher for better texts.

    Null is scored as the empty text, which is one blank line.  Rows without id or
    with a repeated one are scored like others.  Texts of any length are scored
    whole.  Other columns are not read.  No rows: no rows.
    """
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": model.documents(frame["text"].tolist())})

    return texts_of(docs, id_column, text_column).mapInPandas(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: LineCrf, least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``; scored as ``score`` does."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(model.documents(texts) >= least, pa.bool_()))

    # under numbers for names, for a name may hold a dot
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
