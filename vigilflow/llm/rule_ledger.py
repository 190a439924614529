"""Document quality rules as a ledger of bitmasks.

Every rule is evaluated once per document: the ledger keeps the measurements and a
mask with one bit per failed rule.  A policy is a versioned mask of the rules that
count; applying one, or another version of it, and finding what each rule alone
costs are bit operations on the ledger, the texts are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import texts_of
from vigilflow.session import settle

#: Words of a window, found twice or more in a text if it is a repeat.
WINDOW = 8
#: Words of texts measured together: a bound on memory beside the longest text's own size.
TOGETHER = 1_000_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_upper_words", "n_shouts")

#: Rules in the order of their bits: name and the condition, over the measurements, on which a document fails.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("few_letters", "100 * n_letter_words < 50 * n_words"),
    ("upper_case", "100 * n_upper_words > 30 * n_words"),
    ("shouting", "10 * n_shouts > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """The rules that count, under a name and a version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(BIT))

_BLANKS = b" \t\n\v\f\r"
_LETTERS = bytes(i for i in range(256) if i >= 128 or chr(i).isalpha())
_UPPER, _LOWER = bytes(range(65, 91)), bytes(i for i in range(256) if i >= 128 or 97 <= i < 123)


def repeated_words(ids: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each text the words that stand in a window found twice or more in that text.

    ``ids`` are the words of all texts in a row, ``counts`` how many each has.  Windows
    are told apart exactly: equal halves give equal numbers, up to the whole window.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    text = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= window:
        number, width = ids.astype(np.int64), 1
        while width < window:
            joint = number[:-width] * (number.max() + 1) + number[width:]
            number, width = np.unique(joint, return_inverse=True)[1], width * 2
        start = np.flatnonzero(text[: len(number)] == text[window - 1 :])  # windows within one text
        key = text[start] * (number.max() + 1) + number[start]
        _, back, often = np.unique(key, return_inverse=True, return_counts=True)
        found = start[often[back] > 1]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + window, -1)
    inside = np.cumsum(covered)[: len(ids)] > 0
    return np.bincount(text, inside, len(counts)).astype(np.int64)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of texts in UTF-8."""
    numbers: dict[bytes, int] = {}
    ids, rows = [], {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    for i, text in enumerate(texts):
        words = text.split()  # of bytes: exactly at the six ASCII blanks
        rows["n_words"][i] = len(words)
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        rows["n_symbols"][i] = len(text) - len(text.translate(None, b"#*$%&|<>"))
        rows["n_shouts"][i] = text.count(b"!!") + text.count(b"??")
        lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
        rows["n_lines"][i], rows["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
    every, counts = np.concatenate([np.zeros(0, np.int64), *ids]), rows["n_words"]
    text_of = np.repeat(np.arange(len(texts)), counts)
    # of each distinct word once
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in numbers), np.int64, len(numbers))
    letters = np.fromiter((len(w.translate(None, _LETTERS)) < len(w) for w in numbers), bool, len(numbers))
    upper = np.fromiter((len(w) - len(w.translate(None, _UPPER)) > 1 and len(w.translate(None, _LOWER)) == len(w) for w in numbers), bool, len(numbers))
    for name, of_word in (("word_chars", chars), ("n_letter_words", letters), ("n_upper_words", upper)):
        rows[name] = np.bincount(text_of, of_word[every], len(texts)).astype(np.int64)
    rows["n_repeat_words"] = repeated_words(every, counts)
    return rows


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose texts have about ``TOGETHER`` words (taken as six bytes each), one row at least."""
    sizes = np.cumsum([0, *pc.binary_length(texts).to_pylist()])
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + 6 * TOGETHER, "right")) - 1)
        yield begin, end
        begin = end


def measurements(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for begin, end in _pieces(texts):
                found = measure(texts.slice(begin, end - begin).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES])

    texts = texts_of(docs, id_column, text_column).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)]))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, failed`` and the measurements of every row, as a written table; ``failed`` has a bit for each failed rule.

    A null text is an empty one.  Words are runs of characters other than the six
    ASCII blanks.  Rows without id or with a repeated one are judged each for
    itself.  Texts of any length are read whole.  Other columns are not read.  No
    rows: no rows.
    """
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, condition in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return settle(measurements(docs, id_column, text_column).select("doc_id", failed.alias("failed"), *MEASURES), "ledger")


def fails(policy: Policy) -> Column:
    """Whether a ledger's row fails a rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = (BASE, STANDARD)) -> DataFrame:
    """``policy, version, rule, n_failed, n_alone, n_rejected, n_total`` of every rule of every policy.

    n_failed: documents that fail the rule; n_alone: those that fail no other rule of
    the policy, so that the policy without the rule would keep them; n_rejected and
    n_total: documents that the policy rejects, and all.  Documents are first summed
    up by their mask, of which there are 2^rules at most, so no text and no
    document is shuffled.  No rows: no rows.
    """
    masks = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    wanted = [
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.lit(p.mask).cast("long").alias("mask"))
        for p in policies
        for r in dict.fromkeys(p.rules)
    ]
    each = masks.select("n", F.col("failed"), F.explode(F.array(*wanted)).alias("w")).select("n", "w.*", F.col("failed").bitwiseAND(F.col("w.mask")).alias("here"))
    total = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)
    return each.groupBy("policy", "version", "rule").agg(
        total(F.col("here").bitwiseAND(F.col("bit")) != 0, "n_failed"), total(F.col("here") == F.col("bit"), "n_alone"), total(F.col("here") != 0, "n_rejected"), F.sum("n").alias("n_total")
    )


def verdicts(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The columns of the registered query from a ledger: measurements, ``base_failed`` and the policy's ``kept``."""
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), (~fails(BASE) & ~fails(policy)).alias("kept")
    )
