"""Small frames with awkward rows, shared by the tests of this folder."""

from __future__ import annotations

#: A document table whose extra columns bear names that operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row long, fp long, score double, line string, seed long, words array<string>, spans string, t1 long, gone string, label int, carried string, leak long"
)


def document(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), 1, 2, 0.5, "x", 3, ["w"], "s", 4, "g", 1, "c", 5)


def documents(spark, rows):
    return spark.createDataFrame([document(*r) for r in rows], SCHEMA)


LONG = " ".join(f"word{i % 977}" for i in range(40_000))
#: (doc_id, text, source): nulls in every column, empty, blank, very long and repeated rows.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line.", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (4, "   \n\n ", None),
    (5, LONG, "b"),
    (None, "No id here.\nA second line.", "c"),
    (None, None, None),
    (6, "repeated row", "a"),
    (6, "repeated row", "a"),
    (7, "é　漢\U0001F600 ▁ tab\there", "d"),
]
