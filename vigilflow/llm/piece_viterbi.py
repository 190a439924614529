"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is a row of marked words: a run of blanks and the characters up to the next
blank.  No piece of the vocabularies read here goes on over a blank, so words
are segmented alone, each distinct word once per batch.  The distinct words, sorted,
are a trie traversed depth-first: the forward states of a word's prefixes stand
on a stack, and the next word goes on from the prefix that both share.

Vocabularies of scored pieces take the path of the highest sum of scores.
Vocabularies of merges take the path on which every step is one that the merges
leave alone: two neighbouring pieces are allowed if merging their joined text gives
just these two.  Each prefix has one such path, and a word's is what its merges
give, since merges on either side of a boundary that stays do not see each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vigilflow.llm.common import texts_of

MARK = "▁"
WORDS = re.compile(" +[^ ]*")
#: Bytes of words, with their ids, that a Python worker remembers between batches, and of the longest word that it does;
#: pairs of pieces of which it knows whether they may be neighbours (some hundred bytes each).
REMEMBERED, LONG_WORD, PAIRS = 40_000_000, 400, 300_000
#: Bytes of text whose words are segmented together; a longer text is segmented alone.
TOGETHER = 4_000_000
#: Characters of a word up to which the pieces begun stay on the stack.  A word that shares more with the one before
#: goes on from there, so a word needs memory in proportion to its length.
STACKED = 64


#: Stands for a word's begin, and for a character that is no piece: nothing merges with either.
NOTHING = -1


@dataclass
class Pieces:
    """A vocabulary: pieces with a blank for the mark, their ids and scores, ids of the 256 bytes, and the cost of an unknown character."""

    ids: dict[str, int]
    scores: dict[int, float]
    bytes_at: list[int]
    unknown: float
    texts: list[bytes]
    merges: bool = False

    def __post_init__(self) -> None:
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.codes = {i: i.to_bytes(4, "little") for i in self.pieces}
        self.allowed: dict[int, bool] = {}
        sizes = np.array([len(t) for t in self.texts], np.int64)
        #: All pieces' bytes in a row, and where each piece's begin and how many they are.
        self.stored = np.frombuffer(b"".join(self.texts), np.uint8), np.cumsum(sizes) - sizes, sizes
        #: A trie of the pieces: a node is (children by character, id of the piece that ends here or NOTHING).
        self.root: dict = {}
        for piece, i in self.ids.items():
            node = (self.root, NOTHING)
            for char in piece[:-1]:
                node = node[0].setdefault(char, ({}, NOTHING))
            node[0][piece[-1]] = (node[0].get(piece[-1], ({}, NOTHING))[0], i)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the neighbours with the best joint piece first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            joint = [self.scores[i] if (i := self.ids.get(a + b)) is not None else None for a, b in zip(parts, parts[1:], strict=False)]
            known = [s for s in joint if s is not None]
            if not known:
                return parts
            i = joint.index(max(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def allows(self, left: int, right: int) -> bool:
        """Whether merges leave the two pieces alone, side by side."""
        if len(self.allowed) > PAIRS:
            self.allowed.clear()
        texts = [self.pieces[i] for i in (left, right) if i != NOTHING]
        known = self.allowed[left << 32 | right] = self.merged("".join(texts)) == texts
        return known

    def plain(self) -> dict:
        """The vocabulary in plain types: what executors unpickle without this package."""
        return {"given": (self.ids, self.scores, self.bytes_at, self.unknown, self.texts, self.merges)}

    @staticmethod
    def of(plain: dict) -> Pieces:
        """The vocabulary of ``plain``, built once in a worker's life."""
        if "built" not in plain:
            plain["built"] = Pieces(*plain["given"])
        return plain["built"]

    def spelled(self, char: str) -> bytes:
        """The ids of the bytes of a character that is no piece."""
        return b"".join(self.bytes_at[b].to_bytes(4, "little") for b in char.encode("utf-8", "surrogatepass"))


def load(path: str, merges: bool | None = None) -> Pieces:
    """Reads a SentencePiece model file on the driver.

    ``merges`` tells whether the pieces are merges; if it is not given, they are if
    all scores are whole numbers, as ranks are.

    Refused are files whose normaliser changes texts, without byte pieces or with
    pieces that go on over a blank: for them words cannot be segmented alone, or
    texts not be given back exactly.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "ﬁ  Á\t "
    if model.normalize(probe).replace(MARK, " ") != " " + probe:
        raise ValueError("the file's normaliser changes texts")
    ids, scores, bytes_at, texts = {}, {}, [-1] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            piece = piece.replace(MARK, " ")
            if " " in piece.lstrip(" "):
                raise ValueError(f"a piece goes on over a blank: {piece!r}")
            ids[piece], scores[i] = i, model.get_score(i)
            texts.append(piece.encode())
    if min(bytes_at) < 0:
        raise ValueError("the file has no byte pieces")
    if merges is None:
        merges = all(float(s).is_integer() for s in scores.values())
    return Pieces(ids, scores, bytes_at, min(scores.values()) - 10, texts, merges)


def _shared(word: str, before: str) -> int:
    n = min(len(word), len(before))
    i = 0
    while i < n and word[i] == before[i]:
        i += 1
    return i


def segment(words: list[str], pieces: Pieces) -> Iterator[bytes]:
    """The ids (four bytes each, lowest first) of each of the sorted ``words``, on the allowed or on the best path.

    A character that is no piece stands for itself, for scored pieces at the cost
    ``unknown``.  On the stacks, for the word's prefix of n characters:
    ``begun[n]`` are the pieces that go on there (trie node and begin, the longest
    first), ``last[n]`` is the last piece of the prefix's path and ``back[n]`` where it
    begins; a word's path is read from its end.
    """
    return _on_allowed_path(words, pieces) if pieces.merges else _on_best_path(words, pieces)


def _path(word: str, last: list[int], back: list[int], pieces: Pieces) -> bytes:
    parts, at = [], len(word)
    while at:
        parts.append(pieces.codes[last[at]] if last[at] >= 0 else pieces.spelled(word[at - 1]))
        at = back[at]
    parts.reverse()
    return b"".join(parts)


def _on_allowed_path(words: list[str], pieces: Pieces) -> Iterator[bytes]:
    begun, last, back, before = [[]], [NOTHING], [0], ""
    first, known = pieces.root.get, pieces.allowed.get
    for word in words:
        shared = min(_shared(word, before), STACKED)
        del begun[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
        now = begun[shared]
        for end in range(shared, len(word)):
            char = word[end]
            going, piece, begin = [], NOTHING, end
            for children, start in now:
                node = children.get(char)
                if node is not None:
                    if node[0]:
                        going.append((node[0], start))
                    i = node[1]
                    # of the pieces that end here one at most is allowed
                    if i >= 0 > piece:
                        fits = known(last[start] << 32 | i)
                        if pieces.allows(last[start], i) if fits is None else fits:
                            piece, begin = i, start
            node = first(char)
            if node is not None:
                if node[0]:
                    going.append((node[0], end))
                if piece < 0:
                    piece = node[1]
            now = going
            if end < STACKED:
                begun.append(going)
            last.append(piece)
            back.append(begin)
        before = word
        yield _path(word, last, back, pieces)


def _on_best_path(words: list[str], pieces: Pieces) -> Iterator[bytes]:
    """``score[n]`` is that of the prefix's path; of equal scores the longest last piece counts."""
    begun, score, last, back, before = [[]], [0.0], [NOTHING], [0], ""
    for word in words:
        shared = min(_shared(word, before), STACKED)
        del begun[shared + 1 :], score[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
        now = begun[shared]
        for end in range(shared, len(word)):
            char = word[end]
            going, found = [], []
            for children, start in (*now, (pieces.root, end)):
                node = children.get(char)
                if node is not None:
                    going.append((node[0], start))
                    if node[1] >= 0:
                        found.append((score[start] + pieces.scores[node[1]], start, node[1]))
            if char not in pieces.ids:
                found.append((score[end] + pieces.unknown, end, NOTHING))
            top, begin, piece = max(found, key=lambda x: x[0])  # the first of equal ones
            now = going
            if end < STACKED:
                begun.append(going)
            score.append(top)
            last.append(piece)
            back.append(begin)
        before = word
        yield _path(word, last, back, pieces)


def words_of(text: str) -> list[str]:
    """The marked words of a text, each without the blank that all begin with; none for the empty text."""
    if not text:
        return []
    if text[0] == " " or "  " in text:  # runs of blanks belong to the word behind them
        return [w[1:] for w in WORDS.findall(" " + text)]
    return text.split(" ")


class Encoder:
    """Encodes batches of texts; remembers the words of earlier batches up to a bound in bytes."""

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED):
        self.pieces, self.remembered, self.known, self.older, self.held = pieces, remembered, {}, {}, 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        split = [words_of(t) for t in texts]
        if self.held > self.remembered // 2:  # words not met for that long are forgotten
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        distinct = set().union(*split)
        here = {w: known[w] for w in distinct.intersection(known)}
        again = {w: older[w] for w in distinct.difference(here).intersection(older)}
        new = sorted(distinct.difference(here, again))
        again.update(zip(new, segment([" " + w for w in new], self.pieces), strict=True))
        here.update(again)
        for word, code in again.items():
            if len(word) <= LONG_WORD:
                known[word] = code
                self.held += 2 * len(word) + len(code) + 150
        parts = [b"".join(map(here.__getitem__, ws)) for ws in split]
        return np.frombuffer(b"".join(parts), "<i4"), np.array([len(p) // 4 for p in parts], np.int64)


def decode_ids(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> list[str]:
    """The texts of rows of ids: pieces in a row without the first blank, which encoding put there."""
    ids = np.asarray(ids).astype(np.int64)
    if len(ids) and not 0 <= ids.min() <= ids.max() < len(pieces.texts):
        raise ValueError("an id is outside the vocabulary")
    whole, starts, sizes = pieces.stored
    n = sizes[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    # byte k of the output is byte k - (its piece's place in the output) + (its piece's place in the store)
    kind = np.int32 if total < 1 << 30 else np.int64  # the vocabulary's bytes are far fewer
    data = whole[np.arange(total, dtype=kind) + np.repeat((starts[ids] - (ends - n)).astype(kind), n)].tobytes()
    last = np.concatenate(([0], ends))[np.cumsum(counts)].tolist()
    texts = []
    for begin, end in zip([0, *last], last, strict=False):
        texts.append(data[begin + (data[begin : begin + 1] == b" " and begin < end) : end].decode("utf-8", "replace"))
    return texts


def _stretches(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, put together or cut to about ``size`` bytes, a row at least: more words share more prefixes."""
    held, held_bytes = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + size - held_bytes, "right")))
            held.append(batch.slice(begin, end - begin))
            held_bytes += int(ends[end - 1]) - before
            begin = end
            if held_bytes >= size or begin < len(ends):
                yield pa.concat_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, pieces: Pieces, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row.

    Characters that are no piece, the mark U+2581 among them, become their UTF-8
    bytes' pieces.  Null and empty texts have no ids.  Rows without id or with a
    repeated one are encoded like others.  Texts of any length are read
    whole.  Other columns are not read.  No rows: no rows.
    """
    given = docs.sparkSession.sparkContext.broadcast(pieces.plain())  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces.of(given.value))
        for batch in _stretches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(*encoder(batch.column("text").to_pylist()))], ["doc_id", "ids"])

    return texts_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id, ids, text`` for every row; null ids are no ids, an id outside the vocabulary or null raises an error."""
    given = encoded.sparkSession.sparkContext.broadcast(pieces.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            texts = decode_ids(ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), Pieces.of(given.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    known = F.coalesce(F.col(ids_column).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col(id_column).cast("long").alias("doc_id"), known.alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, pieces: Pieces, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids, text`` for every row: ``encode``, and ``decode`` of its ids, in one pass of one worker per core."""
    given = docs.sparkSession.sparkContext.broadcast(pieces.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(given.value)
        encoder = Encoder(pieces)
        for batch in _stretches(batches):
            ids, counts = encoder(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int32()), _lists(ids, counts), pa.array(decode_ids(ids, counts, pieces), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids", "text"])

    return texts_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_ids int, ids array<int>, text string")
