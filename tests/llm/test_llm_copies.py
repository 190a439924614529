"""SimHash, pivot index, Viterbi and WARC against brute force, exact round trips and awkward rows."""

import base64
import hashlib
import random

import numpy as np
import pytest
import xxhash
from frames import AWKWARD, documents

from vigilflow.llm import line_crf, piece_viterbi, pivot_index, simhash, warc
from vigilflow.session import scratch_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    """Smallest id (None counts as none) reachable, by repeated passes over all pairs."""
    low = [i if i is not None else 1 << 60 for i in ids]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return [x if x < 1 << 60 else None for x in low]


def test_fingerprints_of_awkward_rows(spark):
    rows = [*AWKWARD, (30, "Ab\vCd\fEF gh ÄÖ", "a"), (31, "ab cd ef gh ÄÖ", "a")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted((str(i), plain_fingerprint(t)) for i, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert by[2] == by[3] == by[4] == [2] and by[31] == [30] and by[6] == [6, 6] and 2 in by[None]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 5])
@pytest.mark.parametrize("cap", [0, 2, 256])
def test_links_equal_all_pairs(spark, distance, cap):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for center in list(prints)[:12]:
        for _ in range(12):
            other = center
            for _ in range(rng.randint(1, 5)):
                other ^= 1 << rng.randrange(64)
            prints.add(other)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= distance]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance, cap).collect()
    at = {p: i for i, p in enumerate(signed)}
    number = list(range(len(prints)))
    assert plain_components(number, [(at[e.a], at[e.b]) for e in edges]) == plain_components(number, pairs)
    if cap == 256:
        assert sorted((at[e.a], at[e.b]) for e in edges) == sorted((min(x, y, key=lambda i: signed[i]), max(x, y, key=lambda i: signed[i])) for x, y in pairs)


def vectors(rng, groups=8, of=12, size=16):
    out = []
    for _ in range(groups):
        center = rng.normal(size=size)
        out += [(center + rng.normal(size=size) * rng.uniform(0, 0.35)).tolist() for _ in range(of)]
    return out


@pytest.mark.parametrize("block", [3, 512])
def test_vectors_equal_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows = [(int(i), v) for i, v in enumerate(vectors(rng))]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[0][1]]), (None, rows[5][1]), (203, rows[5][1]), (203, rows[5][1])]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] + [1.0] * 15), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] * 16), (308, [1e300] * 16), (309, [1e-300] * 16)]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, node long, copies int, list string")
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]

    def cosine(a, b):
        a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    linked = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= 0.95]
    counts = [sum(i in p for p in linked) for i in range(len(rows))]
    low = plain_components([i for i, _ in rows], linked)
    expected = sorted(str((i, n, c, i is not None and i == c)) for (i, _), n, c in zip(rows, counts, low, strict=True))
    model = pivot_index.fit(frame, sample=100, pivots=24, nearest=8)
    got = sorted(str(tuple(r)) for r in pivot_index.near_duplicates(frame, model, block=block).collect())
    assert got == expected
    assert pivot_index.near_duplicates(frame.limit(0), pivot_index.fit(frame.limit(0))).count() == 0


def test_recall_of_the_index(spark):
    """Against brute force over all pairs of a table that holds near copies and strangers."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1200, 32))
    near = np.concatenate([base[:300] + 0.2 * rng.normal(size=(300, 32)), base[:100] + 0.25 * rng.normal(size=(100, 32))])
    x = np.concatenate([base, near])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = ((u @ u.T) >= 0.95).sum() - len(x)
    got = sum(r.n_links for r in pivot_index.near_duplicates(frame, pivot_index.fit(frame)).collect())
    assert true > 300 and 0.9 * true <= got <= true


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = piece_viterbi.load(MODEL)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150).collect()]
    texts += ["", " ", "  a  b ", "naïve café 漢字かな", "x" * 300, "aaaa bbbb\t\r\n", "\U0001F600\U0001F600", "don't   stop"]
    ids, counts = piece_viterbi.Encoder(pieces)(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(text)
        assert piece_viterbi.decode_ids(own, np.array([len(own)]), pieces) == [text]


def test_scored_pieces_take_the_best_path():
    rated = {" a": -1.0, "b": -2.0, " ab": -4.5, "bc": -1.5, "c": -3.0, "a": -2.5, " ": -1.0, "abc": -3.5, "ca": -2.0}
    ids = {p: i for i, p in enumerate(rated)}
    scores = {ids[p]: s for p, s in rated.items()}
    pieces = piece_viterbi.Pieces(ids, scores, list(range(100, 356)), -20.0, [p.encode() for p in rated])

    def best(word):
        """The best sum over all ways to cut."""
        if not word:
            return 0.0
        return max((rated.get(word[:n], -20.0 if n == 1 else float("-inf")) + best(word[n:])) for n in range(1, len(word) + 1))

    rng = random.Random(3)
    words = sorted({" " + "".join(rng.choice("abcx") for _ in range(rng.randint(0, 9))) for _ in range(200)})
    for word, code in zip(words, piece_viterbi.segment(words, pieces), strict=True):
        found = np.frombuffer(code, "<i4").tolist()
        assert abs(sum(scores[i] if i < 100 else -20.0 for i in found) - best(word)) < 1e-9
        assert b"".join(pieces.texts[i] if i < 100 else bytes([i - 100]) for i in found) == word.encode()


def test_round_trip_of_awkward_rows(spark):
    pieces = piece_viterbi.load(MODEL)
    rows = piece_viterbi.decode(piece_viterbi.encode(documents(spark, AWKWARD), pieces), pieces).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted((str(i), t or "") for i, t, _ in AWKWARD)
    assert piece_viterbi.encode(documents(spark, []), pieces).count() == piece_viterbi.encode_and_decode(documents(spark, []), pieces).count() == 0
    both = piece_viterbi.encode_and_decode(documents(spark, AWKWARD), pieces).collect()
    assert sorted((str(r.doc_id), r.n_ids, r.text) for r in both) == sorted((str(r.doc_id), len(r.ids), r.text) for r in rows)
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.text for r in piece_viterbi.decode(nulls, pieces).collect()} == {""}


def test_words_are_remembered_up_to_a_bound():
    encoder = piece_viterbi.Encoder(piece_viterbi.load(MODEL), remembered=4)
    first = encoder(["the cat sat on the mat", "on a hill"])[0].tolist()
    for _ in range(3):
        assert encoder(["the cat sat on the mat", "on a hill"])[0].tolist() == first


@pytest.mark.parametrize("text", ["漢字" * 20_000, "aB3/" * 5_000, "x" * 30_000, "a\n" * 10_000])
def test_long_words_without_blanks(text):
    """Memory in proportion to the word's length, the library's ids, and prefixes beyond the stack shared by several words."""
    import tracemalloc

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = piece_viterbi.Encoder(piece_viterbi.load(MODEL))
    texts = [text, text[:-1] + "!", text[: len(text) // 2] + " " + text[:70]]
    tracemalloc.start()
    ids, counts = encoder(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for own, given in zip(np.split(ids, np.cumsum(counts)[:-1]), texts, strict=True):
        assert own.tolist() == library.encode(given)
    assert peak < 1000 * len(text) and encoder.held < 100_000


def test_stretches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (3, 50, 1, 1, 1, 0, 7, 12)] + [None]
    batches = [pa.RecordBatch.from_pydict({"text": texts[:5]}), pa.RecordBatch.from_pydict({"text": texts[5:]}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]
    parts = [b.column("text").to_pylist() for b in piece_viterbi._stretches(iter(batches), 10)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 20 for p in parts)


PAGES = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u\r\nX: y", "é漢"), (4, "u", None), (6, "u", ""), (None, "u", "alone"), (None, "v", "same"), (7, "u", "z" * 200_000), (5, "http://b", "same")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], "page_id long, url string, html string, payload string, payload_sha256 int")


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    path = warc.write_archive(pages(spark, PAGES), scratch_path(spark, "archive"), least_bytes=least)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    rows = warc.read_archive(spark, path).collect()
    assert len(rows) == len(PAGES)
    assert sorted(bytes(r.payload) for r in rows) == sorted((h or "").encode() for _, _, h in PAGES)
    for r in rows:
        payload = bytes(r.payload)
        again = [i for i, _, h in PAGES if (h or "").encode() == payload]
        largest = max((i for i in again if i is not None), default=None)
        revisit = len(again) > 1 and len(payload) >= least and r.record_id != largest
        assert (r.record_type, r.refers_to) == (("revisit", largest) if revisit else ("response", None))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r.payload_bytes == len(payload)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert rest[:length].endswith(b"\r\n\r\n" + (b"" if revisit else payload))
    assert {r.target_uri for r in rows} >= {"http://a", None, "u%0D%0AX: y"}


def test_an_altered_payload_is_noticed(spark):
    path = warc.write_archive(pages(spark, PAGES[:2]), scratch_path(spark, "archive"))
    other = spark.read.parquet(f"{path}/payloads").selectExpr("payload_sha256", "cast('other' as binary) as payload").collect()
    spark.createDataFrame(other, "payload_sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="altered"):
        warc.read_archive(spark, path).collect()


def test_archive_of_nothing(spark):
    path = warc.write_archive(pages(spark, []), scratch_path(spark, "archive"))
    assert warc.read_archive(spark, path).count() == 0


def test_batches_are_small(spark):
    line_crf.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
