"""Divergence audit, rule ledger and collocations against brute force, and awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from frames import AWKWARD, LONG, SCHEMA, documents

from vigilflow.llm import collocations, divergence, rule_ledger


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    """``rows``: (doc_id, text, lang, source); the other columns bear clashing names."""
    return spark.createDataFrame([(i, t, lang, source, 1, 1, 2, 0.5, "x", 3, ["w"], "s", 4, "g", 1, "c", 5) for i, t, lang, source in rows], SCHEMA)


def random_rows(rng, n, words, langs=("en", None, ""), sources=("a", "b", "c", None, "é")):
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ". ", "\n", "\t", ", "]) for _ in range(rng.randint(0, 30)))
    return [(i, text(), rng.choice(langs), rng.choice(sources)) for i in range(n)]


# divergence


def plain_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for _, _, ws in own for w in set(ws))
        kept = {w for w, n in seen.items() if n >= least}
        counts = {s: Counter(w for _, s2, ws in own if s2 == s for w in ws if w in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        for s, c in counts.items():
            pairs = [(o, sum((share(c, w) - share(d, w)) ** 2 // share(d, w) for w in kept)) for o, d in counts.items() if o != s]
            words = [(w, (share(c, w) - share(whole, w)) ** 2 // share(whole, w)) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1)]
    return sorted(out)


def audited(docs, **options):
    return sorted(tuple(r) for r in divergence.audit(docs, **options).collect())


@pytest.mark.parametrize("postings,block", [(1, 256), (40, 2), (10**6, 1)])
def test_divergence_equals_brute_force(spark, postings, block):
    rng = random.Random(postings)
    rows = random_rows(rng, 80, ["Alpha", "beta", "gamma-delta", "é漢", "x1y", "12", "Straße", "BETA", "\U0001F600"])
    rows += [(200, "rare words only here", "solo", "a"), (201, None, "solo", "b"), (202, "", "lone", None), (203, rows[0][1], rows[0][2], rows[0][3])]
    found = audited(table(spark, rows), postings=postings, block=block)
    assert found == plain_audit(rows) and any(r[0] == "solo" and r[4] == 0 for r in found)


def test_divergence_ranks_terms_to_the_top(spark):
    rows = [(i, f"{'apple ' * (i + 1)} pear plum {'kiwi ' * (i % 3)}", "en", f"s{i % 4}") for i in range(12)]
    assert audited(table(spark, rows), top=1) == plain_audit(rows, top=1)


def test_divergence_of_awkward_rows(spark):
    assert audited(documents(spark, AWKWARD * 2)) == plain_audit([(i, t, "en", s) for i, t, s in AWKWARD * 2])
    assert divergence.audit(documents(spark, [])).count() == 0


def test_shares_beyond_64_bits():
    counts, total, size = np.array([0, 7, 4 * 10**13]), 5 * 10**13, 10**6
    assert divergence._shares(counts, total, size).tolist() == [1 + 10**9 * (int(c) + 1) // (total + size) for c in counts]


# rule ledger


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    upper = [w for w in words if len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z]|[^\x00-\x7f]", w)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_letter_words": sum(bool(re.search("[A-Za-z]|[^\x00-\x7f]", w)) for w in words), "n_upper_words": len(upper),
        "n_shouts": text.count("!!") + text.count("??"),
    }


def ledger_texts():
    rng = random.Random(4)
    bits = ["one two three four five six seven eight", "a b", "é漢\U0001F600", "SHOUT!!", "$$$ ###", "\n", "\n\n", "x\x0by\x0cz\r", "plain words stand here", "99 1", "??"]
    return [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["w " * 8, "w " * 9, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h"]


@pytest.mark.parametrize("together", [1, 1_000_000])
def test_measures_equal_brute_force(spark, together, monkeypatch):
    monkeypatch.setattr(rule_ledger, "TOGETHER", together)
    texts = ledger_texts()
    rows = {r.doc_id: r.asDict() for r in rule_ledger.ledger(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        expected = plain_measures(text)
        assert {m: rows[i][m] for m in expected} == expected, text
        failed = sum(1 << b for b, (_, rule) in enumerate(rule_ledger.RULES) if eval(rule.replace("=", "=="), {}, expected))  # noqa: S307  no rule holds an equals sign alone
        assert rows[i]["failed"] == failed


def test_policies_and_ablations(spark):
    texts = ledger_texts()
    rows = rule_ledger.ledger(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]))
    failed = [r.failed for r in rows.collect()]
    later = rule_ledger.Policy("standard", 2, ("few_words", "shouting"))
    policies = (rule_ledger.BASE, rule_ledger.STANDARD, later)
    found = {(r.policy, r.version, r.rule): (r.n_failed, r.n_alone, r.n_rejected, r.n_total) for r in rule_ledger.ablations(rows, policies).collect()}
    assert len(found) == sum(len(p.rules) for p in policies)
    for p in policies:
        for rule in p.rules:
            bit, here = rule_ledger.BIT[rule], [f & p.mask for f in failed]
            assert found[p.name, p.version, rule] == (sum(f & bit > 0 for f in here), sum(f == bit for f in here), sum(f > 0 for f in here), len(failed))
    verdicts = rule_ledger.verdicts(rows, later).collect()
    assert sum(r.kept for r in verdicts) == sum(not f & (later.mask | rule_ledger.BASE.mask) for f in failed)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in verdicts)


def test_clean_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in rule_ledger.verdicts(rule_ledger.ledger(docs)).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [rows[i] for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    bad = [rows[i] for i, q in labels.items() if q == 0]
    assert sum(r.kept for r in good) == len(good) and sum(r.kept for r in bad) < 0.25 * len(bad)


def test_ledger_of_awkward_rows(spark):
    found = rule_ledger.verdicts(rule_ledger.ledger(documents(spark, AWKWARD))).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in found) == sorted((str(i), plain_measures(t)["n_words"]) for i, t, _ in AWKWARD)
    by = {r.doc_id: r for r in found}
    assert by[2].base_failed and not by[2].kept and by[5].n_words == 40_000 and by[5].base_failed  # its words repeat
    assert rule_ledger.ledger(documents(spark, [])).count() == rule_ledger.ablations(rule_ledger.ledger(documents(spark, []))).count() == 0


# collocations


def plain_collocations(rows, least, longest=5, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for n in range(1, min(longest, len(words) - i) + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = [p for p, n in f.items() if len(p) > 1 and n >= least]
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p in candidates:
            if any(len(q) > len(p) and 100 * f[q] >= 100 * f[p] and inside(p, q) for q in candidates):
                continue
            score, k = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, f[p], " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, totals[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def collocated(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


PHRASES = ["New York", "new york city", "the", "of the", "in case of need", "é漢 x", "a", "tab\there", "rare", "one two three four five six seven"]


@pytest.mark.parametrize("together,remembered,bits", [(2_000_000, 300_000, 1 << 22), (50, 10, 8)])
def test_collocations_equal_brute_force(spark, together, remembered, bits, monkeypatch):
    for name, value in (("TOGETHER", together), ("REMEMBERED", remembered)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.frequent_filter, "__defaults__", (bits,))
    rng = random.Random(together)
    rows = random_rows(rng, 300, PHRASES + [f"w{i}" for i in range(60)], langs=("en", None, "und", "de"))
    found = collocated(table(spark, rows), least=12)
    assert found == plain_collocations(rows, 12) and len(found) > 20 and {r[0] for r in found} == {"en", "und", "de"}
    assert collocated(table(spark, rows), least=12, top=3) == plain_collocations(rows, 12, top=3)


@pytest.mark.parametrize("overfull", [40, 400])
def test_overfull_buckets_are_parted(spark, overfull):
    """One pair of words leads most suffixes: its bucket is parted by the words behind, down to whole suffixes."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"new york {rng.choice('abcdefgh')} {rng.choice('ijkl')}{rng.randrange(3)}" for _ in range(12)), "en", "s") for i in range(120)]
    docs = table(spark, rows)
    counted = collocations.word_counts(docs)
    found = {(r.lang, r.phrase, r["size"]): r.n for r in collocations.phrase_counts(docs, counted, 5, overfull=overfull).collect()}
    expected = Counter()
    for _, text, _, _ in rows:
        words = text.split()
        expected.update(("en", " ".join(words[i : i + n]), n) for i in range(len(words)) for n in range(2, 6) if i + n <= len(words))
    assert found == {p: n for p, n in expected.items() if n >= 5}


def test_the_sort_counts_prefixes_and_abandons_rare_ones():
    rows = np.array([[0, 1, 2], [0, 1, -1], [0, 3, 1], [2, 1, 0], [0, 1, 2]], np.int32)
    counts = np.array([1, 5, 2, 3, 1])
    found = lambda least, whole: sorted((tuple(rows[r, :size].tolist()), n) for r, size, n in collocations.sorted_counts(rows, counts, least, whole))
    assert found(3, 2) == [((0, 1), 7), ((2, 1), 3), ((2, 1, 0), 3)]
    assert found(3, 3) == [((0, 1), 7), ((0, 3), 2), ((2, 1), 3), ((2, 1, 0), 3)]  # pairs may have their rest elsewhere


def test_counts_beyond_32_bits_travel():
    rows, counts = np.array([[0, 1, -1], [1, 0, 1]]), np.array([5, (7 << 32) + 3])
    ((_, _, n, listed, coded),) = collocations._blocks("en", np.array([b"x", b"y"], object), rows, counts, np.array([4, 4]))
    own, often = collocations._opened(n, coded, 3)
    assert [[listed[i] if i >= 0 else None for i in r] for r in own] == [[b"x", b"y", None], [b"y", b"x", b"y"]] and often.tolist() == counts.tolist()
    found = collocations.count_bucket(pa.table({"lang": ["en"], "rows": [n], "words": [listed], "coded": [coded]}), 1, 2, 3)
    assert (7 << 32) + 3 in found.column("n").to_pylist()


def test_collocations_of_awkward_rows(spark):
    rows = [(i, t, "en", s) for i, t, s in AWKWARD * 3]
    assert collocated(documents(spark, AWKWARD * 3), least=3) == plain_collocations(rows, 3)
    assert LONG.split()[1] == "word1" and collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, AWKWARD), least=10**6).count() == 0
