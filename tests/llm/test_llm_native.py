"""Secret links, line spread, licences and spaced seeds against brute force, and awkward rows."""

import random
import re

import pytest
from frames import AWKWARD, LONG, document, documents

from vigilflow.llm import common, licenses, line_spread, queries, secret_links, spaced_seeds


def spans(text, scope=secret_links.SCOPE):
    """All spans by Python's regular expressions and a comparison of all pairs."""
    kinds = secret_links.KINDS
    found = []
    for i, k in enumerate(kinds):
        for m in re.finditer(k.pattern.replace("(?i:", "(?i:"), text):
            value = m.group(k.value)
            if k.least <= len(value) <= k.most and all(re.search(h, value) for h in k.holds):
                found.append((m.start(), i, k.name, m.end()))
    near = lambda s, role: any(kinds[p[1]].role == role and abs(p[0] - s[0]) <= scope for p in found)
    return sorted(s for s in found if kinds[s[1]].strong or all(near(s, r) for r in secret_links.COMPLEMENT[kinds[s[1]].role]))


def test_spans_equal_brute_force(spark):
    rng = random.Random(5)
    bits = [
        "password=hunter22", "token : abc", "token=secret=abcdefgh", "token=token:abcdef", "API_KEY = 'zzzzzzzz'", "AKIA" + "A1" * 8, "AKIASHORT",
        "AKIAAKIA" + "B" * 12, "0123456789abcdef01234567", "deadbeef", "bob.smith@mail.example.com", "10.0.0.12:8080", "https://host/x?y=1", "é漢\U0001F600",
        "user=alice", "aB3" + "x/Y9+" * 7 + "Zq", "login : carol", "x" * 150, "y " * 90, "\n",
    ]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_links.scan(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == spans(text), text


def test_spans_of_awkward_rows(spark):
    found = secret_links.digest(secret_links.scan(documents(spark, [*AWKWARD, (8, "password=aaaaaa " * 3000, "a")]))).collect()
    assert len(found) == len(AWKWARD) + 1
    by = {r.doc_id: r for r in found}
    assert by[8].n_assign == 3000 and by[8].spans.startswith("assign:0:15,assign:16:31") and by[1].spans == ""
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert by[2].base_sha256 == by[3].base_sha256 == empty
    assert secret_links.scan(documents(spark, [])).count() == 0


def test_long_runs_of_every_pattern(spark):
    """A megabyte of each unit: searched whole, with the spans of Python's regular expressions."""
    units = [".a", "a@", "@a.b", "9", "1.", "\"'", "password ", "token=", "https://", "a.b@c.d,", "AKIA", "f", "aA1+", "password=abcdef "]
    texts = ["x@a" + ".a" * 500_000, *(u * (1_000_000 // len(u)) for u in units)]
    rows = secret_links.scan(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(8)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        for i, k in enumerate(secret_links.KINDS):
            if k.strong:
                whole = [(m.start(), m.end()) for m in re.finditer(k.pattern, texts[r.doc_id]) if len(m.group(k.value)) >= k.least]
                assert [(s.start, s.end) for s in r.spans if s.kind == i] == whole


BLANKS = " \t\r\f\v"


def boilerplate(rows, least):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(BLANKS) and site is not None:
                sites.setdefault(line.strip(BLANKS), set()).add(site)
    return {line for line, s in sites.items() if len(s) >= least}


@pytest.mark.parametrize("least", [1, 2, 10])
def test_line_spread_equals_brute_force(spark, least):
    rng = random.Random(least)
    lines = [f"line {i}" for i in range(30)] + ["", "  padded", "padded  ", "padded\r", "\tpadded \r", "\r", "\t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))), rng.choice([*"abcdefghijklmnop", None])) for i in range(200)]
    gone = boilerplate(rows, least)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_spread.remove_spread_lines(documents(spark, rows), least).collect()}
    for i, text, _ in rows:
        kept = [line for line in text.split("\n") if line.strip(BLANKS) not in gone]
        assert got[i] == (text.count("\n") + 1, text.count("\n") + 1 - len(kept), "\n".join(kept))


def test_line_spread_far_above_and_near_the_threshold(spark):
    """A coarse sketch errs; lines near the threshold are right all the same, for they are counted."""
    rows = [(100 * k + s, f"line {k}", f"site{s}") for k in range(40, 61) for s in range(k)]
    found = line_spread.spread_lines(documents(spark, rows), 50, lg_k=7, margin=0.6)
    assert found.count() == 11


def test_line_spread_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    found = line_spread.remove_spread_lines(docs, 2, carry=("lang", "carried", "t1")).collect()
    assert len(found) == len(AWKWARD)
    texts = {r.doc_id: r.text for r in found if r.doc_id}
    assert texts[1] == "The quick brown fox jumps over the lazy dog."  # its second line stands on two sites
    assert texts[2] == texts[3] == "" and texts[4] == "   \n\n " and texts[5] == LONG
    assert {(r.carried.lang, r.carried.carried, r.carried.t1) for r in found} == {("en", "c", 4)}
    assert line_spread.remove_spread_lines(docs.limit(0), 2).count() == 0


FILES = [
    (1, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (2, "a/b/c/d.py", "import os"),
    (3, "a/LICENSE", "Released under the MIT License."),
    (4, "a/x.py", "print()"),
    (5, "a/b/own.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"),
    (6, "z/q.py", "nothing"),
    (7, "a/bb/x.py", "not below a/b"),
    (8, None, "no path"),
    (9, "a/n.py", None),
    (None, "a/b/null.py", "x"),
    (10, "a/COPYING", "Licensed under CC BY-NC 4.0. and a lot of other words that make it less near"),
    (11, "top.py", "x"),
    (4, "a/x.py", "print()"),
]


def test_licenses_inherit_from_the_nearest_directory(spark):
    files = spark.createDataFrame([(*f, 1, "x") for f in FILES], "doc_id long, path string, text string, row long, license string")
    rows = licenses.scan(files).collect()
    assert len(rows) == len(FILES)
    by = {r.doc_id: r for r in rows}
    assert [by[i].license for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11)] == ["Apache-2.0", "Apache-2.0", "MIT", "MIT", "GPL-3.0", None, "MIT", None, "MIT", None]
    assert by[2].license_directory == "a/b" and by[7].license_directory == "a" and by[1].license_directory is None and by[None].license == "Apache-2.0"
    assert licenses.scan(files.limit(0)).count() == 0


def test_license_ties_go_to_the_first_name(spark):
    files = spark.createDataFrame([(1, "x", "same words licensed")], "doc_id long, path string, text string")
    found = licenses.scan(files, templates={"B": ("same words licensed",), "A": ("same words licensed",)}).first()
    assert (found.own_license, found.own_cosine) == ("A", 1.0)


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def overlaps(docs, items):
    """Every diagonal with a seed hit, and its first best window."""
    out = set()
    for d, text in docs:
        a = tokens(text)
        for b, item in {(i, tuple(tokens(t))) for i, t in items}:
            for g in range(-len(item), len(a)):
                hit = any(
                    all(0 <= i + k + g < len(a) and a[i + k + g] == item[i + k] for k, c in enumerate(mask) if c == "1") and 0 <= i + g and i + g + len(mask) <= len(a)
                    for mask in spaced_seeds.MASKS
                    for i in range(len(item) - len(mask) + 1)
                )
                if not hit:
                    continue
                equal = [int(0 <= i + g < len(a) and a[i + g] == w) for i, w in enumerate(item)]
                wide = min(spaced_seeds.WINDOW, len(item))
                sums = [sum(equal[s : s + wide]) for s in range(len(item) - wide + 1)]
                best = max(sums)
                if best >= wide * spaced_seeds.SHARE:
                    out.add((d, b, g + sums.index(best), sums.index(best), wide, best))
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 16, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (50, items[4][1]), (51, ""), (52, None), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    docs = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(40)]
        if i % 2:
            copy = tokens(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randrange(30)
            words[at : at + len(copy)] = copy
        docs.append((i, (" " if i % 3 else "\n*** ").join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(90, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (91, None), (92, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in spaced_seeds.overlaps(documents(spark, docs), table).collect()}
    assert got == overlaps(docs, items) and len(got) > 12


def test_overlaps_of_awkward_rows_and_without_broadcast(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [*AWKWARD, (20, LONG + " " + item, "a"), (21, item, "b"), (None, item, "c")]
    table = spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string")
    expected = {(20, 1), (21, 1), (None, 1)}
    assert {(r.doc_id, r.item_id) for r in spaced_seeds.overlaps(documents(spark, rows), table).collect()} == expected
    monkeypatch.setattr(spaced_seeds, "lookup", lambda frame: frame)
    assert {(r.doc_id, r.item_id) for r in spaced_seeds.overlaps(documents(spark, rows), table).collect()} == expected
    assert spaced_seeds.contaminated(documents(spark, rows), table.limit(0)).count() == 0
    assert spaced_seeds.contaminated(documents(spark, []), table).count() == 0


def test_masks_are_checked(spark):
    with pytest.raises(ValueError):
        spaced_seeds.overlaps(documents(spark, []), spark.createDataFrame([], "item_id long, text string"), masks=("0110",))


def test_native_queries_run_no_python(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("op2_secret_links", "op3_line_spread", "op4_licenses", "op8_spaced_seeds", "op10_warc"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    mixed = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    edges = chain + star + mixed + [(5, 5), (None, 3), (7, 6), (7, 6)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_document_helper_has_all_columns():
    assert len(document(1, "x")) == 17
