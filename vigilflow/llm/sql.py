"""The registered queries as DuckDB SQL, where SQL can express them.

These are plain statements of the results: exact counts in place of sketches, all
spans of a document compared with each other, word tuples in place of hashes.
"""

from __future__ import annotations

from vigilflow.llm.licenses import COSINE, CUE, FILE_NAME, TEMPLATES
from vigilflow.llm.secret_links import SCOPE
from vigilflow.llm.spaced_seeds import MASKS, SHARE, WINDOW

#: kind, pattern, value group, least and greatest length of the value, further patterns, role; in the order of kinds
_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, 1 << 30, (), "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 1 << 30, (), "identifier"),
    ("hex", r"[0-9a-f]+", 0, 24, 1 << 30, (), "secret"),
    ("account", r"""(?i:(user|username|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3, 1 << 30, (), "identifier"),
    ("email", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, 0, 1 << 30, (), "identifier"),
    ("key40", r"[A-Za-z0-9+/]+", 0, 40, 40, ("[A-Z]", "[a-z]", "[0-9+/]"), "secret"),
    ("url", r"""https?://[^\s"'<>]+""", 0, 0, 1 << 30, (), "endpoint"),
    ("host", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?", 0, 0, 1 << 30, (), "endpoint"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, regexp_extract_all(text, {_quoted(p)}, 0) AS m, regexp_extract_all(text, {_quoted(p)}, {g}) AS v, "
        f"string_split_regex(text, {_quoted(p)}) AS gaps, {a} AS least, {b} AS most FROM d"
        for i, (_, p, g, a, b, _, _) in enumerate(_KINDS)
    )
    holds = " AND ".join(f"(kind <> {i} OR regexp_matches(v, {_quoted(h)}))" for i, k in enumerate(_KINDS) for h in k[5])
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k[0]}'" for i, k in enumerate(_KINDS)) + " END"
    roles = "CASE kind " + " ".join(f"WHEN {i} THEN '{k[6]}'" for i, k in enumerate(_KINDS)) + " END"
    near = lambda role: f"EXISTS (SELECT 1 FROM s p WHERE p.doc_id = s.doc_id AND p.role = '{role}' AND abs(p.start - s.start) <= {SCOPE})"
    text = "name || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT doc_id, kind, least, most, m, gaps, v AS vs, unnest(range(1, len(m) + 1)) AS k FROM found WHERE len(m) > 0),
placed AS (
  SELECT doc_id, kind, vs[k] AS v, least, most, length(m[k]) AS n,
    list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
  FROM each),
s AS (
  SELECT doc_id, kind, {names} AS name, {roles} AS role, start::BIGINT AS start, (start + n)::BIGINT AS stop
  FROM placed WHERE length(v) BETWEEN least AND most AND {holds}),
reported AS (
  SELECT * FROM s WHERE kind < 3
    OR role = 'identifier' AND {near('secret')} OR role = 'secret' AND {near('identifier')}
    OR role = 'endpoint' AND {near('identifier')} AND {near('secret')}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg({text}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({text}, ',' ORDER BY start, kind) AS spans
  FROM reported GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""


_LINES = """
WITH each AS (
  SELECT doc_id, source, ' ' || chr(9) || chr(11) || chr(12) || chr(13) AS b, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
spread AS (SELECT trim(line, b) AS line FROM each WHERE trim(line, b) <> '' GROUP BY trim(line, b) HAVING count(DISTINCT source) >= 10),
marked AS (SELECT doc_id, line, i, trim(line, b) IN (SELECT line FROM spread) AS gone FROM each)
SELECT doc_id, count(*)::INTEGER AS n_lines, (count(*) FILTER (gone))::INTEGER AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id"""


def _license_sql() -> str:
    templates = ", ".join(f"({_quoted(k)}, {i}, {_quoted(t)})" for k, ts in TEMPLATES.items() for i, t in enumerate(ts))
    terms = lambda text: f"unnest(list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: t <> ''))"
    return f"""
WITH f AS (
  SELECT doc_id, coalesce(text, '') AS text,
    CASE WHEN doc_id % 1000 = 0 THEN concat_ws('/', source, 'LICENSE.' || doc_id)
      WHEN doc_id % 100 = 0 THEN concat_ws('/', source, (doc_id // 1000)::VARCHAR, 'LICENSE')
      WHEN doc_id % 10 = 0 THEN concat_ws('/', source, (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR, 'LICENSE')
      ELSE concat_ws('/', source, (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR, doc_id || '.txt') END AS path
  FROM documents),
files AS (
  SELECT doc_id, path, text, array_to_string(string_split(path, '/')[:-2], '/') AS directory,
    regexp_matches(string_split(path, '/')[-1], {_quoted(FILE_NAME)}) AS is_file FROM f),
cued AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS p FROM files),
places AS (
  SELECT doc_id, p FROM cued WHERE regexp_matches(p, {_quoted(CUE)})
  UNION SELECT doc_id, trim(text) FROM files WHERE is_file AND trim(text) <> ''),
passages AS (SELECT p, count(*) AS n FROM places GROUP BY p),
tf AS (SELECT p, n, term, count(*) AS tf FROM (SELECT p, n, {terms('p')} AS term FROM passages) GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) AS total FROM passages),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY term),
w AS (SELECT p, term, tf * (ln((1 + total) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), total),
t AS (SELECT * FROM (VALUES {templates}) AS x(license, variant, text)),
mtf AS (SELECT license, variant, term, count(*) AS tf FROM (SELECT license, variant, {terms('text')} AS term FROM t) GROUP BY ALL),
v AS (SELECT license, variant, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS v FROM mtf LEFT JOIN df USING (term), total),
vn AS (SELECT license, variant, sqrt(sum(v * v)) AS length FROM v GROUP BY ALL),
wn AS (SELECT p, sqrt(sum(w * w)) AS norm FROM w GROUP BY p),
dots AS (SELECT p, license, variant, sum(w * v) AS dot FROM w JOIN v USING (term) GROUP BY ALL),
near AS (SELECT p, license, round(dot / (norm * length), 6) AS cosine FROM dots JOIN wn USING (p) JOIN vn USING (license, variant)),
own AS (
  SELECT doc_id, license AS own_license, cosine AS own_cosine FROM places JOIN near USING (p) WHERE cosine >= {COSINE}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
judged AS (SELECT doc_id, path, directory, is_file, own_license, own_cosine FROM files LEFT JOIN own USING (doc_id)),
licensed AS (
  SELECT directory AS above, own_license AS license FROM judged WHERE is_file AND own_license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY own_cosine DESC, doc_id) = 1),
inherited AS (
  SELECT directory, license, above FROM (SELECT DISTINCT directory FROM judged)
  JOIN licensed ON directory = above OR above = '' OR starts_with(directory, above || '/')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, own_license, own_cosine, coalesce(own_license, license) AS license,
  CASE WHEN own_license IS NULL THEN above END AS license_directory
FROM judged LEFT JOIN inherited USING (directory)"""


def _seed_sql() -> str:
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

    def seeds(table: str, key: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, i, {n} AS mask, concat_ws(' ', {', '.join(f'w[i + {k + 1}]' for k, c in enumerate(mask) if c == '1')}) AS seed "
            f"FROM (SELECT {key}, w, unnest(range(len(w) - {len(mask) - 1})) AS i FROM {table})"
            for n, mask in enumerate(MASKS)
        )

    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
ds AS ({seeds('d', 'doc_id')}), bs AS ({seeds('b', 'item_id')}),
diagonals AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS g FROM ds JOIN bs USING (mask, seed)),
aligned AS (
  SELECT doc_id, item_id, g, least({WINDOW}, len(b.w)) AS wide,
    list_transform(range(len(b.w)), lambda i: CASE WHEN i + g >= 0 AND d.w[i + g + 1] = b.w[i + 1] THEN 1 ELSE 0 END) AS equal
  FROM diagonals JOIN d USING (doc_id) JOIN b USING (item_id)),
counted AS (
  SELECT *, list_transform(range(len(equal) - wide + 1), lambda s: list_sum(equal[s + 1:s + wide])) AS counts FROM aligned)
SELECT DISTINCT doc_id, item_id, (g + list_position(counts, list_max(counts)) - 1)::BIGINT AS doc_start,
  (list_position(counts, list_max(counts)) - 1)::BIGINT AS item_start, wide::BIGINT AS words, list_max(counts)::BIGINT AS matches
FROM counted WHERE list_max(counts) >= wide * {SHARE}"""


_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a AS node, a AS low FROM links UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node),
named AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
counted AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(low, e.vec_id) AS component_id, coalesce(low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN named ON named.node = e.vec_id LEFT JOIN counted ON counted.node = e.vec_id"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  translate(array_to_string(list_transform(range(8), lambda i: to_base(('0x' || substr(d, (1 + 5 * i)::INTEGER, 5))::BIGINT, 32, 4)), ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM r"""


_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
t AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(c) AS total FROM seen GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(sums.total, 0) + sizes.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 1)) // (sizes.total + sizes.v)::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN sums USING (lang, source) LEFT JOIN seen ON seen.lang = g.lang AND seen.source = g.source AND seen.term = kept.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM cells WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
windows AS (SELECT row, i, array_to_string(w[i:i + 7], ' ') AS key FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, key) > 1),
repeats AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) AS r(k) GROUP BY row),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, list_sum([length(x) for x in w])::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len([x for x in w if regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS letters,
    len([x for x in w if regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]|[^\x00-\x7F]')]) AS upper,
    len(regexp_extract_all(text, '!!')) + len(regexp_extract_all(text, '\?\?')) AS shouts
  FROM d LEFT JOIN lines USING (row) LEFT JOIN repeats USING (row)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR letters * 100 < 50 * n_words OR upper * 100 > 30 * n_words OR shouts * 10 > n_words) AS kept
FROM b"""


_COLLOCATIONS = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a FROM f WHERE size > 1 AND f >= 100),
cut AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT cut.lang, cut.size, cut.phrase, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN totals ON totals.lang = cut.lang
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
alone AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = b.lang AND o.size > b.size AND 100 * o.a >= 100 * b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM alone QUALIFY rank <= 2000"""

ORACLES: dict[str, str] = {
    "op2_secret_links": _secret_sql(),
    "op3_line_spread": _LINES,
    "op4_licenses": _license_sql(),
    "op7_pivot_index": _VECTORS,
    "op8_spaced_seeds": _seed_sql(),
    "op10_warc": _WARC,
    "op11_divergence": _DIVERGENCE,
    "op12_rule_ledger": _LEDGER,
    "op13_collocations": _COLLOCATIONS,
}
