"""Secrets in texts, and multipart credentials linked by interval joins.

Three kinds of strong spans are reported wherever they stand.  Weak candidates
(account names, unlabelled key-like tokens, endpoints) are reported only when the
complementary parts of a credential stand within the same scope: they start at
most ``scope`` code points before or after the candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow.llm.common import texts_of
from vigilflow.session import settle


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, the group that is its value, the value's least length, and what else the match must hold."""

    name: str
    pattern: str
    role: str
    strong: bool
    value: int = 0
    least: int = 0
    most: int = 1 << 30
    holds: tuple[str, ...] = ()


#: The strong kinds in the order in which kinds are listed.  A match of ``AKIA[A-Z0-9]+`` or
#: ``[0-9a-f]+`` is a whole run, so asking for the least length within the pattern finds the same spans.
STRONG = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", True, 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "identifier", True),
    Kind("hex", r"[0-9a-f]{24,}", "secret", True),
)
#: Weak candidates.  Possessive runs that begin where the run begins keep the e-mail pattern linear on long texts, and a
#: possessive group keeps Java's stack flat: a greedy one recurses once per repeat.
WEAK = (
    Kind("account", r"""(?i:(user|username|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", "identifier", False, 2, 3),
    Kind("email", r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "identifier", False),
    Kind("key40", r"[A-Za-z0-9+/]{40,}", "secret", False, 0, 40, 40, ("[A-Z]", "[a-z]", "[0-9+/]")),
    Kind("url", r"""https?://[^\s"'<>]+""", "endpoint", False),
    Kind("host", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?", "endpoint", False),
)
KINDS = STRONG + WEAK
#: Roles that must stand within the scope of a weak candidate of a role.
COMPLEMENT = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
#: Code points between the starts of a weak candidate and of its complementary parts, at most.
SCOPE = 200

_PART = "struct<gap:int,n:int,ok:boolean>"


def _parts(kind: Kind) -> Column:
    """Per match of a kind, in order: code points since the match before, length, and whether the match counts."""
    pattern, whole = F.lit(kind.pattern), F.col(f"m_{kind.name}")
    value = F.regexp_extract_all("text", pattern, F.lit(kind.value)) if kind.value else whole
    gaps = F.transform(F.split("text", kind.pattern, -1), F.length)
    # put side by side before they are looked through: within the function of each match they would be made anew for it
    zipped = F.slice(F.arrays_zip(whole.alias("match"), value.alias("held"), gaps.alias("gap")), F.lit(1), F.size(whole))

    def part(m: Column) -> Column:
        ok = F.length(m["held"]).between(kind.least, kind.most)
        for pattern in kind.holds:
            ok = ok & F.regexp(m["held"], F.lit(pattern))
        return F.struct(m["gap"].alias("gap"), F.length(m["match"]).alias("n"), ok.alias("ok"))

    return F.when(F.size(whole) > 0, F.transform(zipped, part).cast(f"array<{_PART}>")).otherwise(F.array().cast(f"array<{_PART}>"))


def _spans(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id)`` for every row, and ``(row, kind, start, end)`` for every span.

    Texts are searched where they are read; only lengths of matches and of the
    gaps between them go on, as a written table, so ``row`` is fixed from there.
    """
    texts = texts_of(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id())
    matched = texts.select("*", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"m_{k.name}") for k in KINDS])
    found = settle(matched.select("row", "doc_id", F.array(*[_parts(k) for k in KINDS]).alias("kinds")), "spans")
    each = found.select("row", F.posexplode("kinds").alias("kind", "parts")).select("row", "kind", F.posexplode("parts").alias("i", "part"))
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("row", "kind", "part.ok", "part.n", F.sum(F.col("part.gap") + F.col("part.n")).over(so_far).alias("end"))
    spans = placed.filter("ok").select("row", "kind", (F.col("end") - F.col("n")).alias("start"), "end")
    return found.select("row", "doc_id"), spans


def _of_role(role: str) -> Column:
    return F.col("kind").isin([i for i, k in enumerate(KINDS) if k.role == role])


def link(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans that have the parts they need within ``scope``.

    An interval join without pairs: parts are reduced to the first and last start
    per row, role and stretch of ``scope`` code points.  A part in a candidate's
    own stretch is always near enough, one in the stretch before if the last
    start there is, one in the stretch after if the first start there is.
    """
    weak = F.col("kind") >= len(STRONG)
    role = F.coalesce(*[F.when(_of_role(r), F.lit(r)) for r in COMPLEMENT])
    stretch = F.floor(F.col("start") / scope).cast("long")
    parts = spans.groupBy("row", role.alias("role"), stretch.alias("stretch")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.coalesce(*[F.when(_of_role(r), F.array(*map(F.lit, needed))) for r, needed in COMPLEMENT.items()])
    asked = (
        spans.filter(weak)
        .select("*", F.explode(needs).alias("role"), stretch.alias("own"))
        .select("*", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("stretch"))
    )
    near = (F.col("first") <= F.col("start") + scope) & (F.col("last") >= F.col("start") - scope)
    met = asked.join(parts, ["row", "role", "stretch"]).filter(near)
    needed = F.coalesce(*[F.when(_of_role(r), F.lit(len(n))) for r, n in COMPLEMENT.items()])
    return (
        met.groupBy("row", "kind", "start", "end").agg(F.countDistinct("role").alias("roles"))
        .filter(F.col("roles") == needed).select("row", "kind", "start", "end")
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans`` for every row; spans: ``array<struct<start, kind, name, end>>`` by start, then kind as listed.

    Positions are code points, the end exclusive.  Of each kind the leftmost
    non-overlapping matches count; spans of different kinds may overlap.  A null or
    empty text has no spans.  Rows with a null or repeated id are judged each for
    itself.  Texts of any length are searched whole.  Other columns are not
    read.  No rows: no rows.
    """
    rows, spans = _spans(docs, id_column, text_column)
    spans = settle(spans, "spans")
    reported = spans.filter(F.col("kind") < len(STRONG)).unionByName(link(spans, scope))
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    listed = reported.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "kind", name.alias("name"), F.col("end").cast("long").alias("end")))).alias("spans")
    )
    empty = F.array().cast("array<struct<start:long,kind:int,name:string,end:long>>")
    return rows.join(listed, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query from those of ``scan``: counts and hash of the strong spans, all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    strong = F.filter("spans", lambda s: s["kind"] < len(STRONG))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k.name}") for i, k in enumerate(STRONG)],
        F.sha2(as_text(strong).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
