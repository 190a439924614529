"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, record headers are kept
exactly and apart from them, and joins put the original records together again.

An archive is a folder with two Parquet tables:

``payloads``  payload_sha256, payload
``headers``   record_id, warc_header, http_header, payload_sha256, has_payload

A record is ``warc_header + http_header + payload + CRLF CRLF``; a revisit record
has no payload of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilflow.llm.common import lookup
from vigilflow.session import settle

CRLF = "\r\n"
#: Digits of base 32 as numbers are written and as RFC 4648 writes them.
DIGITS, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, RFC4648)


def plan_records(pages: DataFrame, id_column: str, url_column: str, payload_column: str, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """One lean row per page (digests, size, record type, response referred to), and the pages' payloads with their SHA-256."""
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"),
    )
    lean = rows.select(
        "page_id", "url",
        F.sha2("payload", 256).alias("payload_sha256"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
    )
    # only payloads that occur again need a look-up; one row for each of them
    newest = lean.groupBy("payload_sha256").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    newest = lookup(settle(newest, "newest"))
    again = F.col("again") & ~F.col("page_id").eqNullSafe(F.col("response_id")) & (F.col("payload_bytes") >= least_bytes)
    records = lean.join(newest.withColumn("again", F.lit(True)), "payload_sha256", "left").withColumn(
        "record_type", F.when(again, "revisit").otherwise("response")
    )
    return records, rows.select(F.sha2("payload", 256).alias("payload_sha256"), "payload")


def _urn(column: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))


def _headers(date: str) -> tuple[Column, Column]:
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2)
    )
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    # a line break inside a URL would end its header line
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _urn("response_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)), http


def write_archive(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Writes a record for every row; returns ``path``.

    Of the rows with equal payloads of at least ``least_bytes`` bytes the one with
    the largest id is the response, the others are revisits of it; smaller
    payloads are all responses, but their bytes too are stored once.

    A null payload is an empty one; a null URL leaves out WARC-Target-URI.  Rows
    without id are responses only among themselves.  A row repeated with its id
    and payload gives a record each, of the same type.  Other columns are not
    read.  No rows: two empty tables.

    Equal SHA-256 stand for equal bytes only after a check of length and of a
    second, unrelated hash of all payloads that meet in a store row.
    """
    records, payloads = plan_records(pages, id_column, url_column, payload_column, least_bytes)
    warc, http = _headers(date)
    records.select(
        F.col("page_id").alias("record_id"), warc.cast("binary").alias("warc_header"), http.cast("binary").alias("http_header"),
        "payload_sha256", (F.col("record_type") == "response").alias("has_payload"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    size, other = F.length("payload"), F.xxhash64("payload")
    once = payloads.groupBy("payload_sha256").agg(
        F.first("payload").alias("payload"),
        ((F.min(size) == F.max(size)) & (F.min(other) == F.max(other))).alias("same"),
    )
    checked = F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads with one SHA-256")).cast("binary"))
    once.select("payload_sha256", checked.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records, put together by a join of headers and payloads.

    Columns: record_id, record_type, refers_to (id), target_uri, payload (of the
    response that a revisit refers to, too), payload_bytes, payload_digest (both
    taken from the stored bytes), record (the record's exact bytes).

    A stored payload whose bytes do not give its SHA-256, a header whose digest
    is not that of its payload and a header without payload raise an error.
    """
    payloads = spark.read.schema("payload_sha256 string, payload binary").parquet(f"{path}/payloads")
    headers = spark.read.schema(
        "record_id long, warc_header binary, http_header binary, payload_sha256 string, has_payload boolean"
    ).parquet(f"{path}/headers")
    sound = F.sha2("payload", 256) == F.col("payload_sha256")
    stored = payloads.select(
        "payload_sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, sha1_base32(F.col("payload"))).otherwise(F.raise_error(F.lit("a stored payload was altered")).cast("string")).alias("payload_digest"),
    )
    text = F.col("warc_header").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    told = field("WARC-Payload-Digest")
    right = F.concat(F.lit("sha1:"), F.col("payload_digest")) == told
    joined = headers.join(stored, "payload_sha256", "left")
    return joined.select(
        "record_id",
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), r"urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        "payload", "payload_bytes",
        F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header does not fit its payload")).cast("string")).alias("payload_digest"),
        F.concat("warc_header", "http_header", F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"),
    )
