"""WARC: content-addressed archive of web pages.

The archive is two tables in shared storage.  ``payloads`` holds each payload's
bytes once under its SHA-256, the strong digest that is verified whenever a
record is rebuilt.  ``headers`` holds the exact bytes of every record before its
payload: the WARC header block and, for a response, the HTTP header block.  A
response is rebuilt by joining its header with its payload; a revisit carries no
payload, as the format has it.

All copies of a payload meet in one aggregation that combines before it shuffles,
so a payload that a third of the pages has travels once a task.  Its pages are
told their response by a join in which digests of very many pages are broadcast.

Defined cases: a null html is an empty payload.  Among records with equal
payloads of at least ``least`` bytes the smallest page_id is the response and the
others are revisits of it; rows that share that smallest id are all responses.
A null page_id ranks after all others; if a payload has no other id, its records
are responses.  A null url gives a header without WARC-Target-URI.  CR and LF in
a url are percent-encoded in the header.  Rows that repeat a page_id with
another url or payload have record ids of their own.  Empty tables make an empty archive.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, shared_dir, table

#: WARC-Date where the caller gives none: the pages table has no times of its own.
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class Archive(NamedTuple):
    payloads: DataFrame
    headers: DataFrame


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five of them make four letters."""
    letters = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(hexadecimal, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page_id: Column, digest: Column, url: Column) -> Column:
    """A name for the record, the same in every run: a version-8 UUID of the page's id, url and payload."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), digest, F.coalesce(url, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-8"), h.substr(14, 3), F.lit("-a"), h.substr(18, 3), F.lit("-"), h.substr(21, 12), F.lit(">"))


def _header(date: str) -> Column:
    """What stands before the payload: the WARC header block and, in a response, the HTTP header block."""
    crlf = "\r\n"
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(crlf)), F.lit(""))
    length = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), length, F.lit(crlf + crlf))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(0).cast("long")).otherwise(F.length(http) + F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("digest"), F.col("first_url")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        line("X-Payload-Length", length),
        line("Content-Length", block.cast("string")),
        F.lit(crlf),
        F.when(revisit, F.lit("")).otherwise(http),
    ).cast("binary")


def write_archive(pages: DataFrame, least: int = 0, date: str = DATE) -> str:
    """Write ``pages`` (page_id, url, html) as an archive; its folder is returned.

    ``date`` is the WARC-Date of all records, in the format of RFC 3339.
    """
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    bytes_of = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Partial aggregation leaves a hot payload one row a task before the shuffle.
    first = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), F.col("page_id"), F.coalesce("url", F.lit("")).alias("url")))
    once = bytes_of.groupBy("digest").agg(first.alias("first"), F.count("*").alias("pages"), F.first("payload").alias("payload"))
    once = once.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "pages", base32(F.sha1("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    once.write.option("compression", "zstd").parquet(f"{at}/payloads")

    firsts = spark.read.parquet(f"{at}/payloads").drop("payload")
    narrow = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"))
    n = firsts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    typed = join_skewed(narrow, firsts, "digest", "pages", n)
    repeat = (F.col("payload_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = typed.withColumn("record_type", F.when(repeat, "revisit").otherwise("response")).withColumn("refers_to", F.when(repeat, F.col("first_id")))
    typed.select("page_id", "url", "digest", "record_type", _header(date).alias("header")).write.parquet(f"{at}/headers")
    return at


def read_archive(spark: SparkSession, at: str) -> Archive:
    return Archive(spark.read.parquet(f"{at}/payloads"), spark.read.parquet(f"{at}/headers"))


def verified(archive: Archive) -> DataFrame:
    """(digest, payload) of the stored payloads; one whose bytes do not give its digest fails the job."""
    good = F.sha2("payload", 256) == F.col("digest")
    digest = F.when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest"))))
    return archive.payloads.select(digest.alias("digest"), "payload")


def rebuild(archive: Archive) -> DataFrame:
    """(page_id, url, record bytes) of every original record: responses by a join on the digest, revisits from their headers."""
    end = F.lit(b"\r\n\r\n")
    responses = archive.headers.where("record_type = 'response'").join(verified(archive), "digest")
    responses = responses.select("page_id", "url", F.concat("header", "payload", end).alias("record"))
    return responses.unionByName(archive.headers.where("record_type = 'revisit'").select("page_id", "url", F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """Fields of ``records`` (record), read out of the bytes; a response whose payload is not what its header says fails the job."""
    # ISO-8859-1 maps bytes to characters one by one, so places in the text are places in the bytes.
    text = F.decode("record", "ISO-8859-1")
    head_end = F.instr(text, "\r\n\r\n")
    head = F.decode(F.encode(F.left(text, head_end + 1), "ISO-8859-1"), "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    cut = records.select("record", head.alias("head"), (head_end + 4).alias("block_at"))
    block = F.expr("substring(record, block_at, octet_length(record) - block_at - 3)")
    cut = cut.select("head", block.alias("block"))
    http_end = F.instr(F.decode("block", "ISO-8859-1"), "\r\n\r\n")
    body = F.when(field("WARC-Type") == "response", F.expr("substring(block, http_end + 4, octet_length(block))"))
    rows = cut.withColumn("http_end", http_end).select(
        field("X-Page-ID").cast("long").alias("page_id"),
        field("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        (field("Content-Length").cast("long") == F.octet_length("block")).alias("whole"),
        F.octet_length(body).cast("long").alias("body_bytes"),
        base32(F.sha1(body)).alias("body_digest"),
    )
    same = F.col("whole") & ((F.col("record_type") == "revisit") | ((F.col("body_digest") == F.col("payload_digest")) & (F.col("body_bytes") == F.col("payload_bytes"))))
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another payload")))
    return rows.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def read_records(archive: Archive) -> DataFrame:
    """Every record's fields, read out of the rebuilt record."""
    return parsed(rebuild(archive))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    at = write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_records(read_archive(spark, at))


_B32 = " || ".join(
    f"substr('{BASE32}', 1 + ((('0x' || substr(h, {at}, 5))::INT >> {shift}) & 31), 1)" for at in range(1, 41, 5) for shift in (15, 10, 5, 0)
)

ORACLE = {
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""
}
