"""WARC archives: writing, reading, and assembly of transactions.

Writing: each page becomes a response (or a revisit of an equal payload), the request and a metadata
record, as text made by column expressions.  Spark's text writer, with the four bytes that end a
WARC record as its line separator, then writes archives that any WARC reader opens, gzip-compressed.
Reading: archives are parsed as streams, a record at a time, in the tasks that load them.
Assembly: records meet through the identifier they are concurrent to, one nested row per capture;
payloads don't travel, a row holds where they are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, scratch_path, table

END_OF_RECORD = "\r\n\r\n"
WARC_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The bounds of an archive, which a task reads whole: captures, and bytes of payloads (a larger page is an archive of its own).
CAPTURES_PER_FILE, ARCHIVE_BYTES = 2_000, 64 << 20
CHUNK = 1 << 20


def base32_sha1(column):
    """Base32 of the SHA-1 of a string column: 32 groups of five bits."""
    digest = F.sha1(column)
    return _base32(digest)


def _base32(hexadecimal):
    chars = []
    for i in range(8):
        bits = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


def _record(kind: str, record_id, fields: list, content_type: str, block):
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {WARC_DATE}\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in fields:
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    lines += [F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block]
    return F.concat(*lines)


def with_types(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, ``refers_to`` (null for a response).

    Of equal payloads that with the largest id is the response and the others revisit it.  Only groups
    of two or more are joined back; they are pre-aggregated, and Spark broadcasts them if they are small.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    groups = materialise(groups.select("sha1", "size", "first_id"), "warc-equal-payloads")
    joined = rows.join(groups, ["sha1", "size"], "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", _base32(F.col("sha1")).alias("digest"), F.when(other, F.col("first_id")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write ``page_id``, ``url``, ``html`` as gzip-compressed WARC 1.1 archives below *path*.

    A null html is an empty payload, a null url an empty target; line breaks in a url are
    percent-encoded.  A capture's identifier is its page id (``null`` for a null) with a row number
    behind it, so that repeated rows stay captures of their own; a revisit refers to the page id alone.
    Payloads of one size and SHA-1 are held equal.  Very long pages are written whole.  Other columns are
    ignored; an empty table gives no records.
    """
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    captures_per_file = max(1, min(CAPTURES_PER_FILE, ARCHIVE_BYTES // (largest + 1)))
    url = F.coalesce(F.col("url"), F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    rows = with_types(pages).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("payload", "digest", "refers_to", url.alias("url"), page.alias("page"), F.concat(F.lit("urn:capture:"), page, F.lit(":"), F.col("row").cast("string")).alias("capture"))
    uri = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    http = "application/http;msgtype="
    response = _record("response", F.concat("capture", F.lit(":response")), [uri, digest], http + "response", F.concat(head, F.col("payload")))
    refers = ("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("refers_to").cast("string"), F.lit(">")))
    revisit = _record("revisit", F.concat("capture", F.lit(":response")), [uri, digest, ("WARC-Profile", F.lit(PROFILE)), refers], http + "response", head)
    with_response = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("capture"), F.lit(":response>")))
    request = _record("request", F.concat("capture", F.lit(":request")), [uri, with_response], http + "request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", F.concat("capture", F.lit(":metadata")), [uri, with_response], "application/warc-fields", F.concat(F.lit("page-id: "), F.col("page"), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(F.when(F.col("refers_to").isNull(), response).otherwise(revisit), request, metadata)).alias("value"))
    writer = records.write.option("lineSep", END_OF_RECORD).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
        found[name.lower()] = value.strip(" ")
    return found


def parse_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive, gzip-compressed or not; a payload is read in chunks and its digest verified."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while first := stream.readline():
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {first[:80]!r}")
        fields = _headers(stream)
        if "content-length" not in fields or "warc-type" not in fields:
            raise ValueError("a record without its length or type")
        offset, left = stream.tell(), int(fields["content-length"])
        kind, block, size = fields["warc-type"], {}, None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        end = offset + left
        if kind in ("response", "revisit"):
            stream.readline()
            block = _headers(stream)
            offset, size = stream.tell(), int(block.get("content-length", 0))
        elif kind == "metadata":
            block = _headers(io.BytesIO(stream.read(left)))
        left = end - stream.tell()
        if kind == "metadata" and left:
            raise ValueError("the archive ends inside a record")
        if kind == "response":
            sha1, size = hashlib.sha1(), left
            while left:
                part = stream.read(min(left, CHUNK))
                if not part:
                    raise ValueError("the archive ends inside a record")
                sha1.update(part)
                left -= len(part)
            found = base64.b32encode(sha1.digest()).decode()
            if digest not in (None, found):
                raise ValueError(f"payload digest of {fields['warc-record-id']}: {found}, stated {digest}")
            digest = found
        elif left and len(stream.read(left)) < left:
            raise ValueError("the archive ends inside a record")
        yield {
            "record_type": kind, "record_id": fields["warc-record-id"].strip("<>"), "concurrent_to": fields.get("warc-concurrent-to", "").strip("<>") or None, "target_uri": fields.get("warc-target-uri"),
            "payload_offset": offset if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "page_id": block.get("page-id"),
        }


RECORD = "archive string, record_type string, record_id string, concurrent_to string, target_uri string, payload_offset long, payload_bytes long, payload_digest string, refers_to string, page_id string"


def read_warc(spark, path: str) -> DataFrame:
    """A row per record of the archives below *path*, without payloads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                frame = pd.DataFrame(parse_archive(content), columns=names[1:])
                frame.insert(0, "archive", archive)
                yield frame.astype({"payload_offset": "Int64", "payload_bytes": "Int64"})

    # a task holds one archive at a time; write_warc bounds them
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its request and its metadata.

    Records are joined by the identifier that they are concurrent to; no records give no rows.  Where a capture has several
    records of a kind that with the smallest record id stands in the row, and ``n_records`` counts all.
    A request or metadata record without its response gives a row with a null ``response``.
    """
    key = F.coalesce("concurrent_to", "record_id")
    row = F.struct("record_id", "record_type", "target_uri", "archive", "payload_offset", "payload_bytes", "payload_digest", "refers_to", "page_id")
    kind = F.col("record_type")
    of = lambda *kinds: F.min(F.when(kind.isin(*kinds), row))
    return records.groupBy(key.alias("capture")).agg(of("response", "revisit").alias("response"), of("request").alias("request"), of("metadata").alias("metadata"), F.count("*").alias("n_records"))


def captures(pages: DataFrame) -> DataFrame:
    """Write *pages* as archives into the shared folder, read them back and assemble their captures.

    One row per page, repeated ones too; nulls, ties of payloads and long pages are as in :func:`write_warc`.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return assemble(read_warc(pages.sparkSession, path))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return captures(table(spark, sf_dir, "pages")).select(
        number("metadata.page_id").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        "response.record_type",
        F.expr("try_cast(substring_index(response.refers_to, ':', -1) AS bigint)").alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda j: substring('{BASE32}', CAST((CAST('0x' || substring(h, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM a WINDOW g AS (PARTITION BY payload)
"""
