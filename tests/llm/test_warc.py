import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from quillspark.llm.common import scratch_path
from quillspark.llm.warc import assemble, captures, parse_archive, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def rows_of(pages):
    return [(i, u, h, "clash", None) for i, u, h in pages]


PAGES = [
    (1, "http://a/", "<p>x"), (2, "http://b/", "<p>x"), (3, None, None), (4, "http://c/\r\nWARC-Type: evil", ""), (5, "", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (6, "u", "é日本\x00"), (7, "u", "long " * 60_000),
    (7, "u", "long " * 60_000), (None, "u", "<p>x"), (None, "u", "only null"), (8, "u", "alone"), (8, "u", "alone"),
]


def slow(pages):
    ids = defaultdict(list)
    for i, _, html in pages:
        ids[html or ""].append(i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        largest = max((x for x in ids[html or ""] if x is not None), default=None)
        revisit = largest is not None and i != largest
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=str)


def test_captures(spark):
    found = captures(spark.createDataFrame(rows_of(PAGES), SCHEMA)).collect()
    number = lambda x: None if x in (None, "null") else int(x)
    got = sorted(((number(r.metadata.page_id), r.response.payload_bytes, r.response.payload_digest, r.response.record_type, number(r.response.refers_to.rpartition(":")[2]) if r.response.refers_to else None) for r in found), key=str)
    assert got == slow(PAGES)
    assert {r.n_records for r in found} == {3} and all(r.request.record_type == "request" for r in found)


def test_archives_are_plain_warc(spark):
    path = scratch_path(spark, "warc-test")
    write_warc(spark.createDataFrame(rows_of(PAGES), SCHEMA), path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    records = [r for f in files for r in parse_archive(bytes(f.content))]
    assert Counter(r["record_type"] for r in records) == {"request": 12, "metadata": 12, "response": 9, "revisit": 3}
    assert not any("evil" in (r["record_type"] or "") for r in records)
    raw = gzip.decompress(bytes(max((f.content for f in files), key=len)))
    some = [r for r in parse_archive(raw) if r["record_type"] == "response"]
    assert all(base64.b32encode(hashlib.sha1(raw[r["payload_offset"] : r["payload_offset"] + r["payload_bytes"]]).digest()).decode() == r["payload_digest"] for r in some)
    with pytest.raises(ValueError):
        list(parse_archive(raw[:-200]))


def test_orphans_and_several_of_a_kind(spark):
    schema = read_warc(spark, _empty_archive(spark)).schema
    row = lambda kind, rid, to: ("a", kind, rid, to, None, None, None, None, None, None)
    records = spark.createDataFrame([row("request", "q2", "r"), row("request", "q1", "r"), row("response", "r", None), row("metadata", "m", "lost")], schema)
    got = {r.capture: r for r in assemble(records).collect()}
    assert got["r"].request.record_id == "q1" and got["r"].n_records == 3 and got["r"].metadata is None
    assert got["lost"].response is None and got["lost"].metadata.record_id == "m"


def _empty_archive(spark):
    path = scratch_path(spark, "warc-empty")
    write_warc(spark.createDataFrame([], SCHEMA), path)
    return path


def test_empty(spark):
    assert captures(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_bounded_by_bytes(spark):
    rows = [(i, f"http://a/{i}", "x" * 400_000 + str(i), "", "") for i in range(30)] + [(100, "http://b/", "y" * (17 << 20), "", "")]
    path = scratch_path(spark, "bounded")
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    found = read_warc(spark, path).filter("record_type = 'response'").groupBy("archive").agg({"payload_bytes": "sum"}).collect()
    assert sum(r[1] for r in found) == sum(len(h) for _, _, h, _, _ in rows) and max(r[1] for r in found) <= 64 << 20 and len(found) > 5
