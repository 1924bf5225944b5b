"""WARC archives: what is written is read back, and transactions are assembled."""

import hashlib
import io
import json
from collections import Counter

import duckdb
import pytest

from riffle.llm import oracle, shared, warc

SCHEMA = "page_id long, url string, html string, digest string, payload string"
BIG, OTHER = "<p>ü</p>" * 200, "<p>b</p>" * 200
PAGES = [
    (1, "http://a.com/1", BIG), (2, "http://a.com/2", BIG), (7, "http://a.com/7", BIG), (3, None, OTHER), (4, "http://x y/\r\nA: b", "small"),
    (5, "http://a.com/5", "small"), (6, "http://a.com/6", None), (8, "http://a.com/8", ""), (9, "u", "x" * 999), (10, "u", "x" * 999),
    (11, "u", "y" * 1000), (12, "u", "y" * 1000), (13, "u", "a\r\n\r\nb" * 300), (14, "", "WARC/1.1\r\n\r\n" * 100), (None, "u", OTHER),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def expected(rows):
    newest = {}
    for i, _, html in rows:
        if i is not None:
            newest[html or ""] = max(i, newest.get(html or "", i))
    out = set()
    for i, _, html in rows:
        body = (html or "").encode()
        repeat = len(body) >= 1000 and newest.get(html or "") not in (None, i)
        out.add((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if repeat else "response", newest[html] if repeat else None))
    return out


def roundtrip(spark, rows, **options):
    directory = shared.scratch(spark, "warc")
    manifest = warc.write(pages(spark, rows), directory, **options)
    return manifest, warc.assemble(warc.read(spark, directory)).cache()


@pytest.mark.parametrize("file_bytes", [32_000_000, 1])
def test_round_trip(spark, file_bytes):
    manifest, captures = roundtrip(spark, PAGES, file_bytes=file_bytes)
    assert sum(r["records"] for r in manifest.collect()) == 3 * len(PAGES)
    assert (manifest.count() == len(PAGES)) == (file_bytes == 1)
    got = [tuple(r) for r in warc.facts(captures).collect()]
    assert len(got) == len(PAGES) and set(got) == expected(PAGES)


def test_nested_rows_hold_payloads_and_links(spark):
    _, captures = roundtrip(spark, PAGES)
    by_digest = {}
    for r in captures.collect():
        assert r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata"
        if r["response"]["type"] == "response":
            assert hashlib.sha1(r["response"]["payload"]).hexdigest() == r["response"]["digest"]
            by_digest.setdefault(r["response"]["digest"], []).append(r["capture_id"])
        else:
            assert r["response"]["refers_to"].startswith("<urn:uuid:") and r["response"]["payload"] == b""
    for r in captures.filter("response.type = 'revisit'").collect():
        assert r["response"]["refers_to"] in by_digest[r["response"]["digest"]]


def test_repeated_rows_are_one_capture(spark):
    _, captures = roundtrip(spark, PAGES + PAGES)
    got = [tuple(r) for r in warc.facts(captures).collect()]
    assert len(got) == len(PAGES) and set(got) == expected(PAGES)


def test_each_row_comes_back_as_often_as_the_sql_says(spark, tmp_path):
    rows = PAGES + PAGES[:4] + [(None, f"http://n/{i}", None) for i in range(3)] + [(None, None, "")] * 3 + [(None, "u", OTHER)]
    rows += [(7, "http://other/7", BIG), (21, "http://m/1", "z" * 1500), (21, "http://m/2", "z" * 1500), (20, "u", "z" * 1500)]
    rows += [(30, "http://hot", "h" * 1200)] * 200 + [(29, "http://hot", "h" * 1200)] * 3
    for least in (1000, 10**9):
        manifest, captures = roundtrip(spark, rows, each_row=True, least=least, file_bytes=10_000)
        assert sum(r["records"] for r in manifest.collect()) == 3 * len(rows)
        got = Counter(tuple(r) for r in warc.facts(captures).collect())
        table = tmp_path / f"pages-{least}.parquet"
        pages(spark, rows).write.parquet(str(table))
        sql = oracle.sql()["op7_warc_transactions"].replace("FROM pages", f"FROM '{table}/*.parquet'").replace(">= 1000", f">= {least}")
        assert got == Counter(duckdb.sql(sql).fetchall())
        found = captures.collect()
        urls = Counter(json.loads(r["metadata"]["payload"])["url"] for r in found)
        assert urls == Counter(url for _, url, _ in rows)
        responses = {r["capture_id"] for r in found if r["response"]["type"] == "response"}
        assert {r["response"]["refers_to"] for r in found if r["response"]["type"] == "revisit"} <= responses


def test_pages_that_differ_in_their_url_are_captures_of_their_own(spark):
    rows = [(None, "http://a", None), (None, "http://b", ""), (1, "http://a", BIG), (1, "http://b", BIG)]
    for each_row in (False, True):
        _, captures = roundtrip(spark, rows, each_row=each_row)
        assert captures.count() == 4


def test_empty_table(spark):
    directory = shared.scratch(spark, "warc")
    assert warc.write(pages(spark, []), directory).count() == 0


def test_parts_without_a_response_and_uncompressed_records(spark):
    schema = "record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, length long, payload binary"
    rows = [("r1", "request", "x", None, None, None, None, b""), ("w", "warcinfo", None, None, None, None, None, b"")]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"x", "w"} and got["x"]["response"] is None and got["x"]["request"]["record_id"] == "r1"
    data = io.BytesIO(b"".join(warc.capture(1, "http://a/", b"abc", "d", None))).getvalue()
    assert [h["warc-type"] for h, _ in warc.records(data)] == ["request", "response", "metadata"]
    with pytest.raises(ValueError):
        list(warc.records(b"not an archive"))
