import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimwright.llm import warc

SCHEMA = "page_id long, url string, html string"


def want(rows):
    """The contract with dictionaries."""
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        least = first.get(body)
        revisit = least is not None and least != page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(map(repr, out))


def got(df):
    return sorted(map(repr, (tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))


def test_chunked_framing():
    rng = random.Random(1)
    for size in (0, 1, 5, 8192, 8193, 40_000):
        data = rng.randbytes(size)
        assert warc.unchunked(warc.chunked(data, 8192)) == data and warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(warc.Damaged):
            warc.unchunked(bad)


def test_pages_come_back_whole(spark, tmp_path):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdé漢\r\n<>") for _ in range(150_000))
    rows = [(k, f"http://a.b/{k}", f"<p>{k % 3}</p>" * (30 if k % 2 else 1)) for k in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x/ y\r\nz", long), (103, "u", long), (104, "u", long + "!"), (None, "u", long), (None, None, "short"), (100, None, None)]
    rows += [(200, "twice", long + "?"), (200, "twice", long + "?"), (300, "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9)]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", digest string, first int").repartition(6)
    read = warc.archived(pages, str(tmp_path / "w"))
    assert got(read) == want(rows) and read.filter("error IS NOT NULL").count() == 0
    back = {(r.page_id, bytes(r.payload).decode()) for r in read.filter("record_type = 'response'").collect()}
    assert (102, long) in back and (200, long + "?") in back and (300, rows[-1][2]) in back


def test_a_hot_payload_and_an_empty_table(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 3 = 1 THEN repeat('hot page ', 40) ELSE concat(repeat('own page ', 20), id div 2) END AS html")
    rows = [tuple(r) for r in pages.collect()]
    assert got(warc.archived(pages.repartition(8), str(tmp_path / "hot"))) == want(rows)
    plan = warc.with_firsts(pages)
    assert plan.filter("first = 1").count() == sum(r[0] % 3 == 1 for r in rows) - 1
    assert warc.archived(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_segments_are_ordered_and_held_against_the_total(spark, tmp_path):
    digest = hashlib.sha256(b"p" * 5000).hexdigest()
    records = list(warc.records_of(5, "u", b"p" * 5000, digest, None, segment=1000))
    assert len(records) == 6
    other = warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:x>"}, b"software: none\r\n")
    (tmp_path / "a.warc").write_bytes(records[3] + other + records[5] + records[0])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in (records[4], records[1], records[2])))
    read = warc.read_archives(spark, str(tmp_path)).collect()
    whole = next(r for r in read if r.record_type == "response")
    assert (whole.page_id, bytes(whole.payload), whole.error) == (5, b"p" * 5000, None) and len(read) == 2
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records[4]) + gzip.compress(records[1]))
    (tmp_path / "c.warc").write_bytes(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:6:x>", "WARC-Payload-Digest": "sha256:" + digest}, b"HTTP/1.1 200 OK\r\n\r\nother"))
    bad = {r.page_id: (r.payload, r.error) for r in warc.read_archives(spark, str(tmp_path)).filter("record_type = 'response'").collect()}
    assert bad[5] == (None, "segments missing or of another length") and bad[6][1] == "payload differs from its digest"


def test_files_that_are_no_archives_fail(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, str(tmp_path)).count()
    (tmp_path / "x.warc").write_bytes(b"hello\r\n")
    with pytest.raises(Exception, match="no record"):
        warc.read_archives(spark, str(tmp_path)).select(F.length("payload")).collect()
