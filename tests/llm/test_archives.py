"""Legacy archives, their conversion and what is read back."""

import base64
import gzip
import hashlib
import io

import pytest

from tessera.llm import archives


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(rows, least=0):
    """(page_id, payload bytes, digest, type, refers_to) by comparing payloads."""
    out, seen = [], {}
    for page_id, html in sorted(((r[0], (r[2] or "").encode()) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        first = len(html) >= least and html not in seen
        out.append((page_id, len(html), b32(html), "response" if first or len(html) < least else "revisit", None if first or len(html) < least else seen[html]))
        seen.setdefault(html, page_id)
    return sorted(out, key=repr)


ROWS = [
    (3, "http://a.example/x y\n", "<p>same</p>"), (1, "http://b.example/é", "<p>same</p>"), (2, None, None), (9, "", ""), (4, "http://c.example/", "é\r\n\r\n漢字 WARC/1.1\r\n\x00"),
    (5, "http://d.example/", "x" * 300_000), (6, "http://d.example/", "x" * 300_000), (7, "dns:d.example", "\n\n"), (7, "http://a.example/7", "twice"), (7, "http://a.example/7", "twice"),
    (None, "http://n.example/", "<p>same</p>"), (None, None, "only null"), (-5, "u" * 5000, "HTTP/1.1 200 OK\r\nX-Page-Id: 77\r\n\r\ninside"),
]


@pytest.mark.parametrize("copies", [1, 400])
def test_round_trip_with_repeats(spark, copies):
    rows = ROWS + [(1000 + k, f"http://hot.example/{k}", "<p>same</p>") for k in range(copies)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, archive string, number long").repartition(3)
    out = archives.converted(df)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()), key=repr)
    assert got == plain(rows)
    urls = {r["page_id"]: r["url"] for r in out.collect()}
    assert urls[3] == "http://a.example/x%20y%0A" and urls[1] == "http://b.example/é" and urls[2] is None and len(urls[-5]) == 5000


def test_least_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(k, "http://a.example/", "ab" if k % 2 else "abc") for k in range(6)], "page_id long, url string, html string")
    index = archives.scan_arc(archives.write_arc(df))
    assert {r["first_page_id"] for r in archives.repeated(index, least_bytes=3).collect()} == {0}
    assert archives.repeated(index).count() == 4
    assert archives.converted(df.filter("false")).collect() == []


V1 = b"filedesc://old.arc 0.0.0.0 19970101 text/plain 76\n1 0 Archive Org\nURL IP-address Archive-date Content-type Archive-length\n\n"
V2 = b"filedesc://new.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 new.arc 122\n2 0 Archive Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"


def legacy(version_block, entries):
    head, _, body = version_block.partition(b"\n")
    out = head.rsplit(b" ", 1)[0] + f" {len(body)}\n".encode() + body
    for line, content in entries:
        out += f"{line} {len(content)}\n".encode() + content + b"\n"
    return out


def test_both_versions_are_read_by_their_lengths():
    page = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhttp://no.header/ 1.2.3.4 19970101000000 text/html 5\n<p>"
    one = legacy(V1, [("http://a.example/with space 1.2.3.4 19970131235959 text/html", page), ("dns:a.example 1.2.3.4 19970131 text/dns", b"a 1 IN A 1.2.3.4")])
    two = legacy(V2, [("http://a.example/ 1.2.3.4 20010203040506 text/html 200 abc - 150 new.arc", page)])
    first, second = (list(archives.arc_records(io.BytesIO(x), "x")) for x in (one, two))
    assert [r["URL"] for r in first] == ["filedesc://old.arc", "http://a.example/with space", "dns:a.example"] and first[1]["body"] == page
    assert second[1]["Result-code"] == "200" and second[1]["Offset"] == "150" and second[1]["body"] == page
    blocks = [archives.synthesised(r, "x", None, "<urn:uuid:0>", None) for r in first]
    read = list(archives.warc_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(b"".join(blocks)))), "x"))
    assert [h["warc-type"] for h, _ in read] == ["warcinfo", "response", "resource"]
    assert read[1][0]["warc-date"] == "1997-01-31T23:59:59Z" and read[2][0]["warc-date"] == "1997-01-31T00:00:00Z" and read[1][1] == page
    assert read[1][0]["warc-payload-digest"] == "sha1:" + b32(page.partition(b"\r\n\r\n")[2]) and read[2][0]["content-type"] == "text/dns"
    assert len({h["warc-record-id"] for h, _ in read}) == 3


def test_cut_and_broken_archives():
    page = b"HTTP/1.0 200 OK\r\n\r\n" + b"y" * 50
    whole = legacy(V1, [("http://a.example/ 1.2.3.4 19970131235959 text/html", page)])
    cut = list(archives.arc_records(io.BytesIO(whole[:-20]), "x"))[-1]
    assert not cut["whole"] and cut["body"] == page[:-19]
    assert b"WARC-Truncated: length" in gzip.decompress(archives.synthesised(cut, "x", None, None, None))
    with pytest.raises(ValueError, match="record 2"):
        list(archives.arc_records(io.BytesIO(whole + b"garbage\n"), "x"))
    record = gzip.decompress(archives.synthesised(cut, "x", None, None, None))
    with pytest.raises(ValueError, match="digest"):
        list(archives.warc_records(io.BytesIO(record.replace(b"yyy", b"zzz")), "x"))
    assert archives.warc_date("1999") == "1999-01-01T00:00:00Z" and archives.warc_date("19991399") is None
