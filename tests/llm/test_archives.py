import hashlib

import pytest

from flowloom.llm import queries, scratch, warc
from tests.conftest import SMALL, same_rows

LONG = "x" * 300


def pages(spark):
    rows = [
        (1, "http://a/x y", f"<p>{LONG}</p>", 1), (2, "http://a/2", f"<p>{LONG}</p>", 1), (2, "http://a/2", f"<p>{LONG}</p>", 1), (3, None, None, 1), (4, "", "", 1), (5, "http://a/é", "<p>é\r\n\r\nWARC/1.1\r\n</p>\n", 1),
        (6, "u", "short", 1), (7, "u", "short", 1), (None, "n", f"<p>{LONG}</p>", 1), (-9, "neg", "y" * 99, 1), (-8, "neg", "y" * 99, 1), (10, "big", "z" * 3_000_000, 1), (11, "http://a/1", "filedesc://x 0.0.0.0 20200101000000 text/plain 5\n1 0 x\n" * 9, 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)


def test_pages_come_back(spark):
    rows = warc.page_rows(spark, warc.archive_pages(pages(spark))[1]).collect()
    source = pages(spark).collect()
    assert len(rows) == len(source)
    first = {}
    for p in source:
        h = (p.html or "").encode()
        if p.page_id is not None:
            first[h] = min(first.get(h, p.page_id), p.page_id)
    want = []
    for p in source:
        h = (p.html or "").encode()
        later = len(h) >= 100 and p.page_id != first[h]
        want.append((p.page_id, len(h), hashlib.sha256(h).hexdigest(), "revisit" if later else "response", first[h] if later else None, True))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows)


def test_empty_table(spark):
    assert warc.page_rows(spark, warc.archive_pages(pages(spark).limit(0))[1]).count() == 0


def test_query_matches_sql(spark, duck):
    same_rows(queries.op5_arc_to_warc(spark, SMALL), duck, queries.OP5_SQL)


def test_files_begin_with_a_version_block_and_both_versions_occur(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 2)
    arc, out = warc.archive_pages(pages(spark))
    kinds = warc.read_arc(spark, arc, payload=False).groupBy("arc_version", "record_type").count().collect()
    by = {(r.arc_version, r.record_type): r["count"] for r in kinds}
    assert by[1, "response"] + by[2, "response"] == 13 and by[1, "warcinfo"] and by[2, "warcinfo"]
    assert warc.page_rows(spark, out).count() == 13


V1 = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
V2 = b"filedesc://b.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 b.arc 122\n2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"


def block(version, names):
    body = f"{version} 0 Archive\n{names}\n".encode()
    more = b" 200 - - 0 f.arc " if version == 2 else b" "
    return b"filedesc://f.arc 0.0.0.0 19970101000000 text/plain" + more + str(len(body)).encode() + b"\n" + body + b"\n"


@pytest.mark.parametrize("version", [1, 2])
def test_headers_of_either_version(version):
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\xfe bytes\n"
    mid = b" 200 - - 12 f.arc " if version == 2 else b" "
    data = block(version, warc.ARC_FIELDS[version])
    data += b"http://x/a b 1.2.3.4 19981231235959 text/html" + mid + str(len(http)).encode() + b"\n" + http + b"\n"
    data += b"junk line\n\ndns:x 1.2.3.4 19981231235959 text/dns" + mid + b"99\n" + b"short"
    records = [warc.convert(*r) for r in warc.parse_arc(data)]
    names = [c.split()[0] for c in warc.CONVERTED.split(", ")]
    info, page, dns = (dict(zip(names, r, strict=True)) for r in records)
    assert info["record_type"] == "warcinfo" and page["record_type"] == "response" and dns["record_type"] == "resource"
    assert page["uri"] == "http://x/a b" and page["ip"] == "1.2.3.4" and page["warc_date"] == "1998-12-31T23:59:59Z"
    assert page["payload"] == b"\xff\xfe bytes\n" and page["payload_digest"] == hashlib.sha256(page["payload"]).hexdigest() and page["block_digest"] == hashlib.sha256(http).hexdigest()
    assert not page["truncated"] and dns["truncated"] and page["arc_version"] == version
    assert page["record_id"] == warc.convert(*list(warc.parse_arc(data))[1])[0] != dns["record_id"]


def test_bytes_that_are_no_text_survive(spark):
    """A foreign ARC file through the converter: payloads are bytes."""
    import os

    body = b"HTTP/1.0 200 OK\r\n\r\n" + bytes(range(256)) * 3
    arc = scratch.new_path(spark, "foreign").removeprefix("file://")
    os.makedirs(arc)
    with open(f"{arc}/part-0.arc", "wb") as file:
        file.write(block(1, warc.ARC_FIELDS[1]) + b"http://x/ 1.1.1.1 19990101000000 text/html " + str(len(body)).encode() + b"\n" + body + b"\n")
    out = scratch.new_path(spark, "foreign-warc")
    warc.convert_folder(spark, f"file://{arc}", out)
    (row,) = warc.read_warc(spark, out).where("record_type = 'response'").collect()
    assert row.payload_digest == hashlib.sha256(bytes(range(256)) * 3).hexdigest() and row.digest_holds
