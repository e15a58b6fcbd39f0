import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from moleweave.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest int"


def brute(rows):
    least = {}
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            least[p] = min(least.get(p, i), i)
    out = []
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        to = least.get(p)
        revisit = to is not None and to != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(map(str, out))


ROWS = [(3, "http://a/x y", "é" * 60, "", 0), (1, None, "é" * 60, "", 0), (2, "http://b", "é" * 49, "", 0), (9, "http://b", "é" * 49, "", 0), (4, "u", None, "", 0), (5, "u", "", "", 0), (6, "u", "a\r\n\r\nb" * 50_000, "", 0), (None, "n", "é" * 60, "", 0), (1, None, "é" * 60, "", 0), (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "", 0)]


def test_round_trip(spark):
    found = warc.archive_pages(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found) == brute(ROWS)


def test_files_roll_over_and_each_record_is_a_member(spark, tmp_path):
    pages = warc.with_revisits(spark.createDataFrame(ROWS, SCHEMA)).coalesce(1)
    raw, normal = f"file://{tmp_path}/raw", f"file://{tmp_path}/normal"
    first = warc.write_warc(pages, raw, roll=1000)
    assert first.count() > 1
    second = warc.normalise_warc(first, raw, normal)
    for r in second.collect():
        data = open(f"{tmp_path}/normal/{r.path}", "rb").read()
        assert data.count(b"\x1f\x8b\x08") >= r.records and len(list(warc.records(io.BytesIO(data)))) == r.records and gzip.decompress(data)
    found = warc.read_warc(second, normal)
    assert found.count() == len(ROWS) and found.where(F.col("length") <= 0).count() == 0


def test_archives_that_are_cut_off_are_errors():
    raw = [warc.record(i, "http://u", b"payload %d" % i * 500, "d", None) for i in range(3)]
    single = gzip.compress(b"".join(raw))
    members = b"".join(map(gzip.compress, raw))
    for data in (single, members):
        assert len(list(warc.records(io.BytesIO(data)))) == 3
        for lost in (1, 6, 20, len(data) // 3):
            with pytest.raises((ValueError, zlib.error)):
                list(warc.records(io.BytesIO(data[:-lost])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(gzip.compress(raw[0]) + gzip.compress(raw[1])[:10])))
    assert list(warc.records(io.BytesIO(b""))) == []


def test_inflated_pieces_are_bounded():
    data = gzip.compress(b"\0" * 50_000_000)
    sizes = [len(x) for x in warc.inflated(io.BytesIO(data), 1 << 16)]
    assert sum(sizes) == 50_000_000 and max(sizes) <= 1 << 16


def test_record_ids_are_unique_and_revisits_find_their_payload(spark, tmp_path):
    rows = ROWS + [ROWS[0], ROWS[4], ROWS[4]]
    raw, normal = f"file://{tmp_path}/raw", f"file://{tmp_path}/normal"
    second = warc.normalise_warc(warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, SCHEMA)).repartition(3), raw), raw, normal)
    ids = [json.loads(x)["id"] for r in second.collect() for x in open(f"{tmp_path}/normal/{r['index']}")]
    assert len(ids) == len(set(ids)) == len(rows)
    found = warc.read_warc(second, normal)
    assert warc.resolved(found).count() == len(rows)
    with pytest.raises(Exception, match="no payload for the revisit"):
        warc.resolved(found.where("record_type = 'revisit'")).collect()


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_of_other_tools(spark, tmp_path):
    """Names in any case, no space after colons, folded fields, an info record, and a revisit without a length."""
    import gzip

    from moleweave.llm.warc import normalise_warc, parse, read_warc, records

    def made(*lines, block=b""):
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    info, page = b"software: x\r\nformat: WARC\r\n\r\nmore", b"HTTP/1.0 200 OK\r\ncontent-TYPE:text/html\r\n\r\n<p>hi"
    raw = made("WARC/1.0", "warc-type:warcinfo", "WARC-Record-ID: <urn:a>", "Content-Type: application/warc-fields", f"content-length:{len(info)}", block=info)
    raw += made("WARC/1.0", "WARC-TYPE: response", "warc-record-id:<urn:b>", "WARC-Target-URI: http://x", "  /y", "Content-Type: application/http;msgtype=response", f"Content-Length : {len(page)}", block=page)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw))
    with open(tmp_path / "a.warc.gz", "rb") as stream:
        found = [parse(r) for r in records(stream)]
    assert found[0][2] == info and found[1][2] == b"<p>hi" and found[1][0]["warc-target-uri"] == "http://x /y"
    manifest = spark.createDataFrame([("a.warc.gz", None, 2, len(raw))], "path string, index string, records long, bytes long")
    rows = sorted(tuple(r) for r in read_warc(normalise_warc(manifest, f"file://{tmp_path}", f"file://{tmp_path}/new"), f"file://{tmp_path}/new").select("record_type", "payload_bytes", "url").collect())
    assert rows == [("response", 5, "http://x /y"), ("warcinfo", len(info), None)]
