import hashlib
import random

import pytest

from inkgraph.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"", b"HTTP/1.1 200 OK\r\n\r\nhi", b"\n\nhttp://x 0 1 2 3\n", bytes(range(256))]
    records = [warc.ArcRecord(f"http://a/{k}?q=a b", "1.2.3.4", "20240102030405", "text/html", b, version) for k, b in enumerate(bodies)]
    got = list(warc.read_arc(warc.arc_file(records, version)))
    assert [x.body for x in got] == bodies and {x.version for x in got} == {version}
    assert got[1].url == "http://a/1?q=a%20b"
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.arc_file(records, version)[:-5]))


def test_dates_and_ids():
    assert warc.warc_date("20240102030405") == "2024-01-02T03:04:05Z"
    assert warc.warc_date("199609") == "1996-09-01T00:00:00Z"
    assert warc.record_id("u", "d", 1) == warc.record_id("u", "d", 1) != warc.record_id("u", "d", 2)


def test_warc_record_lengths():
    raw = warc.warc_record("response", "<urn:x>", "http://a", "2024-01-01T00:00:00Z", "", b"HTTP/1.1 200 OK\r\n\r\n", b"a\r\n\r\nWARC/1.1\r\n", "00", extra="X-Page-Id: 1") + warc.END
    assert [b for _, b in warc.read_warc((raw + raw).split(warc.END))] == [b"HTTP/1.1 200 OK\r\n\r\na\r\n\r\nWARC/1.1\r\n"] * 2


def test_pages_against_brute_force(spark):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "u5", long, "x"), (3, "u3", long, "x"), (9, None, long, "x"), (1, "u1", "short", "x"), (2, "u2", "short", "x"), (4, "u 4", None, "x"), (6, "u6", "", "x"), (None, "n", long, "x"), (3, "u3", long, "x"), (8, "u8", "z" * 300000, "x")]
    rng = random.Random(4)
    rows += [(100 + k, "u", "".join(rng.choices(["\r", "\n", "a", "WARC/1.1"], k=rng.randint(0, 300))), "x") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        first = min([p for p, _, h, _ in rows if p is not None and (h or "") == (html or "")], default=None)
        again = len(payload) >= 100 and page is not None and page != first
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_types_and_content_types(spark):
    rows = [(k, f"http://a/{k}", "1.2.3.4", "20240102030405", 1, h, p, len(p), hashlib.sha256(p).hexdigest(), m) for k, (h, p, m) in enumerate([(b"HTTP/1.1 200 OK\r\n\r\n", b"x" * 200, "text/html"), (b"", b"\x00\xff\r\n\r\n\r\n", "image/png"), (b"", b"x" * 200, "text/plain"), (b"", b"", "")])]
    folder = warc.scratch(spark, "warc")
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, warc._CONVERTED)), folder)
    got = {r.page_id: r for r in warc.read_warc_files(spark, folder).collect()}
    assert [got[k].record_type for k in range(4)] == ["response", "resource", "revisit", "resource"]
    assert [got[k].mime for k in (0, 1, 3)] == ["application/http; msgtype=response", "image/png", "application/octet-stream"]
    assert all(got[k].payload_digest == rows[k][8] and got[k].warc_date == "2024-01-02T03:04:05Z" for k in range(4))
    raw = b"".join(spark.read.format("binaryFile").load(folder).rdd.map(lambda r: __import__("gzip").decompress(r.content)).collect())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_cut_records_are_refused():
    raw = warc.warc_record("resource", "<urn:x>", "http://a", "2024-01-01T00:00:00Z", "", b"", b"abc", "00") + warc.END
    for bad in (raw[:-6], raw.replace(b"abc", b"abcd"), b"junk" + warc.END):
        with pytest.raises(ValueError):
            list(warc.read_warc(bad.split(warc.END)))
