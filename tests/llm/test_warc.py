import gzip
import hashlib
import random

import pytest

from placemill.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = h or ""
        again = h in first and first[h] != i
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


def trip(spark, rows):
    got = warc.digest_rows(warc.round_trip(pages(spark, rows))).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)


def test_round_trip(spark):
    rnd = random.Random(1)
    shared = ["é" * 50, "é" * 49 + "x", "WARC/1.1\r\n\r\n" * 20, "\r\n\r\n" * 30, "short", ""]
    rows = [(i, f"http://h.test/{i}?q", rnd.choice(shared) if rnd.random() < 0.5 else f"page {i} " * 40) for i in range(300)]
    assert trip(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a\r\nX: y", "z" * 120), (3, "no scheme", "z" * 120), (3, "no scheme", "z" * 120), (4, "http://é/ü", "long " * 200_000), (None, "u", "z" * 120), (-5, "u", "q" * 100), (6, "u", "q" * 100)]
    assert trip(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert trip(spark, []) == []


def test_hot_payload(spark):
    rows = [(i, "u", "hot " * 30 if i % 3 == 0 else f"own {i} " * 20) for i in range(1, 900)]
    assert trip(spark, rows) == brute(rows)


def test_rows_that_share_a_page_id(spark):
    rows = [(1, "http://a/1", "h" * 120), (1, "http://a/2", "h" * 120), (1, "http://a/1", "other"), (2, "http://b", "h" * 120)]
    got = warc.digest_rows(warc.round_trip(pages(spark, rows))).collect()
    assert sorted((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted((i, u, len(h), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, u, h in rows)


def test_bytes_bound_an_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 8000)
    rows = [(i, f"u{i}", f"{i} " * (10 if i % 9 else 3000)) for i in range(1, 100)]
    warc.write(pages(spark, rows).coalesce(1), f"file://{tmp_path}/a", (500, 4000))
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("*.gz")]
    assert len(files) > 11 and max(len(f) for f in files if len(f) < 30_000) < 8000 + 48 * 700
    assert all(len(list(warc.parse(f))) == 3 for f in files if any(len(block) > 4500 for _, block in warc.parse(f)))
    assert sum(len(list(warc.parse(f))) for f in files) == 3 * len(rows)


def record(kind, ident, block=b"", **headers):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Gzip by record, plain, info records, chains of concurrent-to in either direction, captures that lack a part."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody\r\n\r\nmore"
    kind = {"Content_Type": "application/http; msgtype=response"}
    one = [
        record("warcinfo", "w"),
        record("response", "r1", http, **kind),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r1>"),
        record("metadata", "m1", b"page-id: 7\r\n", WARC_Concurrent_To="<q1>", Content_Type="application/warc-fields"),
        record("response", "r2", http, WARC_Concurrent_To="<q2>", **kind),
        record("request", "q2", b"GET /2 HTTP/1.1\r\n\r\n"),
    ]
    two = [record("metadata", "m9", b"", WARC_Concurrent_To="<r9>")]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, one)))
    (tmp_path / "two.warc").write_bytes(b"".join(two))
    got = {r.capture_id: r for r in warc.assemble(warc.read(spark, str(tmp_path)).filter("type <> 'warcinfo'")).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r9>"}
    assert bytes(got["<r1>"].response.payload) == b"body\r\n\r\nmore" and got["<r1>"].metadata.fields == {"page-id": "7"} and got["<r1>"].request.record_id == "<q1>"
    assert got["<r2>"].request.record_id == "<q2>" and got["<r2>"].metadata is None
    assert got["<r9>"].response is None


@pytest.mark.parametrize("data", [b"junk", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab"])
def test_broken_archives_raise(data):
    with pytest.raises((ValueError, KeyError)):
        list(warc.parse(data))
