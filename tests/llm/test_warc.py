import base64
import gzip
import hashlib
import io
import json
import os

import pytest

from pagewright.llm import warc
from tests.llm.conftest import SMALL


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (None, "http://d/", "<p>x</p>"), (5, "http://e/ä", "ü" * 1_500_000), (6, "http://f/", "only\r\n\r\nonce")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS payload", "1 AS first_id", "2 AS n")


def test_records(pages, tmp_path):
    index = warc.archive_pages(pages, f"file://{tmp_path}/a")
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    for k, first, text in ((1, None, "<p>x</p>"), (2, 1, "<p>x</p>"), (3, None, ""), (4, 3, ""), (None, 1, "<p>x</p>"), (5, None, "ü" * 1_500_000), (6, None, "only\r\n\r\nonce")):
        assert (got[k].refers_to, got[k].record_type) == (first, "revisit" if first else "response")
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(text.encode()), digest(text))
        assert first or got[k].payload == text.encode()
    assert got[2].target_uri == "http://b/%20%20X:%20y"


def test_members_and_sidecars(pages, tmp_path):
    warc.archive_pages(pages, f"file://{tmp_path}/a")
    whole = 0
    for name in os.listdir(tmp_path / "a/members"):
        if name.endswith(".warc.gz") and name[0] != ".":
            data = (tmp_path / "a/members" / name).read_bytes()
            entries = [json.loads(x) for x in (tmp_path / "a/members" / f"{name}.idx.json").read_text().splitlines()]
            assert sum(x["length"] for x in entries) == len(data)
            for x in entries:
                assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")
                whole += 1
    assert whole == 7


def test_monolithic_files_hold_the_same_bytes(pages, tmp_path):
    warc.archive_pages(pages, f"file://{tmp_path}/a")
    plain = lambda d, end: b"".join(sorted(b"".join(gzip.open(f"{tmp_path}/a/{d}/{x}").read() for x in sorted(os.listdir(tmp_path / "a" / d)) if x.endswith(end) and x[0] != ".").split(b"WARC/1.1\r\n")))
    assert plain("monolithic", ".txt.gz") == plain("members", ".warc.gz")


def test_least_payload(pages, tmp_path):
    got = {r.page_id: r.record_type for r in warc.read_records(warc.archive_pages(pages, f"file://{tmp_path}/a", min_bytes=5)).collect()}
    assert (got[2], got[4]) == ("revisit", "response")


def test_rows_that_repeat_the_smallest_id_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "v", "x"), (2, "w", "x"), (2, "w", "x")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_records(warc.archive_pages(pages, f"file://{tmp_path}/a")).collect())
    assert got == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2


def test_many_members_and_padding_are_inflated():
    data = gzip.compress(b"a" * 3_000_000) + b"\0\0" + gzip.compress(b"b") + gzip.compress(b"")
    assert b"".join(warc.inflated(io.BytesIO(data))) == b"a" * 3_000_000 + b"b"


def test_no_pages(pages, tmp_path):
    assert warc.read_records(warc.archive_pages(pages.where("false"), f"file://{tmp_path}/a")).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: bytes(r.payload) for r in warc.read_records(warc.archive_pages(pages)).collect()}
    assert got == {r.page_id: (r.html or "").encode() for r in pages.collect()}


def test_ids_beyond_2_to_the_53_and_malformed_bytes(spark, tmp_path):
    big = 1152921504606846977
    rows = ", ".join(f"({k}L, cast(unhex('{h}') AS string), cast(unhex('{u}') AS string))" for k, h, u in ((big, "61FF62", "68FF"), (big + 2, "61FF62", "68"), (big + 4, "61EFBFBD62", "68"), (7, "", "FE")))
    pages = spark.sql(f"SELECT * FROM VALUES {rows}, (NULL, cast(unhex('61FF62') AS string), 'x') AS t(page_id, html, url)")
    got = {r.page_id: r for r in warc.read_records(warc.archive_pages(pages, f"file://{tmp_path}/a")).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {
        big: ("response", None, 3), big + 2: ("revisit", big, 3), None: ("revisit", big, 3), big + 4: ("response", None, 5), 7: ("response", None, 0)
    }
    assert bytes(got[big].payload) == b"a\xffb" and got[big].payload_digest == base64.b32encode(hashlib.sha1(b"a\xffb").digest()).decode()
    assert got[big].target_uri == "h�"


def test_records_across_chunks():
    record = lambda k: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % k + b"x" * k + b"\r\n\r\n"
    data = b"".join(map(record, [0, 1, 5, 1000, 3]))
    for size in (1, 7, 64, 10_000):
        stream, seen = warc._Bytes(iter([data[k : k + size] for k in range(0, len(data), size)])), []
        while (head := stream.head()) is not None:
            n = int(warc.fields(head)["content-length"])
            seen.append(b"".join(warc._record(head, stream, n)))
        assert b"".join(seen) == data and len(seen) == 5


def test_many_pages_by_ranges(pages, tmp_path, monkeypatch):
    from pagewright.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "MAX_CELLS", 16)
    monkeypatch.setattr(exact_dedup.ranges, "__defaults__", (16,))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_records(warc.archive_pages(pages, f"file://{tmp_path}/a", keep_monolithic=False)).collect()}
    assert (got[2], got[4], got[None], got[5]) == (("revisit", 1), ("revisit", 3), ("revisit", 1), ("response", None)) and not os.path.exists(tmp_path / "a/monolithic")
