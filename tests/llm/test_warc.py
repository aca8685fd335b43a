import base64
import hashlib
import pathlib

import pytest

from corpusdiff.llm import warc as w

PAGES = [(1, "http://x\r\nA: b", None), (2, None, ""), (3, "u", "é" * 50), (4, "v", "é" * 50), (None, "w", "é" * 50), (None, "w", "zz"), (5, "z", "x" * 200_000), (3, "u", "é" * 50)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS id")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, compression):
    path = w.write_archive(w.crawl_records(pages(spark), min_bytes=10), compression=compression, file_bytes="100000")
    rows = w.read_archive(spark, path, verify="true", partition_bytes="1").collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        if r["record_type"] == "response":
            assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
            assert r["payload_bytes"] == len(r["payload"])
    kinds = sorted((str(r["record_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in rows)
    assert kinds == sorted([
        ("<urn:record:1>", "response", "None", 0), ("<urn:record:2>", "response", "None", 0), ("<urn:record:3>", "response", "None", 100),
        ("<urn:record:3>", "response", "None", 100), ("<urn:record:4>", "revisit", "<urn:record:3>", 100), ("<urn:record:null>", "revisit", "<urn:record:3>", 100),
        ("<urn:record:null>", "response", "None", 2), ("<urn:record:5>", "response", "None", 200_000),
    ])
    assert {r["target_uri"] for r in rows} == {"http://x%0D%0AA: b", None, "u", "v", "w", "z"}


def test_predicates_are_pushed_and_payloads_skipped(spark):
    path = w.write_archive(w.crawl_records(pages(spark), min_bytes=10))
    df = w.read_archive(spark, path, payload="false")
    assert df.filter("record_type = 'revisit' AND target_uri LIKE 'v%'").count() == 1
    assert df.filter("refers_to IS NULL").count() == 6
    assert df.filter("record_type IN ('revisit', 'warcinfo')").count() == 2
    assert df.filter("payload IS NOT NULL").count() == 0
    reader = w.WarcReader({"path": path})
    rest = list(reader.pushFilters([w.EqualTo(("record_type",), "revisit"), w.EqualTo(("payload_bytes",), 3)]))
    assert len(rest) == 1 and reader.predicates == [("EqualTo", "warc-type", "revisit")]


class Counting:
    def __init__(self, data):
        import io

        self.data, self.read_bytes = io.BytesIO(data), 0

    def readline(self):
        return self.data.readline()

    def seek(self, n, how):
        return self.data.seek(n, how)

    def read(self, n):
        self.read_bytes += n
        return self.data.read(n)


def test_a_record_that_fails_is_not_read():
    row = {"record_type": "response", "record_id": "<a>", "date": "d", "target_uri": "u", "refers_to": None, "payload_bytes": 5, "payload": b"12345"}
    stream = Counting(w.record_bytes(row) * 3)
    assert list(w.records(stream, True, lambda h: False)) == [] and stream.read_bytes == 0


def test_broken_archives_are_an_error(tmp_path, spark):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100\r\n\r\nshort")
    with pytest.raises(Exception, match="without an end"):
        w.read_archive(spark, str(tmp_path)).collect()


def test_empty_table_and_foreign_file(tmp_path, spark):
    empty = w.write_archive(w.crawl_records(pages(spark).limit(0)))
    assert w.read_archive(spark, empty).count() == 0
    body = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: f\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pathlib.Path(tmp_path / "y.warc").write_bytes(body * 2)
    rows = w.read_archive(spark, str(tmp_path)).collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [("resource", b"abc")] * 2
