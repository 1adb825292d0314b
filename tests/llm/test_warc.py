"""WARC archives: exact round trip, predicates, skipped payloads, foreign files."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import warc

SCHEMA = "page_id long, url string, html string"
BIG = "é<p>" * 400


def pages():
    return [
        (1, "http://a.com/x", BIG),
        (2, "http://a.com/y\r\nInjected: 1", BIG),
        (3, None, BIG),
        (3, None, BIG),
        (4, "http://b.com/", "small"),
        (5, "http://b.com/2", "small"),
        (6, "u", None),
        (7, "u", ""),
        (None, "http://n.com", BIG),
        (None, "http://n.com", BIG + "x"),
        (None, "http://n.com", BIG + "x"),
        (8, "u", "WARC/1.1\r\n\r\n" + BIG),
    ]


def written(spark, tmp_path, rows=None, schema=SCHEMA):
    path = str(tmp_path / "archive")
    warc.write_archives(warc.page_records(spark.createDataFrame(pages() if rows is None else rows, schema)), path)
    return path


def test_round_trip(spark, tmp_path):
    path = written(spark, tmp_path)
    got = warc.read_archives(spark, path).withColumn("page_id", warc.page_id_of(F.col("record_id"))).collect()
    assert len(got) == len(pages())
    big = hashlib.sha1(BIG.encode()).hexdigest()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to or "") for r in got if r.payload_digest == big)
    three = "<urn:x-page:3>"
    assert kinds == [
        ("1", "revisit", three), ("2", "revisit", three), ("3", "response", ""), ("3", "response", ""), ("None", "revisit", three),
    ]
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_length
        else:
            assert r.payload is None and r.payload_length == len(BIG.encode())
    texts = sorted(bytes(r.payload) for r in got if r.record_type == "response")
    want = [(h or "").encode() for _, _, h in pages()]
    for t in [BIG.encode()] * 3:
        want.remove(t)
    assert texts == sorted(want)
    assert any(r.target_uri == "http://a.com/y%0D%0AInjected: 1" for r in got)


def test_predicates_reach_the_reader(spark, tmp_path):
    path = written(spark, tmp_path)
    df = warc.read_archives(spark, path)
    assert df.where("record_type = 'revisit'").count() == 3
    assert df.where("target_uri like 'http://b.com/%'").count() == 2
    assert df.where("refers_to is null and record_type in ('response', 'other')").count() == 9
    assert df.where("payload_length > 1000 and record_type = 'response'").count() == 5
    assert {r.payload for r in warc.read_archives(spark, path, payload=False).collect()} == {None}


def test_unwanted_payloads_stay_packed():
    big = warc.gzip_member(warc.record_bytes({
        "record_type": "response", "record_id": "<a>", "target_uri": None, "payload_digest": "0", "refers_to": None,
        "payload_length": 1 << 22, "payload": bytes(range(256)) * (1 << 14)}))

    class Counting(io.BytesIO):
        read_bytes = 0

        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            got = super().read(n)
            Counting.read_bytes += len(got)
            return got

    noise = __import__("os").urandom(1 << 20)
    raw = warc.gzip_member(warc.record_bytes({
        "record_type": "response", "record_id": "<b>", "target_uri": None, "payload_digest": "0", "refers_to": None,
        "payload_length": 1 << 20, "payload": noise}))
    rows = list(warc.read_records(Counting(raw * 3 + big), lambda r: r["record_id"] == "<a>"))
    assert [r["record_id"] for r in rows] == ["<a>"] and len(rows[0]["payload"]) == 1 << 22
    assert Counting.read_bytes < 200_000


@pytest.mark.parametrize("suffix", [".warc", ".warc.gz"])
def test_foreign_files(spark, tmp_path, suffix):
    """Other writers: no skip lengths, base-32 digests, unknown records, plain files."""
    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http\r\n"
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    one = head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    parts = [info, one, one]
    data = b"".join(gzip.compress(p) for p in parts) if suffix.endswith("gz") else b"".join(parts)
    (tmp_path / f"x{suffix}").write_bytes(data)
    got = warc.read_archives(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert [(bytes(r.payload), r.payload_digest) for r in got] == [(b"body", hashlib.sha1(b"body").hexdigest())] * 2


def record(kind, body, more=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{body[:4]}>\r\n{more}Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body.encode() + b"\r\n\r\n"


def opened(data):
    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    return File(data)


def test_members_of_many_records():
    """A member may hold one record, some, or the whole archive; unwanted ones in between are passed over."""
    bodies = [f"{i:04d}" + "x" * (i * 977 % 70_000) for i in range(40)]
    parts = [record("response" if i % 3 else "request", b) for i, b in enumerate(bodies)]
    for cuts in ([40], [1, 39], [7, 1, 1, 20, 11], [1] * 40):
        data, at = b"", 0
        for n in cuts:
            data += gzip.compress(b"".join(parts[at : at + n]))
            at += n
        got = list(warc.read_records(opened(data)))
        assert [r["payload"].decode() for r in got] == bodies
        some = list(warc.read_records(opened(data), lambda r: r["record_id"] in ("<0000>", "<0017>", "<0039>")))
        assert [r["payload"].decode() for r in some] == [bodies[0], bodies[17], bodies[39]]
        assert len(list(warc.read_records(opened(data), with_payload=False))) == 40


def test_a_cut_archive_is_an_error():
    whole = [record("response", "body" * 5000), record("response", "tail" * 5000)]
    for data in (gzip.compress(b"".join(whole)), b"".join(map(gzip.compress, whole)), b"".join(whole)):
        assert len(list(warc.read_records(opened(data)))) == 2
        with pytest.raises(ValueError):
            list(warc.read_records(opened(data[:-40])))


def test_a_second_write_adds_and_overwriting_replaces(spark, tmp_path):
    path = written(spark, tmp_path)
    warc.write_archives(warc.page_records(spark.createDataFrame([(90, "u", "more")], SCHEMA)), path)
    assert warc.read_archives(spark, path).count() == len(pages()) + 1
    one = warc.page_records(spark.createDataFrame([(91, "u", "only")], SCHEMA))
    one.write.format("warc").mode("overwrite").save(path)
    assert [bytes(r.payload) for r in warc.read_archives(spark, path).collect()] == [b"only"]


def test_empty_table_and_extra_columns(spark, tmp_path):
    assert warc.read_archives(spark, written(spark, tmp_path, [])).count() == 0
    rows = [(1, "u", "x", "clash", 3)]
    path = written(spark, tmp_path / "b", rows, SCHEMA + ", payload string, owner int")
    assert warc.read_archives(spark, path).count() == 1


def test_only_committed_files_count(spark, tmp_path):
    path = written(spark, tmp_path)
    (tmp_path / "archive" / "part-stray.warc.gz").write_bytes(b"not an archive")
    assert warc.read_archives(spark, path).count() == len(pages())
