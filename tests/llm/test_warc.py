import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

TABLE = "page_id long, url string, html string, `first` long, sha1 string, id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TABLE).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (3, "http://a/3", "<p>same</p>"),
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>same</p>"),
    (4, None, None),
    (5, "http://a/5\r\nX: y", ""),
    (6, "http://ü/6", "ü日\U0001f600\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (None, "http://a/n", "no id"),
    (None, "http://a/n", "<p>same</p>"),
    (7, "http://a/7", "long " * 300_000),
    (8, "http://a/8", "once"),
    (8, "http://a/8", "once"),
    (8, "http://a/8b", "twice"),
]


def expected(rows):
    out = []
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        revisit = first is not None and first != i
        kind, to = ("revisit", first) if revisit else ("response", None)
        out.append((i, len((html or "").encode()), digest(html), kind, to))
    return sorted(map(str, out))


def test_round_trip(spark):
    found = warc.archived(pages(spark, ROWS))
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(ROWS)


def test_empty(spark):
    assert not warc.archived(pages(spark, [])).count()


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_and_predicates(spark, tmp_path, compression):
    path = f"{tmp_path}/archive"
    warc.write_pages(pages(spark, ROWS), path, compression)

    def read(payload):
        return warc.read_records(spark, path, payload)

    texts = {r.record_id: r.payload for r in read("bytes").filter("record_type = 'response'").collect()}
    assert bytes(texts["urn:x-page:6"]).decode() == ROWS[5][2]
    assert bytes(texts["urn:x-page:7"]).decode() == ROWS[8][2]
    assert read("none").count() == len(ROWS)
    assert all(r.payload is None and r.payload_bytes is None for r in read("none").collect())
    revisits = read("digest").filter(F.col("record_type") == "revisit").collect()
    assert {r.record_id for r in revisits} == {"urn:x-page:3", "urn:x-page:2", "urn:x-page:null", "urn:x-page:5"}
    assert {r.payload_bytes for r in revisits} == {0, 11} and all(r.computed_digest is None for r in revisits)
    one = read("bytes").filter(F.col("target_uri").startswith("http://a/8") & (F.col("payload_bytes") > 4))
    assert [bytes(r.payload) for r in one.collect()] == [b"twice"]
    two = read("none").filter(F.col("record_id").isin("urn:x-page:1", "urn:x-page:7"))
    assert two.count() == 2
    assert read("digest").filter(F.col("payload_digest") == digest("once")).count() == 2


def test_predicates_are_pushed(spark, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_pages(pages(spark, ROWS), path)
    plan = warc.read_records(spark, path).filter("record_type = 'revisit' and offset > 1")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in text and "revisit" not in text.split("Filter", 1)[1].split("BatchScan")[0]


def test_unwanted_payloads_are_not_read(tmp_path):
    """A record that is stepped over costs its headers only."""
    from pyarrow import fs

    rows = [
        {"record_type": kind, "record_id": f"urn:{i}", "target_uri": None, "date": "d", "refers_to": "urn:0",
         "digest": "x", "payload": bytes(3_000_000), "payload_bytes": 3_000_000}
        for i, kind in enumerate(["response", "response", "other"])
    ]
    path = f"{tmp_path}/plain.warc"
    with open(path, "wb") as file:
        file.write(b"".join(warc._record(row, False) for row in rows))
    window = warc.Window(fs.LocalFileSystem().open_input_file(path))
    read = []
    whole = window.file.read

    class Counted:
        seek = window.file.seek

        @staticmethod
        def read(count):
            read.append(count)
            return whole(count)

    window.file = Counted()
    kinds = [h["warc-record-id"] for _, h, *_ in warc.records(window, False, lambda h: h["warc-type"] == "other")]
    assert kinds == ["<urn:2>"] and sum(read) <= 3 * warc.WINDOW_BYTES


def test_foreign_files(spark, tmp_path):
    """Members without a noted length, several in one file, and blocks that are not HTTP."""
    def record(i, kind, block, extra=""):
        return (
            f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\n{extra}"
            f"Content-Length: {len(block)}\r\n\r\n"
        ).encode() + block + b"\r\n\r\n"

    info = record(0, "warcinfo", b"software: x")
    http = record(1, "response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", "Content-Type: application/http\r\n")
    long = record(2, "resource", b"z" * 100_000, f"X-Pad: {'p' * 9000}\r\n")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (info, http, long)))
    (tmp_path / "b.warc").write_bytes(info + http + long)
    rows = warc.read_records(spark, str(tmp_path), "bytes").collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in rows) == sorted(
        2 * [("urn:0", b"software: x"), ("urn:1", b"body"), ("urn:2", b"z" * 100_000)]
    )
    assert len({r.file for r in rows}) == 2


def test_files_are_bounded_and_committed(spark, tmp_path):
    path = f"{tmp_path}/archive"
    rows = spark.range(50).selectExpr(
        "'response' record_type", "concat('urn:x-page:', id) record_id", "cast(null as string) target_uri",
        "'d' `date`", "cast(null as string) refers_to", "'x' digest", "1000L payload_bytes",
        "cast(repeat('p', 1000) as binary) payload",
    )
    spark.dataSource.register(warc.WarcSource)
    write = rows.coalesce(1).write.format("warc").option("path", path).option("compression", "none")
    write.option("file_bytes", 10_000).mode("append").save()
    (tmp_path / "archive" / "left-over.warc").write_bytes(b"of a lost task")
    found = warc.read_records(spark, path)
    assert found.count() == 50 and found.select("file").distinct().count() > 4


def record(number, block, length=None, kind="response"):
    length = "" if length is None else f"Content-Length: {length}\r\n"
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{number}>\r\n{length}\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_back(spark, path, payload="bytes"):
    found = warc.read_records(spark, str(path), payload).orderBy("offset").collect()
    return [(r.record_id, None if r.payload is None else bytes(r.payload), r.error) for r in found]


@pytest.mark.parametrize("length", ["abc", "-40", None, "", "3", "99", "1e3", "9" * 30])
def test_a_wrong_length_spoils_one_record_only(spark, tmp_path, length):
    good = [record(i, b"block %d" % i, 7) for i in range(3)]
    bad = record(9, b"a block of its own", length)
    (tmp_path / "a.warc").write_bytes(good[0] + bad + good[1] + good[2])
    found = read_back(spark, tmp_path)
    assert found == [("urn:0", b"block 0", None), ("urn:9", None, "length")] + [
        (f"urn:{i}", b"block %d" % i, None) for i in (1, 2)
    ]


@pytest.mark.parametrize("length", ["abc", "-40", None])
def test_a_member_bounds_a_record_of_unknown_length(spark, tmp_path, length):
    parts = [record(0, b"zero", 4), record(9, b"a block", length), record(1, b"one", 3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    assert read_back(spark, tmp_path) == [
        ("urn:0", b"zero", None), ("urn:9", b"a block", "length"), ("urn:1", b"one", None),
    ]


def own_members(count):
    return [
        warc._record(
            {"record_type": "response", "record_id": f"urn:{i}", "target_uri": "u", "date": "d", "refers_to": None,
             "digest": "x", "payload": bytes([i]) * 9000 + bytes(range(256)) * 40, "payload_bytes": 19240}, True
        )
        for i in range(count)
    ]


@pytest.mark.parametrize("place", [0, 3, 12, 17, 30, 60, 120, -6, -2])
@pytest.mark.parametrize("noted", [True, False])
def test_a_damaged_member_spoils_one_record_only(spark, tmp_path, place, noted):
    members = own_members(4)
    if not noted:
        members = [gzip.compress(gzip.decompress(x)) for x in members]
    members[1] = bytearray(members[1])
    members[1][place] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(bytes, members)))
    found = read_back(spark, tmp_path)
    whole = {i: bytes([i]) * 9000 + bytes(range(256)) * 40 for i in range(4)}
    for i in (0, 2, 3):
        assert (f"urn:{i}", whole[i], None) in found
    # The record itself comes out whole, or with an error and nothing made up.
    rest = [r for r in found if r[0] not in ("urn:0", "urn:2", "urn:3")]
    assert all((r[1] == whole[1] and r[2] is None) or (r[1] is None and r[2]) for r in rest)
    assert warc.read_records(spark, str(tmp_path), "none").filter("record_id = 'urn:3'").count() == 1


@pytest.mark.parametrize("keep", [1, 20, 100, 200, -3])
@pytest.mark.parametrize("packed", [True, False])
def test_a_file_cut_off(spark, tmp_path, keep, packed):
    parts = [record(0, b"zero" * 100, 400), record(1, random.Random(1).randbytes(400), 400)]
    last = gzip.compress(parts[1]) if packed else parts[1].removesuffix(b"\r\n\r\n")
    first = gzip.compress(parts[0]) if packed else parts[0]
    last = last[:keep]
    (tmp_path / f"a.warc{'.gz' if packed else ''}").write_bytes(first + last)
    found = read_back(spark, tmp_path)
    assert found[0] == ("urn:0", b"zero" * 100, None)
    assert len(found) == 2 and found[1][1] is None and found[1][2] in ("cut", "gzip", "length")


def test_not_an_archive(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"\x00" * 100_000)
    (tmp_path / "b.warc.gz").write_bytes(b"\x1f\x8b\x08" * 10_000)
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read_records(spark, str(tmp_path), "bytes").collect()
    assert [(r.record_id, r.payload) for r in found] == [(None, None)] * 2 and all(r.error for r in found)


def test_single_payloads_are_not_shuffled(spark, tmp_path):
    """Where few digests repeat, what is shuffled before the archive is written is far below the payloads."""
    rows = spark.range(2000).selectExpr("id page_id", "'u' url", "repeat(cast(id as string), 2000) html")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lean", "lean")
    warc.write_pages(rows, f"{tmp_path}/x")
    store = spark._jsc.sc().statusStore()
    stages = [i for j in tracker.getJobIdsForGroup("lean") for i in tracker.getJobInfo(j).stageIds]
    written = sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in stages if tracker.getStageInfo(i))
    assert written < 1_000_000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
