import base64
import hashlib
from collections import Counter, defaultdict

import pytest

from quillspark.llm import warc
from quillspark.llm.common import scratch_path

ROWS = [(1, "u1", "<p>é</p>", 9), (2, "u2", "<p>é</p>", 9), (3, "u\r\nX: 3", None, 9), (4, None, "", 9), (5, "u5", "🙂" * 3000, 9), (5, "u5", "🙂" * 3000, 9), (None, "u6", "lone", 9), (None, "u6", "<p>é</p>", 9)]
SCHEMA = "page_id long, url string, html string, payload int"


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, h, _ in rows:
        groups[(h or "").encode()].append(i)
    out = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known and len(ids) > 1 and len(body) >= least else None
        for i in ids:
            revisit = top is not None and i != top
            out[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 1, 10])
def test_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert Counter(tuple(r) for r in warc.archive_round_trip(df, revisit_from=least).collect()) == brute(ROWS, least)


def test_exact_records(spark):
    path = scratch_path(spark, "t")
    df = spark.createDataFrame(ROWS[:5], SCHEMA).selectExpr("*", "timestamp'2024-05-06 07:08:09' as seen")
    warc.write_archive(df, path, date="seen")
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = warc.read_archive(spark, path)
    got = {r.page_id: bytes(r.record) for r in warc.record_bytes(records).collect()}
    empty = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert got[4] == f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4:{empty}>\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nWARC-Target-URI: \r\nWARC-Payload-Digest: sha1:{empty}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()
    sha1 = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest())
    assert b"WARC-Refers-To: <urn:page:2:" + sha1 + b">\r\n" in got[1] and b"WARC-Record-ID: <urn:page:2:" + sha1 + b">\r\n" in got[2]
    assert b"Content-Length: 0\r\n\r\n\r\n\r\n" in got[1]
    assert b"u%0D%0AX: 3\r\n" in got[3]
    assert {r.page_id: bytes(r.payload).decode() for r in records.collect()} == {i: h or "" for i, _, h, _ in ROWS[:5]}
    # The stored header block is the record's own, byte by byte.
    stored = {r.page_id: bytes(r.headers) for r in spark.read.parquet(f"{path}/records").collect()}
    assert all(got[i].startswith(h + b"\r\n") and got[i].endswith(b"\r\n\r\n") for i, h in stored.items())
    for i, record in got.items():
        head, _, block = record[:-4].partition(b"\r\n\r\n")
        lengths = [int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")]
        assert lengths == [len(block)], i


URLS = ["u{}WARC-Refers-To: <urn:page:77:X>", "u{}Content-Length: 999", "http://x/?Content-Length: 5{}", "a{}WARC-Type: revisit{}"]


def test_urls_cannot_write_headers(spark):
    ends = ["\x85", "\u2028", "\u2029", "\r\n", "\n", "\r", "\x0b", "\x0c", "\x00", ""]
    rows = [(i, u.replace("{}", e), f"<p>{i % 23}</p>", 0) for i, (u, e) in enumerate((u, e) for u in URLS for e in ends)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(r) for r in warc.archive_round_trip(df).collect()) == brute(rows)
    path = scratch_path(spark, "t")
    warc.write_archive(df, path)
    for r in warc.record_bytes(warc.read_archive(spark, path)).collect():
        head, _, block = bytes(r.record)[:-4].decode().partition("\r\n\r\n")
        names = [line.split(": ")[0] for line in head.splitlines()[1:]]
        assert len(set(names)) == len(names) and f"\r\nContent-Length: {len(block)}" in head
        assert "\r\nWARC-Date: 20" in head


def test_damage_is_noticed(spark):
    path = scratch_path(spark, "t")
    warc.write_archive(spark.createDataFrame(ROWS[:2], SCHEMA), path)
    spark.createDataFrame([("0" * 64, b"x")], "sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="no whole payload|damaged payload"):
        warc.read_archive(spark, path).collect()


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
