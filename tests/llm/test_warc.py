import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc


def brute(rows, min_bytes=0):
    """Type and target of each record by comparing all payloads."""
    result = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None] if len(data) >= min_bytes else []
        other = max(same) if same and max(same) != page else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        result.append((page, len(data), digest, "revisit" if other is not None else "response", other))
    return sorted(result, key=str)


def test_round_trip_is_brute_force(spark, tmp_path):
    rng = random.Random(2)
    bodies = ["<p>é</p>", "", "x" * 5000, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "\x00\r\n"]
    rows = [(i, f"http://h/{i}\r\nEvil: 1", rng.choice(bodies) + (str(i) if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100, None, None), (101, "http://x", None), (None, "http://y", bodies[0]), (59, "http://z", "again"), (59, "http://z", "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers", F.lit(1)).repartition(3)
    archives = warc.write_archives(warc.with_revisits(df), str(tmp_path))
    files = warc.normalise(archives)
    got = warc.read_records(files)
    cols = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == brute(rows)
    held = {r.id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert all(held[p] == (h or "").encode() for p, _, h in rows if p in held and p != 59)
    assert got.where("url like '%Evil%'").count() == 60 and got.where("url like '%\\n%'").count() == 0
    for r in archives.collect():
        whole = gzip.open(r.path).read()
        new = r.path.removesuffix(".warc.gz") + "-members.warc.gz"
        assert gzip.open(new).read() == whole  # the same stream, cut into members
        index = [line.split("\t") for line in open(new + ".idx").read().splitlines()]
        data = open(new, "rb").read()
        parts = [gzip.decompress(data[int(o) : int(o) + int(n)]) for o, n, _, _ in index]
        assert b"".join(parts) == whole and len(index) == r.n_records
        assert all(warc.parse(p)[0]["warc-record-id"] == name for p, (_, _, _, name) in zip(parts, index))


def test_min_bytes_and_empty(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.with_revisits(df, min_bytes=5).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    none = warc.write_archives(warc.with_revisits(df.where(F.lit(False))), str(tmp_path))
    assert warc.read_records(warc.normalise(none)).count() == 0


def test_streams_of_any_shape():
    some = [warc.record(i, "u", bytes([i]) * i * 40, None, "d") for i in range(30)]
    one, many = gzip.compress(b"".join(some)), b"".join(map(gzip.compress, some))
    for data in (one, many, many[: len(many)] + b"\0\0"):
        for size in (1, 7, 1 << 18):
            assert list(warc.records(warc.inflated(io.BytesIO(data).read, size))) == some
    with pytest.raises(EOFError):
        list(warc.records(warc.inflated(io.BytesIO(one[:-9]).read)))
    cut = gzip.compress(b"".join(some)[:-60])
    with pytest.raises(EOFError):
        list(warc.records(warc.inflated(io.BytesIO(cut).read)))


def test_any_names(spark):
    df = spark.createDataFrame([(1, "u", "x", 5, "k", 7), (2, "v", "x", 6, "l", 8)], "page_id long, url string, html string, Refers_To int, `_key` string, `_last` int")
    got = warc.with_revisits(df)
    assert got.columns == ["page_id", "url", "html", "_key", "_last", "refers_to"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "u", "x", "k", 7, 2), (2, "v", "x", "l", 8, None)]
