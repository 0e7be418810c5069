import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.llm import storage, warc

PAGE = "<html>" + "é" * 100
ROWS = [
    (7, "http://a/", PAGE, "x"), (3, "http://b/ü?q=1 2\r\nX: y", PAGE, "x"), (5, None, PAGE, "x"), (None, "http://n/", PAGE, "x"),
    (9, "u", "", "x"), (10, "u", None, "x"), (11, "u", "short", "x"), (12, "u", "short", "x"),
    (13, "u", "z" * 300_000, "x"), (14, "u", "alone" * 40, "x"), (15, "u", "w" * 100, "x"), (15, "u", "w" * 100, "x"), (16, "u", "\r\n\r\nWARC/1.1\r\n" * 20, "x"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    path = storage.new_path(spark, "warc")
    warc.write_warc(pages(spark, ROWS), path)
    out = warc.read_warc(spark, path).collect()
    assert len(out) == len(ROWS)
    html = {i: h or "" for i, _, h, _ in ROWS}
    for r in out:
        data = html[r.page_id].encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        first = min(i for i, _, h, _ in ROWS if i is not None and (h or "") == html[r.page_id])
        if len(data) >= 100 and r.page_id != first:
            assert r.record_type == "revisit" and r.refers_to == first and r.payload is None
        else:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == data
    assert {r.page_id: r.url for r in out if r.page_id is not None} == {i: u for i, u, *_ in ROWS if i is not None}


def test_pushed_filters_skip_payloads(spark):
    path = storage.new_path(spark, "warc")
    warc.write_warc(pages(spark, ROWS), path)
    found = warc.read_warc(spark, path).where((F.col("record_type") == "revisit") & F.col("page_id").isin(5, 7, 9))
    assert sorted(r.page_id for r in found.collect()) == [5, 7]
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0


def test_null_ids_and_empty_tables(spark):
    path = storage.new_path(spark, "warc")
    warc.write_warc(pages(spark, [(None, "u", PAGE, "x"), (None, "v", PAGE, "x")]), path)
    assert [(r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()] == [("response", None)] * 2
    empty = storage.new_path(spark, "warc")
    warc.write_warc(pages(spark, []), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_byte_ranges_of_an_archive(spark, monkeypatch):
    rows = [(k, "u", f"{k} " * (k % 50 + 30), "x") for k in range(200)]
    parts = {}
    for size in (warc.SPLIT_BYTES, 2_000, 1):
        monkeypatch.setattr(warc, "SPLIT_BYTES", size)
        writer = warc.WarcWriter({"path": storage.new_path(spark, "warc")})
        monkeypatch.setattr(warc.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})()))
        batch = pa.RecordBatch.from_pylist([{"record_type": "response", "page_id": i, "url": u, "payload_digest": hashlib.sha256(h.encode()).hexdigest(), "payload_bytes": len(h), "refers_to": None, "payload": h.encode()} for i, u, h, _ in rows])
        writer.commit([writer.write(iter([batch]))])
        reader = warc.WarcReader({"path": writer.path}, warc.T.StructType.fromDDL(warc.SCHEMA))
        found = [list(reader.read(p)) for p in reader.partitions()]
        parts[size] = len(found)
        assert [(r["page_id"], r["payload"].decode()) for part in found for b in part for r in b.to_pylist()] == [(i, h) for i, _, h, _ in rows]
    assert parts[warc.SPLIT_BYTES] == 200 and 1 < parts[2_000] < 200


def test_a_hot_payload_is_split(spark):
    """A third of all payloads equal: the join with a digest's first page is split, and no payload meets it."""
    spread = spark.range(60_000).repartition(32).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, repeat('hot', 50), concat(repeat('p', 100), id % 20000)) as html")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2048", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        records = warc.as_records(spread)
        found = records.groupBy("record_type").count().collect()
        plan = records.groupBy("record_type").count()
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in text
    hot, rest = 20_000 - 1, 40_000 - len({k % 20_000 for k in range(60_000) if k % 3})
    assert {r.record_type: r["count"] for r in found} == {"revisit": hot + rest, "response": 60_000 - hot - rest}


def test_headers_longer_than_one_read():
    import io

    head = warc.header_lines("response", 1, "http://x/" + "a" * 9000, "d" * 64, 4, None, "2024-01-01T00:00:00Z", 4)
    data = warc.member(head + b"body\r\n\r\n", 1) * 2
    assert [(f["page_id"], p()) for f, p in warc.Records(io.BytesIO(data))] == [(1, b"body")] * 2


def foreign(page_id, body):
    return warc.header_lines("response", page_id, "http://x/", "d" * 64, len(body), None, "2024-01-01T00:00:00Z", len(body)) + body + b"\r\n\r\n"


def test_archives_from_elsewhere(spark, tmp_path):
    import gzip
    import os

    bodies = [b"one", b"", os.urandom(300_000), b"\r\n\r\nWARC/1.1\r\n" * 500, b"z" * 2_000_000]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc").write_bytes(b"".join(foreign(k, b) for k, b in enumerate(bodies)))
    (tmp_path / "sub" / "b.warc.gz").write_bytes(b"".join(gzip.compress(foreign(10 + k, b)) for k, b in enumerate(bodies)))
    (tmp_path / "notes.txt").write_text("no archive")
    out = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    assert out == {k: b for k, b in enumerate(bodies)} | {10 + k: b for k, b in enumerate(bodies)}
    assert sorted(r.page_id for r in warc.read_warc(spark, f"file://{tmp_path}", payload=False).where("page_id in (2, 14)").collect()) == [2, 14]


def test_damage_is_noticed():
    import io

    import pytest

    good = warc.member(foreign(1, b"body" * 100), 1)
    for bad in (good[:-3], good[:60] + bytes([good[60] ^ 255]) + good[61:], b"junk" + good):
        with pytest.raises(Exception):
            [p() for _, p in warc.Records(io.BytesIO(bad))]


def test_long_payloads_are_passed_over_and_read_whole(spark, tmp_path):
    import random

    rnd = random.Random(1)
    long = "".join(chr(rnd.randrange(33, 0x2FF)) for _ in range(3_000_000))  # does not compress
    rows = [(1, "a", long), (2, "b", long), (3, "c", "short " * 30), (4, "d", long[1:]), (5, "e", None)]
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    back = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
    assert back == {k: (t or "").encode() for k, _, t in rows if k != 2}
    names = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")]

    class Counting:
        def __init__(self, name):
            self.f, self.read_bytes = open(name, "rb"), 0

        def read(self, n):
            out = self.f.read(n)
            self.read_bytes += len(out)
            return out

        def seek(self, n, whence=0):
            return self.f.seek(n, whence)

    sources = [Counting(n) for n in names]
    assert sorted(f["page_id"] for s in sources for f, _ in warc.Records(s, chunk=warc.HEAD_CHUNK)) == [1, 2, 3, 4, 5]
    assert sum(s.read_bytes for s in sources) < sum(n.stat().st_size for n in names) / 20
