"""Streams of many units: the queries on them within a time that only work in proportion to their length keeps, and the pieces they are written and read by."""

import io
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumaframe.operators.sequences import sessions
from lumaframe.plans import catalogue, format_queries
from lumaframe.sources import annexb


@pytest.fixture(scope="module")
def long_sf(tmp_path_factory):
    """A folder with 200,000 events of one type."""
    path = tmp_path_factory.mktemp("long")
    duckdb.sql(f"COPY (SELECT i AS event_id, i % 500 AS user_id, 'view' AS event_type, i / 7 AS value FROM range(200000) r(i)) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["read_access_units", "read_slices", "read_timing"])
def test_a_long_stream_takes_time_in_proportion(spark, long_sf, tmp_path, name):
    began = time.time()
    catalogue.QUERIES[name](spark, long_sf).write.parquet(str(tmp_path / "got"))
    assert time.time() - began < 60
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{long_sf}/events.parquet'")
    c.execute(f"CREATE TABLE want AS {catalogue.ORACLES[name]}")
    c.execute(f"CREATE TABLE got AS SELECT {', '.join(chr(34) + r[0] + chr(34) for r in c.execute('DESCRIBE want').fetchall())} FROM '{tmp_path}/got/*.parquet'")
    for a, b in (("got", "want"), ("want", "got")):
        assert c.execute(f"SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b})").fetchone() == (0,)


def test_units_written_together_are_those_written_one_by_one():
    """With numbers of all lengths, and every place at which zeros of the delays or of the slice call for a 3."""
    rnd = random.Random(1)
    for first in (0, 32760, 65500, rnd.randrange(1 << 20)):
        n = np.array([rnd.randrange(1 << rnd.choice((3, 9, 20, 33, 49, 52, 60))) for _ in range(2000)] + [21846 * k for k in range(50)])
        assert format_queries._timed_all(first, n) == b"".join(format_queries._timed(first + k, v) for k, v in enumerate(n.tolist()))


def test_a_stream_is_read_alike_by_chunks_of_any_size(spark, monkeypatch):
    schema = to_arrow_schema(spark.createDataFrame([], annexb.SCHEMA).schema)
    rnd = random.Random(2)
    for _ in range(300):
        data = b"\x00" * rnd.randrange(3) + b"".join(rnd.choice((b"\x00\x00\x01", b"\x00\x00\x00\x01")) + bytes([rnd.choice((0x65, 0x41, 0x67, 6, 0))]) + b"\x90" * 9 + bytes(rnd.choice((0, 0, 3, 200)) for _ in range(rnd.randrange(9))) + b"\x80" for _ in range(1 + rnd.randrange(6)))
        want = []
        for n, (start, body, end) in enumerate(annexb.split(data)):
            rbsp = annexb.unescape(data[body + 1 : end])
            kind = data[body] & 31
            want.append(("s", n, start, end - start, end - body, kind, data[body] >> 5 & 3, annexb.Bits(rbsp[:9]).ue() if kind in (1, 5) else None, rbsp))
        for size in (1, 5, 1 << 20):
            monkeypatch.setattr(annexb, "CHUNK", size)
            assert [tuple(r.values()) for b in annexb.batches("s", io.BytesIO(data), schema) for r in b.to_pylist()] == want
    for bad in (b"abc", b"\x00\x00\x01\x00\x00\x01\x41\x80", b"\x00\x00\x01\x41", b"\x00\x00\x01\x41\x00\x00"):
        with pytest.raises(ValueError):
            list(annexb.batches("s", io.BytesIO(bad), schema))


def test_headers_follow_the_last_set_of_their_own_stream(spark):
    """Two sets of other lengths in a stream, slices before the first, another stream without any, rows in any order and small batches."""
    sets = [format_queries._unit(0x67, [(66, 8), (0, 8), (30, 8), (0, 0), (w, 0), (0, 0), (w, 0), (1, 0), (0, 1), (w, 0), (8, 0), (1, 1), (0, 1), (0, 1), (0, 1)])[5:] for w in (1, 7)]
    slice_ = lambda key, number, w: format_queries._unit(0, [(0, 0), (7, 0), (0, 0), (number, 4 + w), *([(5, 0)] if key else []), (number, 4 + w)])[5:]
    rows = [("a", 0, 1, slice_(0, 3, 1)), ("a", 1, 7, sets[0]), ("a", 2, 5, slice_(1, 17, 1)), ("a", 3, 9, b""), ("a", 4, 7, sets[1]), ("a", 5, 1, slice_(0, 1900, 7)), ("a", 6, 7, sets[0]), ("a", 7, 1, slice_(0, 30, 1)), ("b", 0, 5, slice_(1, 1, 1)), ("b", 1, 6, b"\x06\x01\xa0\x80")]
    random.Random(4).shuffle(rows)
    nals = spark.createDataFrame([(s, q, t, bytearray(x)) for s, q, t, x in rows], "stream string, seq int, type int, rbsp binary").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "2000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r.stream, r.seq): r for r in annexb.headers(nals).collect()}
            assert len(got) == 10
            assert [r.by and r.by.width for _, r in sorted((((r.stream, r.seq), r) for r in annexb.headers(nals, with_set=True).collect()), key=lambda x: x[0])] == [None, 32, 32, 32, 128, 128, 32, 32, None, None]
            assert {k: (r.slice.frame_num, r.slice.idr_pic_id, r.slice.poc_lsb, r.slice.slice_type) for k, r in got.items() if r.slice} == {("a", 2): (17, 5, 17, 2), ("a", 5): (1900, None, 1900, 2), ("a", 7): (30, None, 30, 2)}
            assert {k: (r.sps.width, r.sps.bit_rate) for k, r in got.items() if r.sps} == {("a", 1): (32, None), ("a", 4): (128, None), ("a", 6): (32, None)}
            assert {k: [(m.type, m.size, m.recovery) for m in r.sei] for k, r in got.items() if r.sei is not None} == {("b", 1): [(6, 1, 0)]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_messages_of_many_units():
    hrd = {"vui": {"vcl": {"initial_length": 24, "removal_length": 16, "output_length": 8}}}
    units = [b"\x00\x04\x80\x00\x00\x90\x01\x03\x00\x05\x07\x80", b"\x80", b"\xff\x06\xff\x01" + b"x" * 256 + b"\x06\x01\xff\x80", b"\x01\x03\xff\xff\xff"]
    edges, data = np.cumsum([0, *map(len, units)]), np.frombuffer(b"".join(units), np.uint8)
    got = annexb.messages(data, edges[:-1], edges[1:], hrd)
    assert list(zip(*(v.tolist() for v in got.values()))) == [(0, 0, 4, 1 << 0, -1, -1, -1), (0, 1, 3, -1, 5, 7, -1), (2, 261, 256, -1, -1, -1, -1), (2, 6, 1, -1, -1, -1, 0), (3, 1, 3, -1, 65535, 255, -1)]
    assert annexb.messages(data, edges[:-1], edges[1:], None)["removal_delay"].tolist() == [-1] * 5
    for bad in (b"\x01", b"\x01\x05abc", b"\xff", b"\x01\x01\x00\x80", b"\x80\x80"):
        with pytest.raises(ValueError):
            annexb.messages(np.frombuffer(bad, np.uint8), np.array([0]), np.array([len(bad)]), hrd)


def test_access_units_are_those_of_sessions_for_any_batches(spark):
    """Random types and streams in batches of one row and more, against the window form."""
    rnd = random.Random(6)
    rows = [(f"s{s}", q, rnd.randrange(30), t := rnd.choice((1, 1, 5, 6, 7, 9, 12, 2, 21)), rnd.choice((0, 0, 4)) if t in (1, 5) else None) for s in range(7) for q in range(rnd.randrange(1, 40))]
    rnd.shuffle(rows)
    nals = spark.createDataFrame(rows, "stream string, seq int, nal_size bigint, type int, first_mb int").withColumn("size", F.col("nal_size") + 4)
    slices, opens = F.col("type").isin(1, 5), F.col("type").isin(6, 7, 9)
    want = sessions(nals, "stream", "seq", opens | (slices & (F.col("first_mb") == 0)), slices).groupBy("stream", "unit").agg(F.sum("size"), F.sum(F.when(slices, F.col("nal_size")).otherwise(0)), F.array_sort(F.collect_list(F.struct("seq", "type"))))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "2000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, annexb.access_units(nals).collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
