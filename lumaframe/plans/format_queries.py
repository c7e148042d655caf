"""The text formats as round trips: each query writes files of a format from the tables and reads them back through the format's reader."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from ..functions import registration
from ..sources import annexb
from ..sources import text_formats as X
from ..tables import scratch, table
from .kernel_queries import WEIGHTS
from .registry import query

#: A file for each event type.
_E = "SELECT event_type AS kind, event_id AS n, user_id, value, CAST(floor(value * 100) AS BIGINT) AS bits FROM events"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("n"), "user_id", "value", F.floor(F.col("value") * 100).alias("bits"))


def files(rows, order, spark, label):
    """The path of text files, one for each kind, with the column line in the given order."""
    path = scratch(spark, label)
    rows.repartition("kind").sortWithinPartitions("kind", *order).select("kind", "line").write.partitionBy("kind").text(path)
    return path


def kind(df):
    return df.withColumn("kind", F.regexp_extract("file", "kind=([^/]+)/", 1)).drop("file")


@query(f"WITH e AS ({_E}) SELECT kind, CAST(user_id AS INTEGER) AS gop, CAST(row_number() OVER (PARTITION BY kind, user_id ORDER BY n) - 1 AS INTEGER) AS idx, CAST(n % 3 AS INTEGER) AS type, value AS cplx, CAST(bits AS DOUBLE) AS bits, CAST(n % 52 AS INTEGER) AS qp, CASE WHEN n % 2 = 0 THEN CAST(n % 4 AS INTEGER) ELSE -1 END AS is_ref FROM e")
def read_pass_stats(spark, sf_dir):
    """Sections of a file opened by markers, records of four and five fields, and a comment."""
    e = events(spark, sf_dir)
    text = lambda c: c.cast("string")
    record = F.concat_ws(" ", text(F.col("n") % 3), text(F.col("value")), text(F.col("bits")), text(F.col("n") % 52), F.when(F.col("n") % 2 == 0, text(F.col("n") % 4)))
    body = e.select("kind", "user_id", F.lit(1).alias("o"), "n", record.alias("line"))
    marks = e.groupBy("kind", "user_id").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c")).select("kind", "user_id", F.lit(0).alias("o"), F.lit(-1).cast("long").alias("n"), F.concat_ws(" ", F.lit("#gop"), *(text(F.col(c)) for c in ("user_id", "a", "b", "c"))).alias("line"))
    notes = e.select("kind").distinct().select("kind", F.lit(-1).cast("long").alias("user_id"), F.lit(0).alias("o"), F.lit(-2).cast("long").alias("n"), F.lit("# statistics of a first pass").alias("line"))
    return kind(X.pass_stats(spark, files(body.unionByName(marks).unionByName(notes), ["user_id", "o", "n"], spark, "stats"))).fillna(-1, ["is_ref"])


@query(f"WITH e AS ({_E}) SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY n) - 1 AS INTEGER) AS frame, bits AS size FROM e")
def read_frame_sizes(spark, sf_dir):
    return kind(X.frame_sizes(spark, files(events(spark, sf_dir).withColumn("line", F.concat_ws(",", F.lit("packet"), F.col("bits").cast("string"))), ["n"], spark, "sizes")))


@query(f"WITH e AS ({_E}) SELECT kind, CAST(n AS INTEGER) AS frame, value AS vmaf, value / 2 AS psnr_y FROM e")
def read_frame_scores(spark, sf_dir):
    """A JSON report for each kind and hundred frames."""
    e = events(spark, sf_dir).withColumn("part", F.floor(F.col("n") / 100))
    one = F.struct(F.col("n").cast("int").alias("frameNum"), F.struct(F.col("value").alias("vmaf"), (F.col("value") / 2).alias("psnr_y")).alias("metrics"))
    docs = e.groupBy("kind", "part").agg(F.to_json(F.struct(F.collect_list(one).alias("frames"))).alias("line"))
    # a JSON line is a report of its own: the reader takes whole files, so the lines of a kind are one array
    whole = docs.groupBy("kind").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("line")), F.lit("]")).alias("line"))
    return kind(X.frame_scores(spark, files(whole, [], spark, "scores")))


@query("SELECT n_name AS name, CAST(n_nationkey * 24 AS BIGINT) AS first FROM nation")
def read_cuts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("x").alias("kind"), "n_nationkey", F.concat_ws(" ", (F.col("n_nationkey") * 24).cast("string"), "n_name").alias("line"))
    return X.cuts(spark, files(n, ["n_nationkey"], spark, "cuts")).select("first", "name")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, {w})" for k, v in WEIGHTS.items() for i, w in enumerate(v)) + ") t(name, place, weight)")
def read_weight_lists(spark, sf_dir):
    rows = spark.createDataFrame([("x", i, f"{k} = {', '.join(map(str, v))}  # in scan order") for i, (k, v) in enumerate(WEIGHTS.items())], "kind string, i int, line string")
    return X.weight_lists(spark, files(rows, ["i"], spark, "weights")).drop("file")


@query("SELECT c_name AS thread, c_mktsegment AS stage, CAST(floor(c_acctbal) AS BIGINT) AS weight FROM customer")
def read_trace(spark, sf_dir):
    """Cells name a value once by an id and refer to it afterwards."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.floor("c_acctbal").alias("w"))
    first = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first"))
    j = c.join(first, "c_mktsegment")
    stage = F.when(F.col("c_custkey") == F.col("first"), F.format_string('<stage id="%d">%s</stage>', "first", "c_mktsegment")).otherwise(F.format_string('<stage ref="%d"/>', "first"))
    row = F.concat(F.lit("<row>"), F.format_string('<thread id="%d">%s</thread>', F.col("c_custkey") + 1_000_000_000, "c_name"), stage, F.format_string('<weight id="%d">%d</weight>', F.col("c_custkey") + 2_000_000_000, "w"), F.lit("</row>"))
    text = j.select(F.lit("x").alias("kind"), "c_custkey", row.alias("line"))
    ends = spark.createDataFrame([("x", -1, "<trace>"), ("x", 1 << 60, "</trace>")], "kind string, c_custkey long, line string")
    x = X.trace_rows(spark, files(text.unionByName(ends), ["c_custkey"], spark, "trace"), ("thread", "stage", "weight"))
    return x.withColumn("weight", F.col("weight").cast("long"))


@query("SELECT CAST(c_custkey + 1 AS INTEGER) AS n, CAST(c_custkey % 4 AS INTEGER) AS depth, CAST(floor(c_acctbal + 1000) AS BIGINT) AS samples, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey AS INTEGER) ELSE -1 END AS parent FROM customer")
def read_call_tree(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("x").alias("kind"), "c_custkey", F.concat(F.repeat(F.lit("  "), (F.col("c_custkey") % 4).cast("int")), F.floor(F.col("c_acctbal") + 1000).cast("string"), F.lit(" "), "c_name").alias("line"))
    return X.call_tree(spark, files(c, ["c_custkey"], spark, "tree")).drop("file").fillna(-1, ["parent"])


@query("SELECT user_id AS title, min(event_id) AS first, max(event_id) AS last, round(avg(value), 6) AS cost FROM events GROUP BY user_id")
def scan_round_trip(spark, sf_dir):
    """A table of shots saved with its identity and read under the same."""
    shots = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("title")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.round(F.avg("value"), 6).alias("cost"))
    path, identity = scratch(spark, "scan"), {"source": "events", "version": "1"}
    X.write_scan(shots, path, identity)
    return X.read_scan(spark, path, identity)


@query("SELECT CAST(n_nationkey * 10 AS INTEGER) AS first, CAST(n_nationkey * 10 + 9 AS INTEGER) AS last, n_nationkey % 2 = 0 AS idr, CAST(n_nationkey % 5 - 2 AS INTEGER) AS qp_offset FROM nation")
def read_plan(spark, sf_dir):
    k = F.col("n_nationkey")
    line = F.concat_ws(" ", (k * 10).cast("string"), (k * 10 + 9).cast("string"), F.when(k % 2 == 0, "idr"), F.format_string("qp%+d", (k % 5 - 2).cast("int")), F.lit("# a zone"))
    return X.plan(spark, files(table(spark, sf_dir, "nation").select(F.lit("x").alias("kind"), "n_nationkey", line.alias("line")), ["n_nationkey"], spark, "plan"))


@query("SELECT CAST(event_id AS INTEGER) AS frame, list_extract(['I', 'P', 'B'], CAST(event_id % 3 + 1 AS INTEGER)) AS type, CAST(event_id % 53 - 1 AS INTEGER) AS qp FROM events")
def read_qpfile(spark, sf_dir):
    n = F.col("n")
    line = F.concat_ws(" ", n.cast("string"), F.get(F.array(F.lit("I"), F.lit("P"), F.lit("B")), (n % 3).cast("int")), (n % 53 - 1).cast("string"))
    return X.qpfile(spark, files(events(spark, sf_dir).select(F.lit("x").alias("kind"), "n", line.alias("line")), ["n"], spark, "qpfile"))


@query("SELECT CAST(event_id // 20 AS INTEGER) AS frame, CAST((event_id % 20) // 5 AS INTEGER) AS \"by\", CAST(event_id % 5 AS INTEGER) AS bx, CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN 2 ELSE 1 END AS cls FROM events")
def read_mb_grid(spark, sf_dir):
    """Frames of four rows of five macroblocks, one character each in three."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("f"), F.floor(F.col("event_id") % 20 / 5).alias("y"), (F.col("event_id") % 5).alias("x"), F.get(F.array(F.lit("S  "), F.lit("I  "), F.lit(">  ")), (F.col("user_id") % 3).cast("int")).alias("c"))
    rows = e.groupBy("f", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "c"))), lambda s: s["c"]), "").alias("line"))
    heads = e.select("f").distinct().select("f", F.lit(-1).cast("long").alias("y"), F.lit("New frame, type: P").alias("line"))
    return X.mb_grid(spark, files(rows.unionByName(heads).withColumn("kind", F.lit("x")), ["f", "y"], spark, "grid")).drop("file")


@query("SELECT CAST(event_id AS INTEGER) AS frame, CAST(user_id AS INTEGER) AS gop, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'none' END AS type, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 52 AS INTEGER) ELSE -2 END AS qp, CAST(floor(value * 100) AS INTEGER) AS bytes FROM events")
def read_frame_stats(spark, sf_dir):
    """JSON lines of frame decisions written by section; marks of missing values come back as nulls."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("int").alias("frame"), (F.col("user_id") % 8).alias("part"), F.col("user_id").cast("int").alias("gop"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise("?").alias("type"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 52).otherwise(-1).cast("int").alias("qp"), F.floor(F.col("value") * 100).cast("int").alias("bytes"))
    path = scratch(spark, "frames")
    X.write_stats(rows, path, "part")
    return X.frame_stats(spark, path).select("frame", "gop", "type", "qp", "bytes").fillna({"type": "none", "qp": -2})


@query("SELECT o_orderpriority AS build, o_custkey AS cell, o_orderkey AS record, o_totalprice AS ratio FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey DESC) = 1")
def result_store(spark, sf_dir):
    """Records appended as comma-separated text by build, read with a schema, the newest of each cell kept."""
    path = scratch(spark, "store")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("build"), F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("record"), F.col("o_totalprice").alias("ratio"))
    for half in (0, 1):
        o.where(F.col("record") % 2 == half).write.mode("append").option("header", True).csv(path)
    back = spark.read.schema(o.schema).option("header", True).csv(path, mode="FAILFAST")
    return back.groupBy("build", "cell").agg(F.max(F.struct("record", "ratio")).alias("m")).select("build", "cell", "m.record", "m.ratio")


#: A parameter set of profile 66, level 30, 160x144 at 25 frames a second, with one schedule of 1,000,000 bits a second into 2,000,000 and delays of 24, 16 and 16 bits; fields as (value, bits), or with 0 bits an Exp-Golomb code.
_SET = [(66, 8), (0, 8), (30, 8), (0, 0), (0, 0), (0, 0), (2, 0), (1, 0), (0, 1), (9, 0), (8, 0), (1, 1), (0, 1), (0, 1), (1, 1), *[(0, 1)] * 4, (1, 1), (1, 32), (50, 32), (1, 1), (1, 1), (0, 0), (0, 4), (3, 4), (15624, 0), (15624, 0), (0, 1), (23, 5), (15, 5), (15, 5), (24, 5), (0, 1), (0, 1), (0, 1), (0, 1)]


def _unit(head: int, fields: list[tuple[int, int]]) -> bytes:
    """A start code and a unit of the fields, with the stop bit, and a 3 after two zeros before a byte up to 3."""
    value = size = 0
    for v, n in fields:
        if not n:
            v, n = v + 1, 2 * (v + 1).bit_length() - 1
        value, size = value << n | v, size + n
    body = ((value << 1 | 1) << -(size + 1) % 8).to_bytes(size // 8 + 1)
    if b"\x00\x00" in body:
        out = bytearray()
        for c in body:
            if out[-2:] == b"\x00\x00" and c <= 3:
                out.append(3)
            out.append(c)
        body = bytes(out)
    return b"\x00\x00\x00\x01" + bytes([head]) + body


def _timed(i: int, n: int) -> bytes:
    """A timing message and a slice of event n, the i-th of its stream."""
    key = n % 7 == 0
    return _unit(0x06, [(0x0104, 16), (2 * i % 65536, 16), (n * 3 % 65536, 16)]) + _unit(0x65 if key else 0x41, [(0, 0), (n % 3, 0), (0, 0), (i % 16, 4), *([(n % 9, 0)] if key else []), (2 * i % 64, 6), (n, 0)])


def _bits(fields) -> tuple[np.ndarray, np.ndarray]:
    """The bodies of units by columns of fields, as 16 bytes a row, and how many of them count. A field has 57 bits at most, a row 127."""
    high, low, size = np.uint64(0), np.uint64(0), 0
    for v, n in fields:
        v, n = np.asarray(v, np.uint64), np.asarray(n, np.uint64)
        high, low, size = high << n | low >> np.uint64(1) >> (np.uint64(63) - n), low << n | v, size + n.astype(np.int64)
    # left-justified behind the stop bit: by 64 and then by the rest
    high, low, size = high << np.uint64(1) | low >> np.uint64(63), low << np.uint64(1) | np.uint64(1), size + 1
    far, rest = size <= 64, (-size % 64).astype(np.uint64)
    high, low = np.where(far, low, high), np.where(far, np.uint64(0), low)
    high, low = high << rest | low >> np.uint64(1) >> (np.uint64(63) - rest), low << rest
    return np.stack([high, low], 1).astype(">u8").view(np.uint8), -(-size // 8)


def _timed_all(first: int, n: np.ndarray) -> bytes:
    """_timed of events n, from the place `first` of their stream."""
    i, one = first + np.arange(len(n)), np.ones(len(n), np.int64)
    fixed = lambda *c: np.broadcast_to(np.array(c, np.uint8), (len(n), len(c)))
    code = lambda v: (lambda w: [(0 * w, w - 1), (v + 1, w)])(np.frexp((v + 1).astype(np.float64))[1].astype(np.int64))
    key, wide = n % 7 == 0, n >= 1 << 50
    m = np.where(wide, 0, n)
    picture = [(v, np.where(key, w, 0)) for v, w in code(np.where(key, n % 9, 0))]
    body, size = _bits([(one, 1), *code(n % 3), (one, 1), (i % 16, 4), *((np.where(key, v, 0), w) for v, w in picture), (2 * i % 64, 6), *code(m)])
    delays = np.stack([2 * i % 65536, n * 3 % 65536], 1).astype(">u2").view(np.uint8)
    a, b = np.concatenate([fixed(1, 4), delays, fixed(0x80)], 1), np.concatenate([np.where(key, 0x65, 0x41).astype(np.uint8)[:, None], body], 1)
    used = np.concatenate([np.ones((len(n), 17), bool), np.arange(16) < size[:, None]], 1)
    data = np.concatenate([fixed(0, 0, 0, 1, 6), a, fixed(0, 0, 0, 1), b], 1)
    escapes = lambda x: ((x[:, :-2] == 0) & (x[:, 1:-1] == 0) & (x[:, 2:] <= 3)).any(1)
    # where a 3 may have to go in, and for numbers too long, a unit is written by itself
    odd = np.flatnonzero(wide | escapes(a) | escapes(np.where(used[:, 16:], b, 255))).tolist()
    out = []
    for s, e in zip([0, *(k + 1 for k in odd)], [*odd, len(n)]):
        out += [data[s:e][used[s:e]].tobytes(), *([_timed(first + e, int(n[e]))] if e < len(n) else [])]
    return b"".join(out)


def _named(df):
    """With the kind: the name of the stream's file. A pattern that ends there would be tried from every place of the path, for every row."""
    return df.withColumn("kind", F.regexp_replace(F.substring_index("stream", "/", -1), "[.]264$", ""))


def streams(spark, sf_dir):
    """Streams written from the events, one for each type: a parameter set, then for each event a timing message and a slice. Returns the units as read back."""
    path = scratch(spark, "streams")

    def write(rows):
        """Writes each stream as its rows come, in order of kind and number."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.fs as pafs

        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        runs = ((pc.run_end_encode(b.column("kind")), b.column("n").to_numpy()) for b in rows)
        each = ((k, p) for r, n in runs for k, p in zip(r.values.to_pylist(), np.split(n, r.run_ends.to_pylist()[:-1])))
        for kind, group in itertools.groupby(each, lambda r: r[0]):
            with store.open_output_stream(f"{folder}/{kind}.264") as out:
                out.write(_unit(0x67, _SET))
                i = 0
                for _, n in group:
                    out.write(_timed_all(i, n))
                    i += len(n)
            yield pa.RecordBatch.from_pydict({"kind": [kind]})

    ordered = events(spark, sf_dir).select("kind", "n").repartition("kind").sortWithinPartitions("kind", "n")
    kinds = sorted(r.kind for r in ordered.mapInArrow(write, "kind string").collect())  # one row a file
    annexb.register(spark)
    return spark.read.format("annexb").load(",".join(f"{path}/{k}.264" for k in kinds))


@query(f"WITH e AS ({_E}), i AS (SELECT kind, n, row_number() OVER (PARTITION BY kind ORDER BY n) - 1 AS i FROM e) SELECT kind, CAST(2 * i + 2 AS INTEGER) AS seq, CAST(n % 3 AS INTEGER) AS slice_type, CAST(i % 16 AS INTEGER) AS frame_num, CASE WHEN n % 7 = 0 THEN CAST(n % 9 AS INTEGER) ELSE -1 END AS idr_pic_id, CAST((2 * i) % 64 AS INTEGER) AS poc_lsb FROM i")
def read_slices(spark, sf_dir):
    """Slice headers read by the parameter set before them."""
    nals = streams(spark, sf_dir)
    h = _named(annexb.headers(nals).where("slice is not null"))
    return h.select("kind", "seq", "slice.slice_type", "slice.frame_num", "slice.idr_pic_id", "slice.poc_lsb").fillna(-1, ["idr_pic_id"])


@query(f"WITH e AS ({_E}), i AS (SELECT kind, n, row_number() OVER (PARTITION BY kind ORDER BY n) - 1 AS i FROM e) SELECT kind, CAST(2 * i + 1 AS INTEGER) AS seq, CAST((2 * i) % 65536 AS BIGINT) AS removal_delay, CAST((n * 3) % 65536 AS BIGINT) AS output_delay, 160 AS width, 144 AS height, CAST(1000000 AS BIGINT) AS bit_rate, CAST(2000000 AS BIGINT) AS cpb_size FROM i")
def read_timing(spark, sf_dir):
    """Timing messages, beside what the parameter set that they are read by says about picture and buffer: the streams are read once."""
    h = _named(annexb.headers(streams(spark, sf_dir), with_set=True).where("type = 6"))
    return h.select("kind", "seq", F.explode("sei").alias("m"), "by").select("kind", "seq", "m.removal_delay", "m.output_delay", "by.width", "by.height", "by.bit_rate", "by.cpb_size")


@query(f"WITH e AS ({_E}), i AS (SELECT kind, n, row_number() OVER (PARTITION BY kind ORDER BY n) - 1 AS i FROM e) SELECT kind, i AS unit, CASE WHEN i = 0 THEN 3 ELSE 2 END AS units, n % 7 = 0 AS \"key\" FROM i")
def read_access_units(spark, sf_dir):
    """Access units of a stream: each message opens one once slice data came before."""
    nals = streams(spark, sf_dir)
    u = _named(annexb.access_units(nals))
    return u.select("kind", F.col("unit").cast("long").alias("unit"), F.size("nals").alias("units"), F.exists("nals", lambda x: x["type"] == 5).alias("key"))


@query("WITH e AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, round(1.4826 * median(abs(value - m)), 6) AS sigma FROM e GROUP BY event_type")
def registered_sigma(spark, sf_dir):
    """The registered group function from SQL text."""
    registration.register(spark)
    return spark.sql("SELECT event_type, round(robust_sigma(value), 6) AS sigma FROM {e} GROUP BY event_type", e=table(spark, sf_dir, "events").select("event_type", "value"))
