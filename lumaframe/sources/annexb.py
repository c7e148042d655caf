"""H.264 Annex B streams: format("annexb") gives a row for each NAL unit; sequence parameter sets as structs; access units."""

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .y4m import open_input

SCHEMA = "stream string, seq int, start bigint, size bigint, nal_size bigint, type int, ref_idc int, first_mb int, rbsp binary"

#: Bytes of a stream that are looked at together.
CHUNK = 1 << 20


def split(data: bytes) -> list[tuple[int, int, int]]:
    """(start with the start code, first byte of the unit, end) of each unit; a zero byte before a start code belongs to it, so the sizes add up to the file."""
    at, marks = 0, []
    while (i := data.find(b"\x00\x00\x01", at)) >= 0:
        marks.append((i - 1 if i and data[i - 1] == 0 else i, i + 3))
        at = i + 3
    return [(s if n else 0, b, marks[n + 1][0] if n + 1 < len(marks) else len(data)) for n, (s, b) in enumerate(marks)]


def unescape(nal: bytes) -> bytes:
    """Without the byte 3 that follows two zeros: the pieces between such bytes, each with the zeros before it."""
    return b"\x00\x00".join(nal.split(b"\x00\x00\x03")) if b"\x00\x00\x03" in nal else nal


class Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data), 8 * len(data)

    def u(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the unit is too short")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("not an Exp-Golomb code")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


class Many:
    """Fields of many units at once: each read gives an array, over all units or those of the given places. at and end count bits."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        # the eight bytes from each byte on, as one number
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
        self.at, self.end = 8 * begin.astype(np.int64), 8 * end.astype(np.int64)

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """The bits from a place on, at the upper end; 57 at least are right."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def step(self, n, which) -> np.ndarray:
        at = np.array(self.at[which])
        if (at + n > self.end[which]).any():
            raise ValueError("the unit is too short")
        self.at[which] = at + n
        return at

    def u(self, n: int, which=slice(None)) -> np.ndarray:
        if n > 32:
            if self.u(n - 32, which).any():
                raise ValueError("a field is too large")
            n = 32
        word = self.ahead(self.step(n, which))
        return (word >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(word), np.int64)

    def ue(self, which=slice(None)) -> np.ndarray:
        # 33 bits are exact as a double, whose exponent tells the zeros before the first one
        zeros = 33 - np.frexp((self.ahead(self.at[which]) >> np.uint64(31)).astype(np.float64))[1].astype(np.int64)
        if (zeros > 32).any():
            raise ValueError("not an Exp-Golomb code")
        self.step(zeros + 1, which)
        rest = self.ahead(self.step(zeros, which)) >> np.uint64(1) >> (63 - zeros).astype(np.uint64)
        return (np.int64(1) << zeros) - 1 + rest.astype(np.int64)


def scaling_list(b: Bits, size: int) -> None:
    """Steps over a list of weights, coded as differences that end where the next would be 0."""
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + b.se()) % 256
        last = following or last


def delivery(b: Bits) -> dict:
    """Buffer parameters: the schedules, and the lengths of the delays in messages."""
    count, rate, size = b.ue() + 1, b.u(4), b.u(4)
    schedules = [{"bit_rate": (b.ue() + 1) << (6 + rate), "cpb_size": (b.ue() + 1) << (4 + size), "cbr": bool(b.u(1))} for _ in range(count)]
    return {"schedules": schedules, "initial_length": b.u(5) + 1, "removal_length": b.u(5) + 1, "output_length": b.u(5) + 1, "offset_length": b.u(5)}


def usability(b: Bits) -> dict:
    """What a sequence says about its display, timing and buffers."""
    out: dict = {}
    if b.u(1) and b.u(8) == 255:
        out["aspect"] = (b.u(16), b.u(16))
    if b.u(1):
        b.u(1)
    if b.u(1):
        out["full_range"] = bool((b.u(3), b.u(1))[1])
        if b.u(1):
            out["colour"] = (b.u(8), b.u(8), b.u(8))
    if b.u(1):
        out["chroma_place"] = (b.ue(), b.ue())
    if b.u(1):
        out["tick"], out["time_scale"], out["fixed_rate"] = b.u(32), b.u(32), bool(b.u(1))
    for kind in ("nal", "vcl"):
        if b.u(1):
            out[kind] = delivery(b)
    if "nal" in out or "vcl" in out:
        out["low_delay"] = bool(b.u(1))
    out["pic_struct"] = bool(b.u(1))
    if b.u(1):
        b.u(1)
        out["limits"] = [b.ue() for _ in range(6)]
        out["reorder"], out["buffered"] = out["limits"][4:]
    return out


def parameters(rbsp: bytes) -> dict:
    """A sequence parameter set (type byte left out)."""
    b = Bits(rbsp)
    out: dict = {"profile_idc": b.u(8), "constraint_set": b.u(8), "level_idc": b.u(8), "sps_id": b.ue(), "chroma_format_idc": 1, "bit_depth": 8}
    # fixed values of the standard: the profiles whose sets carry chroma and depth
    if out["profile_idc"] in (100, 110, 122, 244, 44, 83, 86, 118, 128):
        out["chroma_format_idc"] = b.ue()
        if out["chroma_format_idc"] == 3:
            b.u(1)
        out["bit_depth"] = 8 + b.ue()
        b.ue()
        b.u(1)
        if b.u(1):
            for i in range(12 if out["chroma_format_idc"] == 3 else 8):
                if b.u(1):
                    scaling_list(b, 16 if i < 6 else 64)
    out["log2_max_frame_num"], out["pic_order_cnt_type"] = b.ue() + 4, b.ue()
    if out["pic_order_cnt_type"] == 0:
        out["log2_max_poc_lsb"] = b.ue() + 4
    elif out["pic_order_cnt_type"] == 1:
        b.u(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    out["references"] = b.ue()
    b.u(1)
    wide, high, out["frames_only"] = b.ue() + 1, b.ue() + 1, bool(b.u(1))
    if not out["frames_only"]:
        b.u(1)
    b.u(1)
    left, right, top, bottom = (b.ue(), b.ue(), b.ue(), b.ue()) if b.u(1) else (0, 0, 0, 0)
    step = 1 if out["frames_only"] else 2
    sx, sy = (2 if out["chroma_format_idc"] in (1, 2) else 1), (2 if out["chroma_format_idc"] == 1 else 1)
    out["width"], out["height"] = 16 * wide - sx * (left + right), 16 * high * step - sy * step * (top + bottom)
    out["vui"] = usability(b) if b.u(1) else None
    return out


def slice_headers(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray, sps: dict) -> dict[str, np.ndarray]:
    """The fields of slices up to their picture order count, all read by one parameter set; -1 for those a slice does not have."""
    b = Many(data, begin, np.minimum(end, begin + 64))
    out = {"first_mb": b.ue(), "slice_type": b.ue() % 5, "pps_id": b.ue(), "frame_num": b.u(sps["log2_max_frame_num"])}
    out |= {k: np.full(len(begin), -1, np.int64) for k in ("idr_pic_id", "poc_lsb")}
    if not sps["frames_only"]:
        b.u(1, np.flatnonzero(b.u(1)))
    idr = np.flatnonzero(kind == 5)
    out["idr_pic_id"][idr] = b.ue(idr)
    if sps["pic_order_cnt_type"] == 0:
        out["poc_lsb"] = b.u(sps["log2_max_poc_lsb"])
    return out


def messages(data: np.ndarray, begin: np.ndarray, end: np.ndarray, sps: dict | None) -> dict[str, np.ndarray]:
    """The messages of SEI units, all read by one parameter set, in the order of units and in them: unit (its place), type, size, and the delays of those of the buffer (0), of timing (1) and of recovery (6); -1 for what a message does not have.

    The first messages of all units are read together, then the second ones, and so on.
    """
    vui = (sps or {}).get("vui") or {}
    hrd, at, live, rounds = vui.get("nal") or vui.get("vcl"), begin.astype(np.int64), np.arange(len(begin)), []

    def coded() -> np.ndarray:
        """A number as a sum of bytes, of which only the last is under 255."""
        total, going = np.zeros(len(live), np.int64), np.arange(len(live))
        while len(going):
            places = live[going]
            if (at[places] >= end[places]).any():
                raise ValueError("a message is longer than its unit")
            byte = data[at[places]]
            total[going] += byte
            at[places] += 1
            going = going[byte == 255]
        return total

    while True:
        live = live[at[live] < end[live]]
        live = live[~((at[live] == end[live] - 1) & (data[at[live]] == 0x80))]
        if not len(live):
            break
        row = {"unit": live, "type": coded(), "size": coded()} | {k: np.full(len(live), -1, np.int64) for k in ("initial_delay", "removal_delay", "output_delay", "recovery")}
        rest = at[live] + row["size"]
        if (rest > end[live]).any():
            raise ValueError("a message is longer than its unit")
        b = Many(data, at[live], rest)
        at[live] = rest
        if hrd:
            k = np.flatnonzero(row["type"] == 0)
            b.ue(k)
            row["initial_delay"][k] = b.u(hrd["initial_length"], k)
            k = np.flatnonzero(row["type"] == 1)
            row["removal_delay"][k], row["output_delay"][k] = b.u(hrd["removal_length"], k), b.u(hrd["output_length"], k)
        k = np.flatnonzero(row["type"] == 6)
        row["recovery"][k] = b.ue(k)
        rounds.append(row)
    names = ("unit", "type", "size", "initial_delay", "removal_delay", "output_delay", "recovery")
    out = {n: np.concatenate([np.zeros(0, np.int64), *(r[n] for r in rounds)]) for n in names}
    order = np.argsort(out["unit"], kind="stable")
    return {n: v[order] for n, v in out.items()}


_SPS = "struct<profile_idc: int, level_idc: int, width: int, height: int, bit_depth: int, `references`: int, tick: bigint, time_scale: bigint, bit_rate: bigint, cpb_size: bigint, cbr: boolean>"
_SLICE = "struct<first_mb: int, slice_type: int, pps_id: int, frame_num: int, idr_pic_id: int, poc_lsb: int>"
_SEI = "array<struct<type: int, size: int, initial_delay: bigint, removal_delay: bigint, output_delay: bigint, recovery: int>>"


def _set_row(sps: dict) -> dict:
    """A parameter set as the struct of `headers`; of its schedules the first."""
    vui = sps["vui"] or {}
    one = next(iter((vui.get("nal") or vui.get("vcl") or {}).get("schedules", [])), {})
    return {**{k: sps[k] for k in ("profile_idc", "level_idc", "width", "height", "bit_depth", "references")}, "tick": vui.get("tick"), "time_scale": vui.get("time_scale"), "bit_rate": one.get("bit_rate"), "cpb_size": one.get("cpb_size"), "cbr": one.get("cbr")}


def headers(nals: DataFrame, with_set: bool = False) -> DataFrame:
    """stream, seq, type and the parsed header of each unit: sps of parameter sets, slice of slices, sei of messages; null for other types. With with_set also `by`, the parameter set that a unit is read by.

    A unit is read by the last parameter set before it in its stream, which is carried along the sorted rows; the units of a batch that share a set are parsed together.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = f"stream string, seq int, type int, sps {_SPS}, slice {_SLICE}, sei {_SEI}" + f", by {_SPS}" * with_set
    types = to_arrow_schema(nals.sparkSession.createDataFrame([], schema).schema)

    def run(parts):
        known: dict[bytes, int] = {}  # the place of a set in those below
        sets: list[dict] = []
        heads, message = pa.array([], types.field("sps").type), types.field("sei").type.value_type
        stream, now = None, -1
        # a field that is not there is below 0
        struct = lambda kind, values, **more: pa.StructArray.from_arrays([pa.array(values[f.name], mask=values[f.name] < 0).cast(f.type) for f in kind], fields=list(kind), **more)
        for batch in parts:
            if not batch.num_rows:
                continue
            kind, names, units = batch.column("type").to_numpy(), batch.column("stream"), batch.column("rbsp").cast(pa.large_binary())
            edges = np.frombuffer(units.buffers()[1], np.int64)[units.offset :][: len(kind) + 1]
            data = np.frombuffer(units.buffers()[2] or b"", np.uint8)
            fresh = np.append([names[0].as_py() != stream], pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
            ids, at = np.empty(len(kind), np.int64), 0
            for k in np.flatnonzero(fresh | (kind == 7)).tolist():
                ids[at:k], at = now, k
                now = -1 if fresh[k] else now
                if kind[k] == 7:
                    set_ = units[k].as_py()
                    if set_ not in known:
                        known[set_] = len(sets)
                        sets.append(parameters(set_))
                    now = known[set_]
            ids[at:], stream = now, names[-1].as_py()

            slices = np.isin(kind, (1, 5)) & (ids >= 0)
            fields = {f.name: np.full(len(kind), -1, np.int64) for f in types.field("slice").type}
            found = []
            for one in np.unique(ids[slices]):
                k = np.flatnonzero(slices & (ids == one))
                for f, v in slice_headers(data, edges[k], edges[k + 1], kind[k], sets[one]).items():
                    fields[f][k] = v
            for one in np.unique(ids[kind == 6]):
                k = np.flatnonzero((kind == 6) & (ids == one))
                got = messages(data, edges[k], edges[k + 1], sets[one] if one >= 0 else None)
                found.append(got | {"unit": k[got["unit"]]})
            sei = {f: np.concatenate([np.zeros(0, np.int64), *(x[f] for x in found)]) for f in ("unit", *(f.name for f in message))}
            order = np.argsort(sei["unit"], kind="stable")
            counts = np.cumsum(np.append(0, np.bincount(sei.pop("unit"), minlength=len(kind)))).astype(np.int32)
            if len(heads) != len(sets):
                heads = pa.array([_set_row(x) for x in sets], types.field("sps").type)
            columns = list(batch.select(["stream", "seq", "type"]).columns) + [heads.take(pa.array(ids, mask=kind != 7)), struct(types.field("slice").type, fields, mask=pa.array(~slices))]
            columns.append(pa.ListArray.from_arrays(pa.array(counts), struct(message, {f: v[order] for f, v in sei.items()}), type=types.field("sei").type, mask=pa.array(kind != 6)))
            columns += [heads.take(pa.array(ids, mask=ids < 0))] * with_set
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    # of a slice, its first bytes are all that is read
    part = F.when(F.col("type").isin(1, 5), F.substring("rbsp", 1, 64)).when(F.col("type").isin(6, 7), F.col("rbsp"))
    return nals.select("stream", "seq", "type", part.alias("rbsp")).repartition("stream").sortWithinPartitions("stream", "seq").mapInArrow(run, schema)


class Whole(InputPartition):
    def __init__(self, path: str):
        self.path = path


def batches(path: str, f, schema):
    """Rows of a stream by chunks: what is read so far up to its last start code, as the unit there may go on."""
    import pyarrow as pa

    held, begun, n, more = b"", 0, 0, True
    while more:
        chunk = f.read(CHUNK)
        more, held = bool(chunk), held + chunk
        a = np.frombuffer(held, np.uint8)
        code = np.flatnonzero((a[:-2] == 0) & (a[1:-1] == 0) & (a[2:] == 1)) if len(a) > 2 else np.zeros(0, np.int64)
        if not more and held and not len(code):
            raise ValueError("no start code")
        # a zero byte before a start code belongs to it, and what is before the first unit to that
        start, body = code - ((code > 0) & (a[code - 1] == 0)), code + 3
        start[:1] = 0
        end = np.append(start[1:], len(a))
        if more:
            start, body, end = start[:-1], body[:-1], end[:-1]
        if not len(body):
            continue
        if (body >= end).any():
            raise ValueError(f"unit {n + int(np.argmax(body >= end))} is empty")
        head, last = a[body], int(end[-1])
        inside = np.zeros(last + 1, np.int8)
        inside[body + 1] += 1
        inside[end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        # the byte 3 that follows two zeros, all three after the unit's first byte
        three = np.flatnonzero((a[: last - 2] == 0) & (a[1 : last - 1] == 0) & (a[2:last] == 3))
        inside[three[inside[three]] + 2] = False
        rbsp = a[:last][inside]
        edges = np.concatenate([[0], np.cumsum(np.add.reduceat(inside, body, dtype=np.int64))])
        kind = head & 31
        slices = np.flatnonzero((kind == 1) | (kind == 5))
        first = np.zeros(len(body), np.int64)
        first[slices] = Many(rbsp, edges[slices], np.minimum(edges[slices + 1], edges[slices] + 9)).ue()
        other = np.ones(len(body), bool)
        other[slices] = False
        columns = {"stream": pa.repeat(pa.scalar(path), len(body)), "seq": n + np.arange(len(body)), "start": begun + start, "size": end - start, "nal_size": end - body, "type": kind, "ref_idc": head >> 5 & 3, "first_mb": pa.array(first, mask=other)}
        columns["rbsp"] = pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(rbsp)])
        yield pa.RecordBatch.from_arrays([(v if isinstance(v, pa.Array) else pa.array(v)).cast(schema.field(k).type) for k, v in columns.items()], schema=schema)
        held, begun, n = held[last:], begun + last, n + len(body)


class AnnexbReader(DataSourceReader):
    """A stream a task: units begin where the one before ends, so a stream is read in order. Paths are separated by commas."""

    def __init__(self, options: dict, schema):
        self.paths, self.schema = options["path"].split(","), schema

    def partitions(self):
        return [Whole(p) for p in self.paths]

    def read(self, part):
        with open_input(part.path) as f:
            yield from batches(part.path, f, to_arrow_schema(self.schema))


class Annexb(DataSource):
    @classmethod
    def name(cls):
        return "annexb"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return AnnexbReader(self.options, schema)


def register(spark) -> None:
    spark.dataSource.register(Annexb)


def access_units(nals: DataFrame) -> DataFrame:
    """stream, unit, bytes, vcl_bytes, nals: a unit opens at a delimiter, parameter set or SEI, or a slice that starts a picture, once slice data came before.

    As `sequences.sessions` says, of consecutive openers the first counts: one whose last row before it that is opener or slice data is slice data. The sorted rows go by in batches, and
    the last unit of a batch is held until the next opens.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = "stream string, unit bigint, bytes bigint, vcl_bytes bigint, nals array<struct<seq: int, type: int>>"
    types = to_arrow_schema(nals.sparkSession.createDataFrame([], schema).schema)

    def run(parts):
        held, unit = None, 0
        for batch in itertools.chain(parts, [None]):
            both = [b for b in (held, batch) if b is not None and b.num_rows]
            if not both:
                continue
            rows = pa.Table.from_batches(both).combine_chunks().to_batches()[0]
            kind, names, place = rows.column("type").to_numpy(), rows.column("stream"), np.arange(rows.num_rows)
            # the first row is that of a held unit or of the first stream, so none before it is looked at
            fresh = np.append([True], pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
            began = np.maximum.accumulate(np.where(fresh, place, 0))
            slices = np.isin(kind, (1, 5))
            opens = np.isin(kind, (6, 7, 8, 9, 14, 15, 16, 17, 18))
            before = np.append([-1], np.maximum.accumulate(np.where(slices | opens, place, -1))[:-1])
            # a slice with first_mb 0 opens a unit as well as being body
            new = (opens | slices & (rows.column("first_mb").fill_null(-1).to_numpy() == 0)) & (before >= began) & slices[before]
            count = np.cumsum(new)
            number = count - count[began] + np.where(began == 0, unit, 0)
            starts = np.flatnonzero(new | fresh)
            edges = np.append(starts, rows.num_rows)
            if batch is not None:
                held, unit = rows.slice(int(starts[-1])), int(number[starts[-1]])
                starts, edges = starts[:-1], edges[:-1]
            if not len(starts):
                continue
            end = int(edges[-1])
            sums = [np.add.reduceat(v[:end], starts) for v in (rows.column("size").to_numpy(), np.where(slices, rows.column("nal_size").to_numpy(), 0))]
            inner = pa.StructArray.from_arrays([rows.column(c) for c in ("seq", "type")], fields=list(types.field("nals").type.value_type))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(starts)), pa.array(number[starts]), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), inner, type=types.field("nals").type)], schema=types)

    return nals.select("stream", "seq", "type", "size", "nal_size", "first_mb").repartition("stream").sortWithinPartitions("stream", "seq").mapInArrow(run, schema)
