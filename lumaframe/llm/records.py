"""Token-id output as length-delimited binary records with a separate offset index.

Part files `part-00000.rec` hold one record a row in ascending id order; part numbers ascend too. A record:

    8 bytes  length of the payload      4 bytes  masked checksum of those 8 bytes
    payload                             4 bytes  masked checksum of the payload
    payload: 1 byte null id or not, 8 bytes id (signed), 1 byte bytes per token (2 or 4), then the token ids

All numbers are little-endian. The checksum is CRC-32; masked: rotated right by 15 bits plus 0xA282EAD8, so that checksums of
data that hold checksums stay sound. `part-00000.idx` has 8 bytes a record: where it starts in the part file, so that any
record can be read alone in any order; `parts` is a Parquet table with one row a part.
A part is written under a name of its own and renamed when complete: a task that is run again, or twice at once, leaves one whole file.

Edge cases: a null text is an empty one and gives the end id alone; rows with a null id come first; repeated rows are written as often as
they come; an empty table gives no part; ids need not be unique; other columns are ignored.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codepoints import batches, kept, release, slices
from .pretokens import Encoder, distinct, ragged, split
from .storage import fresh_path

END = 2
#: Bytes of text that a part is planned for.
PART_BYTES = 64 << 20
#: Distinct pieces that a worker keeps encoded, about 40 bytes each; beyond, it starts anew.
CACHE = 1_500_000
#: Of those, the latest are kept in a dict and then merged into the sorted arrays.
LATEST = 30_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(id, token ids, where the next record starts) of the record at a place; raises ValueError if a checksum fails."""
    head = bytes(data[at : at + 8])
    (n,) = struct.unpack("<Q", head)
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(head):
        raise ValueError(f"length checksum fails at {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) != n or struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] != masked(payload):
        raise ValueError(f"payload checksum fails at {at}")
    known, doc_id, width = struct.unpack("<?qB", payload[:10])
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=10), at + 16 + n


class Tokens:
    """Encodes batches of texts: each distinct piece once, as long as it stays in the cache."""

    def __init__(self, tokenizer: str):
        self.encoder = Encoder(tokenizer)
        self.width = 2 if self.encoder.size <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots, self.latest = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), {}
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used, self.known = np.zeros(1 << 18, np.uint32), 0, 0

    def _add(self, hashes: list[tuple[int, int]], pieces: list[str]) -> None:
        for h, ids in zip(hashes, self.encoder.encode(pieces)):
            if self.known == len(self.offset):
                self.offset, self.length = np.resize(self.offset, 2 * self.known), np.resize(self.length, 2 * self.known)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.pool[self.used : self.used + len(ids)] = ids
            self.latest[h], self.offset[self.known], self.length[self.known] = self.known, self.used, len(ids)
            self.used, self.known = self.used + len(ids), self.known + 1

    def _slots(self, h: np.ndarray, piece) -> np.ndarray:
        """Where the ids of each piece are, told by its two hashes; piece(i) is the text of the i-th."""
        if len(self.latest) > LATEST:
            keys = np.concatenate([self.keys, np.array(list(self.latest.keys()), np.uint64)])
            slots = np.concatenate([self.slots, np.fromiter(self.latest.values(), np.int64, len(self.latest))])
            order = np.argsort(keys[:, 0], kind="stable")
            self.keys, self.slots, self.latest = keys[order], slots[order], {}
        if self.known > CACHE:
            self.forget()
        slot = np.full(len(h), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys[:, 0], h[:, 0]), len(self.keys) - 1)
            slot = np.where((self.keys[at] == h).all(1), self.slots[at], -1)
        rest = np.flatnonzero(slot < 0)
        names = list(map(tuple, h[rest].tolist()))
        new = [(x, i) for x, i in zip(names, rest.tolist()) if x not in self.latest]
        self._add([x for x, _ in new], [piece(i) for _, i in new])
        slot[rest] = [self.latest[x] for x in names]
        return slot

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = {i: np.array(self.encoder.encode_whole(t), np.uint32) for i, t in enumerate(texts) if self.encoder.special(t)}
        texts = ["" if i in whole else t for i, t in enumerate(texts)]
        cp, a, b, at = split(texts, words=False)
        h, first, which, _ = distinct(cp, a, b)
        joined = "".join(texts)
        slot = self._slots(h, lambda i: joined[a[first[i]] : b[first[i]]])[which] if len(h) else np.zeros(0, np.int64)
        length = self.length[slot]
        ids = ragged(self.pool, self.offset[slot], length)
        ends = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        cut = ends[at]
        return [whole.get(i, ids[cut[i] : cut[i + 1]]) for i in range(len(texts))]


def tokens_of(path: str) -> Tokens:
    """One for each worker process and file, with what it has encoded so far."""
    return kept(f"tokens {path}", lambda: Tokens(path))


def write(docs: DataFrame, tokenizer: str, path: str | None = None, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encodes docs, adds END to each, writes part files in ascending id order, and returns their folder.

    Rows are dealt by ranges of the id before they are encoded, so that each is encoded once and only its text is moved.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
        parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_h"))
    rows = rows.repartitionByRange(parts, "_id", "_h").sortWithinPartitions("_id", "_h").select("_id", "_text")  # with the hash, so that rows of one id spread over parts

    def run(stream):
        tokens, n, store, name = None, 0, None, ""
        starts, total, out, written, first = [], 0, None, 0, None
        for batch in stream:
            ids, texts = batch.column("_id").to_pylist(), batches(batch.column("_text"))
            for x, y in slices(texts):
                if tokens is None:
                    tokens = tokens_of(tokenizer)
                    store, folder = pafs.FileSystem.from_uri(path)
                    store.create_dir(folder, recursive=True)
                    name = f"{folder}/part-{TaskContext.get().partitionId():05d}"
                    trial = f"{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(trial + ".rec")
                for i, t in zip(ids[x:y], tokens(texts[x:y])):
                    t = np.append(t, np.uint32(END))
                    record = frame(i, t, tokens.width)
                    out.write(record)
                    starts.append(written)
                    written, total = written + len(record), total + len(t)
        release()
        if out is not None:
            out.close()
            with store.open_output_stream(trial + ".idx") as index:
                index.write(np.array(starts, "<u8").tobytes())
            for kind in (".rec", ".idx"):
                store.move(trial + kind, name + kind)
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "records": [len(starts)], "tokens": [total], "bytes": [written]}, pa.schema([("part", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    rows.mapInArrow(run, "part int, records long, tokens long, bytes long").write.parquet(f"{path}/parts")
    return path


def load_record(path: str, part: int, n: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index: two short reads, for shuffled access."""
    store, folder = pafs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/part-{part:05d}.idx") as index:
        index.seek(8 * n)
        (at,) = struct.unpack("<Q", index.read(8))
    with store.open_input_file(f"{folder}/part-{part:05d}.rec") as data:
        data.seek(at)
        (size,) = struct.unpack("<Q", data.read(8))
        data.seek(at)
        doc_id, ids, _ = unframe(memoryview(data.read(size + 16)), 0)
    return doc_id, ids


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (tokens of all records before), n_tokens, ids_crc32, and ids unless left out, from the files."""
    parts = spark.read.parquet(f"{path}/parts")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part file
    tasks = parts.select("part", before.alias("before"), "records").repartition(max(1, min(10_000, parts.count())), "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(stream):
        store, folder = pafs.FileSystem.from_uri(path)
        for batch in stream:
            for part, start, records in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "records"))):
                with store.open_input_stream(f"{folder}/part-{part:05d}.rec") as data:
                    rows, held = [], 0
                    for n in range(records):
                        head = data.read(12)
                        (size,) = struct.unpack("<Q", head[:8])
                        doc_id, ids, _ = unframe(memoryview(head + data.read(size + 4)), 0)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + ((ids.astype(np.int64),) if with_ids else ()))
                        start, held = start + len(ids), held + (len(ids) if with_ids else 1)
                        if held > 250_000 or n == records - 1:
                            columns = list(zip(*rows))
                            arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
                            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                            if with_ids:
                                ends = np.cumsum([0, *map(len, columns[4])])
                                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(columns[4]))))
                                names.append("ids")
                            yield pa.RecordBatch.from_arrays(arrays, names)
                            rows, held = [], 0

    return tasks.mapInArrow(run, schema)
