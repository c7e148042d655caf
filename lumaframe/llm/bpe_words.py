"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words where they lie; each task counts its distinct words, and one aggregation gives the table of all.
2. Each distinct word is encoded once.
3. Ids go back by position. Frequent words (at most FREQUENT of them, the bound of what is broadcast) are looked up beside the text;
   every other occurrence is a row (document, position, word) that is joined with the table and returns to its document.
   So no word is hot in that join, and what is moved is the rare words and, compressed, the texts.
Decoding joins ids with pieces; the vocabulary, whose size is fixed by its file, is broadcast.

Edge cases: a null text counts as empty and gives no id; texts that hold the string of an added token are encoded whole;
rows equal in id and text share their result, and each is returned; null ids are ids of their own; an empty table gives an empty result.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .codepoints import batches, codes, kept, release, slices, span_hashes
from .pretokens import Encoder, distinct, folded, ragged, split
from .storage import row_key, written

#: Words that may be broadcast: about 40 bytes each.
FREQUENT = 1_200_000
#: Distinct words that a task holds before it passes them on.
HELD = 400_000

def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def _split(texts: list[str], enc: Encoder):
    """Hash, first place, which, counts of the distinct words; words before each text; the joined text and the places. Texts with added tokens count as empty."""
    plain = ["" if enc.special(t) else folded(t) for t in texts]
    cp, a, b, at = split(plain, words=True)
    return *distinct(cp, a, b), at, "".join(plain), a, b


def counted(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """word, n: the distinct words of all texts."""

    def run(parts) -> Iterator[pa.RecordBatch]:
        enc, held = encoder(tokenizer), {}

        def out() -> pa.RecordBatch:  # in order, as neighbours with a common beginning compress better
            words = sorted(held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for batch in parts:
            texts = batches(batch.column(0))
            for x, y in slices(texts):
                _, first, _, n, _, joined, a, b = _split(texts[x:y], enc)
                for s, e, k in zip(a[first].tolist(), b[first].tolist(), n.tolist()):
                    w = joined[s:e]
                    held[w] = held.get(w, 0) + k
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()
        held.clear()
        release()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded(words: DataFrame, tokenizer: str) -> DataFrame:
    """word, n, ids (little-endian unsigned 32-bit integers): each word encoded once."""

    def run(parts) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for x in range(0, batch.num_rows, 20_000):
                some = batch.slice(x, 20_000)
                ids = [np.array(i, "<u4").tobytes() for i in encoder(tokenizer).encode(some.column("word").to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column("word"), some.column("n"), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n long, ids binary")


class Frequent:
    """The frequent words, told by two independent hashes of 64 bits, sorted by the first, with their ids in one pool."""

    def __init__(self, rows: pa.Table):
        words = rows.column("word").to_pylist()
        hashes = [np.zeros((0, 2), np.uint64)]
        for x, y in slices(words):
            cp, starts = codes(words[x:y])
            hashes.append(np.stack(span_hashes(cp, starts[:-1], starts[1:]), 1))
        h = np.concatenate(hashes)
        order = np.argsort(h[:, 0], kind="stable")
        ids = rows.column("ids").take(pa.array(order)).to_pylist()
        self.hashes, self.second, self.length = h[order, 0], h[order, 1], np.array([len(i) // 4 for i in ids], np.int32)
        self.offset, self.pool = np.cumsum(self.length, dtype=np.int64) - self.length, np.frombuffer(b"".join(ids), "<u4")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h[:, 0]), len(self.hashes) - 1)
        return np.where((self.hashes[at] == h[:, 0]) & (self.second[at] == h[:, 1]), at, -1)


def frequent(words: DataFrame, limit: int = FREQUENT) -> int:
    """The least power of two, 2 or more, for which no more than limit words occur at least so often."""
    steps = {r.k: r["count"] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    total, least = 0, max(steps, default=0) + 1
    while least > 1 and total + steps.get(least - 1, 0) <= limit:
        least -= 1
        total += steps.get(least, 0)
    return 1 << least


def compression(docs: DataFrame, text: str, samples: int = 2000, chars: int = 4000) -> bytes:
    """A dictionary for compressing single texts while they are moved, from the beginnings of about `samples` of them; empty if they are too few to learn from."""
    share = min(1.0, 1.5 * samples / max(1, docs.count()))
    some = docs.where((F.pmod(F.xxhash64(text), F.lit(1 << 30)) / (1 << 30)) < share).select(F.substring(text, 1, chars).alias("t")).limit(samples).collect()
    texts = [r.t.encode("utf-8", "surrogatepass") for r in some if r.t]
    if len(texts) < 200:
        return b""
    try:
        return zstandard.train_dictionary(100_000, texts).as_bytes()
    except zstandard.ZstdError:  # texts without anything in common
        return b""


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", then: tuple[Callable, str] | None = None) -> DataFrame:
    """doc_id and ids ARRAY<INT>; with `then`, what its function makes of the batches of them, in the same workers, and the schema of that."""
    spark = docs.sparkSession
    words = written(encoded(counted(docs, tokenizer, text), tokenizer), "words")
    often = frequent(words)
    known = spark.sparkContext.broadcast(Frequent(words.where(F.col("n") >= often).select("word", "ids").toArrow()))
    keyed = docs.select(F.col(doc_id).alias("_id"), row_key(text).alias("_h"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def rare(parts) -> Iterator[pa.RecordBatch]:
        enc, freq = encoder(tokenizer), known.value
        for batch in parts:
            texts, row = batches(batch.column("_text")), 0
            for x, y in slices(texts):
                h, first, which, _, at, joined, a, b = _split(texts[x:y], enc)
                place = np.flatnonzero(freq.find(h)[which] < 0)
                owner = np.searchsorted(at, place, side="right") - 1
                rows = pa.array(owner + x)
                found = [joined[s:e] for s, e in zip(a[place].tolist(), b[place].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(rows), batch.column("_h").take(rows), pa.array((place - at[owner]).astype(np.int32)), pa.array(found, pa.string())], ["_id", "_h", "pos", "word"])
        release()

    learnt = compression(docs, text)

    def packed(parts) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(learnt) if learnt else None)
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in batches(batch.column("_text"))], pa.binary())], ["_id", "_h", "_packed"])

    spots = keyed.mapInArrow(rare, "_id long, _h long, pos int, word string")
    back = spots.join(words.where(F.col("n") < often).select("word", "ids"), "word").groupBy(F.col("_id").alias("_rid"), F.col("_h").alias("_rh")).agg(F.collect_set(F.struct("pos", "ids")).alias("_rare"))
    texts = keyed.mapInArrow(packed, "_id long, _h long, _packed binary")
    # the texts stream past a hash table of the rare words: they are neither sorted nor held
    joined = texts.join(back.hint("shuffle_hash"), texts["_id"].eqNullSafe(back["_rid"]) & (texts["_h"] == back["_rh"]), "left").select("_id", "_packed", "_rare")

    def run(parts) -> Iterator[pa.RecordBatch]:
        enc, freq = encoder(tokenizer), known.value
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learnt) if learnt else None)
        for batch in parts:
            texts = [unpack.decompress(t).decode("utf-8", "surrogatepass") for t in batch.column("_packed").to_pylist()]
            rare_of = batch.column("_rare")
            for x, y in slices(texts):
                h, _, which, _, at, _, _, _ = _split(texts[x:y], enc)
                slot = freq.find(h)[which]
                length, offset = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
                known_at = slot >= 0
                length[known_at], offset[known_at] = freq.length[slot[known_at]], freq.offset[slot[known_at]]
                extra, used = [freq.pool], len(freq.pool)
                part = rare_of.slice(x, y - x)
                if part.null_count < len(part):
                    flat = part.flatten()
                    owner = np.repeat(np.arange(y - x), np.array([0 if n is None else n for n in pa.compute.list_value_length(part).to_pylist()]))
                    where = at[owner] + flat.field("pos").to_numpy()
                    ids = [np.frombuffer(v, "<u4") for v in flat.field("ids").to_pylist()]
                    sizes = np.array([len(v) for v in ids], np.int64)
                    length[where], offset[where] = sizes, used + np.cumsum(sizes) - sizes
                    extra += ids
                ids = ragged(np.concatenate(extra) if len(extra) > 1 else freq.pool, offset, length)
                ends = np.zeros(len(length) + 1, np.int64)
                np.cumsum(length, out=ends[1:])
                cut = ends[at]
                own = [np.array(enc.encode_whole(t), np.uint32) if enc.special(t) else ids[cut[i] : cut[i + 1]] for i, t in enumerate(texts[x:y])]
                id_column = batch.column("_id").slice(x, y - x)
                yield pa.RecordBatch.from_arrays([id_column, pa.array([v.astype(np.int32) for v in own], pa.list_(pa.int32()))], [doc_id, "ids"])
        release()

    if then:
        step, schema = then
        return joined.mapInArrow(lambda parts: step(run(parts)), schema)
    return joined.mapInArrow(run, f"{doc_id} long, ids array<int>")


def vocabulary(tokenizer: str) -> list[str]:
    """The piece of each id; an id without one gives an empty piece."""
    t = Tokenizer.from_file(tokenizer)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]


def decoder(spark: SparkSession, tokenizer: str, ids: str = "ids") -> Callable:
    """A function that adds the column decoded to batches with ids."""
    shared = spark.sparkContext.broadcast(vocabulary(tokenizer))

    def run(parts) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in parts:
            column = batch.column(ids)
            k, at, empty = column.values.fill_null(-1).to_numpy(), column.offsets.to_numpy(), column.is_null().to_pylist()
            out = []
            for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = k[s:e]
                out.append(None if empty[i] else " ".join([names[x] for x in own[(own >= 0) & (own < len(names))].tolist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """tokens with the column decoded: the pieces of the ids, joined by blanks as the vocabulary's file (it names no decoder) asks. Null ids give null; ids outside the vocabulary are left out."""
    return tokens.mapInArrow(decoder(tokens.sparkSession, tokenizer, ids), tokens.select("*", F.lit(None).cast("string").alias("decoded")).schema)


def digests(parts) -> Iterator[pa.RecordBatch]:
    """Batches of encode() and decode() with n_tokens, ids_sha256 (of little-endian 32-bit integers) and decoded_sha256 instead of decoded."""
    for batch in parts:
        ids, texts = batch.column("ids"), batch.column("decoded").to_pylist()
        k, at = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
        made = [hashlib.sha256(k[s:e].tobytes()).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        kept = [c for c in batch.schema.names if c != "decoded"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(np.diff(at).astype(np.int64)), pa.array(made, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())],
            [*kept, "n_tokens", "ids_sha256", "decoded_sha256"])


def digested(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256: encode(), decode() and the digests of what they return. One pass, since the workers of several do not fit into an executor side by side."""
    decoded = decoder(docs.sparkSession, tokenizer)
    return encode(docs, tokenizer, doc_id, text, (lambda parts: digests(decoded(parts)), f"{doc_id} long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"))
