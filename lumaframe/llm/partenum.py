"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Sets are shingles of N words. Sizes are cut into bands whose sets may be similar only within a band or to the next; in the join of
such a pair of bands two similar sets differ in at most k shingles. The domain of shingles is hashed into n parts and each part into
SUBPARTS; a signature is what a set holds in a subset of all but one of the subparts of a part. Where a part holds at most one of the
differences, at least one of its subsets is equal on both sides, so similar sets share signatures. In numbers: a part all of whose
signatures differ holds two differences or more, a part with a differing one holds at least one; the sum is at most k.

1. Equal sets are one node. Nodes that share least hashes are compared with the most central of them, so that a group of near copies costs one
   comparison each. Only pairs of different components matter after that.
2. Signatures are made of the shingles that are not common in a sample. Which are left out is free, as what is left differs in no more shingles than
   before; so a passage of many documents makes no signature. Nodes with too little besides are given signatures of all their shingles, too.
   Signatures that at most FEW nodes share give their pairs.
3. Signatures of more nodes give none. A node is stuck if a similar one might share only such or empty signatures with it: the parts
   without a sound signature cost nothing, those with some cost one difference, all others two, and the sum is at most k.
   In the order of their number of stuck nodes, a quarter of the shingles of either of two similar sets hold a common one: stuck nodes for which these
   are rare meet there. The others are little but a passage or a text that many share. Each crowded signature has a pivot,
   its most central node P. The symmetric difference with P leaves distances as they are: X and Y are similar if X ^ P and Y ^ P are as close. What a
   group has in common vanishes there, so nodes that are near P are linked with it, and for the others a join on the rarest members
   of the differences finds every partner. Two nodes that share only empty signatures have the empty set as their pivot.
   No signature, group or pair is dropped.
4. Candidates are checked by counts per part of a sketch, a lower bound of the difference, and then by the hashes of all shingles.

Shingles are told apart by 64-bit hashes, sets by two independent ones of 64 bits.

Edge cases: null and empty texts and texts without a word have the empty set, size 0, and link with nothing (each row is its own component);
equal rows and rows of one id are rows of their own; a component's name is its least id, null if it has none; an empty table gives an empty result.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codepoints import absorbed, batches, codes, give_up, mixed, release, slices, span_hashes
from .components import components
from .storage import discard, met_by, row_key, unused, written

N = 5
#: Similar: 100 * |both| >= PERCENT * |either|. The difference is then at most (|a| + |b|) / 7.
PERCENT = 75
#: Nodes that share a signature up to which it gives all their pairs.
FEW = 12
#: Of a signature that more nodes share within one flush of a task, only the most central goes to the meeting; the others learn the pivot by a join.
MANY = 256
#: Stuck nodes that share a shingle up to which it counts as rare.
RARE = 32
#: Least hashes a node.
LEADERS = 10
#: Subparts of a part. A subset leaves out one.
SUBPARTS = 3
#: Pairs of one node that are verified together.
TOGETHER = 200
#: Parts of the sketch of a small set.
SKETCH = 128
#: A shingle is common if COMMON of SAMPLE nodes drawn by hash hold it, of those of up to SAMPLE_SIZE shingles: at most 20 MB reach the driver. It decides on work, not on results.
SAMPLE, SAMPLE_SIZE, COMMON = 5000, 2000, 4
#: Signatures that meet in one group, and that a task holds before it passes them on.
MEET, HELD = 400_000, 600_000
#: Rows of (id, hash) up to which the texts of some nodes are fetched by a broadcast of these, 24 bytes each; beyond, by a shuffle.
BROADCAST_ROWS = 200_000
#: What stands between words, blank and tab to carriage return.
_GAPS = [32, 9, 10, 11, 12, 13]


def bands(size: int) -> list[tuple[int, int]]:
    """(first, last) size of each band, up to one that holds the size."""
    out, low = [], 1
    while not out or out[-1][1] < size:
        out.append((low, 4 * low // 3))
        low = out[-1][1] + 1
    return out


def shape(last: int) -> tuple[int, int]:
    """(n, k) of the join of a band that ends at `last` with itself and the next: parts, and the most shingles that may differ. More than k / 2 parts hold at most one."""
    k = (last + 4 * last // 3) // 7
    return (3 * k) // 5 + 2, k


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (one more at the end)."""
    cp, starts = codes(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    solid = np.ones(len(cp) + 1, bool)
    solid[:-1] = ~np.isin(cp, np.array(_GAPS, np.uint32))
    edge = np.ones(len(cp) + 1, bool)
    edge[1:] = solid[1:] != solid[:-1]
    edge[starts] = True
    cuts = np.flatnonzero(edge)
    a, b = cuts[:-1], cuts[1:]
    a, b = a[solid[a]], b[solid[a]]
    at = np.searchsorted(a, starts)
    words, _ = span_hashes(cp, a, b)
    count = np.diff(at)
    n = np.where(count >= N, count - N + 1, np.minimum(count, 1))
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.arange(ends[-1]) - ends[:-1][owner] + at[:-1][owner]
    length = np.minimum(count, N)[owner]
    h = mixed(length)
    for i in range(N):
        on = np.flatnonzero(length > i)
        h[on] = absorbed(h[on], words[first[on] + i], 0x9E3779B97F4A7C15)
    h = mixed(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _sums(values: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Sums modulo 2**64 of the values of each cell."""
    low = np.bincount(cell, (values & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
    high = np.bincount(cell, (values >> np.uint64(32)).astype(float), cells).astype(np.uint64)
    return low + (high << np.uint64(32))


def bins(n: np.ndarray) -> np.ndarray:
    """Parts of the sketch of a set of n shingles: a power of two with no more than four shingles a part, at least SKETCH. With fuller parts, sets of strangers look alike."""
    return SKETCH << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / (4 * SKETCH))), 0).astype(np.int64)


def narrowed(sketch: np.ndarray, parts: int) -> np.ndarray:
    """Sketches, one a row, with fewer parts."""
    return np.minimum(sketch.reshape(len(sketch), -1, parts).sum(1, dtype=np.int32), 255)


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _h, n (set size), h1 and h2 (hashes of the set), keys (least hashes), sketch, wide (a finer sketch of large sets, else empty), of each row."""
    keyed = docs.select(F.col(doc_id).alias("_id"), row_key(text).alias("_h"), F.col(text).alias("_text"))

    def run(parts):
        give_up()
        salts = mixed(np.arange(1, LEADERS + 1))
        for batch in parts:
            texts = batches(batch.column("_text"))
            for x, y in slices(texts):
                h, at = shingles(texts[x:y])
                n = np.diff(at)
                owner = np.repeat(np.arange(y - x), n)
                sums = [mixed(_sums(mixed(h ^ np.uint64(s)), owner, y - x) + n.astype(np.uint64)).view(np.int64) for s in (0, 0xA0761D6478BD642F)]
                full = n > 0
                keys = np.zeros((y - x, LEADERS), np.uint64)
                for i, s in enumerate(salts):
                    if full.any():
                        keys[full, i] = mixed(np.minimum.reduceat(mixed(h ^ s), at[:-1][full]) + np.uint64(i))
                wide = bins(n)
                base = np.cumsum(wide) - wide
                sketch = np.minimum(np.bincount(base[owner] + (h % wide[owner].astype(np.uint64)).astype(np.int64), minlength=int(wide.sum())), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").slice(x, y - x), batch.column("_h").slice(x, y - x), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(y - x + 1, dtype=np.int32) * LEADERS), pa.array(keys.view(np.int64).reshape(-1))), pa.array([narrowed(sketch[i : i + w][None], SKETCH).astype(np.uint8).tobytes() for i, w in zip(base.tolist(), wide.tolist())], pa.binary()),
                    pa.array([sketch[i : i + w].tobytes() if w > SKETCH else b"" for i, w in zip(base.tolist(), wide.tolist())], pa.binary()),
                ], ["_id", "_h", "n", "h1", "h2", "keys", "sketch", "wide"])
        release()

    return keyed.mapInArrow(run, "_id long, _h long, n long, h1 long, h2 long, keys array<long>, sketch binary, wide binary")


class Scheme:
    """The joins of bands up to a size: their parts, and the groups in which their signatures meet."""

    def __init__(self, sizes: dict[int, int], top: int, common: np.ndarray):
        """sizes: the number of nodes of each band; common: the sorted hashes of the common shingles."""
        self.common = common
        table = bands(top)
        self.lows = np.array([b[0] for b in table])
        self.n, self.k = np.array([shape(b[1]) for b in table]).T
        total = np.array([(sizes.get(j, 0) + sizes.get(j + 1, 0)) * SUBPARTS * self.n[j] for j in range(len(table))])
        groups = total // MEET + 1
        self.ranges, self.cuts = np.minimum(groups, self.n), -(-groups // self.n)
        self.first = np.cumsum(self.ranges * self.cuts) - self.ranges * self.cuts
        self.groups = int((self.ranges * self.cuts).sum())
        self.few, self.many, self.held = FEW, MANY, HELD

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, side="right") - 1

    def signatures(self, h: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None):
        """For the band's own join (down 0) and for that with the band below (1): down, join, owner (which set), part, sig (one column a subset, 40 bits), empty, of each part of each set.

        Without common shingles, or, with `wanted` (a row for each join), with them for the wanted sets.
        """
        n = np.diff(at)
        sets, band = np.arange(len(n)), self.band(n)
        owner = np.repeat(sets, n)
        if wanted is None and len(self.common):
            rare = self.common[np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)] != h
            h, owner = h[rare], owner[rare]
        m = mixed(h)
        for down in (0, 1):
            join = np.maximum(band - down, 0)
            use = (band >= down) & (n > 0) & (self.k[join] > 0)  # where nothing may differ, similar sets are one node
            parts = np.where(use if wanted is None else use & wanted[down], self.n[join], 0)
            total = int(parts.sum())
            if not total:
                continue
            base = np.cumsum(parts) - parts
            on = parts[owner] > 0
            x, o = h[on], owner[on]
            part = ((x >> np.uint64(34)) * parts[o].astype(np.uint64) >> np.uint64(30)).astype(np.int64)
            cell = (base[o] + part) * SUBPARTS + ((x & np.uint64(0xFFFF)) * np.uint64(SUBPARTS) >> np.uint64(16)).astype(np.int64)
            sums = _sums(m[on], cell, SUBPARTS * total).reshape(-1, SUBPARTS)
            count = np.bincount(cell, minlength=SUBPARTS * total).reshape(-1, SUBPARTS)
            of = np.repeat(sets, parts)
            index = np.arange(total) - base[of]
            code = ((join[of] << 32) + index * SUBPARTS)[:, None] + np.arange(SUBPARTS) + (0 if wanted is None else 1 << 60)
            sig = mixed(sums.sum(1, dtype=np.uint64)[:, None] - sums + mixed(code)) >> np.uint64(24)
            yield down, join[of], of, index, sig, count.sum(1)[:, None] == count

    def group(self, join: np.ndarray, part: np.ndarray, sig: np.ndarray) -> np.ndarray:
        cuts = self.cuts[join]
        return self.first[join] + part * self.ranges[join] // self.n[join] * cuts + (sig % cuts.astype(np.uint64)).astype(np.int64)

    def lack(self, join: np.ndarray, owner: np.ndarray, bad: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
        """How many differences more than k the parts of each set need if the bad signatures are worth nothing, and the join of each set (-1: none). At most 0: stuck."""
        free = bad.sum(1)
        cost = np.where(free == 0, 2, np.where(free < SUBPARTS, 1, 0))
        of = np.full(sets, -1)
        of[owner] = join
        return np.bincount(owner, cost, sets).astype(np.int64) - self.k[of], of


def _heads(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)


def _wide(blob: bytes) -> np.ndarray:
    """Numbers of 40 bits."""
    five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").reshape(-1)


def _narrow(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


class Flush:
    """The signatures that a task holds: of each, its group and its node."""

    def __init__(self, groups: int, many: int):
        self.groups, self.many, self.held, self.nodes, self.size, self.docs = groups, many, [], [], 0, 0

    def add(self, p: np.ndarray, sig: np.ndarray, owner: np.ndarray) -> None:
        self.held.append((p.astype(np.int32), sig, (owner + self.docs).astype(np.int32)))
        self.size += len(sig)

    def met(self, nodes: np.ndarray) -> None:
        """node, root, pop, need of the sets added last."""
        self.nodes.append(nodes)
        self.docs += len(nodes)

    def out(self, name: int) -> pa.RecordBatch | None:
        if not self.held:
            return None
        p, sig, idx = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        nodes = np.concatenate(self.nodes)
        ps, blobs = [], []
        for at, to in self.trimmed(p, sig, idx, nodes):  # `at`: the members of one signature, `to` the one that stands for them
            if to is None:
                p, sig, idx = p[at], sig[at], idx[at]
                break
            ps.append(int(p[to]))
            blobs.append(b"T" + struct.pack("<qQqqi", name, int(sig[to]), *nodes[idx[to], :3].tolist()))
            ps.append(-1 - int(sig[to]) % self.groups)
            blobs.append(b"M" + struct.pack("<qQ", name, int(sig[to])) + nodes[idx[at], 0].astype("<i8").tobytes())
        order = np.lexsort((idx, p))
        p, sig, idx = p[order], sig[order], idx[order]
        cuts = np.append(_heads(p), len(p)).tolist()
        for s, e in zip(cuts, cuts[1:]):
            own = idx[s:e]
            at = _heads(own)
            heads, counts = nodes[own[at]], np.diff(np.append(at, e - s)).astype("<u4")
            ps.append(int(p[s]))
            blobs.append(b"S" + struct.pack("<I", len(at)) + heads[:, :2].astype("<i8").tobytes() + heads[:, 2:].astype("<i4").tobytes() + counts.tobytes() + _narrow(sig[s:e]))
        self.__init__(self.groups, self.many)
        return pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(blobs, pa.binary())], ["p", "blob"])

    def trimmed(self, p: np.ndarray, sig: np.ndarray, idx: np.ndarray, nodes: np.ndarray):
        """(members, most central) of each signature of more than `many` members, and last (all others, None)."""
        keep = np.ones(len(sig), bool)
        if np.bincount((sig & np.uint64(0xFFFFF)).astype(np.int64)).max() > self.many:
            order = np.lexsort((sig, p))
            run = np.append(_heads(sig[order]), len(sig))
            for x in np.flatnonzero(np.diff(run) > self.many).tolist():
                at = order[run[x] : run[x + 1]]
                if (p[at] == p[at[0]]).all():
                    keep[at] = False
                    own = nodes[idx[at]]
                    yield at, at[np.lexsort((own[:, 0], -own[:, 2]))[0]]
        yield np.flatnonzero(keep), None


SIGNED = "kind int, a long, b long, blob binary"


def meeting(t: pa.Table, few: int) -> pa.Table:
    """What the signatures of one group give, as rows of SIGNED. kind 0: a pair (a, b); 1: node a, whose differences must be b more to be stuck, has crowded signatures, in blob with their pivots;
    2: the nodes in blob share signature b of flush a; 3: the pivot, in blob, of that; 4: node a is stuck in join b by empty signatures alone."""
    blobs = t.column("blob").to_pylist()
    kind, a, b, extra = [], [], [], []

    def give(k: int, x, y, z) -> None:
        kind.append(np.full(len(x), k, np.int32))
        a.append(np.asarray(x, np.int64))
        b.append(np.asarray(y, np.int64))
        extra.extend(z if z is not None else [b""] * len(x))

    heads, small, sigs, trimmed = [], [], [], []
    for blob in blobs:
        if blob[:1] == b"M":
            flush, sig = struct.unpack_from("<qQ", blob, 1)
            give(2, [flush], [sig], [blob[17:]])
        elif blob[:1] == b"E":
            rows = np.frombuffer(blob, "<i8", offset=1).reshape(-1, 2)
            give(4, rows[:, 0], rows[:, 1], None)
        elif blob[:1] == b"T":
            trimmed.append(struct.unpack_from("<qQqqi", blob, 1))
        else:
            (k,) = struct.unpack_from("<I", blob, 1)
            counts = np.frombuffer(blob, "<u4", k, 5 + 24 * k)
            heads.append(np.repeat(np.frombuffer(blob, "<i8", 2 * k, 5).reshape(k, 2), counts, 0))
            small.append(np.repeat(np.frombuffer(blob, "<i4", 2 * k, 5 + 16 * k).reshape(k, 2), counts, 0))
            sigs.append(_wide(blob[5 + 28 * k :]))
    if trimmed:
        flush, sig, node, root, pop = (np.array(x) for x in zip(*trimmed))
        heads.append(np.stack([node, root], 1).astype(np.int64))
        small.append(np.stack([pop, np.full(len(pop), -1)], 1).astype(np.int32))
        sigs.append(sig.astype(np.uint64))
    if sigs:
        sig, doc, low = np.concatenate(sigs), np.concatenate(heads), np.concatenate(small)
        order = np.lexsort((doc[:, 0], -low[:, 0], sig))  # the most central first
        sig, doc, low = sig[order], doc[order], low[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (doc[1:, 0] != doc[:-1, 0])
        sig, doc, low = sig[new], doc[new], low[new]
        root = doc[:, 1]
        start = _heads(sig)
        length = np.diff(np.append(start, len(sig)))
        differs = np.zeros(len(sig), np.int64)
        differs[1:] = (sig[1:] == sig[:-1]) & (root[1:] != root[:-1])
        cut = np.isin(sig[start], np.array([x[1] for x in trimmed], np.uint64)) if trimmed else np.zeros(len(start), bool)
        tangled = (np.add.reduceat(differs, start) > 0) | cut
        crowded = tangled & ((length > few) | cut)
        run_of = np.repeat(np.arange(len(length)), length)
        pairs, free = [], (tangled & ~crowded)[run_of]
        for d in range(1, min(few, len(sig))):
            i = np.flatnonzero(free[:-d] & (sig[:-d] == sig[d:]) & (root[:-d] != root[d:]))
            if len(i):
                pairs.append(np.sort(np.stack([doc[i, 0], doc[i + d, 0]], 1), axis=1))
        if pairs:
            pairs = np.unique(np.concatenate(pairs), axis=0)
            give(0, pairs[:, 0], pairs[:, 1], None)
        pivot = doc[start, 0]
        hot = np.flatnonzero(crowded[run_of] & (low[:, 1] >= 0))
        hot = hot[np.argsort(doc[hot, 0], kind="stable")]
        at = _heads(doc[hot, 0])
        lists = [struct.pack("<I", len(x)) + _narrow(sig[x]) + pivot[run_of[x]].astype("<i8").tobytes() for x in np.split(hot, at[1:])] if len(hot) else []
        give(1, doc[hot[at], 0], low[hot[at], 1], lists)
        if trimmed:
            where = dict(zip(sig[start].tolist(), pivot.tolist()))
            give(3, [x[0] for x in trimmed], [x[1] for x in trimmed], [struct.pack("<q", where[x[1]]) for x in trimmed])
    empty = np.zeros(0, np.int64)
    return pa.table({"kind": np.concatenate([empty.astype(np.int32), *kind]), "a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b]), "blob": pa.array(extra, pa.binary())})


def _texts(batch: pa.RecordBatch):
    """(from, to, texts) of runs of a batch with _packed or _text."""
    if "_packed" in batch.schema.names:
        for z in range(0, batch.num_rows, 200):
            texts = [zlib.decompress(t).decode("utf-8", "surrogatepass") for t in batch.column("_packed").slice(z, 200).to_pylist()]
            for x, y in slices(texts):
                yield z + x, z + y, texts[x:y]
    else:
        texts = batches(batch.column("_text"))
        for x, y in slices(texts):
            yield x, y, texts[x:y]


class Join:
    """The nodes of a table of documents and the links between them."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.doc_id, self.text, self.spark = doc_id, text, docs.sparkSession
        self.rows = written(digests(docs, doc_id, text), "digests")
        full = self.rows.where("n > 0")
        nodes = full.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
        self.nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.spent: list[DataFrame] = []
        self.docs = docs.select(F.col(doc_id).alias("_id"), row_key(text).alias("_h"), F.col(text).alias("_text"))
        if self.rows.groupBy("_id", "_h").count().where("count > 1").limit(1).count():  # else each representative is one row
            self.docs = self.docs.dropDuplicates(["_id", "_h"])

    def step(self, df: DataFrame, label: str) -> DataFrame:
        """df, written; it goes when the links are all found."""
        self.spent.append(written(df, label, few=True))
        return self.spent[-1]

    def texts(self, nodes: DataFrame, few: bool) -> DataFrame:
        """The columns of nodes (with rep) and the text of the representative, in _text or compressed in _packed. few: at most BROADCAST_ROWS nodes."""

        def run(parts):
            for batch in parts:
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), pa.array([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batches(batch.column("_text"))], pa.binary())], ["_id", "_h", "_packed"])

        docs = self.docs if few else self.docs.mapInArrow(run, "_id long, _h long, _packed binary")
        # by shuffle hashed with the key, so that a nullable id can be matched as equal
        side = F.broadcast(nodes) if few else nodes.hint("shuffle_hash")
        joined = docs.join(side, docs["_id"].eqNullSafe(nodes["rep._id"]) & (docs["_h"] == nodes["rep._h"]))
        return joined.select(*nodes.columns, "_text" if few else "_packed")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node, set (its sorted shingle hashes, 8 bytes each) of the wanted nodes, which may be named more than once."""

        def run(parts):
            for batch in parts:
                for x, y, texts in _texts(batch):
                    h, at = shingles(texts)
                    yield pa.RecordBatch.from_arrays([batch.column("node").slice(x, y - x), pa.array([h[at[i] : at[i + 1]].astype("<u8").tobytes() for i in range(y - x)], pa.binary())], ["node", "set"])
            release()

        own = written(self.nodes.select("node", "rep").join(wanted, "node", "left_semi"), "wanted")
        out = self.step(self.texts(own, own.count() <= BROADCAST_ROWS).mapInArrow(run, "node long, set binary"), "sets")
        discard(own)
        return out

    def compared(self, pairs: DataFrame, sets: DataFrame, with_set, schema: str) -> DataFrame:
        """with_set(a, own set, [b], [set of b]) -> table, for the pairs (a, b). Each pair moves one set: the pairs of a node meet its set, in groups of about TOGETHER."""
        groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("m"))
        asked = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).alias("s"))
        each = sets.select(F.col("node").alias("b"), "set")
        sides = asked.withColumn("own", F.lit(False)).join(each, "b").unionByName(asked.select("a", "s", F.col("a").alias("b"), F.lit(True).alias("own")).distinct().join(each, "b"))

        def run(t: pa.Table) -> pa.Table:
            own, b, held = t.column("own").to_numpy(zero_copy_only=False), t.column("b").to_numpy(), t.column("set").to_pylist()
            other = np.flatnonzero(~own)
            return with_set(t.column("a")[0].as_py(), np.frombuffer(held[int(np.flatnonzero(own)[0])], "<u8"), b[other], [np.frombuffer(held[i], "<u8") for i in other.tolist()])

        return sides.groupBy("a", "s").applyInArrow(run, schema)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are similar."""
        side = lambda s, c: self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col(c).alias(f"s{s}"))

        def near(parts):
            for batch in parts:
                for x in range(0, batch.num_rows, 4000):
                    some = batch.slice(x, 4000)
                    na, nb = (some.column(c).to_numpy() for c in ("na", "nb"))
                    sa, sb = (some.column(c).to_pylist() for c in ("sa", "sb"))
                    la, lb = (np.array([len(v) for v in side]) for side in (sa, sb))
                    keep = np.ones(some.num_rows, bool)
                    for p, q in set(zip(la.tolist(), lb.tolist())):
                        if min(p, q):  # else one set is too small for a finer sketch
                            i, w = np.flatnonzero((la == p) & (lb == q)), min(p, q)
                            u, v = (narrowed(np.frombuffer(b"".join([side[j] for j in i.tolist()]), np.uint8).reshape(len(i), -1), w) for side in (sa, sb))
                            keep[i] = 7 * np.abs(u - v).sum(1) <= na[i] + nb[i]
                    yield some.select(["a", "b"]).filter(pa.array(keep))

        close = pairs
        for column in ("sketch", "wide"):  # what the first leaves is little enough for the second, which is as long as an eighth of the set
            before = close
            close = written(close.join(side("a", column), "a").join(side("b", column), "b").where("7 * abs(na - nb) <= na + nb").mapInArrow(near, "a long, b long"), "close", few=True)
            if column == "wide":
                discard(before)
        held = self.sets(close.select(F.col("a").alias("node")).union(close.select("b")))

        def same(a: int, own: np.ndarray, b: np.ndarray, others: list[np.ndarray]) -> pa.Table:
            both = np.array([len(np.intersect1d(own, x, assume_unique=True)) for x in others])
            keep = b[100 * both >= PERCENT * (len(own) + np.array([len(x) for x in others]) - both)]
            return pa.table({"a": np.full(len(keep), a), "b": keep})

        links = self.step(self.compared(close, held, same, "a long, b long"), "links")
        discard(close, held)
        return links

    def central(self) -> DataFrame:
        """node, pop: how many nodes share its least hashes, of the nodes that share any; in a group of near copies, most for those in its middle."""
        keyed = self.nodes.select("node", F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        return self.step(keyed.join(shared, "key").groupBy("node").agg(F.least(F.sum("m"), F.lit(2_000_000_000)).cast("int").alias("pop")), "central")

    def led(self, central: DataFrame) -> DataFrame:
        """Pairs of a node with the most central of those that share one of its least hashes."""
        keyed = self.nodes.select("node", F.explode("keys").alias("key")).join(central, "node")
        leaders = keyed.groupBy("key").agg(F.max(F.struct("pop", (-F.col("node")).alias("a"))).alias("x"), F.count("*").alias("m")).where("m > 1").select("key", (-F.col("x.a")).alias("lead"))
        return keyed.join(leaders, "key").where("node != lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()

    def common(self) -> np.ndarray:
        """The sorted hashes of the common shingles, from a bounded sample."""
        u = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) / (1 << 30)
        few = self.nodes.where(F.col("n") <= SAMPLE_SIZE)
        some = self.sets(few.where(u < min(1.0, 1.2 * SAMPLE / max(1, few.count()))).orderBy(u).limit(SAMPLE).select("node"))

        def counted(parts):
            for batch in parts:
                h, n = np.unique(np.frombuffer(b"".join(batch.column("set").to_pylist()), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

        found = some.select("set").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select("h").toArrow()
        discard(some)
        return np.sort(found.column("h").to_numpy().view(np.uint64))

    def scheme(self) -> Scheme:
        top = self.nodes.agg(F.max("n").alias("m")).first().m or 1
        lows = F.array(*(F.lit(low) for low, _ in bands(top)))
        band = F.size(F.filter(lows, lambda x: x <= F.col("n"))) - 1
        return Scheme({r.band: r["count"] for r in self.nodes.groupBy(band.alias("band")).count().collect()}, top, self.common())  # one row a band

    def signed(self, scheme: Scheme, central: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of SIGNED for all nodes."""
        nodes = self.nodes.select("node", "rep").join(roots, "node", "left").join(central, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"), F.coalesce("pop", F.lit(0)).alias("pop"))

        def run(parts):
            flush = Flush(scheme.groups, scheme.many)
            for batch in parts:
                doc = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("node", "root", "pop")], 1)
                for x, y, texts in _texts(batch):
                    h, at = shingles(texts)
                    need, marks, bare = np.full(y - x, np.iinfo(np.int32).max, np.int64), [], np.zeros((2, y - x), bool)
                    for wanted in (None, bare):  # those with too few rare shingles are signed with all
                        for down, join, owner, part, sig, empty in scheme.signatures(h, at, wanted):
                            lack, of = scheme.lack(join, owner, empty, y - x)
                            stuck = (of >= 0) & (lack <= 0)
                            if wanted is None:
                                bare[down] = stuck
                            else:
                                marks += [(int(doc[x + i, 0]), int(of[i])) for i in np.flatnonzero(stuck).tolist()]
                            need = np.where(of >= 0, np.minimum(need, np.maximum(lack, 1)), need)
                            on, sub = np.nonzero(~empty)
                            flush.add(scheme.group(join[on], part[on], sig[on, sub]), sig[on, sub], owner[on])
                    flush.met(np.concatenate([doc[x:y], need[:, None]], 1))
                    if marks:
                        yield pa.RecordBatch.from_arrays([pa.array([-1 - marks[0][0] % scheme.groups], pa.int64()), pa.array([b"E" + np.array(marks, "<i8").tobytes()], pa.binary())], ["p", "blob"])
                    if flush.size > scheme.held:
                        yield flush.out(int(doc[x, 0]))
            last = flush.out(int(doc[x, 0])) if flush.size else None
            if last is not None:
                yield last
            release()

        blobs = self.texts(nodes, False).mapInArrow(run, "p long, blob binary")
        return self.step(blobs.groupBy("p").applyInArrow(lambda t: meeting(t, scheme.few), SIGNED), "signed")

    def stuck(self, scheme: Scheme, signed: DataFrame, roots: DataFrame, central: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(x, p): stuck nodes and their pivots, a negative number for the empty set; and the sets of all of them. In place of a pivot stands the most central node of the component
        of its own most central pivot, so that the signatures of one group of near copies have one pivot: nodes that share a pivot still do."""

        def members(parts):
            for batch in parts:
                by: dict[int, list] = {}
                for sig, nodes, pivot in zip(batch.column("b").to_pylist(), batch.column("nodes").to_pylist(), batch.column("pivot").to_pylist()):
                    for node in np.frombuffer(nodes, "<i8").tolist():
                        by.setdefault(node, []).append((sig, struct.unpack("<q", pivot)[0]))
                lists = [struct.pack("<I", len(v)) + _narrow(np.array([s for s, _ in v], np.uint64)) + np.array([q for _, q in v], "<i8").tobytes() for v in by.values()]
                yield pa.RecordBatch.from_arrays([pa.array(by.keys(), pa.int64()), pa.array([0] * len(by), pa.int64()), pa.array(lists, pa.binary())], ["a", "b", "blob"])

        many = signed.where("kind = 2").select("a", "b", F.col("blob").alias("nodes")).join(signed.where("kind = 3").select("a", "b", F.col("blob").alias("pivot")), ["a", "b"]).mapInArrow(members, "a long, b long, blob binary")
        # too few crowded signatures for what the parts need: each takes one difference away at most
        crowd = signed.where("kind = 1").select("a", "b", "blob").unionByName(many).groupBy("a").agg(F.collect_list("blob").alias("lists"), F.min("b").alias("need"), F.sum(F.length("blob") - 4).alias("bytes"))
        crowd = written(crowd.where("bytes >= 13 * need").select(F.col("a").alias("node"), "lists"), "crowd", few=True)
        empty = signed.where("kind = 4").select(F.col("a").alias("x"), (-1 - F.col("b")).alias("p"))

        def pivots(parts):
            for batch in parts:
                for z in range(0, batch.num_rows, 200):
                    some = batch.slice(z, 200)
                    sets = [np.frombuffer(v, "<u8") for v in some.column("set").to_pylist()]
                    h, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
                    keys, values = [], []
                    for i, lists in enumerate(some.column("lists").to_pylist()):
                        for blob in lists:
                            (k,) = struct.unpack_from("<I", blob)
                            keys.append(_wide(blob[4 : 4 + 5 * k]) | np.uint64(i << 40))
                            values.append(np.frombuffer(blob, "<i8", k, 4 + 5 * k))
                    key, value = np.concatenate(keys), np.concatenate(values)
                    order = np.argsort(key)
                    key, value = key[order], value[order]
                    found, bare = [], np.zeros((2, len(sets)), bool)
                    for wanted in (None, bare):
                        for down, join, owner, _, sig, empty in scheme.signatures(h, at, wanted):
                            if wanted is None:
                                bare[down] = scheme.lack(join, owner, empty, len(sets))[0] <= 0
                            own = sig | (owner.astype(np.uint64) << np.uint64(40))[:, None]
                            place = np.minimum(np.searchsorted(key, own), len(key) - 1)
                            crowded = (key[place] == own) & ~empty
                            crowded &= (scheme.lack(join, owner, crowded | empty, len(sets))[0] <= 0)[owner][:, None]
                            found.append(np.stack([np.broadcast_to(owner[:, None], sig.shape)[crowded], value[place[crowded]]], 1))
                    if found:
                        found = np.unique(np.concatenate(found), axis=0)
                        yield pa.RecordBatch.from_arrays([some.column("node").take(pa.array(found[:, 0])), pa.array(found[:, 1])], ["x", "p"])

        own = self.sets(crowd.select("node"))
        found = written(crowd.join(own, "node").mapInArrow(pivots, "x long, p long"), "pivots", few=True)
        middle = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(central, "node", "left").groupBy("root").agg(F.max_by("node", F.struct(F.coalesce("pop", F.lit(0)), -F.col("node"))).alias("middle"))
        best = found.join(central.withColumnRenamed("node", "p"), "p").groupBy("x").agg(F.max_by("p", F.struct("pop", -F.col("p"))).alias("best"))
        whole = found.select("p").distinct().join(best.withColumnRenamed("x", "p"), "p", "left").withColumn("best", F.coalesce("best", "p"))
        whole = whole.join(roots.select(F.col("node").alias("best"), "root"), "best", "left").withColumn("root", F.coalesce("root", "best")).join(middle, "root", "left").select("p", F.coalesce("middle", "best").alias("middle"))
        pairs = self.step(found.join(whole, "p").select("x", F.col("middle").alias("p")).distinct().unionByName(empty), "stuck")
        discard(crowd, own, found)
        return pairs, self.sets(pairs.select(F.col("x").alias("node")).union(pairs.select("p")))

    def rarest(self, scheme: Scheme, stuck: DataFrame, sets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """x: the stuck nodes whose rarest quarter of shingles holds one of more than RARE stuck nodes; and candidates (a, b), all similar pairs with another node among them."""
        common = scheme.common

        def rare(parts):
            for batch in parts:
                h = [np.frombuffer(v, "<u8") for v in batch.column("set").to_pylist()]
                kept = [v[common[np.minimum(np.searchsorted(common, v), len(common) - 1)] != v] if len(common) else v for v in h]
                yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array([len(v) for v in h], pa.int64()), pa.array([v.view("<i8") for v in kept], pa.list_(pa.int64()))], ["x", "n", "tokens"])

        nodes = self.step(stuck.join(sets.withColumnRenamed("node", "x"), "x").select("x", "set").mapInArrow(rare, "x long, n long, tokens array<long>"), "rare")
        tokens = nodes.select("x", F.explode("tokens").alias("t"))
        shared = tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
        ranked = tokens.join(shared, "t").select("x", "t", "c", F.row_number().over(Window.partitionBy("x").orderBy("c", "t")).alias("i"), F.count("*").over(Window.partitionBy("x")).alias("some"))
        facts = nodes.select("x", "n", F.size("tokens").alias("all")).join(roots, "x", "left").select("x", "n", "all", F.coalesce("rx", "x").alias("root"))
        # what no other stuck node has comes first
        first = self.step(ranked.join(facts, "x").withColumn("i", F.col("i") + F.col("all") - F.col("some")).where("i <= n div 4 + 1").select("x", "n", "root", "t", "c", "i"), "first")
        full = facts.where("all < n div 4 + 1").select("x").unionByName(first.where(F.col("c") > RARE).select("x")).distinct()
        one, two = (first.where(F.col("c") <= RARE).select("t", *(F.col(c).alias(f"{c}{k}") for c in ("x", "n", "root", "i"))) for k in (1, 2))
        met = one.join(two, "t").where("x1 < x2 and root1 != root2 and 7 * abs(n1 - n2) <= n1 + n2 and 7 * (1 + least(n1 - i1, n2 - i2)) >= 3 * (n1 + n2)")
        return full, met.select(F.col("x1").alias("a"), F.col("x2").alias("b")).distinct()

    def first(self, outer: DataFrame) -> DataFrame:
        """p, x, n, d, out, root, some (the members of x's difference that another node of p has), t, i: the rarest of these members, all but the last least - 1, ranked from 1.

        The nodes of a pivot are dealt into blocks s. How many nodes have a member is summed from blocks and goes back once a block: what a group has lost of its pivot is in most
        differences, and would else be joined for each node anew."""

        def counted(t: pa.Table) -> pa.Table:
            h, c = np.unique(t.column("tokens").combine_chunks().flatten().to_numpy(), return_counts=True)
            return pa.table({"p": np.full(len(h), t.column("p")[0].as_py()), "s": np.full(len(h), t.column("s")[0].as_py()), "t": h.astype(np.int64), "c": c.astype(np.int64)})

        here = self.step(outer.select("p", "s", "tokens").groupBy("p", "s").applyInArrow(counted, "p long, s long, t long, c long"), "members")
        shared = here.groupBy("p", "t").agg(F.sum("c").alias("c")).where("c > 1")
        known = here.select("p", "s", "t").join(shared, ["p", "t"])

        def ranked(t: pa.Table) -> pa.Table:
            told = t.filter(pa.compute.is_valid(t.column("t")))
            order = np.argsort(told.column("t").to_numpy())
            key, count = told.column("t").to_numpy()[order], told.column("c").to_numpy()[order]
            nodes = t.filter(pa.compute.is_null(t.column("t"))).drop_columns(["t", "c"])
            members, some, takes = [], [], []
            for v, least in zip(nodes.column("tokens"), nodes.column("least").to_pylist()):
                v = v.values.to_numpy()
                at = np.minimum(np.searchsorted(key, v), max(len(key) - 1, 0))
                v, c = (v[on], count[at[on]]) if len(key) and (on := key[at] == v).any() else (v[:0], v[:0])
                some.append(len(v))
                members.append(v[np.lexsort((v, c))][: max(0, len(v) + 1 - least)])
                takes.append(len(members[-1]))
            of = np.repeat(np.arange(len(takes)), takes)
            out = nodes.select(["p", "x", "n", "d", "out", "root"]).take(pa.array(of))
            first = np.cumsum(takes) - takes
            return out.append_column("some", pa.array(np.array(some, np.int64)[of])).append_column("t", pa.array(np.concatenate([*members, np.zeros(0, np.int64)]).astype(np.int64))).append_column("i", pa.array(np.arange(len(of)) - first[of] + 1))

        sides = outer.withColumns({"t": F.lit(None).cast("long"), "c": F.lit(None).cast("long")}).unionByName(known, allowMissingColumns=True)
        return sides.groupBy("p", "s").applyInArrow(ranked, "p long, x long, n long, d long, out boolean, root long, some long, t long, i long")

    def pivoted(self, scheme: Scheme, signed: DataFrame, roots: DataFrame, central: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of stuck nodes with their pivots, and candidates (a, b) among the stuck nodes of a pivot."""
        pairs, sets = self.stuck(scheme, signed, roots, central)
        if not pairs.limit(1).count():
            none = self.spark.createDataFrame([], "a long, b long")
            return none, none
        rooted = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        full, met = self.rarest(scheme, pairs.where("p >= 0").select("x").distinct(), sets, rooted("x"))
        pairs = pairs.join(full, "x", "left_semi").unionByName(pairs.where("p < 0"))

        def apart(p: int, own: np.ndarray, x: np.ndarray, others: list[np.ndarray]) -> pa.Table:
            d = [np.setxor1d(own, o, assume_unique=True) for o in others]
            n, size = np.array([len(o) for o in others], np.int64), np.array([len(v) for v in d], np.int64)
            near = 7 * size <= n + len(own)
            return pa.table({"p": np.full(len(x), p), "x": x, "n": n, "m": np.full(len(x), len(own)), "d": size, "near": near, "tokens": pa.array([v.view(np.int64) for v in d], pa.list_(pa.int64()))})

        schema = "p long, x long, n long, m long, d long, near boolean, tokens array<long>"
        own = self.compared(pairs.where("p >= 0 and x != p").select(F.col("p").alias("a"), F.col("x").alias("b")), sets, apart, schema)

        def whole(parts):
            for batch in parts:
                h = [np.frombuffer(v, "<i8") for v in batch.column("set").to_pylist()]
                n = pa.array([len(v) for v in h], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("x"), n, pa.array([0] * len(h), pa.int64()), n, pa.array([False] * len(h)), pa.array(h, pa.list_(pa.int64()))], ["p", "x", "n", "m", "d", "near", "tokens"])

        alone = pairs.where("p < 0").join(sets.withColumnRenamed("node", "x"), "x").select("p", "x", "set").mapInArrow(whole, schema)
        all_ = self.step(own.unionByName(alone).join(rooted("x"), "x", "left").join(rooted("p"), "p", "left").select("p", "x", "n", "m", "d", "near", "tokens", F.coalesce("rx", "x").alias("root"), (F.coalesce("rx", "x") == F.coalesce("rp", "p")).alias("inside")), "apart")
        links = all_.where("near and not inside").select(F.least("p", "x").alias("a"), F.greatest("p", "x").alias("b"))
        # only a pivot with a node outside its component has more to find: pairs of two inner ones are in one component
        outer = all_.withColumn("out", ~F.col("near") & ~F.col("inside"))
        blocks = outer.groupBy("p").agg(F.max("out").alias("wanted"), F.ceil(F.count("*") / TOGETHER).alias("m")).where("wanted").select("p", "m")
        # the overlap of the differences of an outer node and a similar one is (d + d' - distance) / 2: the least it can be, for each role, is what may be left out at the end.
        # The rarest come first, and of those what no other node has: d - some of them
        least = F.when(F.col("out"), F.greatest(F.lit(1), F.expr("d - n div 3"))).otherwise(F.expr("(7 * d + m - n) div 14 + 1"))
        outer = outer.withColumn("least", least).drop("m").join(blocks, "p").select("p", F.pmod(F.xxhash64("x"), "m").alias("s"), "x", "n", "d", "out", "root", "least", "tokens")
        first = self.step(self.first(outer), "first")
        if not first.where("out").limit(1).count():
            return links, met
        # most outer nodes are near one that is near the pivot: the nearest to it of those that share a rare member is tried before all pairs are
        lead = first.groupBy("p", "t").agg(F.min(F.struct("d", "x")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("p", "t", F.col("lead.x").alias("lead"))
        tried = self.verified(first.where("out").join(lead, ["p", "t"]).where("x != lead").select(F.least("x", "lead").alias("a"), F.greatest("x", "lead").alias("b")).distinct())
        links = links.unionByName(tried)
        now = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
        self.spent.append(now)
        first = self.step(first.drop("root").join(now.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x")), "first")
        x = first.where("out").select(*(F.col(c).alias(c if c in ("p", "t") else f"{c}1") for c in first.columns))
        y = first.select(*(F.col(c).alias(c if c in ("p", "t") else f"{c}2") for c in first.columns))
        # seen from their first common member, the overlap is one and what follows in both
        more = x.join(y, ["p", "t"]).where("root1 != root2 and (not out2 or x1 < x2) and 7 * abs(n1 - n2) <= n1 + n2 and 14 * (1 + least(some1 - i1, some2 - i2)) >= 7 * (d1 + d2) - (n1 + n2)")
        return links, met.unionByName(more.select(F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b"))).distinct()

    def roots(self) -> DataFrame:
        """node, root: the component of each node that has links."""
        central = self.central()
        links = self.verified(self.led(central))
        led, scheme = components(links), self.scheme()
        signed = self.signed(scheme, central, led)
        near, more = self.pivoted(scheme, signed, led, central)
        found = self.verified(signed.where("kind = 0").select("a", "b").unionByName(more).distinct())
        out = components(led.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(near).unionByName(found))
        discard(led, *self.spent)
        return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _h, n_shingles, component_id, root for every row of docs. The root tells components of one name apart; it is null for the empty set."""
    join = Join(docs, doc_id, text)
    nodes = written(join.nodes.select("node", "h1", "h2", "copies", F.col("rep._id").alias("name")).join(join.roots(), "node", "left").select("h1", "h2", "copies", "name", F.coalesce("root", "node").alias("root")), "named", few=True)
    # a null id is the least of structs but no name: the least of the nodes' least ids that are known
    named = join.rows.where("n > 0").groupBy("h1", "h2").agg(F.min("_id").alias("name"))
    nodes = nodes.drop("name").join(named, ["h1", "h2"])
    least = nodes.groupBy("root").agg(F.min("name").alias("component_id"), F.count("*").alias("nodes"))
    nodes = written(met_by(nodes, least, ["root"], "nodes").select("h1", "h2", "copies", "root", "component_id"), "components")
    full = met_by(join.rows.where("n > 0").select("_id", "_h", "n", "h1", "h2"), nodes, ["h1", "h2"], "copies").select("_id", "_h", "n", "component_id", "root")
    none = join.rows.where("n = 0").select("_id", "_h", "n", F.col("_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.unionByName(none).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the least id, and of its rows the one with the least hash of the text. Documents with an empty set stay,
    and of rows equal in id and text one."""
    found = written(classes(docs, doc_id, text), "classes")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_h")).alias("first")).select(F.col("first._id").alias("_kid"), F.col("first._h").alias("_kh"))
    alone = found.where("n_shingles = 0").select(F.col("_id").alias("_kid"), F.col("_h").alias("_kh")).distinct()
    keep = written(first.unionByName(alone), "kept", few=True)
    h = unused(docs, "_h")
    keyed = docs.withColumn(h, row_key(text))
    kept = keyed.join(keep.hint("shuffle_hash"), keyed[doc_id].eqNullSafe(keep["_kid"]) & (keyed[h] == keep["_kh"]), "left_semi")
    if found.groupBy("_id", "_h").count().where("count > 1").limit(1).count():  # else nothing to gain from moving the texts again
        kept = kept.dropDuplicates([doc_id, h])
    return kept.drop(h)
