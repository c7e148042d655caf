"""Embedding near-duplicates by an inverted multi-index (Babenko and Lempitsky, 2012).

Unit vectors are cut into halves, each with a codebook of its own; a pair of codewords is a cell of the product grid.
Every vector is filed in its nearest cell, and asks in the `visits` cells nearest to it, found by the multi-sequence order: cell
(i, j) of the ranked codewords can be among the first t only if (i + 1) * (j + 1) <= t. A pair is found if either of its vectors visits the
other's cell; `visits` is the least number at which at least `recall` of a bounded sample's neighbours at the threshold itself, the hardest
ones, are found. Vectors of each length have a grid of their own; few of a length, or single numbers, are one cell.

Equal vectors are one node with their number, so that copies cost nothing. A vector asks with its components in 16 bits; pairs nearer to the
threshold than the error that this can make, and only those, are compared again. All other pairs are verified in double precision in blocks: no
pair leaves its block, only counts of links and a spanning forest do.

Codebooks are fitted on at most SAMPLE vectors of a length, drawn by hash; every vector is filed and asks. Crowded cells are cut into blocks of BLOCK vectors.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors of different lengths do not link;
equal rows and rows of one id are vectors of their own; a component's name is its least id, a null id counting as none; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .storage import met_by, written

#: Vectors of a length that codebooks are fitted on.
SAMPLE = 50_000
BLOCK = 1500
#: Vectors a cell holds on average, as long as codebooks of CODEWORDS suffice (for 1.6 billion vectors).
PER_CELL = 400
CODEWORDS = 2000
#: Cells of more than a block that may be broadcast with their number of blocks, 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(distances(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048))])


def codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


class Grid:
    """The cells of the vectors of one length. Of two or more components: `half` of them have the first codebook."""

    def __init__(self, x: np.ndarray, k: int):
        self.half = x.shape[1] // 2
        self.books = codebook(x[:, : self.half], k), codebook(x[:, self.half :], k)
        self.k = len(self.books[0])

    def _ranked(self, x: np.ndarray):
        for y, c in zip((x[:, : self.half], x[:, self.half :]), self.books):
            d = distances(y, c)
            order = d.argsort(1, kind="stable")
            yield np.take_along_axis(d, order, 1), order

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(y, c) for y, c in zip((x[:, : self.half], x[:, self.half :]), self.books))
        return a * self.k + b

    def visits(self, x: np.ndarray, t: int) -> np.ndarray:
        """The t nearest cells of each vector, nearest first."""
        t = min(t, self.k**2)
        i, j = np.array([(i, j) for i in range(min(self.k, t)) for j in range(min(self.k, t // (i + 1)))]).T
        (d, p), (e, q) = self._ranked(x)
        order = (d[:, i] + e[:, j]).argsort(1, kind="stable")[:, :t]
        return np.take_along_axis(p[:, i] * self.k + q[:, j], order, 1)

    def needed(self, x: np.ndarray, cosine: float, recall: float) -> int:
        """Visits at which `recall` of random neighbours at exactly this cosine are met from either side."""
        rng = np.random.default_rng(11)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1)[:, None] * x
        away /= np.maximum(np.linalg.norm(away, axis=1)[:, None], 1e-300)
        other = cosine * x + np.sqrt(1 - cosine**2) * away
        here, there = self.cell(x), self.cell(other)
        t = 2
        while t < self.k**2:
            if ((self.visits(x, t) == there[:, None]).any(1) | (self.visits(other, t) == here[:, None]).any(1)).mean() >= recall:
                break
            t = t * 5 // 4 + 1
        return min(t, self.k**2)


class Index:
    """Grids, visits and numbers by length. Cells are numbered over all lengths."""

    def __init__(self, lengths: list[int], grids: dict[int, tuple[Grid, int]]):
        self.first = {d: i << 40 for i, d in enumerate(lengths)}
        self.grids = grids

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, visited cells) of vectors of one length."""
        first = self.first[x.shape[1]]
        if x.shape[1] not in self.grids:
            return np.full(len(x), first), np.full((len(x), 1), first)
        grid, t = self.grids[x.shape[1]]
        return first + grid.cell(x), first + grid.visits(x, t)


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors as rows of doubles, of vectors of one length."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def by_length(raw: list[bytes], some: int = 2000):
    """(places, raw) of runs of vectors of one length."""
    size = np.array([len(r) for r in raw])
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        for i in range(0, len(at), some):
            own = at[i : i + some]
            yield own, [raw[j] for j in own.tolist()]


def sound(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, str]:
    """_id, raw (the components as bytes, null if the vector links with nothing), k1, k2 (a hash of 128 bits), and the kind of number in raw."""
    kind = "<f4" if vectors.schema[embedding].dataType.elementType == T.FloatType() else "<f8"
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def run(parts):
        for batch in parts:
            v = batch.column("v")
            values = v.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            at, null = v.offsets.to_numpy(), v.is_null().to_numpy(zero_copy_only=False)
            bad, full = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
            good = ~null & (bad[at[1:]] == bad[at[:-1]]) & (full[at[1:]] > full[at[:-1]])
            one = good & (np.diff(at) == 1)
            values[at[:-1][one]] = np.sign(values[at[:-1][one]])  # of a single number only the sign counts
            raw = [values[s:e].tobytes() if g else None for s, e, g in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist())]
            keys = np.array([np.frombuffer(hashlib.blake2b(r, digest_size=16).digest(), "<i8") if r else (0, 0) for r in raw], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(raw, pa.binary()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["_id", "raw", "k1", "k2"])

    return rows.mapInArrow(run, "_id long, raw binary, k1 long, k2 long"), kind


def fitted(nodes: DataFrame, kind: str, cosine: float, recall: float) -> Index:
    """An index over all lengths; those of fewer than four cells' vectors, and single numbers, have no grid."""
    width = np.dtype(kind).itemsize
    lengths = {r.d: r["count"] for r in nodes.groupBy((F.length("raw") / width).cast("int").alias("d")).count().collect()}  # one row a length
    grids = {}
    for d, n in lengths.items():
        if d > 1 and n > 4 * PER_CELL:
            u = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) / (1 << 30)  # in its order, any beginning of the sample is drawn from the whole table
            some = nodes.where((F.length("raw") == d * width) & (u < min(1.0, 1.5 * SAMPLE / n))).orderBy(u, "k1", "k2").select("raw").limit(SAMPLE).toArrow()
            x = units(some.column("raw").to_pylist(), kind)
            grid = Grid(x, int(np.clip(np.sqrt(n / PER_CELL), 2, CODEWORDS)))
            grids[d] = grid, grid.needed(x[:2000], cosine, recall)
    return Index(sorted(lengths), grids)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


MET = "node long, other long, n long, back long, doubt boolean"


def met(t: pa.Table, cosine: float, kind: str) -> pa.Table:
    """Of a block and those who ask there: rows of MET. n: links of node, other: a node it reaches; doubt: a pair to be compared again, which gives n links to node and back to other."""
    out: list[tuple] = []
    asks = t.column("asks").to_numpy(zero_copy_only=False)
    q, s = np.flatnonzero(asks), np.flatnonzero(~asks)
    if len(q) and len(s):
        node, home, m = (t.column(c).to_numpy() for c in ("node", "home", "m"))
        raw = t.column("x").to_pylist()
        x = units([raw[i] for i in s.tolist()], kind)
        small = np.frombuffer(b"".join(raw[i] for i in q.tolist()), "<i2").reshape(len(q), -1)
        seen = np.frombuffer(b"".join(t.column("seen").take(pa.array(s)).to_pylist()), "<i8").reshape(len(s), -1)
        cells, which = np.unique(np.concatenate([seen.reshape(-1), home[q]]), return_inverse=True)
        key = np.sort(np.repeat(np.arange(len(s)), seen.shape[1]) * len(cells) + which[: seen.size])
        of_home = which[seen.size :]
        scale = t.column("scale").to_numpy()[q]
        error = np.sqrt(x.shape[1]) * scale / 2 + 1e-9
        links, back_links, a, b = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), [], []
        for i in range(0, len(q), 512):
            own = np.arange(i, min(i + 512, len(q)))
            dot = (small[own].astype(float) * scale[own][:, None]) @ x.T
            r, c = np.nonzero((dot >= cosine - error[own][:, None]) & (node[q[own]][:, None] != node[s][None]))
            if not len(r):
                continue
            # the other way round it is counted there, if the stored vector visits the asker's cell; else here
            way = c * len(cells) + of_home[own[r]]
            alone = key[np.minimum(np.searchsorted(key, way), len(key) - 1)] != way
            sure = dot[r, c] >= cosine + error[own[r]]
            u, v = q[own[r]], s[c]
            np.add.at(links, u[sure], m[v[sure]])
            np.add.at(back_links, v[sure & alone], m[u[sure & alone]])
            a.append(u[sure])
            b.append(v[sure])
            d = ~sure
            out.append((node[u[d]], node[v[d]], m[v[d]], np.where(alone[d], m[u[d]], 0), np.ones(d.sum(), bool)))
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            ids, where = np.unique(node, return_inverse=True)  # an asker may be stored here as well
            label = _forest(where[a], where[b], len(ids))
            tied = np.flatnonzero(label != np.arange(len(ids)))
            n = np.bincount(where, links + back_links, len(ids)).astype(np.int64)
            counted = np.flatnonzero(n)
            zero = lambda x: np.zeros(len(x), np.int64)
            out.append((ids[counted], ids[counted], n[counted], zero(counted), zero(counted) > 0))
            out.append((ids[tied], ids[label[tied]], zero(tied), zero(tied), zero(tied) > 0))
    empty = np.zeros(0, np.int64)
    return pa.table({c: np.concatenate([empty if i < 4 else empty > 0, *(o[i] for o in out)]) for i, c in enumerate(("node", "other", "n", "back", "doubt"))})


def links(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """_id, n_links, component_id for every row."""
    spark = vectors.sparkSession
    rows, kind = sound(vectors, vec_id, embedding)
    ids = written(rows.select("_id", "k1", "k2", F.col("raw").isNotNull().alias("good")), "vector-ids")
    nodes = written(rows.where("raw is not null").groupBy("k1", "k2").agg(F.first("raw").alias("raw"), F.count("*").alias("m"), F.min("_id").alias("name")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    shared = spark.sparkContext.broadcast(fitted(nodes, kind, cosine, recall))

    def file(parts):
        for batch in parts:
            for at, raw in by_length(batch.column("raw").to_pylist()):
                cell, seen = shared.value.file(units(raw, kind))
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column("node"), own.column("m"), pa.array(cell), pa.array([r.astype("<i8").tobytes() for r in seen], pa.binary()), pa.array(raw, pa.binary())], ["node", "m", "home", "seen", "x"])

    filed = written(nodes.select("node", "m", "raw").mapInArrow(file, "node long, m long, home long, seen binary, x binary"), "filed")

    def counts(parts):
        for batch in parts:
            seen = np.frombuffer(b"".join(batch.column("seen").to_pylist()), "<i8")
            cell, n = np.unique(seen, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    # cells of more than a block of vectors, or of askers: cut by the node's hash into blocks, and the askers into crews
    size = filed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    askers = filed.select("seen").mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.ceil(F.sum("n") / (4 * BLOCK)).cast("int").alias("crews"))
    large = written(size.join(askers, "cell").where("blocks > 1 or crews > 1"), "large-cells")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    one = lambda c: F.coalesce(c, F.lit(1))
    spread = lambda df: df.join(large, "cell", "left").withColumn("blocks", one("blocks")).withColumn("crews", one("crews"))
    parts = ["cell", "block", "crew", "asks", "node", "m", "home", "seen", "scale", "x"]
    stored = spread(filed.withColumn("cell", F.col("home"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("crew", F.explode(F.sequence(F.lit(0), F.col("crews") - 1)))
    stored = stored.withColumn("asks", F.lit(False)).withColumn("scale", F.lit(0.0)).select(*parts)

    def ask(stream):
        for batch in stream:
            for at, raw in by_length(batch.column("x").to_pylist(), 500):
                x = units(raw, kind)
                scale = np.abs(x).max(1) / 32767
                small = [r.tobytes() for r in np.round(x / scale[:, None]).astype("<i2")]
                seen = [np.frombuffer(v.as_py(), "<i8") for v in batch.column("seen").take(pa.array(at))]
                i = np.repeat(np.arange(len(at)), [len(v) for v in seen])
                of = pa.array(at[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seen)), batch.column("node").take(of), batch.column("m").take(of), batch.column("home").take(of), pa.array(scale[i]), pa.array(small, pa.binary()).take(pa.array(i))], ["cell", "node", "m", "home", "scale", "x"])

    asked = spread(filed.mapInArrow(ask, "cell long, node long, m long, home long, scale double, x binary"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("crew", F.pmod(F.xxhash64("node", F.lit(1)), F.col("crews")).cast("int"))
    asked = asked.withColumn("asks", F.lit(True)).withColumn("seen", F.lit(None).cast("binary")).select(*parts)
    found = written(stored.unionByName(asked).groupBy("cell", "block", "crew").applyInArrow(lambda t: met(t, cosine, kind), MET), "met")

    def compared(stream):
        for batch in stream:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for at, raw in by_length(u):
                keep[at] = (units(raw, kind) * units([v[i] for i in at.tolist()], kind)).sum(1) >= cosine
            yield batch.select(["node", "other", "n", "back"]).filter(pa.array(keep))

    side = lambda c, x: nodes.select(F.col("node").alias(c), F.col("raw").alias(x))
    again = written(found.where("doubt").join(side("node", "u"), "node").join(side("other", "v"), "other").mapInArrow(compared, "node long, other long, n long, back long"), "compared")
    sure = found.where("not doubt")
    tally = sure.select("node", "n").unionByName(again.select("node", "n")).unionByName(again.select(F.col("other").alias("node"), F.col("back").alias("n"))).where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(sure.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(again.select(F.col("node").alias("a"), F.col("other").alias("b"))))
    named = nodes.select("node", "k1", "k2", "m", "name").join(tally, "node", "left").join(roots, "node", "left").select("k1", "k2", "m", "name", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("name").alias("component_id"), F.count("*").alias("nodes"))
    named = written(met_by(named, least, ["root"], "nodes").select("k1", "k2", "m", "n_links", "component_id"), "vector-components")
    full = met_by(ids.where("good").select("_id", "k1", "k2"), named, ["k1", "k2"], "m").select("_id", "n_links", "component_id")
    return full.unionByName(ids.where("not good").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
