"""Connected components of a graph of links: by joins, or on the driver where the links are few."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written

#: Links up to which the driver finds the components, 16 bytes each. It decides on work, not on results: a round of joins costs seven exchanges, however few its rows.
SMALL = 200_000


def merged(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v) that are not the least of their component, and the least of it for each."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of an edge the least node that it reaches; nodes that are their own root are left out.

    Up to SMALL links are solved on the driver. More by large star and small star in turn (Kiveris et al., 2014): each round ties every node
    to a smaller one of its neighbourhood; rounds grow with the logarithm of a component's diameter. Each round is written to the shared folder.
    """
    linked = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")), "links", few=True)
    if linked.count() <= SMALL:
        t = linked.toArrow()
        node, root = merged(t.column("u").to_numpy(), t.column("v").to_numpy())
        out = written(linked.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long"), "roots")
        discard(linked)
        return out
    now = written(linked.distinct(), "edges")
    discard(linked)
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, written(small, "edges")
        discard(before)
        after = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == (after.n, after.x):
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._written_to = now._written_to
            return out
        state = (after.n, after.x)
