"""Embedding links against brute force."""

import numpy as np
import pytest

from lumaframe.llm import multi_index, queries


def brute(ids, x):
    good = [i for i, v in enumerate(x) if v is not None and len(v) == len(x[0]) and None not in v and np.isfinite(v).all() and np.any(v)]
    u = np.array([x[i] for i in good], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    n, label = np.zeros(len(x), int), np.arange(len(x))
    n[good] = near.sum(1)
    low = np.arange(len(good))
    for _ in range(len(good)):
        new = np.array([min([low[i], *low[near[i]]]) for i in range(len(good))])
        if (new == low).all():
            break
        low = new
    for i, k in zip(good, low):
        label[i] = good[k]
    return n, {i: min(ids[j] for j in range(len(x)) if label[j] == label[i]) for i in range(len(x))}


def test_query_recall_and_links(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, label = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    out = {r.vec_id: r for r in queries.op5_multi_index(spark, sf_dir).collect()}
    got = np.array([out[r.vec_id].n_links for r in rows])
    assert len(out) == len(rows) and (got <= n).all() and got.sum() >= 0.97 * n.sum()
    same = [out[r.vec_id].component_id == label[i] for i, r in enumerate(rows)]
    assert np.mean(same) > 0.99 and all(r.kept == (r.vec_id == r.component_id) for r in out.values())


@pytest.mark.parametrize("block", [1500, 20])
def test_recall_at_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "PER_CELL", 30)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 24))
    x[600:900] = x[:300] + rng.normal(size=(300, 24)) * 0.31  # cosines about the threshold
    x[900:1000] = x[0] * rng.uniform(0.1, 9, 100)[:, None]
    data = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    out = {r["_id"]: r for r in multi_index.links(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    n, label = brute([d[0] for d in data], [d[1] for d in data])
    got = np.array([out[i].n_links for i in range(1200)])
    assert (got <= n).all() and got.sum() >= 0.95 * n.sum() and got.sum() % 2 == 0 and got[950] >= 100
    assert np.mean([out[i].component_id == label[i] for i in range(1200)]) > 0.97


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [2.0, 4.0, 6.0, 8.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, None, 3.0, 4.0]), (7, [inf, 2.0, 3.0, 4.0]), (8, [nan, 2.0, 3.0, 4.0]), (9, [1.0, 2.0]),
            (1, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.1]), (10, [-1.0, -2.0, -3.0, -4.0])]
    docs = spark.createDataFrame([(a, b, "x") for a, b in data], "vec_id long, embedding array<float>, node string")
    out = sorted((r["_id"] or 0, r.n_links, r.component_id) for r in multi_index.links(docs).collect())
    assert out == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (0, 3, 1), *((i, 0, i) for i in range(3, 11))])
    assert multi_index.links(docs.limit(0)).count() == 0


def test_sample_is_drawn_from_the_whole_table(spark, monkeypatch):
    """Rows in order of their angle: the sample's ends and its first rows reach over all of them."""
    class Seen(Exception):
        pass

    def grid(x, k):
        raise Seen(x)

    monkeypatch.setattr(multi_index, "SAMPLE", 200)
    monkeypatch.setattr(multi_index, "Grid", grid)
    rows = spark.range(4000).coalesce(1).selectExpr("id AS vec_id", "array(cos(id / 4000), sin(id / 4000)) AS embedding")
    try:
        multi_index.links(rows)
    except Seen as e:
        at = np.arctan2(e.args[0][:, 1], e.args[0][:, 0])
    assert 150 <= len(at) <= 200 and at.max() > 0.95 and abs(at.mean() - 0.5) < 0.1 and abs(at[:50].mean() - 0.5) < 0.2


def test_recall_of_true_pairs_near_the_threshold(spark, monkeypatch):
    """1,500 pairs with cosines from 0.95 to 0.97 and no copies, over some 300 cells: at least nine of ten are found, none below the threshold."""
    monkeypatch.setattr(multi_index, "PER_CELL", 10)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(rng.normal(size=(1500, 32)))
    away = rng.normal(size=x.shape)
    away = unit(away - (away * x).sum(1)[:, None] * x)
    c = rng.uniform(0.9502, 0.97, 1500)[:, None]
    both = np.concatenate([x, c * x + np.sqrt(1 - c**2) * away]).astype(np.float32)
    n, _ = brute(list(range(3000)), [r.tolist() for r in both])
    assert n.sum() >= 3000
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(both)], "vec_id long, embedding array<float>")
    out = {r["_id"]: r for r in multi_index.links(nodes).collect()}
    got = np.array([out[i].n_links for i in range(3000)])
    assert (got <= n).all() and got.sum() >= 0.9 * n.sum()
    assert all(out[i].component_id == out[i + 1500].component_id for i in range(1500) if got[i] == n[i] == 1)


def test_lengths_and_vectors_of_nothing(spark):
    """Every length has its own links; single numbers link by their sign; tables of zeros, or without a vector, link nothing."""
    data = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.01]), (5, [1.0, 2.0, -3.0]), (6, [3.0]), (7, [0.5]), (8, [-2.0]), (9, [0.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    out = {r["_id"]: (r.n_links, r.component_id) for r in multi_index.links(rows).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9), 10: (1, 10), 11: (1, 10)}
    zeros = spark.createDataFrame([(i, [0.0, 0.0, 0.0]) for i in range(50)], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id == r["_id"]) for r in multi_index.links(zeros).collect()} == {(0, True)}
    assert multi_index.links(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().n_links == 0


def test_a_large_group_of_equal_vectors(spark):
    """Copies are one node: 20,000 of them cost no pairs, and each has the others as links."""
    rows = spark.range(20_000).selectExpr("id AS vec_id", "IF(id < 19000, array(1.0D, 2.0D, 3.0D), array(id * 1.0D, -id * 1.0D, 7.0D * pmod(id, 13))) AS embedding")
    out = {r["_id"]: r for r in multi_index.links(rows).collect()}
    assert {out[i].n_links for i in range(19_000)} == {18_999} and {out[i].component_id for i in range(19_000)} == {0}
