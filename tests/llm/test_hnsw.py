"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filespoor.llm import hnsw
from filespoor.llm.registry import QUERIES


def brute(rows, asked, k):
    out = {}
    rows = {i: v for i, v in rows}
    for q in asked:
        near = sorted((-sum(a * b for a, b in zip(v, rows[q])), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_shards_are_exact(spark, space):
    """With fewer nodes than are held in hand every row is met: results are those of brute force, ties and copies too."""
    pick = np.random.default_rng(1)
    rows = [(i, [float(x) for x in pick.integers(-3, 4, 4)]) for i in range(150)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    rows += [(i, [2.0, 2.0, 1.0, 0.0]) for i in range(200, 300)]  # one vector a hundred times
    rows += [(-5, [9.0, 9.0, 9.0, 9.0]), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, [5.0])]
    odd = [(None, [1.0] * 4), (500, None), (501, []), (502, [0.0] * 4), (503, [1.0, None, 1.0, 1.0]), (504, [1.0, math.nan, 1.0, 1.0]), (505, [math.inf] * 4)]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>")
    for name in ("shard", "vector", "rank", "score", "node"):
        df = df.withColumn(name, F.lit("extra"))
    vectors = hnsw.usable(df)
    assert vectors.columns == ["vec_id", "vector"] and vectors.count() == len(rows) + 3
    asked = [i for i, _ in rows if i % 5 == 0 or i > 399]
    got = found_of(hnsw.nearest(vectors, vectors.filter("vec_id % 5 = 0 or vec_id > 399"), space, k=7, shards=4))
    want = brute(rows, asked, 7)
    assert got == {q: near for q, near in want.items() if near}
    assert found_of(hnsw.nearest(vectors, vectors.limit(0), space)) == {}
    assert found_of(hnsw.nearest(vectors.limit(0), vectors, space)) == {}


def test_one_id_with_two_vectors(spark, space):
    vectors = hnsw.usable(spark.createDataFrame([(1, [2.0, 0.0]), (1, [1.0, 9.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    assert found_of(hnsw.nearest(vectors, vectors, space, k=2)) == {
        1: [(2, 10.0), (3, 9.0)], 2: [(1, 10.0), (3, 1.0)], 3: [(1, 9.0), (2, 1.0)],
    }


@pytest.mark.parametrize("shape", ["even", "lengths", "groups"])
def test_recall_of_one_graph(shape):
    pick = np.random.default_rng(3)
    x = pick.standard_normal((4000, 24))
    if shape == "lengths":
        x *= pick.exponential(size=(4000, 1))
    if shape == "groups":  # tight groups far apart, the largest of a third of all rows
        x = x * 0.01 + pick.standard_normal((40, 24))[np.where(np.arange(4000) % 3, pick.integers(0, 40, 4000), 0)]
    square = (x**2).sum(1)
    whole = np.c_[x, np.sqrt(square.max() - square)].astype(np.float32)
    levels = np.sort((-np.log(pick.random(4000)) / np.log(16)).astype(int))[::-1]
    graph = hnsw.Graph.build(whole, levels)
    assert [len(a) for a in graph.layers] == graph.sizes and graph.layers[0].max() < 4000
    asked = np.c_[x[::20], np.zeros(200)].astype(np.float32)
    near = np.argsort(-(asked @ whole.T), axis=1)[:, :20]
    found = graph.search(asked, hnsw.SEARCH)
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(near, found)]) > 0.9


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = found_of(QUERIES["op11_nearest_neighbours"](spark, folder))
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for q, near in got.items():
        scores = x @ x[np.searchsorted(ids, q)]
        scores[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & {i for i, _ in near})
        assert len(near) == 20
        assert all(abs(s - scores[np.searchsorted(ids, i)]) < 1e-12 for i, s in near)
    assert hits > 0.95 * 20 * len(got)
