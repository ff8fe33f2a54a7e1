"""Pruned neighbours against all pairs, and cells left out."""

import numpy as np
import pytest

from quillmill.operators import dense, pivots


def made(seed, n, dim=16, spread=0.1):
    r = np.random.default_rng(seed)
    centers = np.random.default_rng(9).standard_normal((12, dim))
    return [(i, (centers[i % 12] * r.uniform(0.5, 3) + r.normal(0, spread, dim)).tolist(), f"t{i % 3}") for i in range(n)]


def expected(queries, vectors, k, metric, tagged):
    for i, q, t in queries:
        found = []
        for j, v, u in vectors:
            if v is None or q is None or (tagged and (t is None or t != u)):
                continue
            q_, v_ = np.array(q), np.array(v)
            s = q_ @ v_
            if metric == "cosine":
                s = s / max(np.linalg.norm(q_) * np.linalg.norm(v_), 1e-30)
            found.append((-round(float(s), 6), j))
        yield from ((i, j, -s, rank) for rank, (s, j) in enumerate(sorted(found)[:k], 1))


def same(got, want):
    key = lambda x: (x[0], x[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("tagged", [False, True])
def test_all_neighbours(spark, metric, tagged):
    vectors = [*made(1, 400), (900, [0.0] * 16, "t0"), (901, None, "t1"), (902, made(1, 1)[0][1], None if tagged else "t0"), *[(1000 + i, made(1, 3)[2][1], "t2") for i in range(30)]]
    queries = [*made(2, 25), (500, None, "t1"), (501, [0.0] * 16, "t0"), (502, made(3, 1)[0][1], "nowhere"), (503, made(4, 1)[0][1], None if tagged else "t1")]
    schema = "{0} long, vector array<double>, tag string"
    v, q = spark.createDataFrame(vectors, schema.format("chunk")), spark.createDataFrame(queries, schema.format("query_id"))
    tag = "tag" if tagged else None
    cells = pivots.build(v, metric, tag, block=16)
    found, visited = pivots.searched(cells, q, 7, tag, first=2)
    rows = [tuple(x) for x in found.select("query_id", "chunk", "score", "rank").collect()]
    same(rows, list(expected(queries, vectors, 7, metric, tagged)))
    n = visited.groupBy().sum("cells", "visited").first()
    assert n[1] < n[0] if metric == "cosine" else n[1] <= n[0]


def test_empty(spark):
    schema = "{0} long, vector array<double>, tag string"
    none = spark.createDataFrame([], schema.format("chunk"))
    q = spark.createDataFrame(made(2, 3), schema.format("query_id"))
    assert pivots.search(pivots.build(none), q).count() == 0
    assert pivots.search(pivots.build(spark.createDataFrame(made(1, 5), schema.format("chunk"))), q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pivots.build(none, "other")


def test_best_sorts_what_ties_leave():
    rng = np.random.default_rng(3)
    for n in (1, 3, 4, 50):
        s, ids = np.round(rng.random((20, n)), 1), rng.permutation(n) + 7
        row, best, at = pivots._best(s, ids, 3)
        want = [(r, i, c) for r in range(20) for _, i, c in sorted((-s[r, c], ids[c], c) for c in range(n))[:3]]
        assert list(zip(row, best, at)) == want


def test_angles_of_queries_are_not_broadcast(spark, monkeypatch):
    """A row for each query and pivot stays in the tasks; the cells' bounds go to them, or both are shuffled where these are many."""
    plans, write = {}, pivots.materialize
    monkeypatch.setattr(pivots, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    schema, queries, vectors = "{0} long, vector array<double>, tag string", made(2, 40), made(1, 400)
    cells = pivots.build(spark.createDataFrame(vectors, schema.format("chunk")), tag="tag", block=16)
    for most, join in ((100_000, "BuildRight"), (1, "SortMergeJoin")):
        monkeypatch.setattr(pivots, "BROADCAST_CELLS", most)
        found = pivots.search(cells, spark.createDataFrame(queries, schema.format("query_id")), 5, "tag")
        assert join in plans["cell-bounds"] and "BuildLeft" not in plans["cell-bounds"]
        same([tuple(x) for x in found.select("query_id", "chunk", "score", "rank").collect()], list(expected(queries, vectors, 5, "cosine", True)))


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("tagged", [False, True])
def test_few_queries_read_the_vectors_once(spark, monkeypatch, metric, tagged):
    """Few queries are answered without cells, more by cells, alike; whole ties, zeros and nulls among them."""
    vectors = [*made(1, 300), (900, [0.0] * 16, "t0"), (901, None, "t1"), *[(1000 + i, made(1, 3)[2][1], "t2") for i in range(30)]]
    queries = [*made(2, 25), (500, None, "t1"), (501, [0.0] * 16, "t0"), (502, made(3, 1)[0][1], "nowhere")]
    schema, tag = "{0} long, vector array<double>, tag string", "tag" if tagged else None
    v, q = spark.createDataFrame(vectors, schema.format("chunk")), spark.createDataFrame(queries, schema.format("query_id"))
    built, build = [], pivots.build
    monkeypatch.setattr(pivots, "build", lambda *a, **o: built.append(a) or build(*a, **o))
    monkeypatch.setattr(pivots, "SCORES", 64, raising=False)
    for most, cells in ((1 << 20, 0), (1, 1)):
        monkeypatch.setattr(pivots, "SCANNED", most, raising=False)
        found = dense.knn_topk(q, v, 7, metric, tag)
        same([tuple(x) for x in found.select("query_id", "chunk", "score", "rank").collect()], list(expected(queries, vectors, 7, metric, tagged)))
        assert len(built) == cells
    assert dense.knn_topk(q.limit(0), v).count() == 0 and dense.knn_topk(q, v.limit(0)).count() == 0
