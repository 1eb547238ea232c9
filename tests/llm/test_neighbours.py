import datetime as dt

import numpy as np

from docengine.llm import neighbours
from docengine.llm.forest import Forest, Tree

SCHEMA = "id string, values array<float>, namespace string, upserted_at timestamp_ntz, q int, s int, n int, home int"
T = dt.datetime(2024, 1, 1)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], SCHEMA)


def _true(v, ids, k=5):
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(v)) for j in np.argsort(-s[i])[:k]}


def _clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 10, 64))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, 64))).astype(np.float32)


def test_queue_takes_the_nearest_branches_first():
    x = _clustered(2000, 5)
    trees = [Tree(x, 20, np.random.default_rng(t)) for t in range(3)]
    forest = Forest(trees)
    assert max(map(len, (rows for t in trees for rows in t.leaves))) <= 20
    got = forest.search(x[:50], 9)
    assert all(len(set(r)) == 9 for r in got.tolist())
    for q, row in zip(x[:50], got, strict=True):  # against every leaf's priority, computed leaf by leaf
        price, first = {}, 0
        for t in trees:
            todo = [(t.root, 0.0)]
            while todo:
                node, cost = todo.pop()
                if node < 0:
                    price[first - 1 - node] = cost
                    continue
                m = float(q @ t.planes[node] - t.offsets[node])
                todo += [(int(t.children[node][int(m > 0)]), cost), (int(t.children[node][int(m <= 0)]), max(cost, abs(m)))]
            first += len(t.leaves)
        assert np.isclose(sorted(price.values())[8], max(price[i] for i in row.tolist()), atol=1e-5)


def test_recall_in_a_cell_of_many_leaves():
    x = _clustered(16_384, 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaves = [len(Tree(x, 64, np.random.default_rng(t)).leaves) for t in range(2)]
    assert min(leaves) >= 256
    row, col, _ = neighbours.rank_cell(x, np.ones(len(x), dtype=bool), 5, trees=8, leaf=64, probes=96)
    got = set(zip(row.tolist(), col.tolist(), strict=True))
    some = np.arange(0, len(x), 20)
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -2
    want = {(int(i), int(j)) for i, r in zip(some, s, strict=True) for j in np.argsort(-r)[:5]}
    assert len(got & want) / len(want) >= 0.95


def test_recall_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 400)
    v = _clustered(1500, 1)
    ids = [f"i{i:04}" for i in range(1500)]
    got = {tuple(r) for r in neighbours.neighbour_pairs(_frame(spark, [(i, x.tolist(), "c", T) for i, x in zip(ids, v, strict=True)])).collect()}
    want = _true(v, ids)
    assert len(got & want) / len(want) >= 0.9


def test_codes_are_as_exact_as_floats():
    x = _clustered(100, 7)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import pandas as pd

    assert np.abs(neighbours._decoded(pd.Series(neighbours._coded(x))) - x).max() < 2e-7


def test_dirt_versions_namespaces_and_few_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((6, 64)).astype(np.float32)
    rows = [(f"a{i}", x.tolist(), "c", T) for i, x in enumerate(v)]
    rows += [rows[0], ("a1", (-v[1]).tolist(), "c", T - dt.timedelta(days=1)), ("other", v[0].tolist(), "p", T), ("", v[0].tolist(), "c", T), (None, v[0].tolist(), "c", T)]
    rows += [("bad1", None, "c", T), ("bad2", [0.0] * 64, "c", T), ("bad3", [float("nan")] * 64, "c", T), ("bad4", [1.0] * 63, "c", T), ("bad5", [], "c", T)]
    got = {tuple(r) for r in neighbours.neighbour_pairs(_frame(spark, rows)).collect()}
    assert got == _true(v, [f"a{i}" for i in range(6)])
    assert neighbours.neighbour_pairs(_frame(spark, [])).count() == 0


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal(64).astype(np.float32)
    rows = [(f"h{i:03}", v.tolist(), "c", T) for i in range(200)] + [("x", (v + 0.01).tolist(), "c", T)]
    vectors = neighbours.usable(_frame(spark, rows))
    found = neighbours.nearest(vectors).groupBy("q").count().collect()
    assert len(found) == 201 and all(r["count"] == 5 for r in found)
