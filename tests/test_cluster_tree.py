"""Clustering: one tree whatever the blocks, lists and rounds; copies; deep hierarchies."""

import numpy as np
import pytest

from echoloom.operators import cluster as C


def _tree(x, ids, m):
    """Kruskal over all pairs by (w, i, j)."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((w[a, b], min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(x)) for b in range(a))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for w_, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            out.append((w_, i, j))
    return out


def _data():
    """A grid with many equal distances, far clumps so tight that lists do not leave them, and more equal vectors than a list holds."""
    r = np.random.default_rng(3)
    grid = r.integers(0, 8, (50, 2)).astype(float)
    clumps = np.concatenate([c + r.normal(0, 1e-3, (14, 2)) for c in ([100.0, 0], [0, 100.0], [130.0, 10])])
    return np.concatenate([grid, clumps, np.full((12, 2), 50.0), np.full((3, 2), 60.0)])


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 16, "LIST": 4, "TALL": 8, "WIDE": 8, "FULL": 8}, {"BLOCK": 40, "LIST": 4, "LOCAL": 10}])
def test_one_tree(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(C, k, v)
    x = _data()
    ids = np.random.default_rng(5).permutation(len(x)) - 20
    rows = [("a", int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [("b", int(i), v.tolist()) for i, v in zip(ids[:30], x[:30], strict=True)]
    df = spark.createDataFrame(rows, "corpus_id string, id long, vec array<double>")
    lists = C._first_lists(df, "corpus_id", max(C.LIST, 4), 5)
    core = C.core_distances(df, "corpus_id", 5)
    want = sorted([("a", *e) for e in _tree(x, ids.tolist(), 5)] + [("b", *e) for e in _tree(x[:30], ids[:30].tolist(), 5)])
    for known in (lists, None):
        got = sorted((t.corpus_id, t.w, t.i, t.j) for t in C.spanning_tree(df, core, "corpus_id", known).collect())
        assert [g[2:] for g in got] == [w[2:] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-12)


def test_copies_and_odd_vectors(spark):
    x = _data()
    tree = _tree(x, list(range(len(x))), 5)
    w, i, j = (np.array(c) for c in zip(*tree, strict=True))
    want = C.condensed_labels(w, i, j, 5)
    rows = [("a", k, v.tolist()) for k, v in enumerate(x)] + [("a", 1000, None), ("a", 1001, [1.0, float("nan")]), ("a", 1002, [float("inf"), 1.0])]
    rows += [("same", k, [1.0, 2.0]) for k in range(7)] + [("few", k, [1.0, float(k)]) for k in range(4)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "corpus_id string, pos long, embedding array<float>")
    got = {(q.corpus_id, q.pos): q.label for q in C.cluster_vectors(df).collect()}
    assert len(got) == len(rows) and [got["a", k] for k in range(len(x))] == [want[k] for k in range(len(x))]
    assert all(got["a", k] == -1 for k in (1000, 1001, 1002)) and all(got["few", k] == -1 for k in range(4)) and got["none", 1] == -1
    assert len({got["same", k] for k in range(7)}) == 1


def test_all_distances_once(spark, monkeypatch):
    """Points of no order: the rounds of the tree do not go over all pairs again."""
    monkeypatch.setattr(C, "LEAST", 64)
    x = np.random.default_rng(2).normal(0, 1, (600, 8))
    df = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(x)], "corpus_id string, pos long, embedding array<float>")
    asked, cells = [], C._asked
    monkeypatch.setattr(C, "_asked", lambda p, ask, by: asked.append(ask.count()) or cells(p, ask, by))
    C.cluster_vectors(df).collect()
    assert sum(asked) < 60


def test_deep_hierarchy():
    """A chain of clusters one inside the other, deeper than Python's stack."""
    n = 3000
    w, i, j = [0.99, 1000.0], [2 * n, 0], [2 * n + 1, 2 * n]
    for k in range(n):  # pairs, each a little farther from those before
        w += [0.99 + 1e-6 * k] + ([1.0 + 1e-6 * k] if k else [])
        i += [2 * k] + ([0] if k else [])
        j += [2 * k + 1] + ([2 * k] if k else [])
    got = C.condensed_labels(np.array(w), np.array(i), np.array(j), 2)
    assert len(got) == 2 * n + 2 and {got[k] for k in range(2 * n)} == {0} and got[2 * n] == got[2 * n + 1] == 1


def test_lists_of_tiles(monkeypatch):
    """Lists are the same whatever the size of a matrix; equal distances by ids."""
    for name, v in {"TALL": 8, "WIDE": 16, "FULL": 8}.items():
        monkeypatch.setattr(C, name, v)
    r = np.random.default_rng(4)
    for cored in (0.0, 2.0):
        side = lambda n, first: {"id": first + r.permutation(n), "vec": r.integers(0, 6, (n, 2)).astype(float), "core": r.random(n) * cored, "comp": r.integers(0, 3, n), "many": np.zeros(n, bool)}  # noqa: B023, E731
        x, y = side(53, 0), side(90, 30)
        for one, other, got in zip((x, y), (y, x), C._search(x, y, 5, True), strict=True):
            got = (one["id"], *got.rows())
            for p in range(len(one["id"])):
                d = np.sqrt(((one["vec"][p] - other["vec"]) ** 2).sum(axis=1))
                e = sorted((max(d[q], one["core"][p], other["core"][q]), min(one["id"][p], other["id"][q]), max(one["id"][p], other["id"][q]), other["id"][q]) for q in range(len(d)))[:5]
                assert got[1][p].tolist() == [q[3] for q in e] and np.allclose(got[2][p], [q[0] for q in e])
        (got,) = C._search(x, y, 5, False)
        ids, far, _ = got.rows()
        for p in range(53):
            d = np.sqrt(((x["vec"][p] - y["vec"]) ** 2).sum(axis=1))
            e = sorted((max(d[q], x["core"][p], y["core"][q]), min(x["id"][p], y["id"][q]), max(x["id"][p], y["id"][q]), y["id"][q]) for q in range(90) if y["comp"][q] != x["comp"][p])[:5]
            assert ids[p].tolist() == [q[3] for q in e] and np.allclose(far[p], [q[0] for q in e])
