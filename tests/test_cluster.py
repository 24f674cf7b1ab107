"""Clustering against a dense computation."""

import numpy as np

from echoloom.operators import cluster as C


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.1, (18, 2)), r.normal(5, 0.1, (15, 2)), r.normal((0, 9), 0.2, (9, 2)), [[40.0, 40.0]]])
    rows = [("a", k, v.tolist()) for k, v in enumerate(x)] + [("b", k, [float(k), 0.0]) for k in range(3)]
    df = spark.createDataFrame(rows, "corpus_id string, pos long, embedding array<double>")
    got = {(q.corpus_id, q.pos): q.label for q in C.cluster_vectors(df).collect()}
    want = [0] * 18 + [1] * 15 + [2] * 9 + [-1]
    assert [got["a", k] for k in range(43)] == want and all(got["b", k] == -1 for k in range(3))
    # The tree weighs as much as Prim's over the whole matrix.
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 4]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, total = [0], 0.0
    while len(inside) < len(x):
        rest = [k for k in range(len(x)) if k not in inside]
        sub = w[np.ix_(inside, rest)]
        total += sub.min()
        inside.append(rest[int(sub.min(axis=0).argmin())])
    pts = df.where("corpus_id = 'a'").selectExpr("corpus_id", "pos AS id", "embedding AS vec")
    tree = C.spanning_tree(pts, C.core_distances(pts, "corpus_id", 5), "corpus_id").collect()
    assert len(tree) == 42 and abs(sum(t.w for t in tree) - total) < 1e-9
