"""Frameworks of any depth, and those that are no trees."""

import random

from echoloom.operators import coding as G

SCHEMA = "node_id string, parent_id string, name string, position int"


def paths(spark, rows):
    return {r.node_id: r for r in G.framework_paths(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_long_chain_is_whole(spark):
    got = paths(spark, [(str(k), str(k - 1) if k else None, f"n{k}", k) for k in range(60)])
    assert len(got) == 60
    assert all(got[str(k)].path == [str(i) for i in range(k + 1)] and got[str(k)].names[-1] == f"n{k}" for k in range(60))
    assert {(r.min_leaf_depth, r.max_leaf_depth) for r in got.values()} == {(60, 60)} and all(r.error is None for r in got.values())


def test_random_trees(spark):
    r, rows = random.Random(4), []
    for k in range(200):
        rows.append((str(k), str(r.randrange(max(0, k - 5), k)) if k > 2 else None, f"n{k}", k))
    parent = {x[0]: x[1] for x in rows}
    up = lambda k: [*up(parent[k]), k] if parent[k] else [k]
    leaves = [k for k in parent if k not in parent.values()]
    got = paths(spark, rows)
    assert len(got) == 200
    for k in parent:
        below = [len(up(x)) for x in leaves if k in up(x)]
        assert (got[k].path, got[k].depth, got[k].is_leaf, got[k].min_leaf_depth, got[k].max_leaf_depth) == (up(k), len(up(k)), k in leaves, min(below), max(below))


def test_faults_are_rows(spark):
    rows = [("r", None, "root", 0), ("a", "r", "a", 0), ("x", "z", "x", 0), ("y", "x", "y", 0), ("z", "y", "z", 0), ("under", "x", "u", 0), ("deep", "under", "d", 0), ("self", "self", "s", 0)]
    rows += [("o", "gone", "o", 0), ("o2", "o", "o2", 0), ("t", "r", "t", 0), ("t", "a", "t", 1), ("t2", "t", "t2", 0), (None, "r", "n", 0), ("e", None, None, None)]
    got = [(r.node_id, r.error, r.path) for r in G.framework_paths(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [(k, G.CYCLE, None) for k in ("x", "y", "z", "under", "deep", "self")] + [("o", G.ORPHAN, None), ("o2", G.ORPHAN, None), ("t", G.REPEATED, None), ("t", G.REPEATED, None), ("t2", G.REPEATED, None), (None, G.UNNAMED, None)]
    want += [("r", None, ["r"]), ("a", None, ["r", "a"]), ("e", None, ["e"])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nothing(spark):
    assert paths(spark, []) == {}
