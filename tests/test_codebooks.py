"""Codebooks of both shapes and price lists."""

import json

from echoloom.operators import coding as G
from echoloom.sources import records as S


def test_both_shapes(spark, tmp_path):
    fixed = {"types": [{"name": "T", "categories": [{"name": "C", "codes": [{"name": "x"}, {"code_id": "k", "name": "y", "code_description": "about", "examples": ["e1", "e2"], "sensitive": True}]}, {"code_id": "cat"}]}, {"code_id": "t2", "name": "empty", "categories": []}]}
    deep = {"id": "n0", "name": "0"}
    for k in range(1, 8):
        deep = {"id": f"n{k}", "name": str(k), "children": [deep, {"name": "side"}]}
    (tmp_path / "a.json").write_text(json.dumps(fixed, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"root_codes": [deep]}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"other": 1}')
    (tmp_path / "e.json").write_text('{"types": []}')
    got = {}
    for r in S.read_framework(spark, str(tmp_path / "*.json")).collect():
        got.setdefault(r.book[-6], []).append(r)
    a = {r.node_id: r for r in got["a"]}
    assert set(a) == {"type-0", "category-0-0", "code-0-0-0", "k", "cat", "t2"}
    assert (a["k"].parent_id, a["k"].level, a["k"].position, a["k"].description, a["k"].examples, a["k"].sensitive, a["k"].feedback_type) == ("category-0-0", 3, 1, "about", ["e1", "e2"], True, "T")
    assert (a["cat"].name, a["cat"].sensitive, a["t2"].parent_id) == ("cat", False, None)
    b = {r.node_id: r for r in got["b"]}
    assert b["n0"].level == 8 and b["n0"].parent_id == "n1" and b["n0"].feedback_type == "7" and len(b) == 15
    assert [r.error for r in got["c"] + got["d"]] == ["no codebook"] * 2 and "e" not in got
    nodes = S.read_framework(spark, str(tmp_path / "b.json"))
    assert max(r.depth for r in G.framework_paths(nodes).collect()) == 8


def test_prices(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("models:\n  a/m1:\n    input_cost_per_token: 0.000002\n    output_cost_per_token: 6.0e-06\n    max_tokens: 1000\n  m2:\n    input_cost_per_token: 1\n  m3: text\n")
    (tmp_path / "q.yaml").write_text("other: 1\n")
    (tmp_path / "r.yaml").write_text(": [\n")
    got = S.read_prices(spark, str(tmp_path / "*.yaml")).collect()
    assert [tuple(r) for r in got if r.error is None] == [("a/m1", 0.000002, 0.000006, 1000, None)]
    assert sorted(r.model for r in got if r.error == "no cost") == ["m2", "m3"] and sum(r.model is None for r in got) == 2
