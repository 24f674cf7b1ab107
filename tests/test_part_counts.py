"""Part counts of large groups against a plain search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from echoloom.operators import chunking as C


def plain(sizes, budget, cpt=4):
    n, total, limit = len(sizes), sum(sizes), budget * cpt
    if total // cpt <= budget:
        return 1
    upto = [0]
    for s in sizes:
        upto.append(upto[-1] + s)
    p = min(n, max(1, -(-total // limit)))
    while p < n:
        base, extra = divmod(n, p)
        edges = [i * base + min(i, extra) for i in range(p + 1)]
        if all(upto[b] - upto[a] <= limit for a, b in zip(edges, edges[1:], strict=False)):
            return p
        p += 1
    return n


def counts(spark, groups, budget, **kw):
    rows = [(g, k, s) for g, sizes in groups.items() for k, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g string, rn long, n_chars long").repartition(5)
    return {r.g: (r.n, r.total, r.parts) for r in C.part_counts(df, ["g"], F.lit(budget), **kw).collect()}


@pytest.mark.parametrize("wide", [0, 4096])
def test_both_ways_are_the_plain_one(spark, monkeypatch, wide):
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    monkeypatch.setattr(C, "ROUND_CANDIDATES", (2, 8))
    monkeypatch.setattr(C, "WITNESSES", 2)
    r, groups = random.Random(5), {}
    for k in range(40):
        kind, n = k % 5, r.randint(1, 150)
        size = [lambda: r.randint(0, 90), lambda: r.choice([0, 0, 0, 60]), lambda: int(r.paretovariate(1.1) * 9) % 500, lambda: 40, lambda: r.choice([1, 200])][kind]
        groups[f"g{k}"] = [size() for _ in range(n)]
    groups |= {"empty": [0] * 50, "one": [10**6], None: [30] * 40}
    want = {g: (len(s), sum(s), plain(s, 50)) for g, s in groups.items() if g is not None or wide == 0}
    got = counts(spark, groups, 50, wide=wide)
    assert {g: x for g, x in got.items() if g in want} == want
    assert len({x[2] for x in got.values()}) > 15


def test_a_hundred_thousand_records(spark, monkeypatch):
    r = random.Random(6)
    sizes = [int(r.lognormvariate(4, 1)) for _ in range(100_000)]
    rounds = []
    whole = C.settled
    monkeypatch.setattr(C, "settled", lambda df: rounds.append(1) or whole(df))
    began = time.time()
    got = counts(spark, {"g": sizes, "h": sizes[:10]}, 2000)
    print("seconds", time.time() - began, "jobs", len(rounds))
    assert got["g"][2] == plain(sizes, 2000) and got["h"][2] == plain(sizes[:10], 2000)
    assert (len(rounds) - 2) / 2 < 10  # two tables a round, two before
