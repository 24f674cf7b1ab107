"""Samples of records by threshold."""

import hashlib

import pytest

from echoloom.operators import corpus as C


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
@pytest.mark.parametrize("bins", [4, 1 << 16])
def test_the_least_digests(spark, n, bins):
    ids = [f"doc-{k}" for k in range(500)]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, k long").repartition(5)
    got = sorted(r.id for r in C.sample_records(df, n, 7, bins=bins).collect())
    assert got == sorted(sorted(ids, key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:n])


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "id string, k long")
    assert C.sample_records(df, 3, 1).count() == 3 and C.sample_records(df, 9, 1).count() == 4
    assert C.sample_records(df.limit(0), 3, 1).count() == 0


def test_a_million_rows_stay_in_many_tasks(spark):
    df = spark.range(0, 1_000_000, 1, 8)
    out = C.sample_records(df, 400_000, 3)
    assert out.count() == 400_000
    assert "Limit 400000" not in out._jdf.queryExecution().optimizedPlan().toString()
