"""Hashed vectors and languages are made where a text lies."""

from echoloom.functions import languages as L
from echoloom.functions import vectors as X


def test_no_row_for_each_gram(spark):
    df = spark.createDataFrame([(1, "The water is not good"), (2, None), (3, "ab")], "id long, t string")
    for out in (X.hashing_embed(df, "id", "t", 8), L.detect_language(df, "id", "t")):
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.vector for r in X.hashing_embed(df, "id", "t", 8).collect()}
    assert abs(sum(v * v for v in got[1]) - 1) < 1e-9 and got[2] == got[3] == [0.0] * 8
