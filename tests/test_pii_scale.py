"""Detection in linear time, numbering in ranges and leaks by grams, each against a plain version."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from echoloom.operators import pii, substrings
from echoloom.operators.numbering import number_rows


def test_spans_are_those_of_the_plain_patterns(spark):
    r, rows = random.Random(1), []
    bits = ["a", "b.", "@", "-", "_", ".", "%", "c", "9", " ", "@x.y", "é", "\n", "+4", "http://", "1.2.", "😀"]
    for k in range(1500):
        rows.append((k, "".join(r.choice(bits) for _ in range(r.randint(0, 80)))))
    rows += [(9000, None), (9001, ""), (9002, "a@b.c " * 700)]
    got = sorted((x.id, x.start, x.end, x.type, x.value) for x in pii.detect_entities(spark.createDataFrame(rows, "id long, content string"), "id", "content").collect())
    want = sorted((k, m.start(), m.end(), t, m.group()) for k, text in rows for t, p in pii.DETECTORS.items() for m in re.finditer(p, text or ""))
    assert len(want) > 2000 and got == want


@pytest.mark.parametrize("text", ["y" * 100_000, "y" * 100_000 + "@", "a@b-" * 25_000, "a@" + "b." * 49_000 + "_", "+1" * 50_000])
def test_long_records_take_linear_time(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, content string").cache()
    pii.detect_entities(df, "id", "content").count()
    began = time.time()
    pii.detect_entities(df, "id", "content").count()
    assert time.time() - began < 5  # the plain address pattern takes minutes


def test_numbers_and_sums_in_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "cold", None]), r.choice([None, *range(50)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, k long").repartition(7)
    got = number_rows(df, ["g"], ["v", "k"], "rn", ("v", "upto")).collect()
    assert len(got) == 3000
    for g in ("hot", "cold", None):
        own = sorted((x for x in got if x.g == g), key=lambda x: x.rn)
        order = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [x.rn for x in own] == list(range(len(order))) and [x.k for x in own] == [x[2] for x in order]
        total = 0
        for x in own:
            total += x.v or 0
            assert x.upto == total
    assert number_rows(df.limit(0), ["g"], ["v"]).count() == 0
    assert sorted(x.rn for x in number_rows(df, [], ["k"]).collect()) == list(range(3000))


def test_one_corpus_is_numbered_by_many_tasks(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.lit("c").alias("corpus_id"), F.concat(F.lit("r"), "id").alias("id"), F.lit(0).alias("start"), F.lit("T").alias("type"), F.col("id").cast("string").alias("value"))
    out = pii.number_placeholders(df, ["corpus_id"], ["id", "start"])
    got = out.select(F.spark_partition_id().alias("p"), F.regexp_extract("placeholder", "<T_([0-9]+)>", 1).cast("long").alias("n")).groupBy("p").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()
    assert sum(x.c for x in got) == 200_000 and sum(x.s for x in got) == 200_000 * 199_999 // 2


def test_leaks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(substrings, "TABLE_BITS", 12)  # a full table lets more through, and changes nothing
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abé9") for _ in range(n))
    values = [(r.choice("cd"), f"<T_{k}>", "T", word(r.choice([1, 2, 3, 5, 7, 8, 9, 14, 40]))) for k in range(150)]
    values += [("c", "<T_900>", "T", ""), (None, "<T_901>", "T", "abab"), ("c", "<T_902>", "T", values[0][3]), ("c", "<T_903>", "T", None)]
    values += [("d", f"<T_{910 + k}>", "T", f"https://www.example.org/{k}") for k in range(40)]
    texts = [(r.choice(["c", "d", None]), str(k), word(r.randint(0, 60)) + (r.choice(values)[3] or "") + word(3)) for k in range(300)] + [("c", "x", None), ("d", "y", ""), ("c", "0", "repeated id")]
    df, mapping = spark.createDataFrame(texts, "corpus_id string, id string, content string"), spark.createDataFrame(values, "corpus_id string, placeholder string, type string, value string")
    got = sorted(map(tuple, pii.audit_leaks(df, mapping, "corpus_id", "id", "content").collect()))
    want = sorted((i, p) for c, i, t in texts for d, p, _, v in values if c is not None and c == d and v and t and v in t)
    assert len(want) > 200 and got == want
    plan = pii.audit_leaks(df, mapping, "corpus_id", "id", "content")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
