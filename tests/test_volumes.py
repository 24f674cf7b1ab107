"""Texts of records are not dealt out again and again: bytes that operators shuffle, measured while no small side is broadcast unless the code says so."""

import random
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from echoloom.functions import prompts as P
from echoloom.operators import analyze as A
from echoloom.operators import coding as G
from echoloom.operators import pii
from echoloom.operators.complete import complete, stub_complete


def shuffled(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    time.sleep(0.3)  # figures of executors are brought up to date a little later
    found = sc.statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@contextmanager
def no_broadcasts(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k in keys:
            spark.conf.unset(k)


def texts(spark, n: int = 60, length: int = 20_000):
    rng = random.Random(3)
    rows = [(f"r{k}", "c", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJ.,", k=length)), k) for k in range(n)]
    return spark.createDataFrame(rows, "id string, corpus_id string, content string, pos long")


NODES = [("a", None, "A", 0), ("b", None, "B", 1), ("c", "a", "C", 0), ("d", "a", "D", 1), ("e", "c", "E", 0), ("f", "b", "F", 0)]


def test_codes_do_not_deal_texts(spark):
    r = texts(spark)
    nodes = spark.createDataFrame(NODES, "node_id string, parent_id string, name string, position int")
    size = 60 * 20_000
    with no_broadcasts(spark):
        before = shuffled(spark)
        out = G.assign_codes(r, nodes, stub_complete("pick"), stub_complete("score")).collect()
        assert len({x.id for x in out}) > 40 and any(x.code_3_id for x in out)
        assert shuffled(spark) - before < size / 4


def test_codes_of_records_without_an_id_and_of_failures(spark):
    r = spark.createDataFrame([("1", "x"), (None, "y"), ("2", "z"), ("3", None), ("4", "w")], "id string, content string")
    nodes = spark.createDataFrame(NODES, "node_id string, parent_id string, name string, position int")
    every = lambda messages: [ValueError() if ">z<" in u else {"content": '{"selected": []}' if ">w<" in u else '{"selected": [1, 0]}', "input_tokens": 1, "output_tokens": 1} for _, u in messages]
    score = lambda messages: [{"content": "0.9\nfine", "input_tokens": 1, "output_tokens": 1} for _ in messages]
    out = G.assign_codes(r, nodes, every, score).orderBy("id", "rank").collect()
    got = [(x.id, x.rank, x.code_1_id, x.code_2_id, x.code_3_id, x.error_class) for x in out]
    # C and B have one child, so the number 1 is out of range there
    assert got == [("1", 1, "a", "c", "e", None), ("1", 2, "a", "d", None, None), ("1", 3, "b", "f", None, None), ("2", None, None, None, None, "LLMBadRequestError")]


def test_rows_that_are_not_to_be_asked_have_no_completion(spark):
    df = spark.createDataFrame([(1, True, "t"), (2, False, "t"), (3, None, None)], "id int, ask boolean, user string").selectExpr("*", "'s' as system")
    got = {x.id: x.completion for x in complete(df, stub_complete("text"), only="ask").collect()}
    assert got[1].status == "ok" and got[2] is None and got[3] is None


def requests(r):
    return r.select("corpus_id").distinct().selectExpr("corpus_id", "'why?' as prompt", "cast(null as string) as language")


def dated(r):
    return r.selectExpr("*", "'2024-01-02' as created", "'a' as coding_level_1", "cast(null as string) as coding_level_2", "cast(null as string) as coding_level_3")


def test_texts_of_corpora_that_are_too_large_are_not_dealt(spark):
    r = dated(texts(spark))
    with no_broadcasts(spark):
        before = shuffled(spark)
        out = A.analyze(r, requests(r), stub_complete("text"), stub_complete("judge")).collect()
        assert [(x.record_count, x.error_class) for x in out] == [(60, "DocumentsTooLargeError")]
        A.summarize_bulk(r, stub_complete("summary")).collect()
        assert shuffled(spark) - before < 60 * 20_000 / 4


ODD = (
    "write to a.b@c.org or a.b@c.org, +41 22 123 45 67 & <http://x.org/a?b=c@d.org>", "10.0.0.1 1.2.3.4 10.0.0.1", "user: c@d.org", "x" * 250, "y" * 250 + "@z.org", "", None, "<" * 199 + "q@r.org", "no one",
    "http://10.0.0.1/x,+41 22 123 45 67@c.org 'q' \"r\"", " ".join(f"n{k}@m.org" for k in range(300)),
)


def test_spans_in_place_are_those_of_the_tables(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, content string")
    want = pii.resolve_spans(pii.filter_entities(pii.detect_entities(df, "id", "content")), "id")
    got = df.select("id", F.inline(pii.spans_in_place(F.col("content"))))
    key = lambda x: (x.id, x.start, x.end, x.type, x.value)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 300


@pytest.mark.parametrize("over", [0, 1])
def test_messages_are_measured_as_they_are_built(spark, monkeypatch, over):
    rows = [(f"r{k:03d}", f"c{k % 3}", t, "2024-01-02", "a", None, None, k) for k, t in enumerate(ODD * 3)]
    r = spark.createDataFrame(rows, "id string, corpus_id string, content string, created string, coding_level_1 string, coding_level_2 string, coding_level_3 string, pos long")
    clean, _ = pii.pseudonymise_records(r)
    batch = {x.corpus_id: x for x in P.records_envelope(A.record_blocks(clean), ["corpus_id"], "pos", "block", flag="blocked").collect()}
    for corpus, want in batch.items():
        assert "_10>" in want.records.replace("&gt;", ">") or "_10&gt;" in want.records
        monkeypatch.setattr(A, "MAX_CHARS", len(want.records) - over)
        asked = []
        seen = A.P.with_large
        monkeypatch.setattr(A.P, "with_large", lambda *a, seen=seen: asked.append(seen(*a)) or asked[-1])
        one = r.where(F.col("corpus_id") == corpus)
        A.analyze(one, requests(one), stub_complete("text"), stub_complete("judge"))
        monkeypatch.setattr(A.P, "with_large", seen)
        got = asked[0].collect()
        assert [(x.n_records, x.too_large, x.blocked, x.records) for x in got] == [(want.n_records, over == 1, want.blocked, None if over else want.records)]
