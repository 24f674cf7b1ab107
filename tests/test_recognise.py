import pytest

from echoloom.operators import pii as P
from echoloom.operators import recognise as R


def rows(spark, data):
    return spark.createDataFrame(data, "id string, corpus_id string, content string, language string, error_class string")


def recogniser():
    """Finds capitalised words; fails on a batch that holds the word boom; gives odd spans for odd texts."""

    def make():
        import re

        odd = {"outside": [(0, 99, "PERSON")], "empty": [(2, 2, "PERSON")], "typeless": [(0, 2, None)], "none": None, "refused": RuntimeError("no")}

        def fn(pairs):
            if any("boom" in t for t, _ in pairs):
                raise TimeoutError
            return [odd[t] if t in odd else [(m.start(), m.end(), "PERSON") for m in re.finditer("[A-Z]\\w+", t)] for t, _ in pairs]

        return fn

    return make


def test_failures_are_rows_and_do_not_depend_on_batches(spark):
    texts = ["Ann met Bob", "boom Ann", "outside", "empty", "typeless", "none", "refused", "", None, "Zoë 😀 Ann", "plain"] * 3
    df = rows(spark, [(f"r{i}", "c", t, "en", None) for i, t in enumerate(texts)])
    want = {1: "LLMTimeoutError", 2: "LLMResponseError", 3: "LLMResponseError", 4: "LLMResponseError", 5: "LLMResponseError", 6: "LLMError"}
    for batch, parts in ((1, 1), (4, 3), (64, 1)):
        got = R.recognise(df.repartition(parts), recogniser(), "id", "content", batch=batch).collect()
        assert {(int(r.id[1:]), r.error_class) for r in got if r.error_class} == {(i, want[i % 11]) for i in range(33) if i % 11 in want}
        spans = sorted((int(r.id[1:]) % 11, r.start, r.end, r.value) for r in got if not r.error_class and int(r.id[1:]) < 11)
        assert spans == [(0, 0, 3, "Ann"), (0, 8, 11, "Bob"), (9, 0, 3, "Zoë"), (9, 6, 9, "Ann")]


def test_a_text_that_was_not_looked_at_does_not_leave(spark):
    df = rows(spark, [("1", "c", "Ann met Bob", "en", "old"), ("2", "c", "boom Ann secret", "en", None), ("3", "c", None, None, None), ("4", "c", "", "en", None), ("5", "d", "Bob", None, None), ("6", "c", "Bob again, Ann", "en", None)])
    out, mapping = R.pseudonymise_recognised(df, recogniser())
    got = {r.id: (r.content, r.error_class) for r in out.collect()}
    assert got == {"1": ("<PERSON_0> met <PERSON_1>", None), "2": (None, "LLMTimeoutError"), "3": (None, None), "4": ("", None), "5": ("<PERSON_0>", None), "6": ("<PERSON_1> again, <PERSON_0>", None)}
    assert sorted(map(tuple, mapping.collect())) == [("c", "<PERSON_0>", "PERSON", "Ann"), ("c", "<PERSON_1>", "PERSON", "Bob"), ("d", "<PERSON_0>", "PERSON", "Bob")]
    back = {r.id: r.content for r in P.restore(out, mapping, "corpus_id", "content").collect()}
    assert back == {"1": "Ann met Bob", "2": None, "3": None, "4": "", "5": "Bob", "6": "Bob again, Ann"}


def test_empty_table_and_wrong_number_of_answers(spark):
    out, mapping = R.pseudonymise_recognised(rows(spark, []), recogniser())
    assert out.count() == 0 and mapping.count() == 0
    got = R.recognise_batch(lambda pairs: [] if len(pairs) > 1 else [[(0, 1, "X")]], [("ab", "en"), ("cd", "en")])
    assert got == [[(0, 1, "X")]] * 2
    assert isinstance(R.recognise_batch(lambda pairs: [], [("ab", "en")])[0], TypeError)


def test_the_language_reaches_the_recogniser_and_the_stub_is_linear(spark):
    long = "y" * 200_000
    df = rows(spark, [("en", "c", "a@b.cd +12 3456 7890", "en", None), ("fr", "c", "a@b.cd +12 3456 7890", "fr", None), ("no", "c", "a@b.cd +12 3456 7890", None, None), ("long", "c", long, "en", None)])
    got = sorted((r.id, r.type) for r in R.recognise(df, R.stub_recogniser(), "id", "content", "language").collect())
    assert got == [("en", "EMAIL_ADDRESS"), ("en", "PHONE_NUMBER"), ("fr", "EMAIL_ADDRESS"), ("no", "EMAIL_ADDRESS")]


@pytest.mark.parametrize("text", ["a@b.cd_x@e.fg", "x@y.z@q.rs", "+1 234 5678 +9 876 5432", "http://a.b/c?d e@f.gh"])
def test_the_stub_finds_what_the_detectors_find(spark, text):
    df = rows(spark, [("1", "c", text, "en", None)])
    a = sorted((r.start, r.end, r.type, r.value) for r in P.detect_entities(df, "id", "content").collect())
    b = sorted((r.start, r.end, r.type, r.value) for r in R.recognise(df, R.stub_recogniser(), "id", "content", "language").collect())
    assert a == b
