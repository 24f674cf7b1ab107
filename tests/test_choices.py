import hashlib
import math
from collections import Counter

from echoloom.operators import corpus as C
from echoloom.operators.choices import choose, weight_edges

WEIGHTS = [("a", "x", 1.0), ("a", "y", 3.0), ("a", "y", 4.0), ("a", "none", 0.0), ("a", "less", -2.0), ("a", "nan", math.nan), ("a", "inf", math.inf), ("a", None, 5.0), ("b", "z", 1e-9), (None, "w", 1.0)]


def draw(key, seed):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 2**32


def plain(key, seed, names):
    total, upto = sum(w for _, w in names), 0.0
    for n, w in names:
        upto += w
        if draw(key, seed) < upto / total:
            return n
    return None


def table(spark, rows=WEIGHTS):
    return spark.createDataFrame(rows, "up string, name string, weight double")


def test_edges(spark):
    got = {(r.up, r.name): (r.lo, r.hi) for r in weight_edges(table(spark), "name", "up").collect()}
    assert got == {("a", "x"): (0.0, 0.125), ("a", "y"): (0.125, 1.0), ("b", "z"): (0.0, 1.0)}
    assert weight_edges(table(spark, []), "name", "up").count() == 0


def test_choices_equal_a_plain_scan(spark):
    rows = [(f"k{i}", ("a", "a", "a", "b", "c", None)[i % 6], i) for i in range(3000)] + [(None, "a", -1), ("k0", "a", -2), ("k0", "a", -2)]
    df = spark.createDataFrame(rows, "id string, up string, lo int")  # a clashing name
    got = choose(df, table(spark), "name", 5, under="up").collect()
    lists = {"a": [("x", 1.0), ("y", 7.0)], "b": [("z", 1.0)]}
    want = [(k, u, i, plain(k or "", 5, lists[u]) if u in lists else None) for k, u, i in rows]
    assert Counter(map(tuple, got)) == Counter(want)


def test_many_names_fall_in_one_bin(spark):
    names = [("", f"n{i:04d}", float(1 + i % 7)) for i in range(5000)]
    df = spark.range(2000).selectExpr("cast(id as string) as id")
    got = {r.id: r.name for r in choose(df, table(spark, names).drop("up"), "name", "s").collect()}
    assert got == {str(i): plain(str(i), "s", [(n, w) for _, n, w in names]) for i in range(2000)}


def test_no_weights_and_no_rows(spark):
    df = spark.range(3).selectExpr("cast(id as string) as id", "'old' as name")
    assert [r.name for r in choose(df, table(spark, []).drop("up"), "name", 1).collect()] == [None] * 3
    assert choose(df.where("false"), table(spark), "name", 1).count() == 0


def test_regions_lie_in_their_country_and_shares_come_near_the_weights(spark):
    df = spark.range(20_000).selectExpr("concat('r', id) as id", "if(id % 3 = 0, 'one', if(id % 3 = 1, 'two', 'other')) as code", "'gone' as region")
    leaves = spark.createDataFrame([("one", "praise", True), ("two", "question", None), ("two", "thanks", None)], "code string, feedback_type string, sensitive boolean")
    m = C.sample_metadata(df, 3, leaves=leaves).collect()
    assert len(m) == 20_000 and len({r.id for r in m}) == 20_000
    assert all(r.region in C.PLACES[r.country] for r in m)
    countries, regions, sources = (Counter(r[k] for r in m) for k in ("country", "region", "source"))
    assert all(abs(n / 20_000 - 1 / 7) < 0.02 for n in countries.values()) and len(countries) == 7
    assert all(abs(n / 20_000 - 1 / 28) < 0.01 for n in regions.values()) and len(regions) == 28
    assert all(abs(sources[s] / 20_000 - w) < 0.02 for s, w in C.SOURCES.items())
    assert {(r.code, r.feedback_type) for r in m} == {("one", "praise"), ("two", "question"), ("other", None)}
    share = Counter((r.code, r.sensitive) for r in m)
    assert 0.93 < share["one", True] / sum(v for (c, _), v in share.items() if c == "one") < 0.97
    assert 0.03 < share["two", True] / sum(v for (c, _), v in share.items() if c == "two") < 0.07
    assert {r.year for r in m} == {2020} and {r.language for r in m} == {"en"}


def test_feedback_type_must_be_that_of_every_code(spark):
    f = spark.createDataFrame([("a", "praise"), ("b", "question"), ("n", None)], "node_id string, feedback_type string")
    rows = [("ok", "a", "praise"), ("two", "a,b", "praise"), ("none", "a", None), ("typeless", "n", None), ("typed", "n", "praise"), ("new", "zz", "praise")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "id string, codes string, feedback_type string, sentence_count int")
    got = {tuple(r) for r in C.corpus_checks(df, f).collect()}
    assert got == {("two", "feedback type"), ("none", "feedback type"), ("typed", "feedback type"), ("new", "unknown code")}
    assert {tuple(r) for r in C.corpus_checks(df.drop("feedback_type"), f).collect()} == {("new", "unknown code")}
