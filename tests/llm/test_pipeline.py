"""run() and its stages against plain versions on small tables."""

import re
from collections import Counter, defaultdict

import pytest


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = {}
    for name, stage in p.STAGES[:-1]:
        docs = p.settle(stage(spark, docs, d), name)
        n[name] = docs.count()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = [r.text.lower() for r in p.table(spark, d, "documents").collect()]
    assert 0 < n["near"] <= n["exact"] <= n["quality"] <= len(texts) and n["exact"] <= len(set(texts))
    packed = p.STAGES[-1][1](spark, docs, d)
    a = sorted(map(tuple, packed.collect()))
    assert a == sorted(map(tuple, p.run(spark, d).collect()))
    assert sum(1 for r in a if r[1] == 0) == n["mix"]


WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, _kid long, _kth string, kept boolean, node long, _th string, copies int"


def _fold(t):
    return (t or "").encode().lower()


def _set(t, n=5):
    w = [x.encode() for x in WORD.findall(_fold(t).decode())]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def _survivors(rows):
    """Of rows (id, text) those that the stage on near copies keeps, by all pairs."""
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = defaultdict(lambda: 2**62)
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            least[top(k)] = min(least[top(k)], i)
    return [i for k, (i, _) in enumerate(rows) if not sets[k] or i == least[top(k)]]


def test_stages_against_plain_versions(spark):
    """On each stage's own input: which rows stay, and what the mixture and the sequences hold."""
    import public_tokenizers
    import tokenizers

    import corpus_pipeline as p
    from echoloom.llm import quality

    d = "/root/testdata/sf0.001"
    docs = p.table(spark, d, "documents")
    stage = dict(p.STAGES)
    before = [tuple(r) for r in docs.collect()]
    good = p.settle(stage["quality"](spark, docs, d), "t")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    for i, t, *_ in before:
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + x for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for x in range(5)}
        if len(w) < 10 or 100 * len(inside) > 20 * len(w):
            assert not verdict[i]
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, k in verdict.items() if k)
    alone = p.settle(stage["exact"](spark, good, d), "t")
    last: dict = {}
    for r in good.collect():
        last[_fold(r.text)] = max(r.doc_id, last.get(_fold(r.text), -1))
    assert sorted(r.doc_id for r in alone.collect()) == sorted(last.values())
    apart = p.settle(stage["near"](spark, alone, d), "t")
    assert sorted(r.doc_id for r in apart.collect()) == sorted(_survivors([(r.doc_id, r.text) for r in alone.collect()]))
    mixed = p.settle(stage["mix"](spark, apart, d), "t")
    whole = {r.doc_id: tuple(r) for r in apart.collect()}
    taken = Counter(r.doc_id for r in mixed.collect())
    assert all(tuple(r) == whole[r.doc_id] for r in mixed.collect()) and max(taken.values()) <= 3
    words = lambda of: {s: sum(n * len(WORD.findall(whole[i][1] or "")) for i, n in of.items() if whole[i][3] == s) for s in sources}
    sources = sorted({r[3] for r in whole.values()})
    size, got = words(dict.fromkeys(whole, 1)), words(taken)
    left, target = sum(size.values()), {}
    while True:
        free = [s for s in sources if s not in target]
        share = {s: left * (sources.index(s) % 3 + 1) / sum(sources.index(x) % 3 + 1 for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
    largest = max(len(WORD.findall(r[1] or "")) for r in whole.values())
    assert all(abs(got[s] - target[s]) <= largest for s in sources)
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stage["pack"](spark, mixed, d).collect()
    length = {i: len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for i, r in whole.items()}
    held = Counter()
    for r in pieces:
        assert r.doc_tokens == length[r.doc_id] and r.offset + r.length <= 2048
        held[r.doc_id] += r.length
    assert held == Counter({i: n * length[i] for i, n in taken.items()})


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty texts, repeats and columns whose names the operators use as well."""
    import corpus_pipeline as p

    prose = " ".join(f"word{k * k % 97}x{k}" for k in range(60))
    rows = [(k, f"{prose} number {k} " + " ".join(f"own{k}a{x}" for x in range(40)), "en", f"s{k % 3}", 0, 1, "x", False, 3, "h", 0) for k in range(12)]
    rows += [(k, t, None, None, None, None, None, None, None, None, None) for k, t in ((50, None), (51, ""), (None, None), (None, prose), (None, prose), (52, prose))] + [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in p.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            out = p.settle(stage(spark, df, ""), name)
            assert out.columns == docs.columns, name
            got = Counter(tuple(r) for r in out.collect())
            assert not set(got) - set(rows), name
            if name != "mix":
                assert not got - Counter(rows), name
    kept = dict(p.STAGES)["exact"](spark, docs, "").collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [*range(12), 51, 52]
    near = dict(p.STAGES)["near"](spark, docs, "").collect()
    assert Counter(r.doc_id for r in near)[3] == 3 and {50, 51, 52} <= {r.doc_id for r in near}
    assert dict(p.STAGES)["pack"](spark, docs, "").where("start = 0").count() == len(rows)


def test_many_null_ids(spark):
    """Rows without an id are no product with the classes that have none; chains of copies are one component."""
    from echoloom.llm import near_dedup

    word = lambda k: f"w{k * 7919 % 10007}"
    rows = [(None, " ".join(word(50 * k + x) for x in range(30))) for k in range(1000)] + [(None, f"same text for all {'of them ' * 9}")] * 1000
    rows += [(k, " ".join(word(60_000 + 2 * k + x) for x in range(60))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(df, words=2).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None} == {0}


def test_cells_hold_what_shares_a_key(spark, monkeypatch):
    """3,000 texts, each alike its neighbours but too little: no family of all of them is compared, only what shares a key."""
    from echoloom.llm import near_dedup

    rows = [(k, " ".join(f"w{30 * k + x}" for x in range(50))) for k in range(3000)]
    sizes = {}
    settle = near_dedup.settle
    monkeypatch.setattr(near_dedup, "settle", lambda df, name: (lambda out: (sizes.__setitem__(name, out.count()), out)[1])(settle(df, name)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    assert got.where("kept").count() == 3000
    assert sizes.get("met", 0) < 3000 and sizes["compared"] < 6000


def test_registered(spark):
    import __spark_entry__ as e

    names = [k for k in e.queries() if k.startswith("op") or k == "pipeline"]
    assert len(names) == 11
    with pytest.raises(KeyError):
        e.queries()["op11"]
