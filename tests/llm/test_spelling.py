"""Spelling variants against a comparison of all words with all others."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from echoloom.llm import spelling


def counted(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            out[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words):
    by_len = {}
    for w in words:
        by_len.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_len.get(len(w) + k, ()) if one_edit(w, x)] for w in words}
    best = {w: min(x, key=lambda v: (-words[v], v)) for w, x in near.items() if x}
    form = {w: f for w, f in best.items() if words[f] >= 10 * words[w]}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))


def variants(r, word):
    k, x = r.randrange(len(word)), r.choice("abé÷")
    return r.choice([word[:k] + word[k + 1 :], word[:k] + x + word[k + 1 :], word[:k] + x + word[k:], word + x, word])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    stems = ["".join(r.choice("abc") for _ in range(r.randint(6, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "Éclairage", "÷×ÿabcde", "y" * 3000, "y" * 2999, "z" * 3000 + "a", "z" * 3000]
    words = list(stems)
    for _ in range(900):
        words.append(variants(r, r.choice(words[:300])))
    out = []
    for k in range(300):
        text = r.choice([" ", "\n", "1", "漢", "_"]).join(x.upper() if r.random() < 0.1 else x for x in r.choices(words, k=30) + r.choices(stems, k=20) + stems[:2] * r.choice([0, 0, 200]))
        out.append((k if k % 50 else None, text))
    return [*out, out[1], out[1], (1, None), (2, ""), (None, "short abcde")]


SCHEMA = "doc_id long, text string, word string, n string, form long"


@pytest.mark.parametrize("group_words", [spelling.GROUP_WORDS, 3])
def test_all_words(spark, rows, group_words, monkeypatch):
    """Small groups are dealt anew by halves of their windows; the result is the same."""
    monkeypatch.setattr(spelling, "STEP_PAIRS", 50_000)
    frame = spark.createDataFrame([(d, t, "w", "n", 5) for d, t in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, spelling.group_variants(frame, group_words=group_words).collect()))
    want = sorted(plain(counted(rows)))
    assert sum(w[1] is not None for w in want) > 50
    assert got == want


def test_chains_and_ties(spark):
    words = {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "abcdefghijk": 2000, "bbbbbbb": 3, "bbbbbbc": 30, "bbbbbba": 30, "ccccccc": 4, "cccccccc": 39}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    near = spelling.near_words(frame)
    fits = (near["best"] >= 10 * near["n"])
    forms = near.select("word", spelling.F.when(fits, near["form"]).alias("form"), "n", "n_near", spelling.F.when(fits, near["best"]).alias("form_n"))
    got = sorted(map(tuple, spelling.with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == sorted(plain(words))
    assert ("abcdefgh", "abcdefghi", "abcdefghijk", 2, 1, 20) in got
    assert ("bbbbbbb", "bbbbbba", "bbbbbba", 3, 2, 30) in got


def test_groups_that_share_a_key_are_told_apart():
    texts = [b"aaaaxyz", b"aaaaxyy", b"baaaxyz"]
    pairs = sorted((int(q), int(w)) for x in spelling.scan(spelling._Texts(sorted(texts)), np.array([False, True, True]), np.array([4, 4, 4])) for q, w in zip(*x, strict=True))
    assert pairs == [(0, 1), (1, 0)]


def test_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_query(spark):
    d = "/root/testdata/sf0.001"
    data = [tuple(x) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.op11_spelling_variants(spark, d).collect())) == sorted(plain(counted(data)))
