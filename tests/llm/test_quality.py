"""The perplexity of op4: characters beyond ASCII, the joins against plain arrays, parts of models."""

import random
from collections import Counter

import numpy as np

from echoloom.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def _text(r, vocabulary, n):
    return " ".join(vocabulary[int(len(vocabulary) * r.random() ** 2)] for _ in range(n))


def test_code_points_stand_for_themselves(spark):
    """Letters seven code points from each other are two letters: words with one for the other are no words of the language."""
    r = random.Random(6)
    vocabulary = ["".join(chr(0x430 + r.randrange(14)) for _ in range(r.randint(2, 8))) for _ in range(300)]
    clean = [_text(r, vocabulary, 150) for _ in range(100)]
    other = ["".join(c if c == " " else chr(0x430 + (ord(c) - 0x430 + 7 * r.randrange(2)) % 14) for c in _text(r, vocabulary, 150)) for _ in range(2)]
    df = spark.createDataFrame([(k, t, "ru") for k, t in enumerate(clean + other)], SCHEMA)
    got = {x.doc_id: x for x in quality.judge(df).collect()}
    assert not any(x.base_failed for x in got.values()) and {k for k, x in got.items() if not x.kept} == {100, 101}
    assert got[100].off < 0 and got[101].off < 0


def _rows():
    r = random.Random(8)
    words = lambda letters: ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(80)]
    rows = []
    for lang, letters in (("en", "abcdefgh,.;7"), ("el", "αβγδεζηθ漢"), (None, "xyzß😀")):
        v = words(letters)
        rows += [(len(rows) + k, _text(r, v, r.randint(1, 120)), lang) for k in range(25)]
    return rows + [rows[3], rows[30], rows[30], (None, "no id", "en"), (900, None, "en"), (901, "", "none"), (902, "alone", "one")]


def test_perplexity_against_plain_arrays(spark):
    rows = _rows()
    want = {}
    for lang in {x[2] for x in rows}:
        mine = [x for x in rows if x[2] == lang and x[1]]
        if mine:
            keys, lengths = quality.symbol_keys([x[1] for x in mine])
            model = quality.kneser_ney(*np.unique(keys, return_counts=True), len(np.unique(keys & 63)))
            logp = np.split(quality.log_probabilities(model, keys), np.cumsum(lengths)[:-1])
            want |= {x[0]: float(np.exp(-p.mean())) for x, p in zip(mine, logp, strict=True)}
    got = quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.perplexity is None) == (x.doc_id not in want) and (x.perplexity is None or abs(x.perplexity / want[x.doc_id] - 1) < 1e-5)


def test_parts_of_a_model(spark, monkeypatch):
    """A language's model in several parts, in one pass and in several, gives the same; equal rows stay as many."""
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(2)
    show = lambda: sorted(((x.doc_id if x.doc_id is not None else -1, x.n_words, x.word_chars, x.kept, None if x.perplexity is None else round(x.perplexity, 6)) for x in quality.judge(df).collect()), key=str)
    whole = show()
    monkeypatch.setattr(quality, "PART_GRAMS", 400)
    assert quality.train(df).count() > 5 and show() == whole
    monkeypatch.setattr(quality, "MODEL_BYTES", 1)
    assert show() == whole


def test_grams_of_many_characters():
    r = random.Random(9)
    for texts in (["aé漢\U0010ffff\x00", "", "é"], ["".join(chr(r.choice((0x4E00, 0xAC00)) + r.randrange(6000)) for _ in range(9000)), "ab"]):
        hi, lo, n = quality._grams(texts)
        two = lambda x: (int(x) >> quality.WIDTH, int(x) & ((1 << quality.WIDTH) - 1))
        got = {two(a) + two(b): int(c) for a, b, c in zip(hi, lo, n, strict=True)}
        want = Counter()
        for t in texts:
            c = [quality.EDGE] * 3 + [ord("#") if x == "\x00" else ord(x) for x in t]
            want.update(tuple(c[k : k + 4]) for k in range(len(c) - 3))
        assert got == want
