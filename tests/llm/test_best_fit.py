"""Best-fit packing against the tokenizer itself, and the rule of two documents for one against a plain version."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echoloom.llm import best_fit

SCHEMA = "doc_id long, text string, length string, _row string, n long"


def plain_fit(sizes, room):
    """Sets of sizes, bin by bin."""
    left, out = sorted(sizes, reverse=True), []
    while left:
        held, gap = [], room
        for s in list(left):
            if s <= gap:
                held.append(s)
                left.remove(s)
                gap -= s
        if gap and len(held) > 1:
            least, pairs = held[-1], set()
            for i, x in enumerate(left):
                pairs |= {(x + y, x, y) for y in left[i + 1 :] if least < x + y <= gap + least}
            if pairs:
                _, x, y = max(pairs)
                held[-1:] = [x, y]
                left.remove(x)
                left.remove(y)
                left = sorted([*left, least], reverse=True)
        out.append(sorted(held))
    return sorted(out)


def test_two_for_one():
    r = random.Random(1)
    for _ in range(300):
        room = r.choice([10, 60, 200])
        sizes = [r.randint(1, room) for _ in range(r.randint(0, 50))]
        bins = defaultdict(list)
        for s, (bin_, at) in zip(sizes, best_fit.best_two_fit(sizes, room), strict=True):
            bins[bin_].append((at, s))
        for b in bins.values():
            b.sort()
            assert [at for at, _ in b] == [sum(s for _, s in b[:k]) for k in range(len(b))]
        assert sorted(sorted(s for _, s in b) for b in bins.values()) == plain_fit(sizes, room)


def check(rows, pieces, sequence=2048):
    """Each document's ids in pieces, each sequence without gaps, few sequences."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(doc, k, k * sequence, min(sequence, len(ids) - k * sequence), zlib.crc32(ids[k * sequence :][:sequence].tobytes())) for k in range(-(-len(ids) // sequence))]
    assert Counter(tuple(p[:5]) for p in pieces) == Counter(want)
    bins = defaultdict(list)
    for p in pieces:
        bins[p[5]].append((p[6], p[3]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= sequence
    return len(bins), -(-sum(p[3] for p in pieces) // sequence)


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def test_pieces(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdeé漢!9") for _ in range(r.randint(1, 9))) for _ in range(500)]
    rows = [(k if k % 9 else None, " ".join(r.choices(words, k=r.choice([0, 1, 20, 200, 900])))) for k in range(150)]
    rows += [(1, None), (None, None), (2, ""), (3, "the <|endoftext|> mark"), (4, "a " * 2047), (5, "a " * 2048), (6, "b " * 9000)] + [(None, "same row")] * 200
    frame = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA).repartition(3)
    for group_docs in (best_fit.GROUP_DOCS, 40):
        pieces = [tuple(x[c] for c in COLUMNS) for x in best_fit.pack_best_fit(frame, group_docs=group_docs).collect()]
        used, least = check(rows, pieces)
        assert used <= least + (1 if group_docs > 40 else 9)


def test_ids_and_equal_rows(spark):
    frame = spark.createDataFrame([(None, "same row", "x", "y", 1)] * 5000, SCHEMA).repartition(3)
    got = best_fit.pack_best_fit(frame, group_docs=100, with_ids=True).collect()
    assert len(got) == 5000 and all(zlib.crc32(x["ids"]) == x["ids_crc32"] and len(x["ids"]) == 4 * x["length"] for x in got)
    held = Counter(x["sequence_id"] >> 32 for x in got)
    assert len(held) == 50 and max(held.values()) < 200  # equal rows are dealt to many groups


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, n):
    assert best_fit.pack_best_fit(spark.createDataFrame([], SCHEMA)).count() == n


def test_the_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check(rows, [tuple(x[c] for c in COLUMNS) for x in best_fit.op13_best_fit(spark, d).collect()])
    assert used <= least + 1
