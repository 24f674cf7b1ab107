"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from echoloom.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, substring_dedup, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, kept string, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def _rows():
    base = _words(300, 1)
    near = base.split()
    near[10] = "changed"
    passage = _words(70, 9)
    texts = [
        None, "", " ", "one", "Same Text here", "same text HERE", "Same Text here", base, " ".join(near), "x " * 30 + "\n" + "x " * 30, _words(3000, 2) + "\n" + passage,
        _words(60, 3) + "\n" + passage + "\n" + _words(60, 4), "É é ß 漢字 😀   nbsp", "a line that repeats\nunique " + _words(5, 5) + "\nA line that repeats  ", "a LINE that repeats\nshort\nshort",
        "mail a.b@c.example.org or x_y@z.org and a@b.c_d@e.f, card 4111 1111 1111 1111, 4111111111111112, ip 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1, tel +1 (988) 555-2485 iban GB82 WEST 1234 5698 7654 32, call 988-555-2485",
        "y" * 30000, "9 " * 4000, "the <|endoftext|> mark", "words. And, more; words! " * 20,
    ]
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 3}" if k % 5 else None, 0, 7, "no", "k") for k, t in enumerate(texts)]
    rows += [rows[4], rows[7], (None, "null id text that is long enough here", None, None, None, None, None, None), (None, None, None, "s1", 1, 1, "x", "y")]
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


def test_exact_groups(docs, empty):
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    for g, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(g).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in mine) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in mine} == {(top, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [top]
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and Counter(lower(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.drop_exact(empty).count() == 0


def test_exact_groups_over_many_partitions(spark):
    rows = [(k, "Hot text" if k % 3 else f"t{k % 50}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = exact_dedup.exact_groups(df).collect()
        kept = exact_dedup.drop_exact(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    size = Counter(t for _, t in rows)
    top = {t: max(i for i, x in rows if x == t) for t in size}
    by = dict(rows)
    assert all((r.keep_id, r.group_size, r.kept) == (top[by[r.doc_id]], size[by[r.doc_id]], r.doc_id == top[by[r.doc_id]]) for r in got)
    assert sorted(r.doc_id for r in kept) == sorted(top.values())


def test_lines(spark, docs, empty):
    where = defaultdict(set)
    big = 2**63 - 1
    for r in ROWS:
        for x in (r[1] or "").split("\n"):
            k = x.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()
            if len(k) >= 10:
                where[k].add(big if r[0] is None else r[0])
    want = Counter()
    for r in ROWS:
        keep, lines = [], (r[1] or "").split("\n")
        for x in lines:
            k = x.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()
            if not (len(k) >= 10 and len(where[k]) > 1 and min(where[k]) != (big if r[0] is None else r[0])):
                keep.append(x)
        want[(r[0], len(lines), len(lines) - len(keep), "\n".join(keep).encode())] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept_text)) for r in line_dedup.line_dedup(docs).collect())
    assert got == want and sum(k[2] for k in want) > 0
    assert line_dedup.line_dedup(empty).count() == 0
    bits = line_dedup.unpack_bitmap(line_dedup.pack_bitmap([3, 1]))
    assert bits.tolist() == [True, False, True, False]


def test_near_groups(docs, empty):
    def shingles(t):
        w = WORDS.findall(lower(t).decode())
        return frozenset(tuple(w[k : k + 2]) for k in range(len(w) - 1)) or frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in ROWS]
    comp = list(range(len(ROWS)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    want = Counter()
    for k, r in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if comp[j] == comp[k] and ROWS[j][0] is not None]
        least = r[0] if not sets[k] else min(ids, default=None)
        want[(r[0], len(sets[k]), least, r[0] == least)] += 1
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, words=2).collect())
    assert got == want
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.drop_near(docs).columns == docs.columns


def test_near_groups_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    base = _words(200, 50).split()
    rows, r = [], random.Random(3)
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 18)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    sets = [frozenset(zip(t.split(), t.split()[1:])) for _, t in rows]
    comp = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    least = {c: min(i for i in range(60) if comp[i] == c) for c in comp}
    assert got == {i: least[comp[i]] for i in range(60)}


def test_spans(docs, empty):
    got = {r.doc_id: r for r in pii.detect(docs).collect() if r.doc_id == 15}[15].spans
    text = ROWS[15][1]
    names = [k.name for k in pii.KINDS]
    found = [(names[s.kind], text[s.start : s.end]) for s in got]
    assert [x for k, x in found if k == "email"] == ["a.b@c.example.org", "x_y@z.org", "a@b.c", "_d@e.f"]
    assert [x for k, x in found if k == "card"] == ["4111 1111 1111 1111"]
    assert [x for k, x in found if k == "ip"] == ["10.0.0.1", "1.2.3.4", "5.6.7.8"]
    assert [x for k, x in found if k == "phone"] == ["+1 (988) 555-2485"]
    assert [x for k, x in found if k == "iban"] == ["GB82 WEST 1234 5698 7654 32"]
    assert [x for k, x in found if k == "local_phone"] == ["988-555-2485"]  # by its context word
    assert len(pii.detect(docs).collect()) == len(ROWS) and pii.detect(empty).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "<CARD>" in clean[15] and "4111 1111" not in clean[15] and clean[3] == "one"


def _plain_spans(t):
    out = []
    for kind, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            v = m[0]
            d = re.sub("[^0-9]", "", v)
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if (kind == 1 and any(int(x) > 255 for x in v.split("."))) or (kind == 2 and not (12 <= len(d) <= 19 and luhn)) or (kind == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_spans_against_plain_patterns(spark):
    r = random.Random(4)
    bits = ["@", ".", "1", "22", "+1", " ", "-", "a", "b_c", "x@y.z", "4111111111111111", "255.0.0.1", "(", ")", "%", "é", "\n", "0001.2.3.4", "+49 30 1234567", "@a.b"]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randint(1, 14)))) for k in range(1500)]
    got = {x.doc_id: [(s.start, s.kind, s.end) for s in x.spans if s.kind < 4] for x in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == _plain_spans(t) for k, t in rows)


def test_quality(docs, empty):
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS) and quality.judge(empty).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, t in ((r[0], r[1]) for r in ROWS if r[0] is not None):
        words = WORDS.findall(t or "")
        win = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        rep = {i + j for i in range(len(words) - 4) if win[tuple(words[i : i + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if WORDS.search(x):
                dup += x in seen
                seen.add(x)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep), len(words) < 10 or 100 * len(rep) > 20 * len(words))
        r = by[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_quality_band(spark):
    """Junk that passes the base rules, of the kinds in the given tables, is rejected on both sides; clean text stays."""
    r = random.Random(3)
    vocabulary = [_words(1, k) for k in range(400)]
    words = lambda: [vocabulary[int(400 * r.random() ** 2)] for _ in range(200)]
    clean = [" ".join(words()) for _ in range(120)]
    piped = ["".join(w + r.choice([" | ", " "]) for w in words()) for _ in range(2)]
    marked = [" ".join(w + r.choice(["###", "$$$", "%%%", "***", "&&&"]) for w in words()) for _ in range(12)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(clean + piped + marked)], "doc_id long, text string, lang string")
    got = quality.judge(df).collect()
    assert not any(x.base_failed for x in got) and {x.doc_id for x in got if x.kept} == set(range(120))
    assert all(x.off < 0 for x in got if x.doc_id in (120, 121)) and all(x.off > 0 for x in got if x.doc_id > 121)


def test_kneser_ney_sums_to_one():
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("abc de"), 400)) for _ in range(5)]
    keys, _ = quality.symbol_keys(texts)
    model = quality.kneser_ney(*np.unique(keys, return_counts=True))
    for ctx in (keys[50] >> 6, keys[7] >> 6, 0):
        p = np.exp(quality.log_probabilities(model, (int(ctx) << 6) + np.arange(1, quality.SYMBOLS)))
        assert abs(p.sum() - 1) < 1e-4


def test_models_in_several_passes(docs, monkeypatch):
    one = {(r.doc_id, r.n_words): r.perplexity for r in quality.judge(docs).collect()}
    monkeypatch.setattr(quality, "MODEL_BYTES", 1)
    many = {(r.doc_id, r.n_words): r.perplexity for r in quality.judge(docs).collect()}
    assert one.keys() == many.keys() and all(one[k] == many[k] or abs(one[k] - many[k]) < 1e-6 for k in one)


def test_repeats(docs, empty):
    got = substring_dedup.repeated_spans(docs).collect()
    hits = {r["_id"] for r in got}
    # 10 and 11 share a passage, 7 and 8 are near copies.
    assert {7, 8, 10, 11} <= hits and not hits & {0, 1, 2, 3, 12, 13}
    for r in got:
        mine = {x[1].encode()[r.start : r.end] for x in ROWS if x[0] == r["_id"]}
        first = {x[1].encode() for x in ROWS if x[0] == r.first_id}
        assert any(m in f for m in mine for f in first)
    assert substring_dedup.repeated_spans(empty).count() == 0
    left = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).collect()}
    assert _words(70, 9) in left[10] and _words(70, 9) not in left[11] and left[3] == "one"


def test_chunks_resist_insertions():
    text = _words(4000, 8).encode()
    def cut(t):
        ends = substring_dedup.chunk_ends(np.frombuffer(t, np.uint8), [len(t)])
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    a, b = cut(text), cut(text[:5000] + b"inserted " + text[5000:])
    assert len(a - b) <= 4
    both = substring_dedup.chunk_ends(np.frombuffer(text + text, np.uint8), [len(text), 2 * len(text)])
    n = len(substring_dedup.chunk_ends(np.frombuffer(text, np.uint8), [len(text)]))
    assert [x - len(text) for x in both[n:]] == both[:n]


def test_runs_of_one_word(spark):
    """Long runs of few words give no chunk ends by the mask alone; they are found wherever they stand."""
    words = ("Was ", "Onwhou ", "Thhe ", "a bc ", "La mentre ")
    rows = [(2 * k + j, _words(40 + 7 * j, 100 + 2 * k + j) + "\n" + w * (90 + 11 * j) + _words(30, 200 + 2 * k + j)) for k, w in enumerate(words) for j in (0, 1)]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["_id"] for r in got} == {i for i, _ in rows}
    texts = dict(rows)
    for r in got:
        assert texts[r["_id"]].encode()[r.start : r.end] in texts[r.first_id].encode()
    for w in words:
        text = (_words(50, 5) + w * 3000).encode()
        ends = substring_dedup.chunk_ends(np.frombuffer(text, np.uint8), [len(text)])
        assert ends[-1] == len(text) and all(0 < b - a <= substring_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))


def test_token_counts(docs, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in ROWS)
    assert token_counts.count_tokens(empty).count() == 0
    lengths = token_counts.PieceLengths(public_tokenizers.path("piece_bpe_32k.model"), {})
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(["a", "the", " ", "  ", "\n", "▁", "é", "漢", "<s>", "\x00", "."]) for _ in range(r.randint(0, 10)))
        assert lengths.count(t) == len(sp.encode(t)), repr(t)


def test_mixing(spark, docs, empty):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix_counts(empty).count() == 0
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in ROWS)
    assert all(r.taken <= 3 * r.size for r in got)
    rows = [(k, _words(5 + k % 90, k), f"s{min(k % 40, 5)}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_counts(df).collect()
    size, target, taken = Counter(), {}, Counter()
    for r, (_, _, s) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True):
        size[s] += r.size
        target[s] = r.target
        taken[s] += r.taken
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    want, fixed = {}, set()
    while True:
        left = sum(size.values()) - sum(want[s] for s in fixed)
        w = sum(weights[s] for s in size if s not in fixed)
        over = {s for s in size if s not in fixed and left * weights[s] / w > 3 * size[s]}
        want |= {s: left * weights[s] / w for s in size if s not in fixed} | {s: 3.0 * size[s] for s in over}
        if not over:
            break
        fixed |= over
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) < 0.02 * want[s] + 100 for s in size)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [1]
    got = packing.pack_documents(docs, sequence=512).collect()
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append(r)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = Counter()
    for r in ROWS:
        x = ids(r[1])
        for k in range(0, len(x), 512):
            part = x[k : k + 512]
            want[(r[0], k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(x))] += 1
    assert pieces == want and packing.pack_documents(empty).count() == 0
    full = packing.pack_documents(docs, with_ids=True).first()
    assert zlib.crc32(bytes(full.ids)) == full.ids_crc32


def test_first_fit_decreasing():
    r = random.Random(6)
    sizes = [r.randint(1, 100) for _ in range(400)]
    bins: list[int] = []
    want = {}
    for k in sorted(range(400), key=lambda i: -sizes[i]):
        b = next((i for i, x in enumerate(bins) if x >= sizes[k]), len(bins))
        if b == len(bins):
            bins.append(100)
        want[k] = (b, 100 - bins[b])
        bins[b] -= sizes[k]
    assert packing.first_fit_decreasing(sizes, 100) == [want[k] for k in range(400)]


def _bucket(salt: int, gram: str) -> int:
    """The column of an n-gram, by whole numbers."""
    m = 2**64
    h = 0
    for c in gram.encode():
        h = (h * 257 + c + 1) % m
    x = (h * 4 + salt) % m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % m
    x = (x ^ x >> 27) * 0x94D049BB133111EB % m
    return (x ^ x >> 31) >> (64 - url_filter.BITS)


def test_urls(spark):
    urls = ["http://www.Example.COM/en/x?y#z", "https://a.b.net/es/1", "https://b.net/de/1", "https://example.com/en/1", "https://x.org", None, "no scheme", "://h/p?q", "https://casino-win.example.org/de/3", "ftp://weather.example.org/de/5", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS verdict")
    got = {r.page_id: r for r in url_filter.judge_urls(df, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("net/es/", "block") and got[2].rule is None
    assert (got[3].rule, got[3].verdict) == ("example.com/en/", "block")
    assert [(got[k].host, got[k].path) for k in (4, 5, 6, 7, 10)] == [("x.org", ""), ("", ""), ("", ""), ("h", "/p"), ("", "")]
    assert got[8].verdict == "block" and got[9].verdict == "allow"
    # Held-out urls: of the same words, but no host of the labelled table; and what a plain sum over n-grams gives.
    seen = {url_filter.split_url(r.url)[0] for r in url_filter.labelled_urls(spark).collect()}
    rest = [r for r in url_filter.labelled_urls(spark, 500, seed=99).collect() if url_filter.split_url(r.url)[0] not in seen]
    held = spark.createDataFrame([(k, r.url) for k, r in enumerate(rest)], "page_id long, url string")
    model = url_filter.train(url_filter.labelled_urls(spark))
    out = url_filter.judge_urls(held.unionAll(held.limit(5)), model, rules=()).collect()
    assert len(out) == len(rest) + 5
    hits = np.array([(r.verdict == "block") == (rest[r.page_id].label == 1) for r in out])
    clean = np.array([rest[r.page_id].label == 0 for r in out])
    assert hits.mean() > 0.93 and hits[clean].mean() > 0.98
    for r in out[:40]:
        grams = [(salt, f"^{part}$"[k : k + n]) for salt, part in ((1, r.host), (2, r.path)) for n in url_filter.GRAMS for k in range(len(part) + 3 - n)]
        total = sum(model[0][_bucket(salt, g)] for salt, g in grams) / np.sqrt(len(grams))
        assert abs(r.score - 1 / (1 + np.exp(-(model[1] + total)))) < 1e-9
    # The path alone decides where the host is not known; a very long one is read whole.
    more = spark.createDataFrame([(1, "https://unknown-site.example.org/"), (2, "https://unknown-site.example.org/casino-win/free-bets/"), (3, "https://x.org/" + "a" * 50_000), (None, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(more, model).collect()} == {1: "allow", 2: "block", 3: "allow", None: "allow"}
    assert url_filter.judge_urls(df.limit(0), url_filter.train(df.selectExpr("url", "CAST(NULL AS int) AS label"))).count() == 0


def test_repeats_against_all_windows(spark):
    """Every document with a stretch of 52 words that another holds is found, also where each sentence stands first in a document of its own."""
    import random

    from recall_substring import shared_windows

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    sentences = [prose(12) + "." for _ in range(10)]
    rows = [(k, prose(30) + " " + s + " " + prose(30)) for k, s in enumerate(sentences)]
    rows += [(100 + k, prose(40 + k) + " " + " ".join(sentences) + " " + prose(20)) for k in range(3)]
    long = prose(3000)
    rows += [(200, long), (201, prose(3) + " " + long), (202, "x" + long[:9000] + " " + prose(40) + long[9000:])]
    rows += [(300 + k, prose(20) + " que" * (80 + 30 * k) + " " + prose(20)) for k in range(4)] + [(400 + k, prose(200)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: t.encode() for i, t in rows}
    want = {i: w for i, w in shared_windows(texts).items() if w}
    got = {}
    for x in substring_dedup.repeated_spans(docs).collect():
        got.setdefault(x._id, []).append((x.start, x.end))
        part = texts[x._id][x.start : x.end]
        assert sum(part in t for t in texts.values()) > 1 and part.decode("utf-8")
    assert set(got) == set(want)
    for i in (100, 101, 102, 200, 201):
        a, b = min(s for s, _ in want[i]), max(e for _, e in want[i])
        assert any(s <= a and e >= b for s, e in got[i])


def test_repeats_keep_columns(spark):
    text = _words(70, 9) + " é"
    rows = [(1, text, 5, "a"), (2, "é " + text + " 漢", 6, None), (None, None, 7, "c"), (None, text, 8, "d"), (2, "é " + text + " 漢", 6, None), (4, "", 9, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, gone string")
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    left = sorted(((x.doc_id, x.text, x._row, x.gone) for x in out.collect()), key=str)
    assert len(left) == 6 and (1, text, 5, "a") in left and (None, None, 7, "c") in left and (4, "", 9, "e") in left
    assert all(len(t) < 20 for i, t, *_ in left if i == 2)
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0
