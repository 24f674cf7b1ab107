"""Quality rules: counts that any text can be judged by, and the perplexity under an n-gram model of the corpus itself.

The model is an order-4 modified Kneser-Ney model over characters for each language: every letter and every code point beyond ASCII stands for itself, of ASCII's others white space,
digits, full stop and comma, and the remaining marks are a kind each, so that runs of any marks are alike; all n-grams of all documents are in it. Spark counts the n-grams and works the probabilities out by joins, from one order to the next. What a document needs of the model is the probability of each of
its own n-grams, which the model holds, as they were counted; they are kept in sorted arrays, looked up by binary search, in parts of PART_GRAMS. Parts beyond
MODEL_BYTES together are used in several passes, so the model may be of any size and what is broadcast at once has a bound. A document is rejected when its mean
log-probability is outside a band of its language, from LOWER spreads below the median to UPPER above it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, keep_rows, settle, table

ORDER = 4
#: What stands before a text, beyond all code points; bits of a code point.
EDGE = 0x110000
WIDTH = 21
_LAST = (1 << WIDTH) - 1
#: Parts of models of one broadcast, unless one part has more.
MODEL_BYTES = 256 * 1024 * 1024
#: n-grams of a part of a language's model, about; one has 12 bytes and a share of the pairs of characters.
PART_GRAMS = 4_000_000
#: Characters that a task counts before it passes the counts on.
FLUSH_CHARS = 6_000_000
#: Spreads below and above the middle. On the labelled rows of sf0.1 that pass the base rules, each side rejects one in a hundred
#: of those with quality 1 (the README has the figures). Junk of marks in runs scores above the middle, of scattered bars below.
LOWER, UPPER = 2.7, 2.5
#: Characters of text below which the band of a document is wider.
SHORT = 400
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


# ---------------------------------------------------------------- the model


def _kinds() -> np.ndarray:
    """What stands for each ASCII character: itself for a letter, else the first of its kind."""
    t = np.full(128, ord("#"), dtype=np.int64)
    t[list(SPACE)] = ord(" ")
    t[[ord(c) for c in ".,"]] = ord(".")
    t[48:58] = ord("0")
    for first in "aA":
        t[ord(first) : ord(first) + 26] = ord(first) + np.arange(26)
    return t


_KINDS = _kinds()


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of neighbouring characters of the texts as numbers, texts with a border before them; the place of the pair that ends at each character; and each text's
    number of characters. The n-gram that ends at a character is the pair there and the one two places before."""
    pad = "\x00" * (ORDER - 1)
    joined = pad.join(["", *texts]) if texts else ""
    sym = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sym = np.where(sym < 128, _KINDS[sym & 127], sym)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    border = np.concatenate([[0], np.cumsum(lengths + len(pad))[:-1]]) if texts else np.zeros(0, dtype=np.int64)
    inside = np.ones(len(sym), dtype=bool)
    for k in range(len(pad)):
        sym[border + k] = EDGE
        inside[border + k] = False
    return (sym[:-1] << WIDTH) | sym[1:], np.flatnonzero(inside) - 1, lengths


def _places(x: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of x, which are under bound, and the place of each one among them."""
    if bound > 1 << 24:
        return np.unique(x, return_inverse=True)
    seen = np.bincount(x, minlength=bound) > 0
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts as their two pairs, and how often each stands there."""
    pair, at, _ = _pairs(texts)
    chars, place = _places(np.concatenate([pair[:1] >> WIDTH, pair & _LAST]), EDGE + 1)
    codes, place = _places(place[:-1] * len(chars) + place[1:], len(chars) ** 2)
    pairs = (chars[codes // len(chars)] << WIDTH) | chars[codes % len(chars)]
    key, n = np.unique(place[at - 2] * len(pairs) + place[at], return_counts=True)
    return pairs[key // len(pairs)], pairs[key % len(pairs)], n.astype(np.int64)


def _count_ngrams(batches):
    held: dict[str, list[str]] = {}
    chars: dict[str, int] = {}

    def flush(lang):
        hi, lo, n = _grams(held.pop(lang))
        chars.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(hi), pa.array(lo), pa.array(n)], names=["l", "a", "lo", "n"])

    for b in batches:
        for lang, text in zip(b.column("l").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text)
                chars[lang] = chars.get(lang, 0) + len(text)
                if chars[lang] >= FLUSH_CHARS:
                    yield flush(lang)
        while sum(chars.values()) >= 2 * FLUSH_CHARS:
            yield flush(max(chars, key=chars.get))
    for lang in list(held):
        yield flush(lang)


def _lang(lang_col: str):
    """A language by name, '' for none, so that it can be a key."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("l")


def ngram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(l, a, lo, n): all n-grams of all texts, a and lo their two pairs of characters; counted in each task first, so a hot language is no hot key."""
    rows = docs.select(_lang(lang_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count_ngrams, "l string, a long, lo long, n long").groupBy("l", "a", "lo").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(l, a, lo, p): the probability of each n-gram's last character after the others, from what ngram_counts gives.

    Lower orders count distinct left neighbours. The three discounts of an order follow from its counts of counts
    (0.5, 1 and 1.5 where those are too few to tell). Order 1 mixes with the uniform distribution over the language's characters. Of each order, lo is the last two characters (of
    order 1 the last) and a what stands before them, so (a, lo >> WIDTH) is the context. No key has more rows than a language has characters.
    """
    grams = {ORDER: settle(counts, "grams")}
    # An n-gram without its first character: what is left of a, and of lo.
    rest = {4: (F.col("a").bitwiseAND(_LAST), F.col("lo")), 3: (F.lit(0).cast("long"), F.col("lo")), 2: (F.lit(0).cast("long"), F.col("lo").bitwiseAND(_LAST))}
    for k in range(ORDER - 1, 0, -1):
        grams[k] = settle(grams[k + 1].groupBy("l", rest[k + 1][0].alias("a"), rest[k + 1][1].alias("lo")).agg(F.count("*").alias("n")), "grams")
    below = None
    for k in range(1, ORDER + 1):
        one, two, three, four = (F.sum((F.col("n") == c).cast("long")).cast("double") for c in (1, 2, 3, 4))
        seen = grams[k].groupBy("l").agg(one.alias("s1"), two.alias("s2"), three.alias("s3"), four.alias("s4"), F.count("*").alias("kinds"))
        y = F.col("s1") / (F.col("s1") + 2 * F.col("s2"))
        told = F.least("s1", "s2", "s3") > 0
        off = [(1 - 2 * y * F.col("s2") / F.col("s1"), 0.95, 0.5), (2 - 3 * y * F.col("s3") / F.col("s2"), 1.9, 1.0), (3 - 4 * y * F.col("s4") / F.col("s3"), 2.9, 1.5)]
        seen = seen.select("l", "kinds", *[F.when(told, F.least(F.greatest(d, F.lit(0.05)), F.lit(most))).otherwise(F.lit(few)).alias(f"d{c}") for c, (d, most, few) in enumerate(off, 1)])
        context = W.partitionBy("l", "a", F.shiftright("lo", WIDTH))
        times = [F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long")), F.sum((F.col("n") > 2).cast("long"))]
        t = grams[k].select("*", F.sum("n").over(context).alias("total"), *[x.over(context).alias(f"t{c}") for c, x in enumerate(times, 1)]).join(seen, "l")
        gamma = (F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")) / F.col("total")
        mine = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        if below is None:
            t = t.withColumn("under", 1 / F.col("kinds"))
        else:
            t = t.withColumns({"ra": rest[k][0], "rlo": rest[k][1]}).join(below.select("l", F.col("a").alias("ra"), F.col("lo").alias("rlo"), F.col("p").alias("under")), ["l", "ra", "rlo"])
        below = t.select("l", "a", "lo", ((F.col("n") - mine) / F.col("total") + gamma * F.col("under")).alias("p"))
    return below


def _packed(pdf):
    """The n-grams of one part of a model in sorted arrays: the pairs of characters, the n-grams as two places among these, their log-probabilities."""
    import pandas as pd

    hi, lo = pdf["a"].to_numpy(), pdf["lo"].to_numpy()
    pairs = np.unique(np.concatenate([hi, lo]))
    keys = np.searchsorted(pairs, hi) * len(pairs) + np.searchsorted(pairs, lo)
    order = np.argsort(keys)
    logp = np.log(pdf["p"].to_numpy()[order]).astype(np.float32)
    arrays = [pairs.tobytes(), keys[order].tobytes(), logp.tobytes()]
    return pd.DataFrame([{"l": pdf["l"].iloc[0], "part": pdf["part"].iloc[0], "size": sum(map(len, arrays)), "pairs": arrays[0], "grams": arrays[1], "logp": arrays[2]}])


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The models of the languages with text, a row for each part: l, part, size (bytes), pairs, grams, logp (arrays as bytes)."""
    p = settle(probabilities(ngram_counts(docs, lang_col, text_col)), "probabilities")
    parts = p.groupBy("l").agg(F.ceil(F.count("*") / PART_GRAMS).alias("parts"))
    dealt = p.join(parts, "l").select("l", F.pmod(F.xxhash64("a", "lo"), F.col("parts")).cast("int").alias("part"), "a", "lo", "p")
    return dealt.groupBy("l", "part").applyInPandas(_packed, "l string, part int, size long, pairs binary, grams binary, logp binary")


def _load(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.pairs, np.int64), np.frombuffer(row.grams, np.int64), np.frombuffer(row.logp, np.float32)


def _look_up(part, pair: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-probability at each place that a part of a model has, else 0, and whether it has it."""
    pairs, grams, logp = part
    place = np.searchsorted(pairs, pair).clip(max=len(pairs) - 1)
    known = pairs[place] == pair
    key = place[at - 2] * len(pairs) + place[at]
    k = np.searchsorted(grams, key).clip(max=len(grams) - 1)
    hit = known[at - 2] & known[at] & (grams[k] == key)
    return np.where(hit, logp[k], np.float32(0)).astype(np.float64), hit


# ---------------------------------------------------------------- the same in plain arrays, for texts of few characters: what the joins are held against

BITS = 6
SYMBOLS = 1 << BITS


def symbol_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram key that ends at each character of texts of fewer than SYMBOLS characters, which are numbered from 1 in order, 0 before a text; and each text's length."""
    pair, at, lengths = _pairs(texts)
    chars = np.unique((pair & _LAST)[at])
    if len(chars) >= SYMBOLS:
        raise ValueError("too many characters")
    number = lambda c: np.where(c == EDGE, 0, np.searchsorted(chars, c) + 1)
    both = (number(pair >> WIDTH) << BITS) | number(pair & _LAST)
    return ((both[at - 2] << 2 * BITS) | both[at]).astype(np.int32), lengths


def kneser_ney(keys: np.ndarray, counts: np.ndarray, others: int = SYMBOLS - 1) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the counts of the highest order, for each order from 1: sorted keys and their log-probabilities, sorted contexts
    and their log backoff weights (of order 1 the empty context alone).

    Lower orders count distinct left neighbours. The three discounts of an order follow from its counts of counts
    (0.5, 1 and 1.5 where those are too few to tell). Order 1 mixes with the uniform distribution over so many others.
    """
    order = np.argsort(keys)
    grams = {ORDER: (keys[order].astype(np.int64), counts[order].astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):
        key, n = np.unique(grams[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
        grams[k] = (key, n.astype(np.float64))
    out: list = []
    below = None
    for k in range(1, ORDER + 1):
        key, n = grams[k]
        n1, n2, n3, n4 = (float((n == c).sum()) for c in (1, 2, 3, 4))
        if min(n1, n2, n3) > 0:
            y = n1 / (n1 + 2 * n2)
            d = np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.9, 2.9])
        else:
            d = np.array([0.5, 1.0, 1.5])
        off = np.minimum(d[np.minimum(n, 3).astype(int) - 1], n)
        contexts, which = np.unique(key >> BITS, return_inverse=True)
        total, lost = np.bincount(which, n), np.bincount(which, off)
        gamma = lost / total
        if below is None:
            p = (n - off) / total[which] + gamma[which] / others
        else:
            suffix = key & ((1 << BITS * (k - 1)) - 1)
            p = (n - off) / total[which] + gamma[which] * below[1][np.searchsorted(below[0], suffix)]
        below = (key, p)
        out.append((key.astype(np.int32), np.log(p).astype(np.float32), contexts.astype(np.int32), np.log(gamma).astype(np.float32)))
    return out


def log_probabilities(model, keys: np.ndarray) -> np.ndarray:
    """Natural log-probability of each n-gram's last symbol after the others."""
    out = np.zeros(len(keys))
    todo, carried = np.arange(len(keys)), np.zeros(len(keys))
    for k in range(ORDER, 0, -1):
        key, logp, ctx, back = model[k - 1]
        want = keys[todo] & ((1 << BITS * k) - 1)
        at = np.searchsorted(key, want).clip(0, len(key) - 1)
        hit = key[at] == want
        out[todo[hit]] = carried[hit] + logp[at[hit]]
        todo, carried, want = todo[~hit], carried[~hit], want[~hit]
        if not len(todo):
            return out
        at = np.searchsorted(ctx, want >> BITS).clip(0, len(ctx) - 1)
        carried = carried + np.where(ctx[at] == want >> BITS, back[at], 0.0)
    out[todo] = carried - np.log(SYMBOLS - 1)
    return out


# ---------------------------------------------------------------- counts of a text


def text_counts(raw: bytes, text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    n = len(words)
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    blanks = sum(raw.count(bytes([c])) for c in SPACE)
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    repeat = 0
    if n > 5:
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).astype(np.uint64)
        w = h[: n - 4].copy()
        for k in range(1, 5):
            w = w * np.uint64(0x9E3779B97F4A7C15) + (h[k : n - 4 + k] ^ (w >> np.uint64(29)))
        s = np.sort(w)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            marks = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(np.isin(w, twice))
            np.add.at(marks, at, 1)
            np.add.at(marks, at + 5, -1)
            repeat = int((np.cumsum(marks)[:n] > 0).sum())
    return n, len(text) - blanks, symbols, dup, repeat


def _scored(models, counted):
    def run(batches):
        names = ["_id", "_th", "l", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "total", "found"]
        for b in batches:
            langs, texts = b.column("l").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            first = np.array([counted is None or x in counted for x in langs], dtype=bool)
            counts = np.array([text_counts(t.encode("utf-8", "surrogatepass"), t) if f else (0,) * 5 for t, f in zip(texts, first, strict=True)], dtype=np.int64).reshape(-1, 5)
            total, found, chars = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)
            by: dict[str, list[int]] = {}
            for k, lang in enumerate(langs):
                if texts[k] and lang in models.value:
                    by.setdefault(lang, []).append(k)
            for lang, rows in by.items():
                for group in _parts(rows, chars):
                    pair, at, lengths = _pairs([texts[k] for k in group])
                    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                    for part in models.value[lang]:
                        logp, hit = _look_up(part, pair, at)
                        total[group] += np.add.reduceat(logp, start)
                        found[group] += np.add.reduceat(hit.astype(np.int64), start)
            count = [pa.array(counts[:, k], mask=~first) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), b.column("l"), b.column("lang"), *count, pa.array(chars), pa.array(total), pa.array(found)], names=names)

    return run


def _parts(rows: list[int], chars: np.ndarray, most: int = 2_000_000):
    part, total = [], 0
    for k in rows:
        part.append(k)
        total += chars[k]
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def score(docs: DataFrame, models: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: _id, _th, lang, the counts, n_chars, logp (mean over the characters; null without text). models: of these very documents;
    an n-gram that was not counted would get one of all code points alike."""
    spark = docs.sparkSession
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = "_id long, _th long, l string, lang string, " + ", ".join(f"{c} long" for c in counts) + ", n_chars long, total double, found long"
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), _lang(lang_col), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    passes: list[list] = [[]]
    room = MODEL_BYTES
    for r in models.select("l", "part", "size").orderBy("l", "part").toLocalIterator():  # a name and two numbers for each part
        if r.size > room and passes[-1]:
            passes.append([])
            room = MODEL_BYTES
        passes[-1].append((r.l, r.part))
        room -= r.size
    langs = [{x for x, _ in p} for p in passes]
    out = None
    for k, parts in enumerate(passes):
        held: dict[str, list] = {}
        mine = models if len(passes) == 1 else models.where(F.concat_ws(":", "part", "l").isin([f"{n}:{x}" for x, n in parts]))
        for r in mine.orderBy("l", "part").collect():
            held.setdefault(r.l, []).append(_load(r))
        shared = spark.sparkContext.broadcast(held)
        if len(passes) == 1:
            part, counted = rows, None
        elif k:
            part, counted = rows.where(F.col("l").isin(list(langs[k]))), langs[k] - langs[k - 1]
        else:  # the first pass also takes what has no model
            part, counted = rows.where(~F.col("l").isin(list(set().union(*langs[1:]) - langs[0]))), None
        part = part.mapInArrow(_scored(shared, counted), schema).withColumn("_pass", F.lit(k))
        out = part if out is None else out.unionByName(part)
    several = [x for x in set().union(*langs) if sum(x in p for p in langs) > 1]
    if several:  # a document's sum comes from several passes, added up in their order; equal rows have equal sums
        many = out.where(F.col("l").isin(several)).groupBy("_id", "_th", "l", "lang", "n_chars", "_pass").agg(*[F.max(c).alias(c) for c in (*counts, "total", "found")], F.count("*").alias("_rows"))
        many = many.groupBy("_id", "_th", "l", "lang", "n_chars").agg(*[F.max(c).alias(c) for c in counts], F.sort_array(F.collect_list(F.struct("_pass", "total"))).alias("_t"), F.sum("found").alias("found"), F.max("_rows").alias("_rows"))
        many = many.withColumn("total", F.aggregate("_t", F.lit(0.0), lambda a, x: a + x["total"])).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
        out = out.where(~F.col("l").isin(several)).select("_id", "_th", "lang", *counts, "n_chars", "total", "found").unionByName(many.select("_id", "_th", "lang", *counts, "n_chars", "total", "found"))
    logp = (F.col("total") - (F.col("n_chars") - F.col("found")) * float(np.log(EDGE))) / F.col("n_chars")
    return out.select("_id", "_th", "lang", *counts, "n_chars", F.when(F.col("n_chars") > 0, logp).alias("logp"))


def bands(scored: DataFrame) -> DataFrame:
    """For each language the middle and the spread (1.4826 times the median deviation, by approximate percentiles,
    whose state is bounded) of logp over its documents of SHORT characters or more, or of all where there are none."""
    some = scored.where("logp is not null").select("lang", "logp", (F.col("n_chars") >= SHORT).alias("long"))
    mid = some.groupBy("lang").agg(F.percentile_approx(F.when(F.col("long"), F.col("logp")), 0.5, 10_000).alias("m1"), F.percentile_approx("logp", 0.5, 10_000).alias("m2"), F.max("long").alias("any_long"))
    mid = mid.select(F.col("lang").alias("_l"), F.coalesce("m1", "m2").alias("middle"), "any_long")
    far = some.join(mid, some["lang"].eqNullSafe(mid["_l"])).where("long or not any_long")
    return far.groupBy("_l").agg(F.first("middle").alias("middle"), F.greatest(1.4826 * F.percentile_approx(F.abs(F.col("logp") - F.col("middle")), 0.5, 10_000), F.lit(0.005)).alias("spread"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: float = LOWER, upper: float = UPPER, text_hash: bool = False) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity.

    A text with fewer than MIN_WORDS words, or with more than MAX_REPEAT_PERCENT of its words in repeated windows of
    five, fails; others are kept when their log-probability is inside the band. The band is wider by sqrt(1 + SHORT /
    characters), as a short text's mean varies more. Null texts count as empty, a null language is one of its own.
    Repeated rows are judged alike, a document on the band's edge is kept, very long texts are read whole, other columns of any
    name are ignored, and an empty table gives an empty result.
    """
    models = settle(train(docs, lang_col, text_col), "models")
    scored = settle(score(docs, models, id_col, text_col, lang_col), "scores")
    limits = settle(bands(scored), "bands")
    if limits.count() <= 10_000:
        limits = F.broadcast(limits)
    out = scored.join(limits, scored["lang"].eqNullSafe(limits["_l"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    off = (F.col("logp") - F.col("middle")) / (F.col("spread") * F.sqrt(1 + SHORT / F.greatest(F.col("n_chars"), F.lit(1))))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(off.between(-lower, upper), F.lit(True))).alias("kept"), F.exp(-F.col("logp")).alias("perplexity"), off.alias("off"), *(["_th", F.col("lang").alias("_lang")] if text_hash else []))


def drop_bad(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names; nulls, ties, repeats, long texts and empty tables as in judge."""
    verdicts = judge(docs, id_col, text_col, lang_col, text_hash=True).select(id_col, "kept", "_th", "_lang")
    return keep_rows(docs, verdicts.withColumn("_th", F.xxhash64("_th", "_lang")), id_col, text_col, lang_col)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("off")


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
