"""Spelling variants: words that differ by one edit, found by edit rows along a sorted vocabulary.

Two words of `least` and perhaps one more code points whose first difference is at place p share all before p and all after it.
So words are dealt by keys: a window [from, to) of places, with the code points before it and those behind it. A word
has four windows for its own length and four for the length below; a pair is counted in the window that holds its first
difference, once. A group of more than GROUP_WORDS words is dealt anew by the halves of its window, until the window is one place
wide, where the alphabet bounds the group. No group therefore grows with the input.

Inside a group the sorted words are scanned with edit rows of three cells (the band of one edit). A row belongs to a
prefix and serves all words that share it, as the longest common prefixes of neighbours say; what no row under
two is left for is skipped with all words below it. All pairs of a query and a prefix of one length are a step of array arithmetic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, table

LEAST_CHARS = 7
LEAST_OCCURRENCES = 2
#: A form occurs so many times as often as its variant at least.
RATIO = 10
DAMAGE = 31
GROUP_WORDS = 512
#: Words of sorted groups that are scanned together, at most one group more.
SCAN_WORDS = 30_000
#: (query, prefix) pairs of one step, about.
STEP_PAIRS = 1 << 21
COUNTED = 400_000

#: By Latin-1 byte: A-Z lowered, letters kept, all else a space.
_LETTERS = bytes(k | 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 0xC0 else 32 for k in range(256))


#: Runs of letters that are long enough to be words.
_WORDS = re.compile(b"[^ ]{%d,}" % LEAST_CHARS).findall


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts, counted before they are sent. A run loses a code point where its checksum with the document's id says so."""

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    counts: dict[bytes, int] = {}
    for b in batches:
        for doc, text in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
            seed = crc32(f"{'' if doc is None else doc}:".encode())
            for w, n in Counter(_WORDS((text or "").encode("latin-1", "replace").translate(_LETTERS))).items():
                h = crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                if not h % DAMAGE:
                    w = w[: (k := h % len(w))] + w[k + 1 :]
                    if len(w) < LEAST_CHARS:
                        continue
                counts[w] = counts.get(w, 0) + n
            if len(counts) >= COUNTED:
                yield flush()
    if counts:
        yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_CHARS code points or more that occur LEAST_OCCURRENCES times or more in all texts."""
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return inner.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_OCCURRENCES)


def _windows(words: DataFrame) -> DataFrame:
    """(word, n, least, from, to): four windows of places for each length of the shorter word of a pair."""
    size = F.length("word")
    out = words.withColumn("least", F.explode(F.array_distinct(F.array(size, F.greatest(size - 1, F.lit(LEAST_CHARS))))))
    cut = lambda k: F.floor((F.col("least") + 1) * k / 4).cast("int")
    return out.withColumn("_w", F.explode(F.array(*[F.struct(cut(k).alias("from"), cut(k + 1).alias("to")) for k in range(4)]))).select("word", "n", "least", "_w.from", "_w.to")


def _behind() -> Column:
    """Code points that all words of a group share behind its window."""
    return F.greatest(F.col("least") - F.col("to"), F.lit(0))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of window and code points before and behind it. Two groups may share a key; they are told apart when scanned."""
    return rows.withColumn("_key", F.xxhash64("least", "from", "to", F.substring("word", F.lit(1), F.col("from")), F.right("word", _behind())))


def _dealt(words: DataFrame, group_words: int) -> DataFrame:
    """Rows of _keyed in groups of at most group_words, or a hundred-thousandth of all rows, or what a window of one place can hold."""
    level = _keyed(_windows(words))
    limit = max(group_words, words.count() * 8 // 100_000)
    done = None
    while True:
        sizes = level.where(F.col("to") - F.col("from") > 1).groupBy("_key").count()
        large = settle(sizes.where(F.col("count") > limit).select("_key"), "spelling-large")
        if large.isEmpty():
            return level if done is None else done.unionByName(level)
        # A level has twice the rows of the one before at most, so these keys are a few hundred thousand at most.
        keep = level.join(F.broadcast(large), "_key", "left_anti")
        done = keep if done is None else done.unionByName(keep)
        mid = F.floor((F.col("from") + F.col("to")) / 2).cast("int")
        halves = F.array(F.struct(F.col("from"), mid.alias("to")), F.struct(mid.alias("from"), F.col("to")))
        level = _keyed(level.join(F.broadcast(large), "_key", "left_semi").withColumn("_w", F.explode(halves)).select("word", "n", "least", "_w.from", "_w.to"))


class _Texts:
    """Byte strings in one array."""

    def __init__(self, texts: list[bytes]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first bytes the texts a and b share, pair by pair."""
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        least = np.minimum(self.size[a], self.size[b])
        while len(open_):
            open_ = open_[out[open_] < least[open_]]
            k = out[open_]
            open_ = open_[self.flat[self.start[a[open_]] + k] == self.flat[self.start[b[open_]] + k]]
            out[open_] += 1
        return out


def scan(texts: _Texts, same: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) pairs one edit apart, both ways round, of texts that are sorted and distinct in each group.

    same: true where a text is of its predecessor's group; shared: so many first bytes are equal in that group, at most. All
    (query, prefix) pairs of one prefix length are a step: a row of three edit cells each, for the first places - 1, places and places + 1 of the query.
    """
    n = len(same)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(same)
    lcp[at] = texts.common(at, at - 1)
    same = same & (lcp >= shared)  # a new group where two had one key
    lcp[~same] = -1
    first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    count = np.bincount(first, minlength=n)
    queries = np.flatnonzero(count[first] > 1)
    for part in np.array_split(queries, 1 + int(count[first[queries]].sum()) // STEP_PAIRS):
        yield from _scanned(part, first, count, lcp, texts, shared)


def _scanned(queries: np.ndarray, first: np.ndarray, count: np.ndarray, lcp: np.ndarray, texts: _Texts, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    by_depth = queries[np.argsort(shared[queries], kind="stable")]
    depth, waiting = int(shared[by_depth[0]]) if len(by_depth) else 0, 0
    q, lo, hi = (np.zeros(0, np.int64) for _ in range(3))
    a, b, c = (np.zeros(0, np.int8) for _ in range(3))
    while len(q) or waiting < len(by_depth):
        if not len(q):
            depth = int(shared[by_depth[waiting]])
        until = waiting + int(np.searchsorted(shared[by_depth[waiting:]], depth, "right"))
        if until > waiting:  # queries whose groups share so much start here
            new, waiting = by_depth[waiting:until], until
            own = np.zeros(len(new), np.int8)
            q, lo, hi = (np.concatenate(x) for x in ((q, new), (lo, first[new]), (hi, first[new] + count[first[new]])))
            a, b, c = (np.concatenate(x) for x in ((a, own + (1 if depth else 2)), (b, own), (c, np.where(texts.size[new] > depth, 1, 2).astype(np.int8))))
        gap = texts.size[q] - depth
        ends = texts.size[lo] == depth  # a text that ends here stands first
        cost = np.where(gap == 0, b, np.where(gap == 1, c, np.where(gap == -1, a, 2)))
        hit = ends & (cost == 1)
        if hit.any():
            yield q[hit], lo[hit]
        lo = lo + ends
        # Runs of the next byte start where a text shares no more with its neighbour than the prefix.
        starts = np.flatnonzero((lcp <= depth) & (texts.size > depth))
        begin, end = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        runs = end - begin
        item = np.repeat(np.arange(len(q)), runs)
        ends_at = np.cumsum(runs)
        run = np.repeat(begin, runs) + np.arange(len(item)) - np.repeat(ends_at - runs, runs)
        final = np.zeros(len(item), bool)
        final[ends_at[runs > 0] - 1] = True
        low = starts[run]
        high = np.where(final, hi[item], starts[np.minimum(run + 1, len(starts) - 1)] if len(starts) else 0)
        q, a, b, c = q[item], a[item], b[item], c[item]
        code, left, place = texts.flat[texts.start[low] + depth], texts.size[q] - depth, texts.start[q] + depth
        last = len(texts.flat) - 1
        x = np.minimum(b + 1, a + (texts.flat[place - 1] != code)) if depth else b + 1
        y = np.where(left >= 1, np.minimum(np.minimum(b + (texts.flat[np.minimum(place, last)] != code), c + 1), x + 1), 2)
        z = np.where(left >= 2, np.minimum(c + (texts.flat[np.minimum(place + 1, last)] != code), y + 1), 2)
        live = np.minimum(np.minimum(x, y), z) < 2
        q, lo, hi = q[live], low[live], high[live]
        a, b, c = (np.minimum(v[live], 2).astype(np.int8) for v in (x, y, z))
        depth += 1


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted groups in, (word, n_near, best, form) out: of each word the near words of its window and the most frequent of them."""
    names = ["_key", "least", "from", "to", "shared", "back", "word", "n"]

    def found(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("_key").to_numpy()
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rows = rows.filter(pa.array(~(first & np.concatenate((first[1:], [True])))))  # without words that meet none
        key, least, lo, hi, shared, n = (rows.column(c).to_numpy() for c in ("_key", "least", "from", "to", "shared", "n"))
        words = " ".join(rows.column("word").to_pylist()).encode("latin-1").split()
        plain = _Texts(words)
        turned = _Texts([w[::-1] if back else w for w, back in zip(words, rows.column("back").to_pylist(), strict=True)])
        same = np.concatenate((np.zeros(min(1, len(words)), bool), np.logical_and.reduce([x[1:] == x[:-1] for x in (key, least, lo, hi)])))
        pairs = list(scan(turned, same, shared.astype(np.int64)))
        q, w = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        place = plain.common(q, w)
        fits = (place >= lo[q]) & (place < hi[q]) & (np.minimum(plain.size[q], plain.size[w]) == least[q])
        q, w = q[fits], w[fits]
        near = np.bincount(q, minlength=len(words))
        # Of a word's near words the most frequent, of equally frequent ones the first in the order of code points.
        rank = pc.rank(rows.column("word"), tiebreaker="dense").to_numpy() if len(words) else n
        order = np.lexsort((rank[w], -n[w], q))
        q, w = q[order], w[order]
        best = w[np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1]))]
        k, word = np.flatnonzero(near), rows.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(k)), pa.array(near[k], pa.int64()), pa.array(n[best], pa.int64()), word.take(pa.array(best))], names=["word", "n_near", "best", "form"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < SCAN_WORDS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column("_key").to_numpy()
        whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if whole:
            yield found(rows.slice(0, whole))
        held = rows.slice(whole).to_batches()
    if held:
        yield found(pa.Table.from_batches(held).select(names).combine_chunks())


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, n_near, best, form) of (word, n), distinct words of Latin-1 letters: how many words are one edit away and, if any, the most frequent of them, by code points if several are.

    Words shorter than LEAST_CHARS may not be among them. Words of any length are compared whole.
    """
    rows = _dealt(words, group_words)
    behind = _behind()
    back = behind > F.col("from")
    rows = rows.select("_key", "least", "from", "to", F.when(back, behind).otherwise(F.col("from")).alias("shared"), back.alias("back"), "word", "n")
    # Groups are bounded, so keys may be dealt by hash; one word alone has none to meet.
    rows = rows.repartition("_key").sortWithinPartitions("_key", "least", "from", "to", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    near = rows.mapInArrow(_near, "word string, n_near long, best long, form string")
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,form:string>").alias("_b"))
    both = both.unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best")).alias("less"), "form").alias("_b")))
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("_b").alias("_b"))
    return out.select("word", "n", "n_near", (-F.col("_b.less")).alias("best"), F.col("_b.form").alias("form"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root to (word, form, ...): the last of a word's forms, the word itself if it has none. A form's n is a multiple of its word's, so no chain is longer than the digits of the largest n."""
    linked = forms.where("form is not null")
    step = linked.select(F.col("word").alias("root"), F.col("form").alias("_next"))
    chains = linked.select("word", F.col("form").alias("root"))
    while True:
        further = settle(chains.join(step, "root", "left"), "spelling-chain")
        chains = further.select("word", F.coalesce("_next", "root").alias("root"))
        if further.where("_next is not null").isEmpty():
            break
    return forms.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """A row per word of the vocabulary: word, form, root, n, n_near, form_n.

    A null text has no words; a null id is read as an empty one where the words' damage is drawn. Rows that repeat are counted each. Words and texts
    of any length count whole, other columns may have any name, and an empty table gives an empty result.
    """
    words = settle(vocabulary(docs, id_col, text_col), "spelling-words")
    fits = F.col("best") >= ratio * F.col("n")
    near = near_words(words, group_words).select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("best")).alias("form_n"))
    forms = settle(near, "spelling-forms")
    discard(words)
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL: dict[str, str] = {}
