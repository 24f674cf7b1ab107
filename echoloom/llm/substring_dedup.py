"""Repeated passages by content-defined chunking.

A gear rolling hash over the last WINDOW bytes decides where chunks end, so an insertion moves only the
chunks around it. Chunks are deduplicated by digest over all documents: they are range-partitioned and sorted by
digest and document, so a digest of any size is streamed past its first occurrence, over several partitions if need be. Where chunks
that follow each other stand first in different documents, runs of them (lengths from RUNS on, growing) get digests too
and are deduplicated in the same way, so that a passage made of frequent pieces is laid beside a document that has it in one.

Chunks leave out the ends of a passage, so each stretch of chunks with one offset to their first occurrence is laid beside it with REACH
bytes more on either side; where the bytes are equal up to the edge, it is taken up again with more, until they differ. The bytes that
are equal make the spans, cut to whole characters; those of MIN_WORDS words are reported. Where
the hash allows no end for long, as in runs of a few words, chunks end at its local minima, and a run of equal
chunks is one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SPACE, discard, hot_keys, mix, settle, span_hashes, spread_join, table, text_hash, word_spans

WINDOW = 16
#: A chunk ends where MASK_BITS bits of the rolling hash are zero, not before MIN_CHUNK bytes and at MAX_CHUNK at the latest.
MASK_BITS = 5
MIN_CHUNK = 16
MAX_CHUNK = 160
#: Between ends further apart than that, a chunk may also end where the hash is the least of so many bytes to either side.
RADIUS = 24
#: Whole words in a span that is reported.
MIN_WORDS = 50
#: Bytes beyond the common chunks that are compared at first, more than a chunk has.
REACH = 192
#: Least bytes of the runs of chunks that get a digest; longer ones double.
RUNS = (96, 144, 216, 324, 486)
#: Stands for a null identifier: one document, after all others.
NULL_ID = 2**63 - 1
BATCH_BYTES = 2_000_000

_GEAR = np.random.default_rng(4242).integers(0, 2**32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at each byte, shifted left by one bit a byte."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # the hash of 2 x step bytes from those of step bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def candidate_ends(h: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash allows a chunk to end."""
    return np.flatnonzero((h >> np.uint32(WINDOW - MASK_BITS)) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1


def weak_ends(h: np.ndarray, start: int, end: int) -> list[int]:
    """Ends inside a stretch without candidates: where the hash is the least within RADIUS bytes, RADIUS bytes apart or more.

    A run that repeats a few words has such places at the same spots of its period, wherever it stands.
    """
    base = start + WINDOW  # hashes before may take in bytes of another text
    low = h[base:end]
    if len(low) < 2 * RADIUS + 1:
        return []
    step = 1
    while 2 * step <= 2 * RADIUS + 1:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = 2 * RADIUS + 1 - step
    low = np.minimum(low[:-rest], low[rest:])
    out, last = [], start
    for c in (np.flatnonzero(h[base + RADIUS : end - RADIUS] == low) + base + RADIUS + 1).tolist():
        if c - last >= RADIUS:
            out.append(c)
            last = c
    return out


def chunk_ends(data: np.ndarray, limits: list[int]) -> list[int]:
    """Ends of the chunks of several texts that stand one after the other; limits: their ends.

    The rolling hash is that of a text alone from WINDOW bytes after its start; before, no chunk ends, as MIN_CHUNK >= WINDOW.
    """
    h = rolling_hash(data)
    ends: list[int] = []
    found = candidate_ends(h).tolist()
    at, n, start = 0, len(found), 0

    def close(last: int, end: int) -> None:
        """Ends from last to end, which is one; none is more than MAX_CHUNK after another."""
        for c in (*(weak_ends(h, last, end) if end - last > MAX_CHUNK else ()), end):
            while c - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if c > last:
                ends.append(c)
                last = c

    for limit in limits:
        last = start
        while at < n and found[at] <= limit:
            c = found[at]
            at += 1
            if c - last >= MIN_CHUNK and c > start:
                close(last, c)
                last = c
        close(last, limit)
        start = limit
    return ends


def _chunks(batches):
    names = ["key", "_id", "_row", "start", "size"]
    for b in batches:
        ids, rows = b.column("_id").to_numpy(), b.column("_row").to_numpy()
        texts = [t or b"" for t in b.column("_text").to_pylist()]
        k = 0
        while k < len(texts):
            first, size = k, 0
            while k < len(texts) and (k == first or size < BATCH_BYTES):
                size += len(texts[k])
                k += 1
            data = np.frombuffer(b"".join(texts[first:k]), dtype=np.uint8)
            if not len(data):
                continue
            limits = np.cumsum([len(t) for t in texts[first:k]])
            ends = np.array(chunk_ends(data, limits.tolist()), dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            owner = np.searchsorted(limits, starts, side="right")
            begin = limits - np.array([len(t) for t in texts[first:k]])
            digests = span_hashes(data, starts, ends).view(np.int64)
            # Equal chunks that follow each other in a text are one row of their whole size.
            new = np.ones(len(ends), dtype=bool)
            new[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(ends)) - 1
            mine = owner[head]
            cols = [digests[head], ids[first:k][mine], rows[first:k][mine], (starts[head] - begin[mine]).astype(np.int32), (ends[tail] - starts[head]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), text_hash(text_col).alias("_row"), F.col(f"`{text_col}`").cast("binary").alias("_text"))


_PLACE = ("key", "_id", "_row", "start", "size")
_HELD = "kind int, key long, _id long, _row long, start int, size int, a_id long, a_row long, a_start int"
_HELD_NAMES = ["kind", *_PLACE, "a_id", "a_row", "a_start"]


def _holders(batches):
    """Of a partition sorted by key and place: the places of each key that two documents hold, with the key's first place (kind 0).

    What is not settled here, as the key may go on in another partition, is kind 1; kind 2 are the partition's first and last key with their
    first place, and the last document that holds them as _id.
    """
    edge = None  # the partition's first key
    state = None  # a key that goes on: its first place, and whether two documents are known to hold it
    held = None
    last_id = None

    def out(cols, kind, first):
        n = len(cols[0])
        whole = [np.full(n, kind, np.int32) if np.isscalar(kind) else kind, *cols, *first]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, types, strict=True)], names=_HELD_NAMES)

    def marker(key, first, top):
        return out([np.array([v]) for v in (key, top, 0, 0, 0)], 2, [np.array([v]) for v in first])

    def settled(cols, end: bool):
        """Rows of whole groups, and of the last one if it is known to be shared or at the end; the others are held."""
        nonlocal edge, state, held, last_id
        key, ids = cols[0], cols[1]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tail = np.append(head[1:], len(key)) - 1
        firsts = [c[head].copy() for c in cols[1:4]]
        shared = ids[head] != ids[tail]
        if state is not None and state[0] == key[0]:
            for c, v in zip(firsts, state[1], strict=True):
                c[0] = v
            shared[0] = state[2] or ids[tail[0]] != state[1][0]
        if edge is None:
            edge = [key[0], tuple(int(c[0]) for c in firsts), int(ids[tail[0]])]
        elif edge[0] == key[0]:
            edge[2] = int(ids[tail[0]])
        go = np.ones(len(head), dtype=bool)
        first_key = key[head] == edge[0]
        state = (key[-1], tuple(int(c[-1]) for c in firsts), bool(shared[-1]))
        last_id = int(ids[-1])
        kind = np.where(first_key, 1, 0)
        if end:
            if not shared[-1]:
                kind[-1] = 1
        elif not (shared[-1] or first_key[-1]):
            go[-1] = False
        keep = go & (shared | (kind == 1))
        held = None if go[-1] else [c[head[-1] :] for c in cols]
        take = np.repeat(keep, tail - head + 1)
        if take.any():
            group = np.repeat(np.arange(len(head)), tail - head + 1)[take]
            yield out([c[take] for c in cols], kind[group].astype(np.int32), [c[group] for c in firsts])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in _PLACE]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            state = None if state is not None and state[0] == cols[0][0] else state
        yield from settled(cols, False)
    if held is not None:
        state = None
        yield from settled(held, True)
    if edge is not None:
        yield marker(*edge)
        if state[0] != edge[0]:
            yield marker(state[0], state[1], last_id)


def _shared_places(places: DataFrame, name: str) -> DataFrame:
    """(key, place, a_id, a_row, a_start) of the keys in places (settled, not read again) that two documents hold, with the first place of each; and what was settled for it."""
    order = places.repartitionByRange("key", "_id", "_row", "start").sortWithinPartitions("key", "_id", "_row", "start").select(*_PLACE)
    found = settle(order.mapInArrow(_holders, _HELD), name)
    discard(places)
    ends = found.where("kind = 2").groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("a_id", "a_row", "a_start")).alias("_first"), F.max("_id").alias("_last")).where("_first.a_id < _last")
    # Two rows a partition.
    open_ = found.where("kind = 1").join(F.broadcast(ends), F.col("key") == F.col("_key"))
    open_ = open_.select(*_PLACE, "_first.a_id", "_first.a_row", "_first.a_start")
    return found.where("kind = 0").select(*_PLACE, "a_id", "a_row", "a_start").unionByName(open_), found


_DOC = ("_id", "_row", "start", "size", "key", "a_id", "a_row", "a_start")
_FOUND = "kind int, _id long, _row long, a_id long, a_row long, shift long, lo long, hi long, key long"


def _lengths():
    """The lengths of RUNS, then the last one doubled again and again."""
    yield from RUNS
    length = RUNS[-1]
    while True:
        length *= 2
        yield length


def _run_ends(runs: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each length: pairs (i, j) of the first and last chunk of the runs that have about that length and lie in one stretch of neighbours."""
    base = np.cumsum(np.concatenate([[0], np.where(runs[1:] != runs[:-1], 1, 0)])) * np.int64(2**33)
    g_start, g_end = base + start, base + end
    for length in _lengths():
        j = np.searchsorted(g_end, g_start + length)
        ok = np.flatnonzero(j < len(runs))
        ok = ok[runs[j[ok]] == runs[ok]]
        if not len(ok):
            return
        yield ok, j[ok]


def _of_documents(batches):
    """Of a partition sorted by place: stretches of chunks with one offset to their first occurrence (kind 0), and the runs of chunks
    that stand first in different documents, or at different offsets (kind 1)."""
    types = [pa.int32(), *[pa.int64()] * 8]
    names = ["kind", "_id", "_row", "a_id", "a_row", "shift", "lo", "hi", "key"]
    held = None

    def out(*cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def found(cols):
        ids, rows, start, size, key, a_id, a_row, a_start = cols
        start, end = start.astype(np.int64), start.astype(np.int64) + size
        once = np.ones(len(ids), dtype=bool)  # rows of docs that are repeated as they are
        once[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (start[1:] != start[:-1])
        ids, rows, start, end, key, a_id, a_row, a_start = (c[once] for c in (ids, rows, start, end, key, a_id, a_row, a_start))
        shift = start - a_start
        near = np.zeros(len(ids), dtype=bool)  # goes on where the one before ends
        near[1:] = (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1]) & (start[1:] == end[:-1])
        same = near.copy()
        same[1:] &= (a_id[1:] == a_id[:-1]) & (a_row[1:] == a_row[:-1]) & (shift[1:] == shift[:-1])
        head = np.flatnonzero(~same)
        tail = np.append(head[1:], len(ids)) - 1
        take = ids[head] > a_id[head]
        head, tail = head[take], tail[take]
        zero = np.zeros(len(head), np.int64)
        yield out(zero, ids[head], rows[head], a_id[head], a_row[head], shift[head], start[head], end[tail], zero)
        changes = np.cumsum(~same)
        common._grow(len(ids) + 1)
        h = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(mix(key.view(np.uint64) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * common._POWERS[: len(ids)], out=h[1:])
        # A run of equal chunks is one row, whatever its length; here those of a length at least meet each other.
        long = np.flatnonzero(end - start >= RUNS[0])
        for k, length in enumerate(_lengths()):
            long = long[end[long] - start[long] >= length]
            if not len(long):
                break
            zero = np.zeros(len(long), np.int64)
            yield out(zero + 1, ids[long], rows[long], zero, zero, zero, start[long], start[long] + length, mix(key[long].view(np.uint64) ^ mix(np.full(len(long), k + 1, dtype=np.uint64))).view(np.int64))
        seen = np.zeros(0, dtype=np.int64)
        for i, j in _run_ends(np.cumsum(~near), start, end):
            mixed = changes[i] != changes[j]
            i, j = i[mixed], j[mixed]
            new = ~np.isin(i * len(ids) + j, seen)
            i, j = i[new], j[new]
            seen = np.concatenate([seen, i * len(ids) + j])
            zero = np.zeros(len(i), np.int64)
            digest = mix((h[j + 1] - h[i]) * common._INVERSES[i] + (j - i).astype(np.uint64)).view(np.int64)
            yield out(zero + 1, ids[i], rows[i], zero, zero, zero, start[i], end[j], digest)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in _DOC]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last document may go on
        if cut:
            yield from found([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield from found(held)


_SPAN = "open int, _id long, _row long, start long, end long, n_words long, first_id long, a_row long, a_at long, is_first boolean"


def _edge(x: np.ndarray, y: np.ndarray, s: int, e: int) -> tuple[int, int]:
    """s and e moved in to the borders of characters."""
    inner = lambda z, k: k < len(z) and z[k] & 0xC0 == 0x80
    while s < e and inner(x, s):
        s += 1
    while e > s and (inner(x, e) or inner(y, e)):
        e -= 1
    return s, e


def _stretches(min_words: int):
    """The equal stretches of two segments laid side by side, a row for each document of the pair (open 0).

    Where they are equal up to an edge that is not the edge of a text, the pair comes back with open 1: the place that is to be compared, from start to end, with what a_at is beside.
    """

    def run(batches):
        names = ["open", "_id", "_row", "start", "end", "n_words", "first_id", "a_row", "a_at", "is_first"]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            rows = zip(*(b.column(c).to_pylist() for c in ("a_id", "a_row", "a_at", "a_seg", "b_id", "b_row", "b_at", "b_seg", "n")), strict=True)
            for a_id, a_row, a_at, a_seg, b_id, b_row, b_at, b_seg, asked in rows:
                # The segments start at the same offset to each other; where one starts later, the other loses as much.
                x, y = np.frombuffer(a_seg, np.uint8), np.frombuffer(b_seg, np.uint8)
                n = min(len(x), len(y))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], x[:n] == y[:n], [False])).astype(np.int8)))
                before = min(asked, a_at, b_at) if len(edge) and edge[0] == 0 else 0
                after = asked if len(edge) and edge[-1] == asked == n else 0
                if before or after:
                    for c, v in zip(cols, (1, b_id, b_row, b_at - before, b_at + asked + after, 0, a_id, a_row, a_at - before, False), strict=True):
                        c.append(v)
                    continue
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    s, e = _edge(x, y, s, e)
                    if e - s < 2 * min_words - 1:
                        continue
                    words = _whole_words(x, y, s, e)
                    if words >= min_words:
                        for doc, row, at, first in ((a_id, a_row, a_at, True), (b_id, b_row, b_at, False)):
                            for c, v in zip(cols, (0, doc, row, at + s, at + e, words, a_id, a_row, a_at, first), strict=True):
                                c.append(v)
            types = [pa.int32(), *[pa.int64()] * 8, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _whole_words(x: np.ndarray, y: np.ndarray, s: int, e: int) -> int:
    """Words of x[s:e] that are not cut at either end, in x or in y."""
    starts, _ = word_spans(x[s:e])
    inside = lambda z, k: 0 <= k < len(z) and z[k] not in SPACE
    first = s < e and inside(x, s) and (inside(x, s - 1) or inside(y, s - 1))
    last = s < e and inside(x, e - 1) and (inside(x, e) or inside(y, e))
    return max(0, len(starts) - first - last)


def _compared(keyed: DataFrame, repeated: bool, pairs: DataFrame, min_words: int) -> DataFrame:
    """_SPAN rows of pairs (b_id, b_row, a_id, a_row, b_at, a_at, n). repeated: keyed has rows with one id and text."""
    sides = [pairs.select(F.col(f"{x}_id").alias("_id"), F.col(f"{x}_row").alias("_row"), F.col(f"{x}_at").alias("at"), "n") for x in "ab"]
    need = settle(sides[0].unionByName(sides[1]).distinct(), "need")
    segments = spread_join(need, keyed, ["_id", "_row"], hot_keys(need, ["_id", "_row"]), F.xxhash64("at", "n"))
    segments = settle(segments.select("_id", "_row", "at", "n", F.expr("substring(_text, cast(at + 1 as int), cast(n as int))").alias("seg")), "segments")
    texts = segments.dropDuplicates(["_id", "_row", "at", "n"]) if repeated else segments
    for x in "ba":
        keys = [f"{x}_id", f"{x}_row", f"{x}_at", "n"]
        mine = texts.select(*[F.col(c).alias(k) for c, k in zip(("_id", "_row", "at", "n"), keys, strict=True)], F.col("seg").alias(f"{x}_seg"))
        held = pairs if x == "b" else held  # noqa: F821
        held = held.join(mine, keys) if x == "b" else spread_join(held, mine, keys, hot_keys(pairs, keys), F.xxhash64("b_id", "b_row", "b_at"))
    held = held.select("a_id", "a_row", "a_at", "a_seg", "b_id", "b_row", "b_at", "b_seg", "n")
    out = settle(held.mapInArrow(_stretches(min_words), _SPAN), "stretches")
    discard(need, segments)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per span that another document holds too: _id, _row, start, end (bytes of the UTF-8 text, end exclusive), n_words, first_id, is_first.

    first_id is the document that it was compared with, one with a smaller id; is_first marks that one's own span. Rows that share an id are one document
    (_row, a hash of the text, tells them apart), so what they share is no repeat, and repeated rows give their spans once; a null id is one document, after all
    others. Null and empty texts, and an empty table, have no spans; very long texts are compared whole. Other columns of any name are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    chunks = settle(keyed.mapInArrow(_chunks, "key long, _id long, _row long, start int, size int"), "chunks")
    hits, written = _shared_places(chunks, "hits")
    found = settle(hits.repartition("_id", "_row").sortWithinPartitions("_id", "_row", "start").select(*_DOC).mapInArrow(_of_documents, _FOUND), "found")
    discard(written)
    runs = settle(found.where("kind = 1").select("key", "_id", "_row", F.col("lo").cast("int").alias("start"), (F.col("hi") - F.col("lo")).cast("int").alias("size")), "run-keys")
    more, written = _shared_places(runs, "runs")
    more = more.where("_id > a_id").select("_id", "_row", "a_id", "a_row", (F.col("start") - F.col("a_start")).cast("long").alias("shift"), F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("size")).cast("long").alias("hi"))
    pairs = found.where("kind = 0").drop("kind", "key").unionByName(more)
    pairs = pairs.groupBy(F.col("_id").alias("b_id"), F.col("_row").alias("b_row"), "a_id", "a_row", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = F.least(F.lit(REACH), F.col("lo"), F.col("lo") - F.col("shift"))
    pairs = settle(pairs.select("b_id", "b_row", "a_id", "a_row", (F.col("lo") - before).alias("b_at"), (F.col("lo") - F.col("shift") - before).alias("a_at"), (F.col("hi") - F.col("lo") + before + REACH).alias("n")), "pairs")
    discard(found, written)
    repeated = not keyed.groupBy("_id", "_row").count().where("count > 1").isEmpty()
    spans = None
    while True:
        part = _compared(keyed, repeated, pairs, min_words)
        done = part.where("open = 0").select("_id", "_row", "start", "end", "n_words", "first_id", "is_first")
        spans = done if spans is None else spans.unionByName(done)
        wider = part.where("open = 1")
        if wider.isEmpty():
            return spans.distinct()
        pairs = wider.select(F.col("_id").alias("b_id"), F.col("_row").alias("b_row"), F.col("first_id").alias("a_id"), "a_row", F.col("start").alias("b_at"), "a_at", (F.col("end") - F.col("start")).alias("n")).distinct()


def _cut():
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("_text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                at, parts = 0, []
                for s in spans or ():
                    parts.append(text[at : max(at, s["start"])])
                    at = max(at, s["end"])
                out.append(None if text is None else b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("_whole"), pa.array(out, pa.binary())], names=["_whole", "_text"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with all their columns, their texts without the spans whose first occurrence is in another document.

    Nulls, empty and long texts, repeated rows and empty tables as in repeated_spans; a null text stays null. Columns of docs may have any name.
    """
    spans = repeated_spans(docs, id_col, text_col, min_words).where(~F.col("is_first"))
    gone = settle(spans.groupBy("_id", "_row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone")), "gone")
    others = [c for c in docs.columns if c != text_col]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    held = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), text_hash(text_col).alias("_row"), F.col(f"`{text_col}`").cast("binary").alias("_text"), whole.alias("_whole"))
    out = spread_join(held, gone, ["_id", "_row"], hot_keys(held, ["_id", "_row"]), F.monotonically_increasing_id(), "left").select("_whole", "_text", "gone")
    schema = out.select("_whole", "_text").schema
    back = {c: F.col(f"_whole.c{k}") for k, c in enumerate(others)} | {text_col: F.col("_text").cast("string")}
    return out.mapInArrow(_cut(), schema).select(*[back[c].alias(c) for c in docs.columns])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(F.col("_id").alias("doc_id"), "start", "end", "n_words", F.col("first_id").alias("first_doc_id"), "is_first")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL: dict[str, str] = {}
