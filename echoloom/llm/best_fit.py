"""Best-fit packing: bins are filled greedily, then a bin's smallest document gives way to two others that fit its gap more tightly.

Documents are dealt at random to groups of about GROUP_DOCS, so groups do not grow with the input. Inside a
group only sizes matter, and there are at most as many as a sequence has tokens: the pieces of a size are a stack,
and sets of sizes are bits of one integer, so a search for a size or for a pair of sizes is a shift and an AND.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table
from .packing import text_ids

SEQUENCE = 2048
END_ID = 0
GROUP_DOCS = 8192


def best_two_fit(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """For each size (1 to room) its bin and its place in that bin.

    A bin takes the largest size that fits until none does. If it then holds two or more and has a gap, its smallest is
    replaced by the two unpacked sizes whose sum is the largest above it that fits; of equal sums the most unequal pair.
    Pieces of equal size are taken in their order.
    """
    stacks: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        stacks.setdefault(sizes[k], []).append(k)
    there = sum(1 << s for s in stacks)  # bit s: some piece of size s is unpacked
    mirror = sum(1 << (room - s) for s in stacks)  # bit room - s, the same
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)

    def take(s: int) -> int:
        nonlocal there, mirror
        k = stacks[s].pop()
        if not stacks[s]:
            there ^= 1 << s
            mirror ^= 1 << (room - s)
        return k

    def give_back(k: int) -> None:
        nonlocal there, mirror
        s = sizes[k]
        if not stacks[s]:
            there |= 1 << s
            mirror |= 1 << (room - s)
        stacks[s].append(k)

    def pair(most: int, least: int) -> tuple[int, int] | None:
        """Two unpacked sizes, the sum at most `most` and above `least`."""
        for total in range(most, least, -1):
            both = there & (mirror >> (room - total))  # bit s: s and total - s are there
            half = total // 2
            if both and total == 2 * half and both >> half & 1 and len(stacks[half]) < 2:
                both ^= 1 << half
            if both:
                large = both.bit_length() - 1
                return large, total - large
        return None

    bin_ = 0
    while there:
        held, gap = [], room
        while fit := there & ((1 << (gap + 1)) - 1):
            held.append(take(fit.bit_length() - 1))
            gap -= sizes[held[-1]]
        if gap and len(held) > 1:
            least = sizes[held[-1]]
            if found := pair(gap + least, least):
                last = held.pop()
                held += [take(found[0]), take(found[1])]
                give_back(last)
        at = 0
        for k in held:
            out[k] = (bin_, at)
            at += sizes[k]
        bin_ += 1
    return out


def _tokenized(path: str, sequence: int, end_id: int, with_ids: bool):
    """A row per document: its length, and the checksum (and ids) of each piece it is cut into."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for b in batches:
            n, crcs, ids = [], [], []
            for data in text_ids([t or b"" for t in b.column("_text").to_pylist()], path):
                data = data[:-4] + end  # in place of the end that text_ids puts
                pieces = [data[k : k + 4 * sequence] for k in range(0, len(data), 4 * sequence)]
                n.append(len(data) // 4)
                crcs.append([zlib.crc32(p) for p in pieces])
                ids.append(pieces if with_ids else None)
            cols = [b.column("_id"), b.column("_row"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_row", "n", "crcs", "ids"])

    return run


def _packed(sequence: int, with_ids: bool):
    """Pieces of sorted partitions, group by group."""
    names = ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]

    def pack(group: int, rows: list[tuple]) -> pa.RecordBatch:
        pieces = [(doc, k, k * sequence, min(sequence, n - k * sequence), crc, ids[k] if with_ids else None) for doc, n, crcs, ids in rows for k, crc in enumerate(crcs)]
        places = best_two_fit([p[3] for p in pieces], sequence)
        full = [(*p[:5], (group << 32) + bin_, at, p[5]) for p, (bin_, at) in zip(pieces, places, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full, strict=True), types, strict=True)], names=names)

    def run(batches):
        group, rows = None, []
        for b in batches:
            ids = b.column("ids").to_pylist() if with_ids else [None] * b.num_rows
            for g, doc, n, crcs, own in zip(b.column("_group").to_pylist(), b.column("_id").to_pylist(), b.column("n").to_pylist(), b.column("crcs").to_pylist(), ids, strict=True):
                if rows and g != group:
                    yield pack(group, rows)
                    rows = []
                group = g
                rows.append((doc, n, crcs, own))
        if rows:
            yield pack(group, rows)

    return run


def pack_best_fit(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, bytes of little-endian unsigned 32-bit ids).

    A document is its text's ids and end_id; a null or empty text is end_id alone. Only one that is longer than a
    sequence is cut, into full sequences and a rest. Rows are documents each for itself: ones that repeat an id, or have none, or are
    equal in all, are dealt to groups by their place in the table, so no group is larger for them. Other columns of
    any name are ignored; an empty table gives an empty result. path: a tokenizers file at the same place on every worker.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    rows = inner.mapInArrow(_tokenized(path, sequence, end_id, with_ids), "_id long, _row long, n long, crcs array<long>, ids array<binary>")
    rows = settle(rows, "best-fit")  # places are data from here on: a task that runs again deals the same groups
    groups = max(1, math.ceil(rows.count() / group_docs))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    dealt = dealt.repartition("_group").sortWithinPartitions("_group", "n", "_id", "crcs", "_row")
    out = dealt.mapInArrow(_packed(sequence, with_ids), "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op13_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_best_fit": op13_best_fit}
SQL: dict[str, str] = {}
