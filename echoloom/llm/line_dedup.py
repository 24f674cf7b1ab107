"""Line dedup: hashes of line keys are range-partitioned and sorted by document and position;
first occurrences stream by, and all later documents' lines go into per-document keep bitmaps.

The range is over (hash, document), so a line that a third of all documents hold spreads over
several partitions. Each partition tells its first and last key; those few rows decide whether
the first run of a partition goes on from an earlier one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settle, table

MIN_KEY = 10
#: Stands for a null identifier: one document, after all others.
NULL_ID = 2**63 - 1


def line_key(line: bytes, min_key: int = MIN_KEY) -> bytes | None:
    """The key of a line, or None if it has fewer than min_key code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_key or (len(key) < 4 * min_key and not key.isascii() and len(key.decode("utf-8", "replace")) < min_key):
        return None
    return key


def _lines(min_key: int):
    def run(batches):
        for b in batches:
            ids, ths, pos, digests, docs = b.column("_id").to_numpy(zero_copy_only=False), b.column("_th").to_numpy(zero_copy_only=False), [], [], []
            for k, text in enumerate(b.column("_text").to_pylist()):
                if not text:
                    continue
                for p, line in enumerate(text.split(b"\n")):
                    key = line_key(line, min_key)
                    if key is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        pos.append(p)
                        docs.append(k)
            h = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            docs = np.array(docs, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids[docs]), pa.array(ths[docs]), pa.array(np.array(pos, dtype=np.int32))], names=["h1", "h2", "_id", "_th", "pos"])

    return run


def _first_stays(batches):
    """kind 0: a line that goes; 1: a line of the first document of this partition's first key; 2: this partition's last key."""
    last = None  # key and first document of the current run
    head = None  # the partition's first (key, document)
    names = ["kind", "h1", "h2", "_id", "_th", "pos"]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h1, h2, ids, ths, pos = (b.column(c).to_numpy() for c in ("h1", "h2", "_id", "_th", "pos"))
        new = np.ones(n, dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None and (h1[0], h2[0]) == last[:2]:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = np.where(at >= 0, ids[at], last[2] if last is not None else 0)
        if head is None:
            head = (h1[0], h2[0], ids[0])
        in_head = (h1 == head[0]) & (h2 == head[1]) & (ids == head[2])
        kind = np.where(in_head, 1, 0)
        take = np.flatnonzero((ids != first) | in_head)
        last = (h1[-1], h2[-1], first[-1])
        if len(take):
            yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (kind.astype(np.int32), h1, h2, ids, ths, pos)], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), *[pa.array([int(x)], pa.int64()) for x in last], pa.array([0], pa.int64()), pa.array([-1], pa.int32())], names=names)


def pack_bitmap(dropped: list[int]) -> bytes:
    """A keep bitmap (1 = stays), deflated; lines after its end stay."""
    bits = np.ones(max(dropped) + 1, dtype=np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes() + len(bits).to_bytes(8, "little"))


def unpack_bitmap(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.unpackbits(np.frombuffer(raw[:-8], dtype=np.uint8), count=int.from_bytes(raw[-8:], "little")).astype(bool)


def _bitmaps(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array([len(x) for x in b.column("gone").to_pylist()], pa.int64()), pa.array([pack_bitmap(x) for x in b.column("gone").to_pylist()], pa.binary())], names=["_id", "_th", "n_dropped", "keep_bitmap"])


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), F.col(text_col).cast("binary").alias("_text"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """Keep bitmaps (_id, _th, n_dropped, keep_bitmap) of the documents that lose lines.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    min_key code points in at least two documents lose all their lines except in the smallest id.
    _th is a hash of the text: rows that share an id but not a text each have a bitmap of their own,
    while they count as one document. A null id is one document, after all others. Of equal lines of one document all stay or
    none; null and empty texts are one empty line, which never goes; long texts are read whole; other columns of any name are ignored; an empty
    table gives an empty result.
    """
    lines = keyed_documents(docs, id_col, text_col).mapInArrow(_lines(min_key), "h1 long, h2 long, _id long, _th long, pos int")
    lines = lines.repartitionByRange("h1", "h2", "_id").sortWithinPartitions("h1", "h2", "_id", "_th", "pos")
    seen = settle(lines.mapInArrow(_first_stays, "kind int, h1 long, h2 long, _id long, _th long, pos int"), "lines")
    # One first and one last key for each partition.
    ends = seen.where("kind > 0").groupBy("h1", "h2").agg(F.min("_id").alias("_least"))
    ends = ends.select(F.col("h1").alias("_e1"), F.col("h2").alias("_e2"), "_least")
    going = seen.where("kind < 2").join(F.broadcast(ends), (F.col("h1") == F.col("_e1")) & (F.col("h2") == F.col("_e2")) & (F.col("kind") == 1), "left")
    going = going.where("kind = 0 or _id > _least").groupBy("_id", "_th").agg(F.collect_set("pos").alias("gone"))
    return going.mapInArrow(_bitmaps, "_id long, _th long, n_dropped long, keep_bitmap binary")


def _apply(batches):
    for b in batches:
        n_lines, texts = [], []
        for text, bitmap in zip(b.column("_text").to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if bitmap is not None:
                keep = unpack_bitmap(bitmap)
                lines = [x for k, x in enumerate(lines) if k >= len(keep) or keep[k]]
            texts.append(b"\n".join(lines))
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n_lines, pa.int64()), b.column("n_dropped"), pa.array(texts, pa.binary())], names=["_id", "n_lines", "n_dropped", "kept_text"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, kept_text (binary)."""
    joined = keyed_documents(docs, id_col, text_col).join(bitmaps, ["_id", "_th"], "left").select("_id", "_text", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep_bitmap")
    out = joined.mapInArrow(_apply, "_id long, n_lines long, n_dropped long, kept_text binary")
    return out.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias(id_col), "n_lines", "n_dropped", "kept_text")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """apply_bitmaps of line_bitmaps. Null and empty texts have one empty line; an empty table gives an empty result."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_key), id_col, text_col)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op6_line_dedup": r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    m AS (SELECT key, min(doc_id) AS home FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    f AS (SELECT k.*, m.home IS NOT NULL AND m.home <> k.doc_id AS gone FROM k LEFT JOIN m ON k.key = m.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM f GROUP BY doc_id"""
}
QUERIES = {"op6_line_dedup": op6_line_dedup}
