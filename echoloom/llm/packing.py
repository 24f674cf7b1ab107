"""Packing token sequences: first-fit decreasing over a tournament tree of what bins have left,
run independently in randomised groups of documents.

A document longer than a sequence is cut into full sequences and a rest; only the rests are packed.
Groups are dealt by a hash of the identifier, about GROUP_DOCS documents each, so their number
grows with the input and their size does not. Only lengths and checksums are shuffled, unless the
token ids themselves are asked for.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 4096
#: Rows packed together at most; a group with more (many rows of one identifier) is packed in several turns.
TURN = 4 * GROUP_DOCS
CACHE = 700_000
_PUNCT = b".,!?:;|*#$%&()\"/"

_loaded: dict[str, object] = {}
_caches: dict[str, WordIds] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _plain_ids(path: str, text: str) -> bytes:
    return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class WordIds(dict):
    """Little-endian ids of lower-cased words. The tokenizer lower-cases and drops white space, and its pre-tokens
    never cross white space, so a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        t = _tokenizer(path)
        self.last = np.array([(t.id_to_token(i) or "").endswith("</w>") for i in range(t.get_vocab_size())])

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_PUNCT)
        if stem and stem != word and stem[-1:].isalnum():
            ids = self[stem] + self[word[len(stem) :]]  # a letter or digit, then other characters: two pre-tokens
        else:
            ids = _plain_ids(self.path, word.decode("utf-8", "replace"))
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids

    def fill(self, words: set[bytes]) -> None:
        """Encode the words of letters that are not known together: each is one pre-token, and those end with their own ids."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) >= CACHE:
            self.clear()
            new = list(words)
        plain = [x for x in (w.decode("utf-8", "replace") for w in new) if x.isalpha()]
        parts = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        t = _tokenizer(self.path)
        for part, e in zip(parts, getattr(t, "encode_batch_fast", t.encode_batch)([" ".join(x) for x in parts], add_special_tokens=False) if parts else (), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                data, at = ids.tobytes(), 0
                for x, end in zip(part, ends.tolist(), strict=True):
                    self[x.encode()] = data[4 * at : 4 * end]
                    at = end


#: The kind of each byte: a letter or digit, white space, another ASCII character, or (?) one that is not known to be a letter.
_KIND = bytes(97 if chr(i).isalnum() and i < 128 or 0x80 <= i < 0xC0 or i == 0xC3 else 32 if i in SPACE else 46 if i < 128 else 63 for i in range(256))


def _words(text: bytes) -> list[bytes] | None:
    """The lower-cased words of a text, with its full stops and commas set apart where each stands alone between
    letters, digits and spaces. None if the text may hold one of the tokenizer's own special strings."""
    low = text.lower()
    if b"<|" in low and (b"<|startoftext|>" in low or b"<|endoftext|>" in low):
        return None
    kinds = low.translate(_KIND)
    if b"?" not in kinds and b".." not in kinds and b"\xc3\x97" not in low and b"\xc3\xb7" not in low:
        low = low.replace(b",", b" , ").replace(b".", b" . ")
    return low.split()


def text_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of whole texts as bytes, END_ID last."""
    if path not in _caches:
        _caches.clear()
        _caches[path] = WordIds(path)
    known, end = _caches[path], np.array([END_ID], dtype="<u4").tobytes()
    out: list[bytes] = []
    for k in range(0, len(texts), 200):
        split = [_words(t) for t in texts[k : k + 200]]
        known.fill({w for words in split if words for w in words})
        for text, words in zip(texts[k : k + 200], split, strict=True):
            out.append((_plain_ids(path, text.decode("utf-8", "replace")) if words is None else b"".join(map(known.__getitem__, words))) + end)
    return out


def _tokenized(path: str, sequence: int, with_ids: bool):
    """A row per document: its length, and the checksum (and ids) of each piece it is cut into."""

    def run(batches):
        for b in batches:
            n, crcs, ids = [], [], []
            texts = [t or b"" for t in b.column("_text").to_pylist()]
            for data in text_ids(texts, path):
                n.append(len(data) // 4)
                pieces = [data[k : k + 4 * sequence] for k in range(0, len(data), 4 * sequence)]
                crcs.append([zlib.crc32(p) for p in pieces])
                ids.append(pieces if with_ids else None)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_group"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.binary()))], names=["_id", "_group", "n", "crcs", "ids"])

    return run


class Bins:
    """A tournament tree: each leaf is what a bin has left, each inner node the most below it."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)
        self.room = room

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and what it held before."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        left = tree[k]
        tree[k] = left - size
        at = k - self.leaves
        while k > 1:
            k //= 2
            most = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == most:
                break
            tree[k] = most
        return at, self.room - left


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """For each size its bin and its place in that bin."""
    bins, out = Bins(max(1, len(sizes)), room), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[k] = bins.put(sizes[k])
    return out


def _packed(sequence: int, with_ids: bool):
    """Pieces of the documents of sorted partitions, group by group."""
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64()] * 7 + [pa.binary()]

    def pack(group: int, used: int, rows: list[tuple]) -> tuple[pa.RecordBatch, int]:
        """used: sequences of this group so far."""
        cols: list[list] = [[] for _ in names]

        def add(*values):
            for c, v in zip(cols, values, strict=True):
                c.append(v)

        rests = []
        for doc, n, crcs, ids in rows:
            for k, crc in enumerate(crcs):
                length = min(sequence, n - k * sequence)
                piece = (doc, k * sequence, length, crc, n, ids[k] if with_ids else None)
                if length == sequence:
                    add(*piece[:5], (group << 32) + used, 0, piece[5])
                    used += 1
                else:
                    rests.append(piece)
        places = first_fit_decreasing([p[2] for p in rests], sequence)
        for p, (at, offset) in zip(rests, places, strict=True):
            add(*p[:5], (group << 32) + used + at, offset, p[5])
        used += 1 + max((at for at, _ in places), default=-1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names), used

    def run(batches):
        group, used, rows = None, 0, []
        for b in batches:
            ids = b.column("ids").to_pylist() if with_ids else [None] * b.num_rows
            for doc, g, n, crcs, own in zip(b.column("_id").to_pylist(), b.column("_group").to_pylist(), b.column("n").to_pylist(), b.column("crcs").to_pylist(), ids, strict=True):
                if rows and (g != group or len(rows) >= TURN):
                    out, used = pack(group, used, rows)
                    yield out
                    rows = []
                if g != group:
                    group, used = g, 0
                rows.append((doc, n, crcs, own))
        if rows:
            yield pack(group, used, rows)[0]

    return run


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, bytes of little-endian unsigned 32-bit ids).

    Every row of docs is a document of its own: its text's ids and END_ID. A null or empty text is END_ID alone.
    Rows that repeat an id, or have none, are packed each for itself. Very long texts are cut into
    pieces freely; other columns of any name are ignored. An empty table gives an empty result. path: a tokenizers
    file at the same place on every worker.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    groups = max(1, math.ceil(docs.count() / group_docs))
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(groups)), F.lit(groups)).cast("long").alias("_group"))
    rows = inner.mapInArrow(_tokenized(path, sequence, with_ids), "_id long, _group long, n long, crcs array<long>, ids array<binary>")
    rows = rows.repartition("_group").sortWithinPartitions("_group", "n", "_id", "crcs")
    out = rows.mapInArrow(_packed(sequence, with_ids), "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return out.select(F.col("_id").alias(id_col), *columns)


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pack": op10_pack}
SQL: dict[str, str] = {}
