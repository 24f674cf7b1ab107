"""Token counts by a two-tier look-up on the map side.

A text is cut into pre-tokens that the tokenizer is sure to treat on their own: the vocabulary has
no piece with the space mark after another character, and none with a newline, so no merge
crosses those places. Tier one is a broadcast table of the lengths of frequent pre-tokens, tier
two a cache in each worker, filled by the tokenizer itself. Both only save work: every length comes
from the tokenizer. Counting shuffles no pre-token; only the choice of tier one does: each task of a sample names its own
most frequent ones, and these lists (FREQUENT words a task) are summed by word.
"""

from __future__ import annotations

import uuid
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Entries of the broadcast table, and of a worker's cache before it is emptied.
FREQUENT = 20_000
CACHE = 600_000
#: The frequent pre-tokens are looked for in one document of so many. This decides how often the
#: cache is asked, never a count.
SAMPLE_ONE_IN = 100
MARK = "▁"

_loaded: dict[str, object] = {}
_caches: dict[tuple, PieceLengths] = {}


def _processor(path: str):
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


class PieceLengths(dict):
    """Token counts of pre-tokens: what stands between two spaces, the space before it included."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.path, self.frequent = path, frequent

    def __missing__(self, word: str) -> int:
        if "\n" in word:
            first, *rest = word.split("\n")
            return (self[first] if first else 1) + len(rest) + sum(map(self.bare, filter(None, rest)))
        if len(self) >= CACHE:
            self.clear()
            self.update(self.frequent)
        n = self[word] = len(_processor(self.path).encode(word))
        return n

    def bare(self, word: str) -> int:
        """Of a word with no space before it. Space mark, newline and word are never merged."""
        key = ("\n", word)
        if (n := self.get(key)) is None:
            n = self[key] = len(_processor(self.path).encode("\n" + word)) - 2
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        total = blanks = 0
        for w in words:
            if not w:
                blanks += 1
            else:
                if not blanks:
                    total += self[w]
                else:  # the spaces before it can merge with each other and with it
                    line, sep, rest = w.partition("\n")
                    total += len(_processor(self.path).encode(" " * blanks + line)) + (self["x" + sep + rest] - self["x"] if sep else 0)
                blanks = 0
        if blanks:
            total += len(_processor(self.path).encode(" " * (blanks - 1))) if blanks > 1 else 1
        return total


def frequent_lengths(docs: DataFrame, path: str, id_col: str, text_col: str, size: int = FREQUENT) -> dict[str, int]:
    """Lengths of frequent pre-tokens: each task of the sample names its own most frequent ones, at most size."""

    def top(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(text.replace(MARK, " ").split(" "))
                if len(seen) > 20 * size:
                    seen = Counter(dict(seen.most_common(5 * size)))
        best = [(w, n) for w, n in seen.most_common(size) if n > 1 and w and "\n" not in w and len(w) <= 40]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(SAMPLE_ONE_IN)) == 0).where(F.length(text_col) > 0).select(F.col(text_col).cast("string").alias("t"))
    best = sample.mapInArrow(top, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    words = [r.word for r in best]
    return dict(zip(words, map(len, _processor(path).encode(words, num_threads=1)), strict=True)) if words else {}


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 tokens; special strings inside texts are ordinary text. Very long texts are counted whole, repeated rows
    and null ids are rows like any other, other columns of any name are ignored, and an empty table gives an empty result.
    path: a sentencepiece model; the file must be at the same place on every worker.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, id_col, text_col))
    name = uuid.uuid4().hex  # of this table, for the workers' caches

    def run(batches):
        key = (path, name)
        if key not in _caches:
            _caches.clear()
            _caches[key] = PieceLengths(path, shared.value)
        lengths = _caches[key]
        for b in batches:
            counts = [lengths.count(t) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_bytes"), pa.array(counts, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("_bytes"))
    out = inner.mapInArrow(run, "_id long, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
