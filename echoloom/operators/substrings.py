"""Which of many values stand in which of many texts, without comparing every text with every value.

Of each value one gram of GRAM bytes is chosen, the one that fewest values of its corpus share (a shorter value is its own
gram). Texts give the grams that some value has chosen, found by hash in a bit table of fixed size, and meet the values on
(corpus, gram). What meets is looked up in the text itself, so hashes decide cost, never a result. A text is read once, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled

GRAM = 8
#: Bits of the table of chosen grams: 2 MB, whatever the number of values.
TABLE_BITS = 24
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size bytes."""
    n = len(data) - size + 1
    out = np.full(max(0, n), size, np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _FACTOR + data[k : k + n]
        out ^= out >> np.uint64(29)
    return out


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64)


def _value_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, grams, sizes = [], [], []
        for k, value in enumerate(b.column("_value").to_pylist()):
            data = _bytes(value)
            size = min(GRAM, len(data))
            if size:
                own = np.unique(_hashes(data, size))
                at += [k] * len(own)
                grams.append(own.view(np.int64))
                sizes += [size] * len(own)
        rows = b.take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)), pa.array(sizes, pa.int32())], names=["_by", "_value", "_gram", "_size"])


def _text_grams(sizes: list[int], table: bytes):
    bits = np.frombuffer(table, np.uint8)
    mask = np.uint64((1 << TABLE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, grams = [], []
            for k, text in enumerate(b.column("_text").to_pylist()):
                data = _bytes(text)
                for size in sizes:
                    all_ = _hashes(data, size)
                    place = all_ & mask
                    own = np.unique(all_[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0])
                    at += [k] * len(own)
                    grams.append(own.view(np.int64))
            rows = b.select(["_by", "_row"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))], names=["_by", "_row", "_gram"])

    return run


def _bit_table(chosen: DataFrame) -> bytes:
    """Bit h of the table is set if a chosen gram's hash ends in h. Words of 64 bits are put together by Spark; at most 2^18 of them reach the driver."""
    low = F.col("_gram").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    words = chosen.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for word, bits in words.collect():
        table[word] = bits
    return table.astype("<i8").tobytes()


def values_in_texts(texts: DataFrame, values: DataFrame, by: str, col: str, value: str = "value") -> DataFrame:
    """Rows of texts joined with those of values of the same `by` whose value stands in col: their columns, by once.

    Values that repeat are found each; an empty one, and a null in any of by, col and value, is found nowhere. Columns besides by must have different names.
    """
    kept = values.where(f"`{by}` is not null and `{value}` <> ''")
    distinct = kept.select(F.col(by).cast("string").alias("_by"), F.col(value).alias("_value")).distinct()
    grams = settled(distinct.mapInArrow(_value_grams, "_by string, _value string, _gram long, _size int"))
    shared = grams.groupBy("_by", "_gram").agg(F.count("*").alias("_c"))
    rare = grams.join(shared, ["_by", "_gram"]).groupBy("_by", "_value").agg(F.min(F.struct("_c", "_gram")).alias("_m"), F.max("_size").alias("_size"))
    chosen = settled(rare.select("_by", "_value", F.col("_m._gram").alias("_gram"), "_size"))
    sizes = sorted(r[0] for r in chosen.select("_size").distinct().collect())  # GRAM numbers at most
    row = F.xxhash64(F.col(by).cast("string"), F.col(col))
    once = texts.where(f"`{by}` is not null").select(F.col(by).cast("string").alias("_by"), row.alias("_row"), F.col(col).alias("_text"))
    found = once.mapInArrow(_text_grams(sizes, _bit_table(chosen)), "_by string, _row long, _gram long").distinct()
    # Few values share a gram that fewest share; each candidate is looked up in its text.
    pairs = found.join(chosen, ["_by", "_gram"]).select(F.col("_by").alias("_pby"), F.col("_row").alias("_prow"), "_value").distinct()
    rows = texts.select(*texts.columns, row.alias("_row")).join(pairs, (F.col("_row") == F.col("_prow")) & (F.col(by).cast("string") == F.col("_pby")))
    hits = rows.where(F.contains(F.col(col), F.col("_value"))).select(*texts.columns, "_value")
    more = [c for c in kept.columns if c != by]
    named = kept.select(F.col(by).alias("_vby"), *more)
    return hits.join(named, (F.col(by) == F.col("_vby")) & (F.col("_value") == F.col(value))).select(*texts.columns, *more)
