"""Exact duplicates by content sort.

Texts are range-partitioned by sampled splitters, sorted inside each partition so that equal
texts are neighbours, and neighbours are compared in full. The splitters are taken from
(first bytes, SHA-256, identifier), so no splitter is longer than about a hundred bytes and a
group of equal texts of any size spreads over several partitions, as contiguous runs. A run at
the edge of a partition may go on in the next; at most two runs a partition do, and those alone
are matched up again.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, table

PREFIX_BYTES = 24


def _keyed(batches):
    for b in batches:
        texts = b.column("_text").to_pylist()
        norm = [(t or b"").lower() for t in texts]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([x[:PREFIX_BYTES] for x in norm], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary())],
            names=[*b.schema.names, "_prefix", "_sha"],
        )


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*inner.schema.fields, T.StructField("_prefix", T.BinaryType()), T.StructField("_sha", T.BinaryType())])
    last = F.col("_id").desc_nulls_last()
    return inner.mapInArrow(_keyed, schema).repartitionByRange("_prefix", "_sha", last).sortWithinPartitions("_prefix", "_sha", last)


def _decide(batches):
    """Rows of a sorted partition: a row for each text, with what is known of its run here."""
    schema = pa.schema([("_id", pa.int64()), ("_sha", pa.binary()), ("_keep", pa.int64()), ("_n", pa.int64()), ("_first", pa.bool_()), ("_open", pa.bool_())])
    text = sha = None
    ids: list = []
    done: list[tuple] = []
    runs = 0

    def close(is_open: bool) -> None:
        done.append((ids, sha, is_open))

    def out():
        n = sum(len(r[0]) for r in done)
        cols: list[list] = [[], [], [], [], []]
        for group, digest, is_open in done:
            cols[0] += group
            cols[1] += [digest] * len(group)
            cols[2] += [group[0]] * len(group)
            cols[3] += [len(group)] * len(group)
            cols[4] += [is_open] * len(group)
        first = []
        for group, _, _ in done:
            first += [True] + [False] * (len(group) - 1)
        assert len(first) == n
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*cols[:4], first, cols[4]), schema, strict=True)], schema=schema)

    for b in batches:
        for i, raw, digest in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), b.column("_sha").to_pylist(), strict=True):
            norm = (raw or b"").lower()
            if text is not None and digest == sha and norm == text:
                ids.append(i)
                continue
            if text is not None:
                close(runs == 1)
            text, sha, ids = norm, digest, [i]
            runs += 1
        if done:
            yield out()
            done.clear()
    if text is not None:
        close(True)
        yield out()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id stays.
    Null and empty texts are equal to each other. Null ids count as the smallest; if a group has
    no other id, keep_id is null. Of repeated rows with the largest id one stays. An empty table
    gives an empty result; very long texts are compared whole, and other columns of any name are ignored. Runs that go on in another
    partition are matched by SHA-256.
    """
    runs = _sorted_runs(docs, id_col, text_col, []).select("_id", "_text", "_sha")
    local = settle(runs.mapInArrow(_decide, "_id long, _sha binary, _keep long, _n long, _first boolean, _open boolean"), "exact")
    # At most two runs a partition: the size of this side is bounded by the number of partitions.
    ends = local.where("_open and _first").groupBy("_sha").agg(F.max("_keep").alias("_top"), F.sum("_n").alias("_total"), F.count("*").alias("_parts"))
    ends = ends.where("_parts > 1").withColumnRenamed("_sha", "_esha")
    joined = local.join(F.broadcast(ends), (local["_sha"] == ends["_esha"]) & local["_open"], "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.coalesce("_top", "_keep").alias("keep_id"),
        F.coalesce("_total", "_n").alias("group_size"),
        (F.col("_first") & (F.col("_top").isNull() | F.col("_keep").eqNullSafe(F.col("_top")))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _survivors(batches):
    """Of a sorted partition the first row of each run, with what it carries."""
    text = sha = None
    runs = 0
    held = None

    def out(group, is_open):
        n = len(group)
        flags = pa.array([is_open] * n, pa.bool_())
        return pa.RecordBatch.from_arrays([*group.columns, flags], names=[*group.schema.names, "_open"])

    for b in batches:
        take, opens = [], []
        for k, (raw, digest) in enumerate(zip(b.column("_text").to_pylist(), b.column("_sha").to_pylist(), strict=True)):
            norm = (raw or b"").lower()
            if text is None or digest != sha or norm != text:
                text, sha = norm, digest
                runs += 1
                take.append(k)
                opens.append(runs == 1)
        if not take:
            continue
        if held is not None:
            yield out(*held)
        rest = b.take(pa.array(take))
        if opens[0] and len(take) > 1:
            yield out(rest.slice(0, 1), True)
            rest = rest.slice(1)
            opens = opens[1:]
        if len(rest) > 1:
            yield out(rest.slice(0, len(rest) - 1), False)
        held = (rest.slice(len(rest) - 1), opens[-1])
    if held is not None:
        yield out(held[0], True)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; same rule as exact_groups (nulls, ties, repeats, long texts, empty tables), one shuffle. Columns may have any name."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    runs = _sorted_runs(docs, id_col, text_col, others)
    schema = T.StructType([*runs.schema.fields, T.StructField("_open", T.BooleanType())])
    local = settle(runs.mapInArrow(_survivors, schema), "exact-rows")
    ends = local.where("_open").groupBy("_sha").agg(F.max("_id").alias("_top"), F.count("*").alias("_parts")).where("_parts > 1").withColumnRenamed("_sha", "_esha")
    joined = local.join(F.broadcast(ends), (local["_sha"] == ends["_esha"]) & local["_open"], "left")
    kept = joined.where("_parts is null or _id <=> _top")
    types = dict(docs.dtypes)
    by = {id_col: F.col("_id").cast(types[id_col]), text_col: F.col("_text").cast(types[text_col])} | {c: F.col(f"_c{i}") for i, c in enumerate(others)}
    return kept.select(*[by[c].alias(c) for c in docs.columns])


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = {
    "op2_exact_dedup": """
    WITH t AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)"""
}
QUERIES = {"op2_exact_dedup": op2_exact_dedup}
