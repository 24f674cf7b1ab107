"""Chunks of clustered records that fit a token budget: order inside a group, balanced contiguous parts, checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import date_sort_key
from ..session import settled
from .numbering import number_rows

CHARS_PER_TOKEN = 4
TARGET_TOKENS = 2000
CAP_TOKENS = 100_000


def effective_budget(target: Column | int | None, cap: Column | int = CAP_TOKENS) -> Column:
    """The smaller of target and cap; without a target the cap."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(as_col(target).cast("bigint"), as_col(cap).cast("bigint"))


def order_members(df: DataFrame, by: list[str], created: str = "created", pos: str = "pos") -> DataFrame:
    """Adds rn, from 0: dated records first, by date, then the others; ties by input position. A group of any size is numbered by many tasks."""
    key = date_sort_key(F.col(created))
    return number_rows(df, by, [key.isNull(), key, pos])


def balanced_part(rn: Column, n: Column, p: Column) -> Column:
    """The part (from 0) of record rn when n records are cut into p runs whose sizes differ by one at most, longer ones first."""
    base, extra = F.floor(n / p), n % p
    long = extra * (base + 1)
    return F.when(rn < long, F.floor(rn / (base + 1))).otherwise(extra + F.floor((rn - long) / F.greatest(base, F.lit(1)))).cast("bigint")


def part_counts(members: DataFrame, by: list[str], budget: Column, chars: str = "n_chars", cpt: int = CHARS_PER_TOKEN, wide: int = 4096) -> DataFrame:
    """(by, n, total, parts): the number of balanced parts of each group.

    1 where floor(total / cpt) is in the budget; else from ceil(total / (budget cpt)) upward the first number whose parts all
    fit, or one part a record. No number is passed over, as fitting is not monotone. Groups of up to `wide` records are searched
    on an array of prefix sums in one row; larger ones on their runs of records over the budget, in a few rounds.
    """
    groups = members.groupBy(*by).agg(F.count("*").alias("n"), F.sum(chars).alias("total")).withColumn("_b", budget)
    limit = F.col("_b") * cpt
    groups = groups.withColumn("_p0", F.when(F.floor(F.col("total") / cpt) <= F.col("_b"), 1).otherwise(F.greatest(F.ceil(F.col("total") / limit), F.lit(1))).cast("bigint"))
    groups = groups.withColumn("_p0", F.least("_p0", "n"))
    done = groups.where("_p0 = 1").select(*by, "n", "total", F.lit(1).cast("bigint").alias("parts"))

    open_ = groups.where("_p0 > 1")
    few = members.join(open_.where(F.col("n") <= wide), by, "left_semi")
    small = few.withColumn("_s", F.sum(chars).over(W.partitionBy(*by).orderBy("rn"))).groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("_pre"))
    small = small.join(open_, by)
    edge = lambda i, p: i * F.floor(F.col("n") / p) + F.least(i, F.col("n") % p)  # noqa: E731  records before part i
    at = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_pre", (k - 1).cast("int")))
    fits = lambda p: F.forall(F.sequence(F.lit(0).cast("bigint"), p - 1), lambda i: at(edge(i + 1, p)) - at(edge(i, p)) <= limit)
    # The first fit of a fold: once one is found the others are not looked at.
    found = F.aggregate(F.sequence("_p0", "n"), F.lit(None).cast("bigint"), lambda acc, p: F.when(acc.isNotNull(), acc).when((p == F.col("n")) | fits(p), p))
    out = done.unionByName(small.select(*by, "n", "total", found.alias("parts")))

    large = open_.where(F.col("n") > wide)
    return out if large.isEmpty() else out.unionByName(_large_part_counts(members, large, by, chars, cpt))


#: Rows of a block in which windows over the budget are looked for, at least; candidates that a round tries in full, at first and at most.
BLOCK_ROWS = 4096
ROUND_CANDIDATES = (64, 1024)
WITNESSES = 64


def _over_budget(by: list[str]):
    """For each (group, block) of sorted partitions the shortest runs over the limit: (by, first, last), none inside another."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            rn, upto, own, limit, size = (t.column(c).to_numpy() for c in ("rn", "_upto", "_own", "_limit", "_chars"))
            last = np.searchsorted(upto, upto - size + limit, "right")
            closed = last < len(rn)
            alone = np.append(last[1:] != last[:-1], True)  # a later start with the same end is a shorter run
            k = np.flatnonzero(closed & alone & own)
            first = t.select(by).combine_chunks().to_batches()[0].slice(0, 1)
            return pa.RecordBatch.from_arrays([*first.take(pa.array(np.zeros(len(k), np.int64))).columns, pa.array(rn[k]), pa.array(rn[last[k]])], names=[*by, "first", "last"])

        for b in batches:
            key = b.column("_key").to_numpy()
            for lo, hi in zip((cuts := [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]), cuts[1:], strict=False):
                if held and held[0].column("_key")[0].as_py() != int(key[lo]):
                    yield found()
                    held.clear()
                held.append(b.slice(lo, hi - lo))
        if held:
            yield found()

    return run


def _meet(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on by, null equal to null; by stays once."""
    names = {c: f"_on{k}" for k, c in enumerate(by)}
    on = [F.col(c).eqNullSafe(F.col(x)) for c, x in names.items()]
    return a.join(b.withColumnsRenamed(names), on, how).drop(*names.values())


def _large_part_counts(members: DataFrame, large: DataFrame, by: list[str], chars: str, cpt: int) -> DataFrame:
    """part_counts of groups of any size. A number of parts fits where no part holds a run of records over the limit, that is where the first and the
    last record of each shortest such run are in different parts, and which part a record is in is arithmetic.

    Records with text are dealt to blocks that hold a budget's worth each, so a run starts in a block and ends there or in the next. All
    numbers between the least possible and the one whose parts are shorter than any such run are tried on the WITNESSES shortest runs;
    those that pass are tried in order on all runs, many a round.
    """
    limits = large.select(*by, (F.col("_b") * cpt).cast("bigint").alias("_limit"))
    rows = members.select(*by, F.col("rn").cast("bigint").alias("rn"), F.col(chars).cast("bigint").alias("_chars")).where("_chars > 0")
    placed = number_rows(_meet(rows, limits, by), by, ["rn"], "_k", ("_chars", "_upto"))
    # A run over the limit has one record more than the limit has characters at most.
    block = F.floor(F.col("_k") / F.greatest(F.lit(BLOCK_ROWS), F.col("_limit") + 1))
    dealt = placed.withColumn("_to", F.explode(F.array_distinct(F.array(block, F.greatest(block - 1, F.lit(0)))))).withColumn("_own", F.col("_to") == block)
    dealt = dealt.withColumn("_key", F.xxhash64(*by, "_to")).repartition("_key").sortWithinPartitions("_key", *by, "_to", "_k")
    kinds = ", ".join(f"`{c}` {members.schema[c].dataType.simpleString()}" for c in by)
    runs = settled(dealt.select(*by, "rn", "_upto", F.col("_own"), "_limit", "_chars", "_key").mapInArrow(_over_budget(by), f"{kinds}, first long, last long"))

    length = F.col("last") - F.col("first") + 1
    few = runs.withColumns({"_len": length, "_bucket": F.pmod(F.xxhash64("first"), F.lit(256))})
    for part in ([*by, "_bucket"], by):
        few = few.withColumn("_r", F.row_number().over(W.partitionBy(*part).orderBy("_len", "first"))).where(F.col("_r") <= WITNESSES)
    few = few.groupBy(*by).agg(F.collect_list(F.struct("first", "last")).alias("_runs"), F.min("_len").alias("_least"))
    groups = settled(_meet(large.select(*by, "n", "total", "_p0"), few, by, "left"))
    sure = F.when(F.col("_least").isNull(), F.col("_p0")).when(F.col("_least") <= 1, F.col("n")).otherwise(F.least("n", F.ceil(F.col("n") / (F.col("_least") - 1)))).cast("bigint")
    groups = groups.withColumn("_sure", F.greatest(sure, F.col("_p0")))
    cut = lambda r, p: balanced_part(r["first"], F.col("n"), p) == balanced_part(r["last"], F.col("n"), p)
    tried = groups.where("_p0 < _sure and _least > 1").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_sure") - 1 - F.col("_p0")) / BLOCK_ROWS))))
    low = F.col("_p0") + F.col("_block") * BLOCK_ROWS
    tried = tried.repartition(*by, "_block").withColumn("parts", F.explode(F.sequence(low, F.least(low + (BLOCK_ROWS - 1), F.col("_sure") - 1))))
    tried = tried.where(~F.exists("_runs", lambda r: cut(r, F.col("parts")))).select(*by, "n", "parts")
    tried = number_rows(tried, by, ["parts"], "_s")

    todo, done, at, size = groups.select(*by, "n", "total", "_sure"), None, 0, ROUND_CANDIDATES[0]
    while True:
        now = _meet(tried.where((F.col("_s") >= at) & (F.col("_s") < at + size)), todo.select(*by), by, "left_semi")
        listed = settled(now.groupBy(*by).agg(F.first("n").alias("n"), F.collect_list("parts").alias("_all")))
        failed = F.filter("_all", lambda p: cut({"first": F.col("first"), "last": F.col("last")}, p))
        bad = _meet(runs, listed, by).select(*by, F.explode(failed).alias("parts")).distinct()
        good = _meet(now, bad, [*by, "parts"], "left_anti").groupBy(*by).agg(F.min("parts").alias("parts"))
        judged = _meet(_meet(todo, good, by, "left"), listed.select(*by, F.lit(True).alias("_more")), by, "left")
        judged = settled(judged.withColumn("parts", F.coalesce("parts", F.when(F.col("_more").isNull(), F.col("_sure")))).drop("_more"))
        ended = judged.where("parts is not null").select(*by, "n", "total", "parts")
        done = ended if done is None else done.unionByName(ended)
        todo = judged.where("parts is null").drop("parts")
        if todo.isEmpty():
            return done
        at, size = at + size, min(4 * size, ROUND_CANDIDATES[1])


def chunk_groups(df: DataFrame, corpus: str = "corpus_id", label: str = "label", chars: str = "n_chars", target: int | None = TARGET_TOKENS, cap: int = CAP_TOKENS, cpt: int = CHARS_PER_TOKEN, created: str = "created", pos: str = "pos", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Members (corpus, chunk_id, label, rn, id, chars) and chunks (corpus, chunk_id, label, is_uncategorised, n_records, n_chars).

    Chunks are numbered by label (noise, -1, first), then part; a record over the budget is a chunk of its own.
    """
    by = [corpus, label]
    members = order_members(df.select(corpus, label, F.col(chars).cast("bigint").alias(chars), created, pos, id_col), by, created, pos)
    parts = part_counts(members, by, effective_budget(target, cap), chars, cpt)
    placed = members.join(parts, by).withColumn("_part", balanced_part(F.col("rn"), F.col("n"), F.col("parts")))
    # Numbers come from the sizes of groups, not from a sort of all records of a corpus.
    first = parts.withColumn("_first", F.coalesce(F.sum("parts").over(W.partitionBy(corpus).orderBy(label).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(first.select(*by, "_first"), by).withColumn("chunk_id", F.col("_first") + F.col("_part"))
    members = placed.select(corpus, "chunk_id", label, "rn", id_col, chars)
    chunks = members.groupBy(corpus, "chunk_id", label).agg(F.count("*").alias("n_records"), F.sum(chars).alias("n_chars")).withColumn("is_uncategorised", F.col(label) == -1)
    return members, chunks


def small_corpora_as_noise(df: DataFrame, corpus: str, label: str, least: int) -> DataFrame:
    """Labels of corpora with fewer than `least` records become -1."""
    return df.withColumn(label, F.when(F.count("*").over(W.partitionBy(corpus)) < least, F.lit(-1)).otherwise(F.col(label)))


def check_coverage(members: DataFrame, records: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, problem) of records that are missing, repeated or unknown in members."""
    a = members.groupBy(id_col).agg(F.count("*").alias("_a"))
    b = records.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_b"))
    both = a.join(b, a[id_col] == b["_id"], "full_outer")
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unknown").when(F.col("_a") != F.col("_b"), "repeated")
    return both.select(F.coalesce(id_col, "_id").alias(id_col), problem.alias("problem")).where("problem is not null")


def check_budget(chunks: DataFrame, budget: int, cpt: int = CHARS_PER_TOKEN) -> DataFrame:
    """Chunks of more than one record that are over the budget."""
    return chunks.where((F.floor(F.col("n_chars") / cpt) > budget) & (F.col("n_records") > 1))


def check_pairs(vectors: DataFrame, records: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, side) of vectors without a record and records without a vector."""
    a = vectors.join(records, id_col, "left_anti").select(id_col, F.lit("vector").alias("side"))
    return a.unionByName(records.join(vectors, id_col, "left_anti").select(id_col, F.lit("record").alias("side")))
