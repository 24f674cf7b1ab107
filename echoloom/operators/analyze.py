"""Analyses and summaries of many corpora at once: single pass, and map / tree-reduce / judge over chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from ..functions import prompts as P
from ..functions.text import parse_structured
from ..session import checkpointed, settled
from . import chunking, pii, trends
from .call_log import CallLog, answered
from .complete import MAX_TOKENS, Complete
from .validate import DISCLAIMER, injection

JUDGE = "struct<quality_score:double,uncertainty_explanation:string>"
NO_JUDGE = "There is no score, as the judge gave no usable answer."
CPT = 4
#: Records of more characters are over the token limit whatever stands round them.
MAX_CHARS = (MAX_TOKENS + 1) * CPT - 1
RETAIN = ("PERSON",)
_META = ("created", "coding_level_1", "coding_level_2", "coding_level_3")


def quality_score(faithfulness: Column, coverage: Column, clarity: Column) -> Column:
    return 0.6 * faithfulness + 0.3 * coverage + 0.1 * clarity


def judged(df: DataFrame, fn: Complete, source: str, prompt: str, analysis: str, log: CallLog | None = None, **opts) -> DataFrame:
    """Adds score and why. A failed or unusable judge, or no analysis, gives a null score."""
    asked = df.withColumns({"system": P.system_message("judge"), "user": P.judge_message(F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(analysis), F.lit("")))})
    some = answered(asked.where(F.col(analysis).isNotNull()), fn, log, "_judge", **opts)
    rules = {"score_range": F.coalesce(~F.col("parsed.quality_score").between(0, 1), F.lit(True))}
    some = parse_structured(some.withColumn("_raw", F.col("_judge.content")), "_raw", JUDGE, rules)
    some = some.select(*df.columns, F.col("parsed.quality_score").alias("score"), F.coalesce("parsed.uncertainty_explanation", F.lit(NO_JUDGE)).alias("why"))
    none = df.where(F.col(analysis).isNull()).withColumns({"score": F.lit(None).cast("double"), "why": F.lit(NO_JUDGE)})
    return some.unionByName(none)


def record_blocks(records: DataFrame) -> DataFrame:
    """Adds block, the record in its envelope, and blocked: its own text looks like an injection."""
    records = records.withColumn("blocked", injection(F.col("content")).isNotNull())
    meta = {k: F.col(k) for k in _META if k in records.columns}
    return records.withColumn("block", P.record_envelope(F.col("content"), F.col("id"), meta))


def analyze(records: DataFrame, requests: DataFrame, fn: Complete, judge: Complete, by: str = "corpus_id", retain: tuple[str, ...] = RETAIN, period: str | None = None, log: CallLog | None = None) -> DataFrame:
    """One row per request (by, prompt, language): analysis, quality_score, explanation, record_count, status, error_class, trends.

    One message holds all records of a corpus, so a corpus over the token limit is an error row, made from the
    lengths of its records alone, and so is a corpus with a record that looks like an injection. Records are redacted first,
    placeholders of types not in retain are turned back at the end, and the disclaimer comes first.

    A first pass over the texts writes their spans, screens and lengths; a second one redacts and gathers those of corpora that fit. No text is dealt by corpus or sorted for a corpus that does not.
    """
    seen = records.withColumn("spans", pii.spans_in_place(F.col("content")))
    seen = record_blocks(seen.withColumn("content", pii.marked(F.col("content"), F.col("spans"))))
    seen = settled(seen.select(by, "id", "spans", F.length("block").alias("chars"), "blocked"))
    spans = seen.select(by, "id", F.inline("spans"))
    mapping = pii.number_placeholders(spans, [by], ["id", "start"])
    digits = F.length("placeholder") - F.length(pii.placeholder(F.col("type"), F.lit(0)))
    times = spans.groupBy(by, "type", "value").agg(F.count("*").alias("_times"))
    more = times.join(mapping, [by, "type", "value"]).groupBy(by).agg(F.sum(F.col("_times") * digits).alias("more"))
    sums = settled(P.envelope_sums(seen, [by], F.col("chars"), MAX_CHARS, "blocked", more))
    clean = pii.redacted(P.without_large(records, [by], sums), spans, mapping, by)
    batch = P.with_large(P.records_envelope(record_blocks(clean), [by], "pos", "block", flag="blocked"), [by], sums, "blocked")
    asked = requests.join(batch, by).withColumns({"system": P.system_message("analyze", F.col("language")), "user": P.analyze_message(F.col("prompt"), F.col("records"))})
    got = answered(asked, fn, log, too_large="too_large", blocked="blocked")
    got = got.withColumn("analysis", F.when(F.col("completion.status") == "ok", F.col("completion.content")))
    scored = judged(got, judge, "records", "prompt", "analysis", log)
    back = pii.with_disclaimer(pii.restore(scored, mapping, by, "analysis", retain), "analysis")
    cells = trends.trends_as_struct(trends.coding_trends(records, by, period=period), trends.trend_periods(records, by, period))
    return back.join(cells, by, "left").select(
        by, F.when(F.col("completion.status") == "ok", F.col("analysis")).alias("analysis"), F.col("score").alias("quality_score"), F.col("why").alias("explanation"), F.col("n_records").alias("record_count"),
        F.col("completion.status").alias("status"), F.col("completion.error_class").alias("error_class"), "periods", "cells",
    )


def map_chunks(members: DataFrame, records: DataFrame, requests: DataFrame, fn: Complete, by: str = "corpus_id", concurrency: int = 64, log: CallLog | None = None) -> DataFrame:
    """One row per chunk: by, chunk_id, n_records, source, partial (null if the call failed), completion.

    A chunk that is over the token limit, or holds a record that looks like an injection, is not sent.
    """
    placed = record_blocks(records).join(members.select("id", "chunk_id", "rn"), "id")
    batch = P.records_envelope(placed, [by, "chunk_id"], "rn", "block", MAX_CHARS, "blocked").withColumnRenamed("records", "source")
    asked = batch.join(requests, by).withColumns({"system": P.system_message("map"), "user": P.analyze_message(F.col("prompt"), F.col("source"))})
    got = answered(asked, fn, log, concurrency=concurrency, too_large="too_large", blocked="blocked")
    return got.withColumn("partial", F.when(F.col("completion.status") == "ok", F.col("completion.content"))).select(by, "chunk_id", "n_records", "source", "prompt", "language", "partial", "completion")


def pack_sizes(sizes: Column, room: Column) -> Column:
    """Group numbers of an array of sizes, in order: a group takes the next one while they fit in room; one that is too large is alone.

    Several of them never make one group: then the first half is one, the second another.
    """

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + s <= room)
        return F.struct(F.when(fits, acc["used"] + s).otherwise(s).alias("used"), F.when(fits, acc["g"]).otherwise(acc["g"] + 1).alias("g"), F.concat(acc["out"], F.array(F.when(fits, acc["g"]).otherwise(acc["g"] + 1))).alias("out"))

    first = F.aggregate(F.transform(sizes, lambda x: x.cast("bigint")), F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
    halves = F.transform(sizes, lambda x, i: F.when(i < F.floor(F.size(sizes) / 2), 0).otherwise(1))
    return F.when((F.size(sizes) > 1) & (F.array_max(first) == 0), halves).otherwise(first)


#: Partials of one block of the running pass of pack_partials.
BLOCK = 65_536
#: More requests than this are joined by shuffle, not broadcast.
SMALL = 10_000


def _starts(sizes: np.ndarray, ends: np.ndarray, room) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each item (one more at the end), and for a group that starts at an item where the next one starts, at its corpus's end (ends) at the latest. room: one number, or one for each item."""
    n = len(sizes)
    pre = np.concatenate([[0], np.cumsum(sizes)])
    full = np.minimum.accumulate(np.where(sizes > 0, np.arange(n), n)[::-1])[::-1]  # a group without size takes an item of any size
    return pre, np.minimum(ends, np.maximum(full + 1, np.searchsorted(pre, pre[:-1] + room, side="right") - 1))


def _segments(keys) -> tuple[np.ndarray, np.ndarray]:
    """First item and end of each run of equal keys."""
    codes = pa.chunked_array([keys]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return first, np.append(first[1:], len(codes))


def _whole(batches):
    """The rows of a partition as one batch, or None."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None


def _break_of(used: int, pre, room: int) -> int:
    """The first item that doesn't fit into a group of this size."""
    return max(0, int(np.searchsorted(pre, room - used, side="right")) - 1)


def _block_tables(schema: pa.Schema):
    """For the first and the last corpus of a block, which may go on in other blocks: what the block makes of each state that it may be entered with."""

    def run(batches):
        b = _whole(batches)
        if b is None:
            return
        first, end = _segments(b.column(0))
        for k in sorted({0, len(first) - 1}):
            at, n = int(first[k]), int(end[k] - first[k])
            room = int(b.column(3)[at].as_py())
            sizes = b.column(2).to_numpy()[at : at + n]
            pre, nxt = _starts(sizes, np.full(n, n), room)
            used, made, nxt = [0] * n, [1] * n, nxt.tolist()
            for i in range(n - 1, -1, -1):
                if nxt[i] < n:
                    used[i], made[i] = used[nxt[i]], made[nxt[i]] + 1
                else:
                    used[i] = int(pre[n] - pre[i])
            most = min(n, int(np.searchsorted(pre, max(room, 0))) + 1)  # later items cannot be the first to break
            row = [b.column(0).slice(at, 1), *([x] for x in (b.column(4)[at].as_py(), room, n, int(pre[n]), pre[: most + 1].tolist(), used[:most], made[:most]))]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _carried(schema: pa.Schema):
    """Over the blocks of one corpus in order: the state that each is entered with, and the corpus's size and last group."""

    def run(table):
        table = table.sort_by("_p")
        used = group = seen = 0
        out = []
        for r in table.select(["_p", "room", "n", "total", "pre", "used", "made"]).to_pylist():
            out.append([r["_p"], used, group, seen])
            seen += r["n"]
            k = 0 if used == 0 else _break_of(used, r["pre"], r["room"])
            if used and k >= r["n"]:
                used += r["total"]
            else:
                used, group = r["used"][k], group + r["made"][k] - (used == 0)
        cols = [pa.array([x[k] for x in out], schema.field(k + 1).type) for k in range(4)]
        return pa.Table.from_arrays([table.column(0), *cols, pa.array([seen] * len(out), pa.int64()), pa.array([group] * len(out), pa.int64())], schema=schema)

    return run


def _numbered(schema: pa.Schema):
    """Numbers the groups of a block, whose rows hold the state in the columns from 5 where their corpus may go on elsewhere."""

    def run(batches):
        b = _whole(batches)
        if b is None:
            return
        n = b.num_rows
        first, end = _segments(b.column(0))
        length = end - first
        sizes, room = b.column(2).to_numpy(), b.column(3).to_numpy()
        used, base, seen, whole, last = (b.column(k).fill_null(-1).to_numpy()[first] for k in range(5, 10))
        inside = whole < 0
        used, base, seen = (np.where(inside, 0, x) for x in (used, base, seen))
        pre, nxt = _starts(sizes, np.repeat(end, length), room)
        nxt = nxt.tolist()
        # Only the first corpus of a block is entered with a size.
        at = min(int(end[0]), _break_of(int(used[0]), pre, int(room[0]))) if used[0] else 0
        starts = np.zeros(n, dtype=np.int64)
        while at < n:
            starts[at] = 1
            at = nxt[at]
        made = np.cumsum(starts)
        group = made - np.repeat(made[first] - starts[first] - base + (used == 0), length)
        whole, last = np.where(inside, length, whole), np.where(inside, group[end - 1], last)
        rank = np.arange(n) - np.repeat(first - seen, length)
        one, whole = np.repeat((last == 0) & (whole > 1), length), np.repeat(whole, length)
        group = np.where(one, (rank >= whole // 2).astype(np.int64), group)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(group.astype(np.int32))], schema=schema)

    return run


def pack_partials(df: DataFrame, by: str, size: str, order: str, room: Column | int, block: int = BLOCK) -> DataFrame:
    """(by, order, group) by the rules of pack_sizes over the partials of each corpus; room: characters, the same for all partials of a corpus.

    Partials are dealt by (by, order) into blocks; a block says what it makes of any state that it may be entered with, a pass over
    the blocks of a corpus carries the state over, and each block numbers its groups. No row or task holds a corpus.
    """
    rows = df.select(by, order, F.col(size).cast("bigint").alias("_s"), (F.lit(room) if isinstance(room, int) else room).cast("bigint").alias("_room"))
    n = max(1, -(-rows.count() // block))
    rows = checkpointed(rows.repartitionByRange(n, by, order, "_s").sortWithinPartitions(by, order, "_s").withColumn("_p", F.spark_partition_id()))
    kind = {f.name: f for f in rows.schema.fields}
    state = StructType([kind[by]]).add("_p", "integer").add("room", "long").add("n", "long").add("total", "long").add("pre", ArrayType(LongType())).add("used", ArrayType(LongType())).add("made", ArrayType(LongType()))
    entry = StructType([kind[by]]).add("_p", "integer").add("_used", "long").add("_base", "long").add("_seen", "long").add("_n", "long").add("_last", "long")
    out = StructType([kind[by], kind[order]]).add("group", "integer")
    tables = rows.mapInArrow(_block_tables(to_arrow_schema(state)), state)
    entries = tables.groupBy(by).applyInArrow(_carried(to_arrow_schema(entry)), entry).withColumnsRenamed({by: "_k", "_p": "_q"})
    # Two rows a block.
    entered = rows.join(F.broadcast(entries), rows[by].eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")), "left")
    return entered.select(by, order, "_s", "_room", "_p", "_used", "_base", "_seen", "_n", "_last").mapInArrow(_numbered(to_arrow_schema(out)), out)


def tree_reduce(partials: DataFrame, requests: DataFrame, fn: Complete, grids: DataFrame | None = None, by: str = "corpus_id", budget: int = MAX_TOKENS, cpt: int = CPT, log: CallLog | None = None) -> DataFrame:
    """(by, analysis, status, error_class, rounds): partials (by, ord, partial) joined into one answer for each corpus.

    In each round all corpora take part: one whose partials fit in a message (or that has one alone) is answered with its grid of
    trends; the others' partials are packed into groups and each group is joined. Where every group is a single partial
    joining would not shrink anything, so one message is tried all the same. Sizes are those of whole messages: instructions,
    question, tags, escaped texts, and the grid in the last one. A message over the budget, a partial that looks like an
    injection, or any other failed call ends a corpus as an error row (of its first failed group), so an answer
    always rests on all partials. partials is read several times.
    """
    asked = requests.select(by, "prompt", "language")
    if grids is not None:
        asked = asked.join(grids.select(by, "grid"), by, "left")
    else:
        asked = asked.withColumn("grid", F.lit(None).cast("string"))
    limit = budget * cpt + cpt - 1
    fixed = F.length(P.system_message("reduce", F.col("language")))
    asked = checkpointed(asked.withColumns({"_room": limit - fixed - P.reduce_chars(F.col("prompt")), "_last": limit - fixed - P.reduce_chars(F.col("prompt"), F.col("grid"))}))
    now = partials.where("partial is not null").select(by, "ord", "partial")
    failed = lambda e: (F.lit("error").alias("status"), e.alias("error_class"))
    done, rounds = None, 0
    lost = requests.select(by).join(now, by, "left_anti").select(by, *failed(F.lit("AnalysisError")), F.lit(0).alias("rounds"))
    while not now.isEmpty():
        rounds += 1
        # Only sizes are packed and kept; texts go once to their place and once to their message.
        sized = checkpointed(now.select(by, "ord", P.partial_chars(F.col("partial")).alias("size")).join(F.broadcast(asked.select(by, "_room")) if asked.count() <= SMALL else asked.select(by, "_room"), by))
        plan = checkpointed(sized.join(pack_partials(sized, by, "size", "ord", F.col("_room")), [by, "ord"]))
        per = plan.groupBy(by).agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.count_distinct("group").alias("k")).join(asked.select(by, "_last"), by)
        last = per.select(by, ((F.col("n") <= 1) | (F.col("total") <= F.col("_last")) | (F.col("k") == F.col("n"))).alias("last"))
        plan = plan.join(last, by).select(by, "ord", "size", "last", F.when(F.col("last"), F.lit(0)).otherwise(F.col("group")).alias("group"))
        # A message over the limit is an error row from its length alone; its texts are not gathered.
        sums = plan.groupBy(by, "group", "last").agg(F.sum("size").alias("_size")).join(asked, by)
        sums = sums.withColumn("too_large", F.col("_size") > F.when(F.col("last"), F.col("_last")).otherwise(F.col("_room")))
        sums = checkpointed(sums.withColumn("grid", F.when(F.col("last"), F.col("grid"))).select(by, "group", "last", "prompt", "language", "grid", "too_large"))
        fit = plan.join(sums.where("not too_large").select(by, "group"), [by, "group"]).select(by, "ord", "group")
        texts = now.join(fit, [by, "ord"]).groupBy(by, "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "partial"))), lambda x: x["partial"]).alias("parts"), F.max(injection(F.col("partial")).isNotNull()).alias("blocked"))
        lists = sums.join(texts, [by, "group"], "left")
        lists = lists.withColumns({"system": P.system_message("reduce", F.col("language")), "user": P.reduce_message(F.col("prompt"), F.coalesce("parts", F.array().cast("array<string>")), F.col("grid"))})
        lists = lists.select(by, "group", "last", "system", "user", "too_large", "blocked")
        got = answered(lists, fn, log, max_tokens=budget, chars_per_token=cpt, too_large="too_large", blocked="blocked").select(by, "group", "last", "completion")
        end = got.where("last").select(by, F.when(F.col("completion.status") == "ok", F.col("completion.content")).alias("analysis"), F.col("completion.status").alias("status"), F.col("completion.error_class").alias("error_class"), F.lit(rounds).alias("rounds"))
        done = end if done is None else done.unionByName(end)
        gone = got.where("not last and completion.status <> 'ok'").groupBy(by).agg(F.min_by(F.col("completion.error_class"), F.col("group")).alias("_e"))
        lost = lost.unionByName(gone.select(by, *failed(F.coalesce("_e", F.lit("LLMError"))), F.lit(rounds).alias("rounds")))
        now = checkpointed(got.where("not last").join(gone, by, "left_anti").select(by, F.col("group").alias("ord"), F.col("completion.content").alias("partial")))
    lost = lost.withColumn("analysis", F.lit(None).cast("string"))
    return lost.select(by, "analysis", "status", "error_class", "rounds") if done is None else done.unionByName(lost)


def confidence(df: DataFrame, by: list[str], score: str = "score", weight: str = "n_records") -> DataFrame:
    """Mean score weighted by records over judged chunks: null when none was judged, 0 when their weights are 0."""
    w = F.when(F.col(score).isNotNull(), F.col(weight))
    total = F.sum(w)
    return df.groupBy(*by).agg(F.when(F.count(score) == 0, F.lit(None)).when(total == 0, 0.0).otherwise(F.sum(F.col(score) * w) / total).alias("confidence"), F.count(score).alias("judged"), F.count("*").alias("chunks"), F.min(score).alias("lowest"))


def uncertainty_text(df: DataFrame) -> DataFrame:
    """Adds uncertainty, a sentence on judged, chunks and lowest (the columns of confidence)."""
    out = F.col("chunks") - F.col("judged")
    left_out = F.when(out > 0, F.format_string(" (%d left out, as their judges failed)", out)).otherwise("")
    some = F.concat(F.format_string("The confidence is a mean over %d of %d chunk(s), weighted by records", "judged", "chunks"), left_out, F.format_string("; the lowest score of a chunk is %.2f.", "lowest"))
    return df.withColumn("uncertainty", F.when(F.col("judged") == 0, F.format_string("No confidence: none of the %d chunk(s) could be judged.", "chunks")).otherwise(some))


def judge_chunks(chunks: DataFrame, fn: Complete, log: CallLog | None = None) -> DataFrame:
    """chunks (with source, prompt, partial) with the score of each partial against its own records."""
    return judged(chunks, fn, "source", "prompt", "partial", log)


def analyze_hierarchical(records: DataFrame, requests: DataFrame, labels: DataFrame, fn: Complete, judge: Complete, by: str = "corpus_id", target: int = chunking.TARGET_TOKENS, cap: int = chunking.CAP_TOKENS, budget: int = 100_000, period: str | None = None, retain: tuple[str, ...] = RETAIN, log: CallLog | None = None) -> DataFrame:
    """One row per corpus: analysis, confidence, uncertainty, status and more. labels: (id, label) from clustering, -1 for noise.

    Redact, count trends, cut clusters into chunks, answer each chunk, join the answers, judge each answer against its chunk,
    weigh the scores, turn placeholders back, put the disclaimer first.
    """
    clean, mapping = pii.pseudonymise_records(records, by)
    clean = checkpointed(clean)
    members, _ = chunking.chunk_groups(clean.join(labels, "id").withColumn("n_chars", F.length("content").cast("bigint")), by, target=target, cap=cap)
    members = checkpointed(members)
    chunks = map_chunks(members, clean, requests, fn, by, log=log)
    grids = trends.render_trends(trends.coding_trends(records, by, period=period), trends.trend_periods(records, by, period), by)
    whole = tree_reduce(chunks.select(by, F.col("chunk_id").alias("ord"), "partial"), requests, fn, grids, by, budget, log=log)
    scores = uncertainty_text(confidence(judge_chunks(chunks, judge, log), [by]))
    back = pii.restore(whole, mapping, by, "analysis", retain)
    out = back.join(scores, by, "left")
    return out.select(by, F.when(F.col("status") == "ok", F.concat(F.lit(DISCLAIMER), "analysis")).alias("analysis"), "status", "error_class", "rounds", "confidence", "uncertainty", "chunks", "judged")


SUMMARY = "struct<title:string,summary:string,quality_score:double>"


def _summaries(asked: DataFrame, fn: Complete, keep: list[str], log: CallLog | None = None, **opts) -> DataFrame:
    got = answered(asked, fn, log, **opts).withColumn("_raw", F.col("completion.content"))
    rules = {"score_range": F.coalesce(~F.col("parsed.quality_score").between(0, 1), F.lit(True)), "no_title": F.coalesce(F.col("parsed.title"), F.lit("")) == ""}
    got = parse_structured(got, "_raw", SUMMARY, rules)
    return got.select(*keep, "parsed.title", "parsed.summary", "parsed.quality_score", F.coalesce("completion.error_class", F.when(F.col("parsed_error").isNotNull(), "LLMResponseError")).alias("error_class"))


def summarize(records: DataFrame, fn: Complete, language: Column | None = None, log: CallLog | None = None) -> DataFrame:
    """One row per record: id, title, summary, quality_score, error_class. Empty records are not sent and get blanks with score 0; one that looks like an injection is an error row."""
    full = records.where(F.coalesce(F.length("content"), F.lit(0)) > 0)
    asked = full.withColumns({"system": P.system_message("summarize", language), "user": P.record_envelope(F.col("content"), F.col("id"))})
    blank = records.where(F.coalesce(F.length("content"), F.lit(0)) == 0).select("id", F.lit("").alias("title"), F.lit("").alias("summary"), F.lit(0.0).alias("quality_score"), F.lit(None).cast("string").alias("error_class"))
    return _summaries(asked.select("id", "system", "user", injection(F.col("content")).isNotNull().alias("blocked")), fn, ["id"], log, blocked="blocked").unionByName(blank)


def summarize_bulk(records: DataFrame, fn: Complete, by: str = "corpus_id", language: Column | None = None, log: CallLog | None = None) -> DataFrame:
    """One row per corpus: ids in input order, title, summary, quality_score, error_class."""
    batch = P.records_envelope(record_blocks(records), [by], "pos", "block", MAX_CHARS, "blocked")
    ids = records.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    asked = batch.withColumns({"system": P.system_message("aggregate", language), "user": F.col("records")})
    return _summaries(asked.select(by, "system", "user", "too_large", "blocked"), fn, [by], log, too_large="too_large", blocked="blocked").join(ids, by)


# The kinds of sensitive content.
SENSITIVITY_TYPES = (
    "GENDER_INEQUALITY", "GENDER_DISCRIMINATION", "SEXUAL_VIOLENCE", "SEXUAL_EXPLOITATION",
    "SEXUAL_ABUSE", "GENDER_BASED_VIOLENCE", "CORRUPTION", "FRAUD",
    "CODE_OF_CONDUCT_VIOLATION", "ENVIRONMENTAL_HEALTH_AND_SAFETY_ISSUES", "THREATS_AND_PHYSICAL_VIOLENCE", "ALCOHOL_OR_NARCOTIC_ABUSE",
    "CONFLICT_OF_INTEREST", "THEFT", "EMBEZZLEMENT", "GIFTS_BRIBES_AND_KICKBACKS",
    "PROCUREMENT_OR_TENDER_VIOLATION", "INSIDER_TRADING", "FALSIFICATION_OR_DESTRUCTION_OF_INFORMATION", "NEPOTISM_AND_FAVOURITISM",
    "ABUSE_OF_OFFICIAL_POSITION", "UNFAIR_TREATMENT_OF_EMPLOYEES", "UNFAIR_DISMISSAL", "HARASSMENT",
    "PRIVACY_AND_CONFIDENTIALITY_ISSUES", "WORKPLACE_BULLYING", "SEXUAL_HARASSMENT", "VANDALISM",
    "GIFTS_AND_HOSPITALITY", "ENVIRONMENTAL_VIOLATIONS", "FOOD_SAFETY", "RETALIATION_AGAINST_WHISTLEBLOWERS",
    "INAPPROPRIATE_BEHAVIOUR",
)


def detect_sensitive(records: DataFrame, fn: Complete, log: CallLog | None = None) -> DataFrame:
    """One row per record: id, is_sensitive, sensitivity_types (known ones, each once), explanation, error_class."""
    from .validate import NO_SENSITIVE_CONTENT

    full = F.coalesce(F.length("content"), F.lit(0)) > 0
    asked = records.where(full).select("id", P.system_message("sensitivity").alias("system"), P.record_envelope(F.col("content")).alias("user"), injection(F.col("content")).isNotNull().alias("blocked"))
    got = answered(asked, fn, log, blocked="blocked").withColumn("_raw", F.col("completion.content"))
    known = F.array(*[F.lit(t) for t in SENSITIVITY_TYPES])
    rules = {"unknown_type": F.size(F.array_except(F.coalesce("parsed.sensitivity_types", F.array().cast("array<string>")), known)) > 0}
    got = parse_structured(got, "_raw", "struct<sensitivity_types:array<string>,explanation:string>", rules)
    types = F.array_distinct("parsed.sensitivity_types")
    out = got.select("id", (F.size(types) > 0).alias("is_sensitive"), types.alias("sensitivity_types"), F.col("parsed.explanation").alias("explanation"), F.coalesce("completion.error_class", F.when(F.col("parsed_error").isNotNull(), "LLMResponseError")).alias("error_class"))
    blank = records.where(~full).select("id", F.lit(False).alias("is_sensitive"), F.array().cast("array<string>").alias("sensitivity_types"), F.lit(NO_SENSITIVE_CONTENT).alias("explanation"), F.lit(None).cast("string").alias("error_class"))
    return out.unionByName(blank)


