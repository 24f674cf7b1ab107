"""Repair of conversations: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`, by Four-Russians block tables.

A row is one of nine symbols: its role's initial and whether its text is cut off, or that it must go. What the rest of a
conversation costs from each state of the pattern is a vector of four numbers; less its least entry it is one of a few dozen, so the
step over any BLOCK symbols is a table of (vector, block). Conversations are read from their end, a lookup a block. The edits are
then traced from the start, against that direction: each block is expanded from the vector at its end, and of edits
that cost the same the one whose letter is least in ASCII is taken, which makes the whole audit the least.

Rows are symbols of a byte until the edits are known. Texts travel once, sorted, and are hashed as they pass, so no task holds the
texts of a conversation; it does hold a byte a row, as the audit that is returned does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

BLOCK = 4
#: States of the pattern: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or renamed row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Symbols: 2 * the initial's place (3 for any other), and one more if the text is cut off; DROP must go.
DROP = 8
SYMBOLS = 9
DELETE_COST, CHANGE_COST, INSERT_COST, CUT_COST = 3, 2, 2, 1
#: A row's code is 4 * the initial's place + its fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
SPACES = " \t\n\x0b\x0c\r"

_SYMBOL = bytes((DROP if k % 4 in (BLANK, DUPLICATE) else 2 * (k // 4) + (k % 4 == CUT)) if k < 16 else 0 for k in range(256))
_FAULT = bytes(k % 4 for k in range(256))
_ROLE = bytes(k // 4 if k < 16 else 0 for k in range(256))
_LEGAL = [bytes(INITIALS.index(x) for x in pair) for pair in ("su", "ua", "au")]


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of a row."""
    out = [("D", DELETE_COST, state)]
    if symbol != DROP:
        cut, role = CUT_COST * (symbol % 2), symbol // 2
        if role < len(INITIALS) and (INITIALS[role], state) in KEEP:
            out.append(("K", cut, KEEP[INITIALS[role], state]))
        out.append(("R", CHANGE_COST + cut, NEXT[state]))
    return out


def _inserting(costs: list[int]) -> list[int]:
    """Costs of the rest from each state where rows may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT_COST + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return costs


class BlockTables:
    """vectors: those that occur, number 0 at the end of a conversation. one: by vector and symbol the number of the vector before it and what
    was taken off its entries; step and taken: the same by vector and block."""

    def __init__(self, block: int = BLOCK):
        self.block, self.one = block, []
        self.vectors: list[tuple[int, ...]] = [tuple(_inserting([0, 99, 99, 0]))]
        at = {self.vectors[0]: 0}
        for rest in self.vectors:  # grows as it is read
            row = []
            for symbol in range(SYMBOLS):
                costs = _inserting([min(c + rest[to] for _, c, to in _options(symbol, q)) for q in range(4)])
                before = tuple(c - min(costs) for c in costs)
                if before not in at:
                    at[before] = len(self.vectors)
                    self.vectors.append(before)
                row.append((at[before], min(costs)))
            self.one.append(row)
        vector, off = np.array(self.one, dtype=np.int64).transpose(2, 0, 1)
        step, taken = vector, off
        for _ in range(block - 1):  # a symbol more in front
            taken = (taken[:, None, :] + off[step].transpose(0, 2, 1)).reshape(len(off), -1)
            step = vector[step].transpose(0, 2, 1).reshape(len(off), -1)
        self.step, self.taken = step.tolist(), taken.tolist()
        self._expanded: dict[tuple[int, bytes, int], tuple[str, int]] = {}

    def expand(self, vector: int, symbols: bytes, state: int) -> tuple[str, int]:
        """The edits of a block's rows from a state on, and the state after them; vector: the one at the block's end."""
        key = (vector, symbols, state)
        if key not in self._expanded:
            behind = [vector]
            for s in reversed(symbols):
                behind.append(self.one[behind[-1]][s][0])
            letters = ""
            for s in symbols:
                here = self.vectors[behind.pop()]
                after, off = self.vectors[behind[-1]], self.one[behind[-1]][s][1]
                letter = "I"
                while letter == "I":
                    ways = {x: to for x, cost, to in _options(s, state) if cost + after[to] == here[state] + off}
                    if INSERT_COST + here[NEXT[state]] == here[state]:
                        ways["I"] = NEXT[state]
                    letter = min(ways)
                    letters, state = letters + letter, ways[letter]
            self._expanded[key] = (letters, state)
        return self._expanded[key]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost and, of the audits of that cost, the least."""
        head = len(symbols) % self.block
        cost, vector, behind = 0, 0, []
        for k in range(len(symbols) - self.block, head - 1, -self.block):
            behind.append(vector)
            number = 0
            for s in symbols[k : k + self.block]:
                number = number * SYMBOLS + s
            cost += self.taken[vector][number]
            vector = self.step[vector][number]
        edits = self.expand(vector, symbols[:head], START)
        letters = [edits[0]]
        for s in reversed(symbols[:head]):
            vector, off = self.one[vector][s]
            cost += off
        for k in range(head, len(symbols), self.block):
            edits = self.expand(behind.pop(), symbols[k : k + self.block], edits[1])
            letters.append(edits[0])
        return cost + self.vectors[vector][START], "".join(letters) + {SYSTEM: "II", USER: "I"}.get(edits[1], "")


@cache
def block_tables() -> BlockTables:
    return BlockTables()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LONG = 2**63 - 1


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of sorted partitions: its counts and its audit."""
    out: list[list] = []

    def close() -> None:
        faults, roles = bytes(codes).translate(_FAULT), bytes(codes).translate(_ROLE)
        cost, audit = block_tables().repair(bytes(codes).translate(_SYMBOL))
        gaps = min(last - first + 1 - turns, _LONG) if turns else 0
        out.append([conv, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), max(0, len(roles) - 1) - sum(map(roles.count, _LEGAL)), cost, audit])

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(cols)], names=["_conv", *COUNTS, "audit"])

    known = False
    for b in batches:
        for c, turn, code in zip(*(b.column(x).to_pylist() for x in ("_conv", "_turn", "_code")), strict=True):
            if not known or c != conv:
                if known:
                    close()
                known, conv, codes, first, last, turns = True, c, bytearray(), None, None, 0
            if code is not None:
                codes.append(code)
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
        if len(out) >= 1000:
            yield flush()
    if known:
        close()
    if out:
        yield flush()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation's counts and audit, None) first, then (None, (role, text)) for each of its repaired rows, in order."""

    def inserted() -> Iterator[tuple]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            yield None, (NAMES[state], "")

    audit, at, state = "", 0, START
    for b in batches:
        for head, *own, role, text in zip(*(b.column(x).to_pylist() for x in ("_head", "_conv", *COUNTS, "audit", "_role", "_text")), strict=True):
            if head:
                yield from inserted()  # those behind the last row of the conversation before
                audit, at, state = own[-1], 0, START
                yield own, None
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter != "D":
                state = KEEP[role[0], state] if letter == "K" else NEXT[state]
                yield None, (role if letter == "K" else NAMES[state], text)
    yield from inserted()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    for head, row in _edited(batches):
        if head:
            conv, place = head[0], 0
            continue
        out.append((conv, place, *row))
        place, size = place + 1, size + len(row[1])
        if len(out) >= 10_000 or size > 1 << 24:
            yield _repaired_batch(out)
            out, size = [], 0
    if out:
        yield _repaired_batch(out)


def _repaired_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["_conv", "place", "role", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 7 else pa.string()) for k, c in enumerate(cols)], names=["_conv", *COUNTS, "audit", "repaired_sha256"])

    out: list[list] = []
    for head, row in _edited(batches):
        if head:
            if out:
                out[-1].append(sha.hexdigest())
                if len(out) >= 1000:
                    yield batch()
                    out = []
            out.append(head)
            sha, sep = hashlib.sha256(), b""
        else:
            sha.update(sep + f"{row[0]}:{row[1]}".encode())
            sep = b"\n"
    if out:
        out[-1].append(sha.hexdigest())
        yield batch()


def _coded(rows: DataFrame) -> DataFrame:
    """_conv, _turn and _code of rows (_conv, _turn, _role, _text, _gone), in each conversation's order; no code if a row is gone."""
    bare = F.rtrim(F.col("_text"), F.lit(SPACES))
    initial = F.substring("_role", 1, 1)
    place = F.coalesce(*[F.when(initial == x, F.lit(k)) for k, x in enumerate(INITIALS)], F.lit(len(INITIALS)))
    light = rows.select("_conv", "_turn", "_role", _digest(), "_gone", place.alias("_place"), (bare == "").alias("_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("_cut")).repartition("_conv")
    # Partitioned by conversation already, so the window only sorts.
    n = F.row_number().over(W.partitionBy("_conv", "_gone", "_role", "_digest").orderBy("_turn"))
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_n") > 1, DUPLICATE).when(F.col("_cut"), CUT).otherwise(SOUND)
    ordered = light.withColumn("_n", n).sortWithinPartitions("_conv", "_turn", "_role", "_digest", "_n")
    return ordered.select("_conv", "_turn", F.when(~F.col("_gone"), 4 * F.col("_place") + fault).cast("int").alias("_code"))


def _digest() -> Column:
    return F.unhex(F.sha2("_text", 256)).alias("_digest")


def _inner(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None) -> DataFrame:
    named = [F.col(f"`{c}`").cast(t).alias(n) for c, t, n in ((conv_col, "long", "_conv"), (turn_col, "long", "_turn"))]
    named += [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "_role"), (text_col, "_text"))]
    return rows.select(*named, (F.lit(False) if gone is None else gone).alias("_gone"))


_AUDIT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def _in_order(inner: DataFrame) -> DataFrame:
    """Rows of each conversation in order, the row of its audit before them."""
    audits = _coded(inner).mapInArrow(_audited, f"_conv long, {_AUDIT}")
    heads = audits.select("_conv", F.lit(True).alias("_head"), *COUNTS, "audit")
    rows = inner.where("not _gone").select("_conv", F.lit(False).alias("_head"), "_turn", "_role", _digest(), "_text")
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("_conv").sortWithinPartitions("_conv", F.desc("_head"), "_turn", "_role", "_digest")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text` lines).

    Rows are taken by turn, nulls first, then by role and SHA-256 of the text; equal rows are rows each for itself. A null role or
    text is one space, so such a text is blank; rows without a conversation are one conversation, whose id is null. Rows where
    `gone` is true count for nothing, but a conversation that has no others is returned: zeros, an empty audit, the digest of nothing. An
    empty text is blank; texts and conversations of any length are read whole. Columns beside the four may have any name. An empty table gives an empty result.
    """
    done = _in_order(_inner(rows, conv_col, turn_col, role_col, text_col, gone)).mapInArrow(_hashed, f"_conv long, {_AUDIT}, repaired_sha256 string")
    return done.withColumnRenamed("_conv", conv_col)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: id, place from 0, role, text. Rows and nulls as in repair_conversations; a conversation of which nothing stays has no row."""
    done = _in_order(_inner(rows, conv_col, turn_col, role_col, text_col, gone)).mapInArrow(_rows, "_conv long, place long, role string, text string")
    return done.select(F.col("_conv").alias(conv_col), "place", F.col("role").alias(role_col), F.col("text").alias(text_col))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with the query's damage: conv_id, turn, role, text, gone."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    once = once.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_kind")
    return once.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text", (F.col("_kind") == 0).alias("gone"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL: dict[str, str] = {}
