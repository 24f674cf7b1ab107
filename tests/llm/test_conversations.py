"""Conversation repair against a search over all edits, written without the operator's tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from echoloom.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """(cost, audit, repaired rows): a shortest path over (rows read, roles so far as the pattern's state), least audit first."""

    def state(roles):  # None where roles is no prefix of the pattern
        return next((k for k, p in enumerate(("", "s", "s?(ua)*u", "s?(ua)+")) if re.fullmatch(p, roles)), None)

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        now = state(roles)
        if (at, now) in seen:
            continue
        seen.add((at, now))
        if at == len(rows) and now in (0, 3):
            return cost, audit, kept
        for r in ("user", "assistant"):
            if state(roles + r[0]) is not None:
                heapq.heappush(heap, (cost + 2, audit + "I", at, roles + r[0], (*kept, (r, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles, kept))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role and state(roles + role[0]) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*kept, (role, text))))
                for r in ("user", "assistant"):
                    if state(roles + r[0]) is not None:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, roles + r[0], (*kept, (r, text))))
    raise AssertionError


def plain(rows):
    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, kept = cheapest([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        yield conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_block_tables_find_the_least_audit():
    r, tables = random.Random(3), conversations.block_tables()
    kinds = [(role, fault) for role in ("system", "user", "assistant", "other") for fault in ("", "truncated")] + [("user", "blank")]
    for _ in range(3000):
        own = [r.choice(kinds) for _ in range(r.randint(0, 11))]
        symbols = bytes(8 if f == "blank" else 2 * "suao".index(role[0]) + (f == "truncated") for role, f in own)
        want = cheapest([("?" if role == "other" else role, "x", f) for role, f in own])
        assert tables.repair(symbols) == want[:2], own
    assert len(tables.vectors) < 200
    long = bytes(r.randrange(9) for _ in range(100_003))
    cost, audit = tables.repair(long)
    assert len(audit.replace("I", "")) == len(long)
    assert cost == 3 * audit.count("D") + 2 * audit.count("R") + 2 * audit.count("I") + sum(s % 2 for s, e in zip(long, audit.replace("I", ""), strict=True) if e != "D")


SCHEMA = "conv_id long, turn long, role string, text string, _conv long, place long, gone string"


def rows(seed, convs):
    r = random.Random(seed)
    texts = ["Good.", "Cut off here", " ", "", None, "Same one.", "Why? \n", "é ß!", "tail \x0b"]
    for c in range(convs):
        conv = None if c == 3 else c
        for t in range(r.randint(1, 12)):
            turn = None if r.random() < 0.1 else t if r.random() < 0.8 else r.randint(-3, 40)
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            yield conv, turn, role, r.choice(texts) if r.random() < 0.6 else f"text {r.random()}."
    yield from [(7, 5, "user", "Twice.")] * 4
    yield from [(9, -(2**63), "user", "Far."), (9, 2**63 - 1, "assistant", "Far.")]
    yield from [(1000, t, "user" if t % 2 else "assistant", "w " * 5000 + f"{t}.") for t in range(200)]


def test_repair_against_a_search(spark):
    data = list(rows(5, 120))
    frame = spark.createDataFrame([(*x, 1, 2, "x") for x in data], SCHEMA).repartition(5)
    got = sorted((tuple(x) for x in conversations.repair_conversations(conversations.damaged(frame), gone=conversations.F.col("gone")).collect()), key=str)
    want = [(w[0], min(w[1], 2**63 - 1), *w[2:]) for w in plain(data)]
    assert got == sorted(want, key=str)


def test_repaired_rows_have_the_digest(spark):
    frame = conversations.damaged(spark.createDataFrame([(*x, 1, 2, "x") for x in rows(6, 60)], SCHEMA))
    parts = defaultdict(list)
    for conv, place, role, text in sorted(map(tuple, conversations.repaired_rows(frame, gone=frame["gone"]).collect()), key=lambda x: (str(x[0]), x[1])):
        assert place == len(parts[conv])
        parts[conv].append(f"{role}:{text}")
    for x in conversations.repair_conversations(frame, gone=frame["gone"]).collect():
        lines = parts[x["conv_id"]]
        assert x["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


@pytest.mark.parametrize("gone", [True, False])
def test_nothing_left(spark, gone):
    frame = spark.createDataFrame([(4, 1, "user", "", 0, 0, "")] if gone else [], SCHEMA)
    got = [tuple(x) for x in conversations.repair_conversations(frame, gone=conversations.F.lit(True)).collect()]
    assert got == ([(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] if gone else [])


def test_the_query(spark):
    d = "/root/testdata/sf0.001"
    data = [tuple(x) for x in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, conversations.op12_conversation_repair(spark, d).collect()))
    assert got == sorted(plain(data))
