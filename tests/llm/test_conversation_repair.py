"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from metasieve.llm import conversation_repair
from metasieve.llm.conversation_repair import repair_conversations


def shortest(rows):
    """(cost, audit, repaired lines) of rows (initial, role, text, must go, truncated) by uniform-cost search."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        tail = roles if roles in ("", "s") else ("u" if roles[-1] == "u" else "a")
        if (at, tail, "end") in done:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        done.add((at, tail, "end"))
        needed = "assistant" if roles[-1:] == "u" else "user"

        def push(more, letter, step, role=None, text="", cost=cost, audit=audit, at=at, roles=roles, lines=lines):
            heapq.heappush(heap, (cost + more, audit + letter, at + step, roles + (role[:1] if role else ""), (*lines, f"{role}:{text}") if role else lines))

        push(5, "I", 0, needed)
        if at < len(rows):
            role, text, gone, short = rows[at]
            push(2, "D", 1)
            if not gone:
                push(1 + 5 * short, "R", 1, needed, text)
                if role[:1] and re.match("(s?(ua)*u?)$", roles + role[:1]) and role[:1] in "sua":
                    push(5 * short, "K", 1, role, text)
    raise AssertionError


def brute(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            c, t, role, text = (" " if x is None else x for x in (c, turn, role, text))
            fate = zlib.crc32(f"{c}:{t}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        rows.sort()
        seen, faults = set(), []
        for _, _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for given, t, _, _ in rows if given]
        cost, audit, lines = shortest([(r, x, f in ("b", "d"), f == "t") for (_, _, r, x), f in zip(rows, faults, strict=True)])
        pairs = [x[2][:1] + y[2][:1] for x, y in zip(rows, rows[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, n):
    rng = random.Random(seed)
    rows = [(None, None, None, None), (None, 1, "user", "x."), (10_000, None, "user", None), (10_001, 0, "user", "Hi."), (10_002, 2**40, "assistant", "é" * 5000 + ".")]
    rows += [(20_000 + k, t, "system", "Go.") for k in range(40) for t in range(2)]
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            turn = rng.choice([turn] * 12 + [None, turn + 3])
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", None, "", "User"])
            text = rng.choice(["One.", "Two!", "Three? \n", "four", "", " \t", None, "a: b.\nc", f"{rng.random()}."])
            rows += [(conv, turn, role, text)] * rng.choice([1] * 9 + [2])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "segment", "batch"), [(1, 512, 20_000), (2, 512, 7), (3, 3, 20), (4, 1, 20_000)])
def test_repairs_equal_those_of_a_search(spark, monkeypatch, seed, segment, batch):
    monkeypatch.setattr(conversation_repair, "BATCH", batch)
    rows = table(seed, 90)
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, t int, audit string")
    got = repair_conversations(given.repartition(3), segment).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_one_conversation_has_nearly_all_rows(spark):
    rng = random.Random(7)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"{k}.", "cut"])) for k in range(1200)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair_conversations(given, 50).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table_and_text_ids(spark):
    kind = "conv_id string, turn long, role string, text string"
    assert repair_conversations(spark.createDataFrame([], kind)).count() == 0
    got = repair_conversations(spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "assistant", "Ho.")], kind)).first()
    assert got.conv_id == "x"
