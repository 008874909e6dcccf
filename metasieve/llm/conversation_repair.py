"""Repair of conversations to the grammar (s?(ua)+)? at least cost: keep, rerole, delete and insert.

A grammar state is what the repaired roles end in: nothing, a system turn, a user turn, an assistant turn. Conversations
are dealt by hash; a task takes batches of them and runs one recursive DuckDB query for a batch: each recursion advances one
turn in all its conversations and keeps, for each state, the least cost and of its audits the ASCII-least. Audits of equal
cost and state never start with one another, so the least prefix stays the least.

A conversation of more than SEGMENT turns is cut. Its turns are sorted over many tasks, numbered in segments, and the same
query runs on each segment from every state. The segments' tables are then composed in order: what all states agree on is
given out at once, so only undecided turns are held. Each segment is rewritten by its own part of the audit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from os.path import commonprefix

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasieve.llm.common import bounded_batches, stored

#: Turns of a segment of a long conversation; turns of a batch.
SEGMENT, BATCH = 512, 20_000
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: nothing, after system, after user, after assistant. NEXT[state][initial] is the state that a turn leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INITIALS, LEGAL = "sua", {"su", "ua", "au"}
#: Role that a reroled or inserted turn takes in each state.
ROLE = ("user", "user", "assistant", "user")
#: What ends a conversation from each state, and its cost.
ENDS = (("", 0), ("II", 2 * INSERT), ("I", INSERT), ("", 0))
#: Faults of a turn.
WHOLE, SHORT, BLANK, REPEATED = range(4)

_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_END = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def _moves() -> list[tuple[int, int, int, int, str]]:
    """(state, kind, next state, cost, letters): the cheapest ways past a turn, with what is inserted before it.

    kind is 3 * the number of the turn's initial (3 for any other) + 0 whole, 1 truncated, 2 to be deleted.
    """
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for state in range(4):
        before = [(state, 0, "")]
        while (to := NEXT[before[-1][0]][ROLE[before[-1][0]][0]]) not in [s for s, _, _ in before]:
            before.append((to, before[-1][1] + INSERT, before[-1][2] + "I"))
        for mid, cost, letters in before:
            for kind in range(12):
                initial, fault = (*INITIALS, " ")[kind // 3], kind % 3
                ways = [(mid, DELETE, "D")]
                if fault < 2:
                    ways.append((NEXT[mid][ROLE[mid][0]], REROLE + TRUNCATED * fault, "R"))
                    if initial in NEXT[mid]:
                        ways.append((NEXT[mid][initial], TRUNCATED * fault, "K"))
                for to, more, letter in ways:
                    way, key = (cost + more, letters + letter), (state, kind, to)
                    best[key] = min(best.get(key, way), way)
    return [(*key, *way) for key, way in best.items()]


WALK = """
WITH RECURSIVE walk AS (
    SELECT g, 0 AS pos, start, start AS state, {'cost': 0, 'audit': ''} AS best FROM groups, starts
    UNION ALL
    SELECT w.g, w.pos + 1, w.start, m.target, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters})
    FROM walk w JOIN turns t ON t.g = w.g AND t.pos = w.pos JOIN moves m ON m.state = w.state AND m.kind = t.kind
    GROUP BY ALL
)
SELECT w.g, w.start, w.state, w.best.cost, w.best.audit FROM walk w JOIN groups USING (g) WHERE w.pos = groups.n
"""


def walked(kinds: list[list[int]], starts: Iterable[int]) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """For each list of kinds of turns: (start state, end state) -> (least cost, its least audit)."""
    out: list[dict[tuple[int, int], tuple[int, str]]] = [{} for _ in kinds]
    sizes = np.array([len(k) for k in kinds], np.int64)
    moves = pa.table(dict(zip(("state", "kind", "target", "cost", "letters"), map(list, zip(*_moves(), strict=True)), strict=True)))
    turns = pa.table({"g": np.repeat(np.arange(len(kinds)), sizes), "pos": np.concatenate([np.arange(n) for n in sizes]), "kind": np.concatenate([np.array(k, np.int64) for k in kinds])})
    with duckdb.connect(config={"threads": 1}) as con:
        con.register("groups", pa.table({"g": np.arange(len(kinds)), "n": sizes}))
        con.register("starts", pa.table({"start": list(starts)}))
        con.register("given", turns)
        con.register("given_moves", moves)
        con.execute("CREATE TABLE turns AS FROM given ORDER BY pos; CREATE TABLE moves AS FROM given_moves")
        for g, start, state, cost, audit in con.execute(WALK).fetchall():
            out[g][start, state] = cost, audit
    return out


def fault_of(text: str, repeated: bool) -> int:
    if not _SOLID.search(text):
        return BLANK
    return REPEATED if repeated else WHOLE if _END.search(text)[1] in ".!?" else SHORT


def kind_of(role: str, fault: int) -> int:
    initial = INITIALS.find(role[0]) if role and role[0] in INITIALS else 3
    return 3 * initial + min(fault, BLANK)


def illegal_pairs(initials: list[str]) -> int:
    return sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))


def rewritten(rows: Iterable[tuple[str, str]], audit: str, state: int) -> list[str]:
    """The repaired `role:text` lines that an audit makes of rows (role, text), from a state."""
    out, rows = [], iter(rows)
    for letter in audit:
        role, text = (ROLE[state], "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "R":
            role = ROLE[state]
        out.append(f"{role}:{text}")
        state = NEXT[state][role[0]]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of equal first columns, in order."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True))
    for key, run in groupby(rows, lambda r: r[:keys]):
        yield key, list(run)


def _batched(runs: Iterator[tuple[tuple, list[tuple]]]) -> Iterator[list[tuple[tuple, list[tuple]]]]:
    """Runs in batches of about BATCH rows."""
    held, n = [], 0
    for key, run in runs:
        held.append((key, run))
        n += len(run)
        if n >= BATCH:
            yield held
            held, n = [], 0
    if held:
        yield held


def _rows(names: str, out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names.split())


COLUMNS = "cn boolean, ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES, _KINDS = "cn ck gaps blank duplicate truncated illegal cost audit repaired_sha256", [pa.bool_(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from sorted rows cn, ck, tn, t, role, text, copies."""
    for batch in _batched(_runs(batches, 2)):
        turns, faults = [], []
        for _, run in batch:
            turns.append([r for r in run for _ in range(r[6])])
            seen: set[tuple[str, str]] = set()
            faults.append([])
            for r in turns[-1]:
                faults[-1].append(fault_of(r[5], (r[4], r[5]) in seen))
                seen.add((r[4], r[5]))
        ways = walked([[kind_of(r[4], f) for r, f in zip(t, fs, strict=True)] for t, fs in zip(turns, faults, strict=True)], [0])
        out = []
        for (key, _), rows, found, way in zip(batch, turns, faults, ways, strict=True):
            cost, audit = min((c + ENDS[s][1], a + ENDS[s][0]) for (_, s), (c, a) in way.items())
            numbers = {r[3] for r in rows if r[2]}
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            lines = "\n".join(rewritten(((r[4], r[5]) for r in rows), audit, 0))
            out.append((*key, gaps, found.count(BLANK), found.count(REPEATED), found.count(SHORT), illegal_pairs([r[4][:1] for r in rows]), cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
        yield _rows(_NAMES, out, _KINDS)


def _segments(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows with their segment's number in this task behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            chunks = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = n + 1 if key == last else 0
                last = key
                chunks.append(n // size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.int32())], [*b.schema.names, "chunk"])

    return run


SEGMENT_COLUMNS = "cn boolean, ck string, part int, chunk int, blank long, duplicate long, truncated long, illegal long, head string, tail string, ways array<struct<start: int, state: int, cost: long, audit: string>>"


def _segment_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from sorted rows cn, ck, part, chunk, role, text, repeated."""
    for batch in _batched(_runs(batches, 4)):
        faults = [[fault_of(r[5], r[6]) for r in run] for _, run in batch]
        ways = walked([[kind_of(r[4], f) for r, f in zip(run, fs, strict=True)] for (_, run), fs in zip(batch, faults, strict=True)], range(4))
        out = []
        for (key, run), found, way in zip(batch, faults, ways, strict=True):
            initials = [r[4][:1] for r in run]
            out.append((*key, found.count(BLANK), found.count(REPEATED), found.count(SHORT), illegal_pairs(initials), initials[0], initials[-1], [{"start": a, "state": b, "cost": c, "audit": x} for (a, b), (c, x) in way.items()]))
        kinds = [pa.bool_(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
        yield _rows("cn ck part chunk blank duplicate truncated illegal head tail ways", out, kinds)


PATH_COLUMNS = "cn boolean, ck string, part int, chunk int, start int, audit string, ending boolean, blank long, duplicate long, truncated long, illegal long, cost long"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in order: a row for each with its start state and part of the best audit, then one for each conversation.

    A conversation's own row (ending) has its counts, its cost, the whole audit and the state before its last insertions.
    """
    kinds = [pa.bool_(), pa.string(), *[pa.int32()] * 3, pa.string(), pa.bool_(), *[pa.int64()] * 5]
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(11)), strict=True))
    for key, segments in groupby(rows, lambda r: r[:2]):
        # state -> (cost, audit behind what is decided, undecided (part, chunk, start, audit))
        front, decided, out, counts, last = {0: (0, "", [])}, [], [], [0, 0, 0, 0], None
        for _, _, part, chunk, *own, head, tail, ways in segments:
            counts = [x + y for x, y in zip(counts, own, strict=True)]
            counts[3] += last is not None and last + head not in LEGAL
            last, new = tail, {}
            for w in ways:
                if w["start"] in front:
                    cost, audit, path = front[w["start"]]
                    way = (cost + w["cost"], audit + w["audit"], [*path, (part, chunk, w["start"], w["audit"])])
                    if w["state"] not in new or way[:2] < new[w["state"]][:2]:
                        new[w["state"]] = way
            common = commonprefix([a for _, a, _ in new.values()])
            decided.append(common)
            front = {s: (c, a[len(common) :], p) for s, (c, a, p) in new.items()}
            while (paths := [p for _, _, p in front.values()])[0] and all(p and p[0] == paths[0][0] for p in paths):
                part_, chunk_, start, piece = paths[0][0]
                out.append((*key, part_, chunk_, start, piece, False, *[None] * 5))
                front = {s: (c, a, p[1:]) for s, (c, a, p) in front.items()}
            if len(out) >= 1000:
                yield _rows("cn ck part chunk start audit ending blank duplicate truncated illegal cost", out, kinds)
                out = []
        cost, audit, state = min((c + ENDS[s][1], a + ENDS[s][0], s) for s, (c, a, _) in front.items())
        out += [(*key, *step[:3], step[3], False, *[None] * 5) for step in front[state][2]]
        out.append((*key, None, None, state, "".join(decided) + audit, True, *counts, cost))
        yield _rows("cn ck part chunk start audit ending blank duplicate truncated illegal cost", out, kinds)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cn, ck, part, chunk, lines of segments, from sorted rows cn, ck, part, chunk, start, audit, role, text."""
    for batch in _batched(_runs(batches, 4)):
        out = [(*key, rewritten(((r[6], r[7]) for r in run), run[0][5], run[0][4])) for key, run in batch]
        yield _rows("cn ck part chunk lines", out, [pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cn, ck, repaired_sha256 from each conversation's lines in order."""
    rows = (r for b in batches for r in zip(b.column("cn").to_pylist(), b.column("ck").to_pylist(), b.column("lines").to_pylist(), strict=True))
    for key, run in groupby(rows, lambda r: r[:2]):
        digest, any_ = hashlib.sha256(), False
        for _, _, lines in run:
            if lines:
                digest.update((("\n" if any_ else "") + "\n".join(lines)).encode())
                any_ = True
        yield _rows("cn ck repaired_sha256", [(*key, digest.hexdigest())], [pa.bool_(), pa.string(), pa.string()])


def _long(rows: DataFrame, size: int) -> DataFrame:
    """Conversations cut in segments, from rows cn, ck, tn, t, role, text, copies."""
    order = ["cn", "ck", "tn", "t", "role", "text", "uid", "copy"]
    turns = rows.filter("copies > 0").withColumn("uid", F.monotonically_increasing_id()).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    turns = stored(turns.select(*order), "turns")
    first = turns.groupBy("cn", "ck", "role", "text").agg(F.min(F.struct("tn", "t", "uid", "copy")).alias("first"))
    known = turns.join(first, ["cn", "ck", "role", "text"]).select(*order, (F.col("first") != F.struct("tn", "t", "uid", "copy")).alias("repeated"))
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    cut = stored(dealt.mapInArrow(_segments(size), f"{kinds}, chunk int"), "segments")
    segment = ["cn", "ck", "part", "chunk"]
    by_segment = cut.repartition(*segment).sortWithinPartitions(*segment, *order[2:])
    ways = stored(by_segment.select(*segment, "role", "text", "repeated").mapInArrow(_segment_ways, SEGMENT_COLUMNS), "ways")
    path = stored(ways.repartition("cn", "ck").sortWithinPartitions(*segment).mapInArrow(_composed, PATH_COLUMNS), "path")
    ends = path.filter("ending")
    steps = path.filter("NOT ending").select(*segment, "start", "audit")
    lines = cut.join(steps, segment).repartition(*segment).sortWithinPartitions(*segment, *order[2:]).select(*segment, "start", "audit", "role", "text").mapInArrow(_rewritten, "cn boolean, ck string, part int, chunk int, lines array<string>")
    inserted = F.when(F.col("start") == 1, F.array(F.lit("user:"), F.lit("assistant:"))).when(F.col("start") == 2, F.array(F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    lines = lines.unionByName(ends.select("cn", "ck", F.lit(2**31 - 1).alias("part"), F.lit(0).alias("chunk"), inserted.alias("lines")))
    digests = lines.repartition("cn", "ck").sortWithinPartitions(*segment).mapInArrow(_digests, "cn boolean, ck string, repaired_sha256 string")
    numbers = turns.groupBy("cn", "ck").agg(F.coalesce(F.max(F.when(F.col("tn"), F.col("t"))) - F.min(F.when(F.col("tn"), F.col("t"))) + 1 - F.countDistinct(F.when(F.col("tn"), F.col("t"))), F.lit(0).cast("long")).alias("gaps"))
    return ends.join(numbers, ["cn", "ck"]).join(digests, ["cn", "ck"]).select("cn", "ck", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """cn, ck (conversation: null or its text), tn, t (turn: given and number), role, text, copies of every row, damaged.

    The remainder of crc32(`conv_id:turn`) by 20: 0 drops the row (no copies), 1 empties the text, 2 removes its [.!?],
    3 repeats the row, 4 makes it a user's. A null counts as one space, but in the order of turns, where it comes first.
    """
    space = F.lit(" ")
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    fate = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.select(
        F.col("conv_id").isNull().alias("cn"), conv.alias("ck"), F.col("turn").isNotNull().alias("tn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.when(fate == 4, "user").otherwise(role).alias("role"), F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """cn, ck, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    rows are those of `damaged`: a conversation's turns in order of tn, t, role, text; those without copies only name their
    conversation. A role counts by its initial; a role that starts with none of s, u, a cannot stay as it is. A
    conversation without turns has zeros, an empty audit and the hash of the empty text. An empty table gives an empty
    result. Texts of a conversation of `segment` turns or fewer are held together, longer ones are cut.
    """
    spark = rows.sparkSession
    keys, order = ["cn", "ck"], ["cn", "ck", "tn", "t", "role", "text", "copies"]
    rows = rows.select(*order)
    long = stored(rows.groupBy(*keys).agg(F.sum("copies").alias("n")).filter(F.col("n") > segment).select(*keys), "long-conversations")
    bounded_batches(spark)
    some = long.limit(1).count()
    short = rows.join(long, keys, "left_anti") if some else rows
    out = short.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_whole, COLUMNS)
    return out.unionByName(_long(rows.join(long, keys, "left_semi"), segment)) if some else out


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id, damaged first.

    conversations has conv_id, turn, role, text; other columns are ignored. See `damaged` and `repair`.
    """
    kind = conversations.schema["conv_id"].dataType
    found = repair(damaged(conversations), segment)
    return found.select(F.when(~F.col("cn"), F.col("ck").cast(kind)).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
