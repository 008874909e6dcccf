"""Benchmark decontamination by pigeonhole edit matching.

Texts are sequences of lower-cased words. A test item of m words may differ from a passage of a document by at most
floor(ERRORS * m) word edits. Cut into one more piece than that, an item that matches has at least one piece unharmed, so
one Aho-Corasick pass over a document finds every place worth a look; Myers' bit-parallel algorithm, with a bit for each
word of the item, then computes the edit distance over the window around it.

The items go to the executors in blocks of bounded size. A benchmark of more than one block is matched block by block,
each against all documents, so nothing that is broadcast grows with the benchmark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from metasieve.llm.common import bounded_batches

#: Word edits allowed for each word of an item.
ERRORS = 0.2
#: Characters of item text in one broadcast block.
BLOCK_CHARS = 8 << 20

_GAPS = re.compile(r"[\W_]+")


def words_of(text: str) -> str:
    """The lower-cased words of a text (letters and digits of any script), with one space around each."""
    return f" {_GAPS.sub(' ', text.lower()).strip()} "


def pieces(words: list[str], budget: int) -> list[tuple[int, str]]:
    """(first word, text) of budget + 1 pieces of nearly equal length, none empty."""
    n = min(budget + 1, len(words))
    cuts = [len(words) * k // n for k in range(n + 1)]
    return [(a, f" {' '.join(words[a:b])} ") for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """For each position of text, the least edit distance of pattern to a stretch of text that ends there."""
    m = len(pattern)
    at: dict[str, int] = {}
    for k, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << k
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = at.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hm = (minus | ~(d | plus)) & full, plus & d
        if hp & last:
            score += 1
        elif hm & last:
            score -= 1
        hp = hp << 1 & full
        plus, minus = (hm << 1 | ~(d | hp)) & full, hp & d
        out.append(score)
    return out


class Matcher:
    """Items (id, text) made ready to be found in documents."""

    def __init__(self, items: list[tuple[object, str]], errors: float = ERRORS):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if words := words_of(text).split():
                budget = int(errors * len(words) + 1e-9)
                for first, piece in pieces(words, budget):
                    found.setdefault(piece, []).append((len(self.items), first))
                self.items.append((item_id, words, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if self.items:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, distance, budget, n_words, first_word, last_word) of the best match of each item within its budget.

        Of equal distances the earliest counts. Word numbers are positions in the document, both ends included.
        """
        if not text or not self.items:
            return []
        s = words_of(text)
        best: dict[int, tuple[int, int, int]] = {}
        words: list[str] | None = None
        seen: dict[int, list[tuple[int, int]]] = {}
        counted, words_before = 0, 0
        for end, (length, where) in self.automaton.iter(s):
            if words is None:
                words = s.split()
            begin = end - length + 1
            words_before += s.count(" ", counted, begin) if begin >= counted else -s.count(" ", begin, counted)
            counted = begin
            for k, first in where:
                _, pattern, budget = self.items[k]
                a = max(0, words_before - first - budget)
                b = min(len(words), words_before - first + len(pattern) + budget)
                spans = seen.setdefault(k, [])
                if spans and spans[-1][0] <= a and b <= spans[-1][1]:
                    continue
                spans.append((a, b))
                distances = myers(pattern, words[a:b])
                least = min(distances)
                if least <= budget and (k not in best or least < best[k][0]):
                    stop = a + distances.index(least)
                    back = myers(pattern[::-1], words[max(0, stop - len(pattern) - budget + 1) : stop + 1][::-1])
                    best[k] = (least, stop - back.index(least), stop)
        return [(self.items[k][0], d, self.items[k][2], len(self.items[k][1]), a, b) for k, (d, a, b) in sorted(best.items())]


@lru_cache(maxsize=2)
def _matcher(key: str, errors: float, items) -> Matcher:
    """One per block and worker process; items is a broadcast variable."""
    return Matcher(items.value, errors)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks; only one block is on the driver's side of the iterator at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, n_words, first_word, last_word: each item that a document holds within its budget.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Null, empty and wordless texts match
    nothing. Repeated documents or items give a row each. Items of fewer than 1 / errors words must match exactly. An
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = "long" if isinstance(benchmark.schema["item_id"].dataType, IntegralType) else "string"
    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance int, budget int, n_words int, first_word int, last_word int"
    source = docs.select("doc_id", "text")

    def scan(items) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, errors, items)
            for b in batches:
                at, rows = [], []
                for k, t in enumerate(b.column(1).to_pylist()):
                    for m in matcher.matches(t):
                        at.append(k)
                        rows.append(m)
                if rows:
                    item, *numbers = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(item, pa.int64() if item_kind == "long" else pa.string()), *(pa.array(x, pa.int32()) for x in numbers)], names)

        names = ["doc_id", "item_id", "distance", "budget", "n_words", "first_word", "last_word"]
        return source.mapInArrow(run, schema)

    wanted = benchmark.select(F.col("item_id").cast(item_kind), "text").filter(F.col("text").isNotNull())
    found = [scan(spark.sparkContext.broadcast(block)) for block in _blocks(wanted, block_chars)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item within its error budget.

    Each row is judged by its own text, so neither null nor repeated ids matter; null and empty texts hold nothing and stay.
    Other columns may have any name. An empty table gives none, and an empty benchmark drops nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    at_text = docs.columns.index("text")

    def clean(rows: DataFrame, items) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, errors, items)
            for b in batches:
                yield b.filter(pa.array([not matcher.matches(t) for t in b.column(at_text).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    wanted = benchmark.select(F.col("item_id").cast("string"), "text").filter(F.col("text").isNotNull())
    return reduce(clean, (spark.sparkContext.broadcast(block) for block in _blocks(wanted, block_chars)), docs)
