"""Phrase collocations by hierarchical pair naming.

A phrase of k words is a pair of adjacent phrases of k - 1 words that overlap in all but one. Words that are frequent get
ids; adjacent ids are counted as pairs, the frequent pairs get ids in turn, and these take the place of the ids at their
positions for the next length. A name's two halves are its parents: following them gives every cut's first part and rest,
and the names that have a phrase as parent are the longer phrases that may subsume it.

Texts are held in portions: the word numbers of about PORTION characters of one language, in the portion's own vocabulary.
Of each distinct word or pair of a portion one entry is counted, so a word in every text makes one entry for a portion.
Pairs are counted in cells of their hash, packed in arrays; a cell names its frequent pairs and answers each portion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metasieve.llm.common import BATCH_BYTES, bounded_batches, stored
from metasieve.llm.ngram_join import _STEP, _mixed

#: Longest phrase in words; least count; a longer phrase subsumes with this percentage of the count; phrases of a language.
LONGEST, LEAST, SUBSUMED, TOP = 3, 10, 50, 2000
#: Language of texts that have none.
UNKNOWN = "und"
#: Characters of a portion; entries of a cell.
PORTION, CELL = 4 << 20, 1 << 20

#: The contract's separators end a piece; tab and space end a word.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def numbered(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(word numbers of all texts in turn, -1 where a piece ends, the words by number, how often each occurs)."""
    joined = "\n".join(texts).encode().lower().translate(_ENDS).replace(b"\n", b" \n ").decode()
    coded = pc.split_pattern(pa.array([joined], pa.large_string()), " ").values.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    real = np.array([w not in ("", "\n") for w in words], bool)
    number = np.where(real, np.cumsum(real) - 1, -1)
    if "" in words:
        at = at[at != words.index("")]
    seq = number[at].astype(np.int32)
    return seq, [w for w, r in zip(words, real, strict=True) if r], np.bincount(seq[seq >= 0], minlength=int(real.sum()))


def paired(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of pairs by position, left ids, right ids, counts) of neighbours in seq whose ids are both known.

    ids holds the id of each number of seq, 0 where it has none; a position without a pair is -1. Pairs ascend by ids.
    """
    known = np.r_[ids, 0][seq]
    both = (known[:-1] > 0) & (known[1:] > 0) if len(seq) > 1 else np.zeros(0, bool)
    out = np.full(len(seq), -1, np.int32)
    if not both.any():
        return out, *(np.zeros(0, np.int64),) * 3
    distinct, place = np.unique(known, return_inverse=True)  # 0 may be among them, never in a pair
    at = np.flatnonzero(both)
    keys, number, counts = np.unique(place[at].astype(np.int64) * len(distinct) + place[at + 1], return_inverse=True, return_counts=True)
    out[at] = number
    return out, distinct[keys // len(distinct)], distinct[keys % len(distinct)], counts


def _narrow(ids: np.ndarray) -> bytes:
    """ids as 32-bit integers where they fit, else as 64-bit ones; what reads them knows how many there are."""
    return ids.astype(np.uint32 if not len(ids) or ids.max() < 1 << 32 else np.uint64).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint64 if n and len(data) == 8 * n else np.uint32).astype(np.int64)


def _cell_of(a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    h = _mixed(a.astype(np.uint64) * _STEP + b.astype(np.uint64))
    return ((h >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _portions(docs: DataFrame) -> DataFrame:
    """lang, pid, seq, words, counts: portions of the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size, task, made = 0, None, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                seq, words, counts = numbered(texts)
                if len(words):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([f"{task}-{made}"]), pa.array([seq.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["lang", "pid", "seq", "words", "counts"])
                made += 1

        for b in batches:
            for lang, text, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                task = part
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
                if size >= PORTION:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "lang string, pid string, seq binary, words array<string>, counts array<long>")


def _named_portions(portions: DataFrame, words: DataFrame) -> DataFrame:
    """pid, lang, seq, ids: the id of each word number of a portion, as bytes; 0 for a word that has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            filled = []
            for n, got in zip(b.column("n").to_pylist(), b.column("got"), strict=True):
                ids = np.zeros(n, np.int64)
                if got.is_valid and len(got.values):
                    ids[got.values.field(0).to_numpy()] = got.values.field(1).to_numpy()
                filled.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("seq"), pa.array(filled, pa.binary())], ["pid", "seq", "ids"])

    entries = portions.select("pid", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    got = entries.groupBy("pid").agg(F.collect_list(F.struct("at", "id")).alias("got"))
    rows = portions.select("pid", "seq", F.size("words").alias("n")).join(got, "pid", "left")
    return rows.select("pid", "seq", "n", "got").mapInArrow(run, "pid string, seq binary, ids binary")


def _counted(named: DataFrame, least: int, cells: int) -> DataFrame:
    """kind 0: a, b, f, ids (packed) of the frequent pairs of a cell. kind 1: pid, a (places among the portion's pairs), ids.

    Pairs travel packed by cell; rows of a cell meet in one task, which holds one cell at a time. A portion gives each
    distinct pair once, so no pair outweighs a cell.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, seq, ids in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                _, a, c, n = paired(np.frombuffer(seq, np.int32), np.frombuffer(ids, np.int64))
                if not len(n):
                    continue
                cell = _cell_of(a, c, cells)
                order = np.argsort(cell, kind="stable")
                stops = np.flatnonzero(np.r_[cell[order][1:] != cell[order][:-1], True]) + 1
                spans = [order[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)]
                for k in range(0, len(spans), 64):
                    part = spans[k : k + 64]
                    columns = [pa.array([int(cell[s[0]]) for s in part], pa.int64()), pa.array([pid] * len(part)), *(pa.array([f(s) for s in part], pa.binary()) for f in (lambda s: s.astype(np.int32).tobytes(), lambda s: _narrow(a[s]), lambda s: _narrow(c[s]), lambda s: _narrow(n[s])))]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "pid", "at", "a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            sizes = [len(r[1]) // 4 for r in held]
            a, b, n = (np.concatenate([_wide(r[k], s) for r, s in zip(held, sizes, strict=True)]) for k in (2, 3, 4))
            order = np.lexsort((b, a))
            new = np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]
            first, group = np.flatnonzero(new), np.empty(len(a), np.int64)
            group[order] = np.cumsum(new) - 1
            f = np.add.reduceat(n[order], first)
            frequent = f >= least
            ids = np.where(frequent, (np.cumsum(frequent) - 1) * cells + cell + 1, 0)
            if not frequent.any():
                return
            told = [(0, None, *(v[frequent].tobytes() for v in (a[order][first], b[order][first], f, ids)))]
            mine, at = ids[group], 0
            for (pid, places, *_), s in zip(held, sizes, strict=True):
                some = np.flatnonzero(mine[at : at + s])
                if len(some):
                    told.append((1, pid, np.frombuffer(places, np.int32)[some].astype(np.uint32).tobytes(), None, None, _narrow(mine[at : at + s][some])))
                at += s
            for k in range(0, len(told), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told[k : k + 256], strict=True), (pa.int32(), pa.string(), *[pa.binary()] * 4), strict=True)], ["kind", "pid", "a", "b", "f", "ids"])

        for b in batches:
            for c, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if held and c != cell:
                    yield from closed()
                    held = []
                cell = c
                held.append(row)
        if held:
            yield from closed()

    bounded_batches(named.sparkSession, rows=200)
    sent = named.mapInArrow(send, "cell long, pid string, at binary, a binary, b binary, n binary")
    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(count, "kind int, pid string, a binary, b binary, f binary, ids binary")


def _pairs(counted: DataFrame) -> DataFrame:
    """id, a, b, f of the frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], ["id", "a", "b", "f"])

    return counted.filter("kind = 0").select("ids", "a", "b", "f").mapInArrow(run, "id long, a long, b long, f long")


def _renamed(named: DataFrame, counted: DataFrame) -> DataFrame:
    """pid, seq, ids with pairs in the place of what they pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, seq, ids, got in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                out, a, _, _ = paired(np.frombuffer(seq, np.int32), np.frombuffer(ids, np.int64))
                new = np.zeros(len(a), np.int64)
                for x in got:
                    at = np.frombuffer(x["a"], np.uint32)
                    new[at] = _wide(x["ids"], len(at))
                yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([out.tobytes()], pa.binary()), pa.array([new.tobytes()], pa.binary())], ["pid", "seq", "ids"])

    got = counted.filter("kind = 1").groupBy("pid").agg(F.collect_list(F.struct("a", "ids")).alias("got"))
    return named.join(got, "pid").select("pid", "seq", "ids", "got").mapInArrow(run, "pid string, seq binary, ids binary")


def _outlived(names: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """The names of which no longer one, by one word, has this percentage of their count.

    Counts only fall with length, so what a phrase of more words would subsume, one between subsumes too.
    """
    most = longer.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("f2")).groupBy("id").agg(F.max("f2").alias("most"))
    return names.join(most, "id", "left").filter(f"most IS NULL OR 100 * most < {percent} * f").drop("most")


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words (docs: text, lang).

    A phrase counts (a) where its words follow one another within a piece of text; n counts all words of the language, l
    and r the two parts of the cut with the least score floor(1000000 a a / (l r)), of the shortest first part among such.
    Phrases with a >= least compete, unless a longer one that holds them has subsumed percent of their count or more.
    Ranks go by score and a, both descending, then by the phrase's bytes. A null text is empty, a null lang `und`; rows
    that repeat count each time; other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    portions = stored(_portions(docs), "portions")
    entries = portions.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("lang", F.col("e.words").alias("word"), F.col("e.counts").alias("c"))
    words = entries.groupBy("lang", "word").agg(F.sum("c").alias("f"))
    totals = portions.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("c")).groupBy("lang").agg(F.sum("c").alias("n"))
    words = stored(words.filter(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id() + 1), "words")
    # what a phrase is looked up by: its text, its count, the counts of its first and of its last 1, 2, ... words
    nothing = F.array().cast("array<long>")
    names = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", nothing.alias("firsts"), nothing.alias("lasts"))
    named, shorter, found = stored(_named_portions(portions, words), "named"), None, None
    for k in range(2, longest + 1):
        tokens = int(named.agg(F.coalesce(F.sum(F.length("seq") / 4), F.lit(0))).first()[0])
        counted = stored(_counted(named, least, max(tokens // CELL, int(spark.conf.get("spark.sql.shuffle.partitions")))), "counted")
        left = names.select(F.col("id").alias("a"), "lang", "phrase", F.concat("firsts", F.array("f")).alias("firsts"))
        right = names.select(F.col("id").alias("b"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
        names = _pairs(counted).join(left, "a").join(right, "b").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "firsts", "lasts", "a", "b")
        names = stored(names, "names")
        if shorter is not None:
            found = _outlived(shorter, names, subsumed) if found is None else found.unionByName(_outlived(shorter, names, subsumed))
        shorter = names
        if k < longest:
            named = stored(_renamed(named, counted), "named")
    found = shorter if found is None else found.unionByName(shorter)
    # the cut's first i + 1 words and the words after them; the least of (score, i) counts
    product = "CAST({} AS DECIMAL(15, 0)) * CAST({} AS DECIMAL(15, 0))"
    cuts = f"""transform(firsts, (l, i) -> named_struct(
        'score', (CAST(1000000 AS DECIMAL(7, 0)) * ({product.format("f", "f")})) DIV ({product.format("l", "element_at(lasts, size(lasts) - i)")}),
        'i', i, 'l', l, 'r', element_at(lasts, size(lasts) - i)))"""
    scored = found.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.expr(cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the best of each part of a language first: one task ranks no more than `top` of each part
    parts = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = (F.desc("score"), F.desc("a"), "phrase")
    some = scored.withColumn("part", parts).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
