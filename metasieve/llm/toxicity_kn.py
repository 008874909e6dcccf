"""Toxicity by class-conditional Kneser-Ney models.

Two word models, one of the toxic and one of the ordinary labelled documents, are compared by a document's log-likelihoods,
divided by its number of words. Both are Kneser-Ney distributions: a word counts by how many different words it follows
(its continuations), not by how often it occurs, so copies of a document and bursts of a word within one add nothing. Each
class interpolates its discounted counts with the same backoff, the continuations in both classes together:

    P_c(w) = max(N_c(w) - D_c(w), 0) / N_c + lambda_c * S(w)          lambda_c = 1 - sum of the first term over all words
    S(w)   = (max(N(w) - d, 0) + d * T / V) / N                       N(w): continuations in both classes, d = DISCOUNT
    D_c(w) = FLOOR + r_c * (N_0(w) + N_1(w))                          r_c = EXCESS * N_c / (EXCESS * N_c + N_other)

T is the number of different words and V = T + 1 leaves room for the unseen ones. The discount D_c(w) is what keeps the
comparison to the point: an expression stays in its class only as far as it has more than FLOOR continuations there beyond
those that EXCESS times the class's odds would give it. All others, rare ones above all, get their probability from the shared backoff in both
classes, where they cannot tell languages or topics apart. P_c sums to 1 over all words.

Labelled documents that are not held out are split by a hash of their id: one in CALIBRATION_SHARE, which the counts leave
out, sets one shift and one scale of the score, all others are counted. Neither part is capped.

Counts are made distinct per task, dealt by word hash and
made distinct again; the words that keep something after the discount are written to the shared folder. A task that scores
reads them block by block for the distinct words of a portion of texts, so that it never holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metasieve.llm.common import blob, bounded_batches, is_held_out, portions, scratch, split_spans, stored, texts
from metasieve.llm.decontam import words_of

#: Discount of the shared counts; what the classes' counts are discounted by, at least, and in times their odds.
DISCOUNT, FLOOR, EXCESS = 0.75, 5.0, 2.0
#: Of so many labelled documents one, all told, is left out of the counts and sets shift and scale.
CALIBRATION_SHARE = 10
#: Score from which a document counts as toxic.
THRESHOLD = 0.5
#: Pairs gathered by a task before it sends the distinct ones; rows of the model that it holds; bytes of a row group.
SEND, BLOCK_ROWS, GROUP_BYTES = 2_000_000, 1 << 18, 16 << 20

#: Words are known by 48 bits of their hash, so a pair takes 12 bytes: a word, and 16 bits and 32 bits of the one before.
WORD = np.uint64(0xFFFFFFFFFFFF)


def hashed_words(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit hashes of the distinct words, the number of each word of all rows in turn, where each row's words stop)."""
    normal = [words_of(t).strip() for t in rows]
    words, numbers, ends = split_spans(normal)
    size = np.diff(np.r_[0, ends])
    empty = np.fromiter((not t for t in normal), bool, len(normal))
    if empty.any():  # an empty text has one empty span
        numbers = np.delete(numbers, ends[empty] - 1)
        ends = np.cumsum(size - empty)
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words)) >> np.uint64(16), numbers, ends


def pairs_of(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the word and the upper 16 bits of the one before it, the lower 32 bits of that) for each word; first words follow 0."""
    before = np.r_[np.zeros(1, np.uint64), hashes[:-1]][: len(hashes)]
    starts = np.r_[0, ends[:-1]][np.diff(np.r_[0, ends]) > 0]
    before[starts] = 0
    return hashes << np.uint64(16) | before >> np.uint64(32), before.astype(np.uint32)


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.zeros(0, bool)
    return high[new], low[new]


def continuations(labelled: DataFrame, parts: int) -> DataFrame:
    """word, n_ordinary, n_toxic, n_both of labelled (label 0 or 1, text): continuations in each class and in both together.

    Only words with more than FLOOR in a class have a row: the discount leaves the others nothing. One row per part has a
    null word and the sums over all of its words, with n_words: how many different ones there are.
    """
    bounded_batches(labelled.sparkSession)

    def packed(held: list[tuple[np.ndarray, np.ndarray]], label: int) -> Iterator[pa.RecordBatch]:
        high, low = distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
        part = (high >> np.uint64(40)).astype(np.int64) * parts >> 24
        cuts = np.searchsorted(part, np.arange(parts + 1))
        used = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        for at in range(0, len(used), 64):
            some = used[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([label] * len(some), pa.int32()), *(pa.array([x[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()) for x in (high, low))], ["part", "label", "high", "low"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = [0, 0]
        for b in batches:
            for label in (0, 1):
                rows = texts(b.filter(pa.compute.equal(b.column(0), label)).column(1))
                for some in portions(rows):
                    hashes, numbers, ends = hashed_words(some)
                    if len(numbers):
                        held[label].append(distinct(*pairs_of(hashes[numbers], ends)))
                        size[label] += len(held[label][-1][0])
                    if size[label] >= SEND:
                        yield from packed(held[label], label)
                        held[label], size[label] = [], 0
        for label in (0, 1):
            if held[label]:
                yield from packed(held[label], label)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        kept = [none, none]
        for b in batches:
            label = b.column(1).to_numpy()
            for c in (0, 1):
                at = np.flatnonzero(label == c).tolist()
                if at:
                    kept[c] = distinct(*(np.concatenate([kept[c][k], *(np.frombuffer(b.column(2 + k)[x].as_buffer(), none[k].dtype) for x in at)]) for k in (0, 1)))
        both = distinct(*(np.concatenate([kept[0][k], kept[1][k]]) for k in (0, 1)))[0] >> np.uint64(16)
        if not len(both):
            return
        words, n = np.unique(both, return_counts=True)
        each = []
        for c in (0, 1):
            w, k = np.unique(kept[c][0] >> np.uint64(16), return_counts=True)
            each.append(np.zeros(len(words), np.int64))
            each[c][np.searchsorted(words, w)] = k
        yield _rows([None], *([x.sum()] for x in (*each, n)), [len(words)])
        at = np.flatnonzero((each[0] > FLOOR) | (each[1] > FLOOR))
        for start in range(0, len(at), 100_000):
            s = at[start : start + 100_000]
            yield _rows(words[s].astype(np.int64), each[0][s], each[1][s], n[s], np.ones(len(s), np.int64))

    sent = labelled.select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(gather, "part int, label int, high binary, low binary")
    return sent.repartition(parts, "part").mapInArrow(total, "word long, n_ordinary long, n_toxic long, n_both long, n_words long")


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "n_ordinary", "n_toxic", "n_both", "n_words"])


@dataclass(frozen=True)
class Model:
    """The folder of words (word, ratio), and shift and scale of the score.

    ratio is the word's log-likelihood ratio, toxic to ordinary, less the one that all other words share (base). A model of
    one class or none has no folder, and calls nothing toxic.
    """

    folder: str = ""
    base: float = 0.0
    shift: float = 1.0
    scale: float = 4.0

    def differences(self, rows: list[str]) -> np.ndarray:
        """The length-normalised difference of each text's log-likelihoods, less base; 0 for a text without words."""
        hashes, numbers, ends = hashed_words(rows)
        size = np.diff(np.r_[0, ends])
        if not self.folder or not len(numbers):
            return np.zeros(len(rows))
        wanted, at = np.unique(hashes.view(np.int64), return_inverse=True)
        ratio = _looked_up(self.folder, wanted)[at]
        return np.bincount(np.repeat(np.arange(len(size)), size), weights=ratio[numbers], minlength=len(size)) / np.maximum(size, 1)

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((differences - self.shift) * self.scale, -50, 50)))


def _looked_up(folder: str, wanted: np.ndarray) -> np.ndarray:
    """The ratios of the wanted words, which ascend; 0 for one without a row."""
    out = np.zeros(len(wanted))
    fs, path = blob(folder)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                for b in pq.ParquetFile(file).iter_batches(BLOCK_ROWS, columns=["word", "ratio"], use_threads=False):
                    words = b.column(0).to_numpy()
                    at = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
                    found = wanted[at] == words
                    out[at[found]] = b.column(1).to_numpy()[found]
    return out


def kneser_ney(counts: DataFrame) -> Model:
    """The model from the rows of continuations(); the words' probabilities are worked out row by row."""
    sums = counts.filter("word IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_ordinary", "n_toxic", "n_both", "n_words"))).first()
    n, both, kinds = (sums.n_ordinary, sums.n_toxic), sums.n_both, sums.n_words
    if not n[0] or not n[1]:
        return Model()
    words = counts.filter("word IS NOT NULL")
    for name, c in (("n_ordinary", 0), ("n_toxic", 1)):
        discount = F.lit(FLOOR) + (F.col("n_ordinary") + F.col("n_toxic")) * (EXCESS * n[c] / (EXCESS * n[c] + n[1 - c]))
        words = words.withColumn(f"p{c}", F.greatest(F.col(name) - discount, F.lit(0.0)) / n[c])
    words = words.filter("p0 > 0 OR p1 > 0")
    kept = words.agg(F.coalesce(F.sum("p0"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("p1"), F.lit(0.0)).alias("b")).first()
    rest = (1 - kept.a, 1 - kept.b)
    base = float(np.log(rest[1] / rest[0]))
    shared = (F.greatest(F.col("n_both") - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds / (kinds + 1)) / both
    folder = scratch(counts.sparkSession, "toxicity-words")
    ratio = F.log((F.col("p1") + rest[1] * shared) / (F.col("p0") + rest[0] * shared)) - base
    words.select("word", ratio.alias("ratio")).write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
    return Model(folder, base)


def calibrated(model: Model, differences: np.ndarray, labels: np.ndarray) -> Model:
    """Shift: where the two classes are best told apart, counting both alike, the least of equal places, between two
    differences. Scale: such that half of the toxic documents beyond it score sigmoid(4) or more."""
    if not len(labels) or labels.min() == labels.max():
        return model
    at = np.unique(differences)
    if len(at) < 2:
        return model
    right = np.array([(differences[labels == 1] >= x).mean() + (differences[labels == 0] < x).mean() for x in at[1:]])
    k = int(np.argmax(right)) + 1
    shift = float(at[k - 1] + at[k]) / 2
    beyond = differences[(labels == 1) & (differences >= at[k])]
    return replace(model, shift=shift, scale=4 / max(float(np.median(beyond)) - shift, 1e-9)) if len(beyond) else model


def calibrated_on(model: Model, told: DataFrame) -> Model:
    """calibrated() over the rows of told (difference, label), however many: ranges of differences are summed side by side."""
    counts = told.groupBy("difference").agg(*(F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1)))
    counts = stored(counts, "toxicity-scored")  # ranges are chosen from rows that would be scored twice
    counts = stored(counts.repartitionByRange("difference").withColumn("part", F.spark_partition_id()), "toxicity-differences")
    sums = counts.groupBy("part").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))  # a row for each range
    n0, n1 = sums.agg(F.coalesce(F.sum("s0"), F.lit(0)), F.coalesce(F.sum("s1"), F.lit(0))).first()
    if not n0 or not n1:
        return model
    earlier, within = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("part"), Window.partitionBy("part").orderBy("difference")))
    sums = sums.select("part", *(F.coalesce(F.sum(f"s{c}").over(earlier), F.lit(0)).alias(f"s{c}") for c in (0, 1)))
    below = counts.join(F.broadcast(sums), "part").select("difference", "n1", *((F.col(f"s{c}") + F.coalesce(F.sum(f"n{c}").over(within), F.lit(0))).alias(f"b{c}") for c in (0, 1)))
    below = stored(below, "toxicity-below")
    best = below.filter("b0 + b1 > 0").select("difference", "b1", ((n1 - F.col("b1")) * n0 + F.col("b0") * n1).alias("right")).orderBy(F.desc("right"), "difference").first()
    if best is None:
        return model
    shift = (below.filter(F.col("difference") < best.difference).agg(F.max("difference")).first()[0] + best.difference) / 2
    beyond = n1 - best.b1
    if not beyond:
        return model
    low, high = best.b1 + (beyond - 1) // 2, best.b1 + beyond // 2
    middle = below.filter((F.col("n1") > 0) & (F.col("b1") <= high) & (F.col("b1") + F.col("n1") > low)).agg(F.min("difference"), F.max("difference")).first()
    return replace(model, shift=shift, scale=4 / max((middle[0] + middle[1]) / 2 - shift, 1e-9))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_column: str = "toxic") -> Model:
    """Fit on every labelled document that is not held out: one in CALIBRATION_SHARE sets shift and scale, the others count.

    Rows with a null id or label are left out; of repeated ids one label counts, the largest.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label_column).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col(label_column).isin(0, 1) & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the ids alone tell the two parts apart, so that no text moves for the first and those of the second move once
    first = F.pmod(F.xxhash64(F.col("doc_id").cast(labels.schema["doc_id"].dataType)), F.lit(CALIBRATION_SHARE)) == 0
    whole = docs.select("doc_id", "text").filter(~is_held_out())
    # the labels grow with the corpus, so they are merged and not broadcast, however few they are
    rows = whole.filter(~first).join(known.filter(~first).hint("merge"), "doc_id")
    model = kneser_ney(stored(continuations(rows, parts), "toxicity-counts"))
    scored = _scored(whole.filter(first), model).select("doc_id", "difference")
    return calibrated_on(model, scored.join(known.filter(first).hint("merge"), "doc_id").select("difference", "label"))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, difference of every row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for rows in portions(texts(b.column(1))):
                d = model.differences(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), pa.array(model.score(d), pa.float64()), pa.array(d, pa.float64())], ["doc_id", "score", "difference"])
                at += len(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, difference double")


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, difference for every row of docs (columns doc_id, text), whole texts.

    difference is the length-normalised difference of the log-likelihoods, less the one that unmarked words have. Null,
    empty and wordless texts have a difference of 0; a null doc_id counts as the empty text when held_out is found.
    Repeated rows get equal scores, ties of the threshold count as toxic, other columns are ignored, an empty table gives
    an empty result.
    """
    return _scored(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
