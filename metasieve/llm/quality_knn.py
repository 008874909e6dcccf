"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are pairs of neighbouring bytes, folded to 64 classes, and the shapes of its words, hashed to SHAPES
numbers: a shape has the kinds of a word's characters in turn (capitals, other letters, digits, each sign as itself), with
repeats of a kind folded, and says whether the word repeats the one before. Term weights are square roots of shares, times
an inverse document frequency; a truncated singular value decomposition of a bounded sample of labelled documents gives
the latent space. The sample's vectors and labels are broadcast; every document is projected, its cosines with all of them
are computed exactly, a block of documents at a time, and the nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasieve.llm.common import bounded_batches, is_held_out, split_spans, texts

#: Labelled documents that the model is fitted on, at most; chosen by a hash of their ids.
SAMPLE = 4000
#: Latent dimensions, voting neighbours, exponent of a vote's similarity, weight of the prior in votes.
DIMS, NEIGHBOURS, SHARPNESS, PRIOR = 48, 15, 40.0, 0.1
#: Documents whose cosines are computed at once.
BLOCK = 512
#: Score from which a document counts as good.
THRESHOLD = 0.3

#: Classes of bytes, numbers of shapes, terms in all.
CLASSES, SHAPES = 64, 2048
TERMS = CLASSES * CLASSES + SHAPES


def _byte_classes() -> np.ndarray:
    """Lower-case letters apart; capitals, digits and the two halves of non-ASCII bytes folded; other signs apart or hashed."""
    out = np.full(256, 63, np.uint16)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            out[b] = b - 97
        elif "A" <= c <= "Z":
            out[b] = 26
        elif "0" <= c <= "9":
            out[b] = 27
        elif b >= 0xC0:
            out[b] = 28 + b % 4
        elif b >= 0x80:
            out[b] = 32 + b % 8
        elif b <= 32:
            out[b] = 40 if b == 32 else 41
        else:
            out[b] = 42 + (b * 7) % 21
    return out


BYTE_CLASS = _byte_classes()


def _kinds() -> bytes:
    """Capitals, other letters and bytes beyond ASCII, and digits as one sign each; all other bytes as they are."""
    return bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


KINDS = _kinds()
_AGAIN = re.compile(rb"([^\n])\1+")


def shape_numbers(words: list[str]) -> np.ndarray:
    """An even number below SHAPES for each word (without line ends), by its shape."""
    shapes = _AGAIN.sub(rb"\1", "\n".join(words).encode().translate(KINDS)).split(b"\n")
    known = {x: zlib.crc32(x) % (SHAPES // 2) * 2 for x in set(shapes)}
    return np.fromiter(map(known.__getitem__, shapes), np.int64, len(shapes))


def features(rows: list[str]) -> np.ndarray:
    """Square roots of the shares of byte-class pairs, then of word shapes, one row of float32 for each text.

    An empty text has no pairs, and one empty word.
    """
    out = np.zeros((len(rows), TERMS), np.float32)
    if not rows:
        return out
    for x, text in zip(out, rows, strict=True):
        c = BYTE_CLASS[np.frombuffer(text.encode(), np.uint8)]
        if len(c) > 1:
            x[: CLASSES * CLASSES] = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
            x[: CLASSES * CLASSES] /= len(c) - 1
    words, numbers, ends = split_spans([" ".join(t.split()) for t in rows])
    size = np.diff(np.r_[0, ends])
    again = np.r_[False, numbers[1:] == numbers[:-1]]
    again[np.r_[0, ends[:-1]]] = False
    place = np.repeat(np.arange(len(rows)), size) * SHAPES + shape_numbers(words)[numbers] + again
    out[:, CLASSES * CLASSES :] = np.bincount(place, minlength=len(rows) * SHAPES).reshape(-1, SHAPES) / size[:, None]
    return np.sqrt(out, out)


@dataclass(frozen=True)
class Model:
    """Term weights, the projection to the latent space, unit vectors and labels of the sample."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def vectors_of(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weights) @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Votes of the nearest sample vectors for each row of features."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        cosines = self.vectors_of(x) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(cosines, cosines.shape[1] - k, axis=1)[:, -k:]
        w = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
        prior = self.labels.mean()
        return (np.sum(w * self.labels[near], 1) + PRIOR * prior) / (np.sum(w, 1) + PRIOR)


def fit(x: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> Model:
    """The model of a sample's features: a randomised truncated SVD with a fixed seed."""
    if not len(x):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    df = (x > 0).sum(0)
    weights = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + np.float32(0.2)
    a = x * weights
    rng = np.random.default_rng(17)
    r = min(dims + 16, *a.shape)
    q = np.linalg.qr(a @ rng.standard_normal((a.shape[1], r), np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    vt = np.linalg.svd(q.T @ a, full_matrices=False)[2]
    projection = np.ascontiguousarray(vt[:dims].T, np.float32)
    model = Model(weights, projection, np.zeros((0, 1), np.float32), labels)
    return Model(weights, projection, model.vectors_of(x).astype(np.float32), labels.astype(np.float64))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_column: str = "quality") -> Model:
    """Fit on at most `sample` labelled documents that are not held out; which ones depends on their ids' hashes only.

    Rows with a null id or label are left out; of repeated ids one label counts. Features are made on the executors.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label_column).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~is_held_out())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                made = [zlib.compress(x.astype(np.float16).tobytes(), 1) for x in features(texts(part.column(2)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # documents that repeat an id would pass the bound
    got = rows.mapInArrow(run, f"doc_id {kind}, label int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()
    x = np.array([np.frombuffer(zlib.decompress(r.x), np.float16) for r in got], np.float32).reshape(len(got), TERMS)
    return fit(x, np.array([r.label for r in got], np.float64))


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (columns doc_id, text), whole texts.

    Null text counts as empty; a null doc_id as the empty text when held_out is found. Repeated rows get equal scores.
    Other columns are ignored. A model of no sample scores 0.5 throughout. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores(features(texts(part.column(1)))), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold, ties included.

    Null and empty texts are scored as the empty text is; rows that repeat an id are judged each by its own text. Other
    columns may have any name. An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield part.filter(pa.array(m.scores(features(texts(part.column(at_text)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
