"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    block*  bloom  index  footer

A block is a run of entries, closed at BLOCK_BYTES and compressed with zstd: varint length of the prefix shared with the key before (0 for the
first of a block), varint length of the rest, the rest, varint length of the value, the value. Keys are 9 bytes: 0 for a
null id, else 1, then the id as a big-endian integer with its sign bit turned, so that bytes sort as ids do. A value is
a byte with the width of an id, 2 where all ids of the document fit and else 4, and the ids as little-endian unsigned
integers of that width. The Bloom filter has 10 bits for each key and 7 probes. The index
has, per block, its first key, offset, length and rows. The footer is of fixed size: offsets and lengths of filter and
index, rows, ids in all, and the magic number. lookup() reads footer, filter and index, searches the index by bisection
and reads one block, or several where a key repeats.

Shards are written whole under a temporary name and renamed, so a lost task leaves none that is read. Their names and
totals come back as one small row for each shard; `start` positions are sums over those rows.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.llm.common import Ragged, blob, bounded_batches, split_spans, texts

BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_PROBES = 10, 7
MAGIC = b"MSVSST01"
FOOTER = struct.Struct("<QQQQQQ8s")
INDEX = struct.Struct("<9sQQI")
#: Spans, and pre-tokens, remembered by a worker before the older half is forgotten; longer ones are never remembered.
CACHE_SPANS, CACHE_CHARS = 300_000, 48
#: Spans whose lower case and normal form are the same under every version of Unicode: ASCII and precomposed Latin letters.
LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]*").fullmatch
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017e"
#: The pre-tokens of such a span once in lower case.
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\x20\\x09-\\x0d{LETTERS}0-9]+").findall


_LATIN_1 = bytes(range(128)) + bytes(b for b in range(0xC0, 0x100) if b not in (0xD7, 0xF7))


def is_latin(text: str) -> bool:
    """LATIN, by way of bytes where that can be."""
    try:
        return text.isascii() or not text.encode("latin-1").translate(None, _LATIN_1)
    except UnicodeEncodeError:
        return LATIN(text) is not None


class SpanEncoder:
    """Ids of whole texts by the tokenizers library, with what repeats encoded once.

    For tokenizers that lower-case, drop white space and split at it, so that no token crosses a space: a text is cut at
    its spaces, and Latin spans at their pre-tokens too, which letter case and punctuation then do not multiply. Texts that
    hold an added token, such as <|endoftext|>, stay whole. What is new goes to the library, many pieces in a call.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        #: whether a text holds an added token, in any letter case: such a text goes to the library whole
        self.marks = re.compile("|".join(map(re.escape, self.added)) or r"(?!)", re.IGNORECASE).search
        start = os.path.commonprefix(self.added)
        #: what each added token holds whatever its letter case
        self.sign = start[: next((k for k, c in enumerate(start) if c.lower() != c.upper()), len(start))]
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or "\0"
        #: whether an id ends a pre-token
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(suffix) for k in range(self.tokenizer.get_vocab_size())])
        probe = "Ab's  cd1 \nÉ2x, 'tis ..!a"
        if [i for p in PRE_TOKENS(probe.lower()) for i in self._call([p])[0]] != self._call([probe])[0].tolist():
            raise ValueError("the tokenizer splits text in another way")
        self.spans: list[dict[str, bytes]] = [{}, {}]
        self.pieces: list[dict[str, bytes]] = [{}, {}]

    def _call(self, pieces: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _call_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these pre-tokens, many in a text where their ends can be told."""
        if not pieces:
            return []
        (e,) = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces) or stops[-1] != len(ids):
            return [x.tobytes() for x in self._call(pieces)]
        data = ids.tobytes()
        return [data[4 * x : 4 * y] for x, y in pairwise([0, *stops.tolist()])]

    @staticmethod
    def _missing(wanted: Iterable[str], generations: list[dict[str, bytes]]) -> list[str]:
        """What neither generation has; what the old one has moves to the young one."""
        young, old = generations
        out = []
        for p in filterfalse(young.__contains__, wanted):
            if (found := old.get(p)) is None:
                out.append(p)
            else:
                young[p] = found
        return out

    @staticmethod
    def _forget(generations: list[dict[str, bytes]], new: list[str]) -> None:
        young = generations[0]
        for p in new:
            if len(p) > CACHE_CHARS:
                young.pop(p, None)
        if len(young) > CACHE_SPANS:
            generations[:] = [{}, young]

    def encode_all(self, rows: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(rows)
        marked = {k for k, t in enumerate(rows) if self.sign in t and self.marks(t)}
        for k, ids in zip(marked, self._call([rows[k] for k in marked]), strict=True):
            out[k] = ids.tobytes()
        latin = {k for k, t in enumerate(rows) if k not in marked and is_latin(t)}
        # letter case may bear on the normal form of other letters
        for some, lower in ((sorted(latin), True), ([k for k in range(len(rows)) if k not in marked and k not in latin], False)):
            if some:
                spans, numbers, ends = split_spans([rows[k].replace("\n", " ") for k in some], lower)
                ids, stops = Ragged(self._spans(spans), np.uint32).laid_out(numbers, ends)
                data, at = ids.astype("<u4").tobytes(), [0, *(4 * stops).tolist()]
                for k, x, y in zip(some, at, at[1:], strict=False):
                    out[k] = data[x:y]
        return out

    def _spans(self, spans: list[str]) -> list[bytes]:
        """The ids of each of these different spans."""
        known = self.spans[0].get
        got = [known(p) if g is None else g for p, g in zip(spans, map(self.pieces[0].get, spans), strict=True)]
        missing = [p for p, g in zip(spans, got, strict=True) if g is None]
        plain = {p for p in missing if p.isascii() and p.islower() and p.isalpha()}
        new = self._missing([p for p in missing if p not in plain], self.spans)
        cut = {p: PRE_TOKENS(p.lower()) if LATIN(p) else None for p in new}
        new_pieces = self._missing(plain.union(*[parts for parts in cut.values() if parts]), self.pieces)
        whole, pieces = self.spans[0], self.pieces[0]
        for at in range(0, len(new_pieces), 1000):
            some = new_pieces[at : at + 1000]
            pieces.update(zip(some, self._call_pieces(some), strict=True))
        others = [p for p, parts in cut.items() if parts is None]
        for at in range(0, len(others), 10_000):
            some = others[at : at + 10_000]
            whole.update(zip(some, [ids.tobytes() for ids in self._call(some)], strict=True))
        for p, parts in cut.items():
            if parts is not None:
                whole[p] = b"".join([pieces[q] for q in parts])
        out = [(pieces[p] if p in plain else whole[p]) if g is None else g for p, g in zip(spans, got, strict=True)]
        self._forget(self.spans, new)
        self._forget(self.pieces, new_pieces)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> SpanEncoder:
    """One per worker process."""
    return SpanEncoder(path)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + k * b) % bits for k in range(BLOOM_PROBES)]


def pack_ids(ids: bytes) -> bytes:
    """A value from little-endian unsigned 32-bit ids."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids


def unpack_ids(value: bytes) -> bytes:
    """Little-endian unsigned 32-bit ids from a value."""
    return value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()


class ShardWriter:
    """Writes one shard; add() takes keys in ascending order. Only the open block, the index and 16 bytes a key are held."""

    def __init__(self, out):
        self.out, self.at, self.rows, self.n_ids = out, 0, 0, 0
        self.block, self.first, self.block_rows, self.last = bytearray(), b"", 0, b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        value = pack_ids(ids)
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block_rows:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + key[shared:] + varint(len(value)) + value
        self.block_rows += 1
        self.rows += 1
        self.n_ids += len(ids) // 4
        if key != self.last:
            self.keys.append(key)
        self.last = key
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.block_rows:
            block = zstandard.compress(bytes(self.block), 1)
            self.out.write(block)
            self.index.append(INDEX.pack(self.first, self.at, len(block), self.block_rows))
            self.at += len(block)
            self.block, self.block_rows = bytearray(), 0

    def finish(self) -> None:
        self._close_block()
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(bytes(bloom))
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.rows, self.n_ids, MAGIC))


def _entries(stored: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, ids) of a block."""
    block = zstandard.decompress(stored)
    at, key = 0, b""
    while at < len(block):
        shared, at = read_varint(block, at)
        n, at = read_varint(block, at)
        key = key[:shared] + block[at : at + n]
        at += n
        n, at = read_varint(block, at)
        yield key, unpack_ids(block[at : at + n])
        at += n


class Shard:
    """Reads one shard by whole blocks."""

    def __init__(self, path: str):
        fs, p = blob(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        footer = self.file.read_at(FOOTER.size, size - FOOTER.size)
        self.bloom_at, self.bloom_n, index_at, index_n, self.rows, self.n_ids, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        self.index = list(INDEX.iter_unpack(self.file.read_at(index_n, index_at)))

    def close(self) -> None:
        self.file.close()

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n, _ in self.index:
            yield from _entries(self.file.read_at(n, at))

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """The values of a key, none if it is absent; the Bloom filter answers most absent keys without a block."""
        key = key_of(doc_id)
        bloom = self.file.read_at(self.bloom_n, self.bloom_at)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bloom_n * 8)):
            return []
        firsts = [x[0] for x in self.index]
        out, k = [], max(0, bisect_left(firsts, key) - 1)
        while k < len(firsts) and firsts[k] <= key:
            out += [v for x, v in _entries(self.file.read_at(self.index[k][2], self.index[k][1])) if x == key]
            k += 1
        return out


def write_sstables(docs: DataFrame, tokenizer_file: str, end_id: int, path: str, shards: int | None = None) -> DataFrame:
    """Encode every whole text, append end_id, write shards below path; returns their manifest, itself stored in path.

    The manifest has a row for each shard: shard (ascending with its keys), file, n_docs, n_ids, first_key, last_key.
    Documents (doc_id integer, text) are range-partitioned on doc_id alone; null texts count as empty, null ids come
    first, rows with equal ids stay together in one shard. Other columns are ignored. An empty table gives no shard.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer, first, attempt = _encoder(tokenizer_file), struct.pack("<I", end_id), None, b"", uuid.uuid4().hex
        fs, base = blob(path)
        gc.disable()  # nothing here makes cycles
        for b in batches:
            ids = b.column(0).to_pylist()
            coded = encoder.encode_all(texts(b.column(1)))
            for doc_id, value in zip(ids, coded, strict=True):
                key = key_of(doc_id)
                if writer is None:
                    first = key
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/.{attempt}")
                    writer = ShardWriter(out)
                writer.add(key, value + end)
        if writer is not None:
            writer.finish()
            out.close()
            # the attempt is part of the name: a task that runs twice leaves a file that no manifest row names
            name = f"{first.hex()}-{attempt}.sst"
            fs.move(f"{base}/.{attempt}", f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "n_docs": writer.rows, "n_ids": writer.n_ids, "first_key": first, "last_key": writer.last}])

    made = ranged.sortWithinPartitions("doc_id").mapInArrow(run, "file string, n_docs long, n_ids long, first_key binary, last_key binary")
    made.write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards below path with the number of documents and ids before each: a few numbers for each shard."""
    kept = spark.read.schema("file string, n_docs long, n_ids long, first_key binary, last_key binary").parquet(f"{path}/manifest")
    rows = sorted(kept.collect(), key=lambda r: bytes(r.first_key))
    out, docs_before, ids_before = [], 0, 0
    for k, r in enumerate(rows):
        out.append((k, f"{path}/{r.file}", r.n_docs, r.n_ids, docs_before, ids_before))
        docs_before, ids_before = docs_before + r.n_docs, ids_before + r.n_ids
    return spark.createDataFrame(out, "shard int, file string, n_docs long, n_ids long, docs_before long, ids_before long")


def read_sstables(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (binary, little-endian unsigned 32-bit) of every document, shard by shard.

    start is the number of ids of all documents before it in key order.
    """
    bounded_batches(spark)
    manifest = read_manifest(spark, path)
    n = manifest.count()
    listed = manifest.select("file", "ids_before").repartition(max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(file)
                ids, starts, values, size = [], [], [], 0
                for key, value in shard.scan():
                    ids.append(id_of(key))
                    starts.append(start)
                    values.append(value)
                    start += len(value) // 4
                    size += len(value)
                    if size >= 1 << 23:
                        yield _batch(ids, starts, values)
                        ids, starts, values, size = [], [], [], 0
                shard.close()
                if ids:
                    yield _batch(ids, starts, values)

    return listed.mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(ids: list, starts: list, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])


def lookup(spark: SparkSession, path: str, doc_id: int | None) -> list[list[int]]:
    """The ids of a document, once for each row that had this id: footer, filter, index and one block are read."""
    key = key_of(doc_id)
    kept = spark.read.parquet(f"{path}/manifest").filter((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key)))
    out = []
    for r in kept.collect():
        shard = Shard(f"{path}/{r.file}")
        out += [np.frombuffer(v, "<u4").tolist() for v in shard.lookup(doc_id)]
        shard.close()
    return out
