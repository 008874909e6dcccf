"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of many pre-tokens lie behind one another as one linked list, in which no pair crosses a pre-token's end.
Buckets, one per merge rank, hold the list positions whose pair has that rank; a two-level bitmap over the ranks (words of
64 ranks below one word with a bit for each of them) finds the lowest rank in use by two find-first-set steps. A bucket is
worked off from left to right; entries whose pair has changed since are skipped when they come up, and a merge that makes a
pair of lower rank sends the rest of the bucket back to the queue. Each pre-token thus sees its merges in the order that it
would see alone: lowest rank first, leftmost first. The next merge costs the same whatever the length of a pre-token.

Documents repeat their words, so spans of text between spaces, and the pre-tokens in them, are encoded once and remembered
in bounded caches; what a batch of documents has that is new goes through the queue together.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse, pairwise
from sys import byteorder

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasieve.llm.common import Ragged, bounded_batches, portions, split_spans, texts

#: Spans and pre-tokens remembered by a worker before the older half is forgotten; longer ones are never remembered.
CACHE, CACHE_CHARS = 200_000, 48
#: Bytes of pre-tokens that are in the queue at once, but for a longer one.
QUEUED = 1 << 14
#: Patterns under which a space before a character that is no white space always starts a pre-token: fixed values.
SPACE_STARTS = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"})

#: Whether a space stands before white space or the end.
SPACES = re.compile(r" (?:\s|\Z)").search


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.cuts = pattern in SPACE_STARTS
        n = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_bytes, self.decimal_bytes = Ragged(self.tokens), Ragged([b"%d," % k for k in range(n)])
        self.byte_id = np.array([ranks.get(bytes([b]), n) for b in range(256)], np.int64)
        #: rank of each pair of ids that is a token together, by (left << 32 | right)
        self.pair: dict[int, int] = {}
        self.byte_pair = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
            if len(token) == 2:
                self.byte_pair[token[0] << 8 | token[1]] = rank
        # spans after a space by what follows it, and pre-tokens without one, each in a young and an old generation
        self.spaced: list[dict[str, bytes]] = [{}, {}]
        self.bare: list[dict[str, bytes]] = [{}, {}]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as unsigned 32-bit integers in the machine's order."""
        whole = list(map(self.ranks.get, pieces))
        todo = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        made = iter(self._queued(todo) if todo else ())
        return [next(made) if w is None else w.to_bytes(4, byteorder) for w in whole]

    def _queued(self, pieces: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, sizes = len(data), np.array([len(p) for p in pieces], np.int64)
        last = np.cumsum(sizes[sizes > 0]) - 1
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.byte_pair[data[:-1].astype(np.int64) << 8 | data[1:]]
        ranks[last] = -1
        nexts, befores = np.arange(1, n + 1), np.arange(-1, n - 1)
        nexts[last] = befores[(last + 1)[:-1]] = befores[:1] = n
        # position n is the end of all pre-tokens: no pair with it has a rank
        rank_at, after, before, token = ([*x.tolist(), y] for x, y in ((ranks, -1), (nexts, n), (befores, n), (self.byte_id[data], 1 << 31)))
        order = np.argsort(ranks, kind="stable")[int((ranks < 0).sum()) :]
        used, first = np.unique(ranks[order], return_index=True)
        buckets = dict(zip(used.tolist(), [x.tolist() for x in np.split(order, first[1:])] if len(used) else [], strict=True))
        words = [0] * (len(self.tokens) // 64 + 1)
        top = 0
        for r in buckets:
            words[r >> 6] |= 1 << (r & 63)
            top |= 1 << (r >> 6)
        rank_of = self.pair.get
        while top:
            k = (top & -top).bit_length() - 1
            low = words[k] & -words[k]
            rank = k << 6 | low.bit_length() - 1
            words[k] ^= low
            if not words[k]:
                top ^= 1 << k
            bucket = buckets.pop(rank)
            bucket.sort()
            for at, i in enumerate(bucket):
                if rank_at[i] != rank:
                    continue  # stale
                j, p = after[i], before[i]
                e = after[i] = after[j]
                before[e] = i
                token[i], token[j], rank_at[j] = rank, -1, -1
                r = rank_at[i] = rank_of(rank << 32 | token[e], -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        buckets[r] = [i]
                        words[r >> 6] |= 1 << (r & 63)
                        top |= 1 << (r >> 6)
                q = rank_at[p] = rank_of(token[p] << 32 | rank, -1)
                if q >= 0:
                    if q in buckets:
                        buckets[q].append(p)
                    else:
                        buckets[q] = [p]
                        words[q >> 6] |= 1 << (q & 63)
                        top |= 1 << (q >> 6)
                if -1 < r < rank or -1 < q < rank:
                    if rest := bucket[at + 1 :]:
                        buckets[rank] = rest
                        words[k] |= low
                        top |= 1 << k
                    break
        ids = np.array(token[:n], np.int64)
        kept = ids >= 0
        ends = np.r_[0, np.cumsum(kept)][np.cumsum(sizes)].tolist()
        out = ids[kept].astype(np.uint32).tobytes()
        return [out[4 * x : 4 * y] for x, y in zip([0, *ends], ends, strict=False)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        return np.frombuffer(self.merge_all([piece])[0], np.uint32).tolist()

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
        if len(young) > CACHE:
            generations[:] = [{}, young]

    def _spans(self, text: str) -> list[str]:
        """A text cut at each space that starts a pre-token whatever stands before it; other spaces stay where they are."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if SPACES(text):
            glued = [parts[0]]
            for p in parts[1:]:
                if not p or p[0].isspace():
                    glued[-1] += " " + p
                else:
                    glued.append(p)
            parts = glued
        return parts

    def encode_all(self, rows: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers in the machine's order."""
        out: list[bytes] = [b""] * len(rows)
        glued = {k for k, t in enumerate(rows) if not self.cuts or SPACES(t)}
        simple = [k for k in range(len(rows)) if k not in glued]
        if simple:
            spans, numbers, ends = split_spans([rows[k] for k in simple])
            first = np.r_[0, ends[:-1]]
            heads = self._bare([self.find(spans[n]) for n in numbers[first].tolist()])
            numbers = numbers.astype(np.int64)
            numbers[first] = len(spans) + np.arange(len(first))
            ids, stops = Ragged(self._spaced(spans) + heads, np.uint32).laid_out(numbers, ends)
            data, at = ids.tobytes(), [0, *(4 * stops).tolist()]
            for k, x, y in zip(simple, at, at[1:], strict=False):
                out[k] = data[x:y]
        if glued:
            split = {k: self._spans(rows[k]) for k in glued}
            heads = self._bare([self.find(parts[0]) for parts in split.values()])
            spans = list({p for parts in split.values() for p in parts[1:]})
            known = dict(zip(spans, self._spaced(spans), strict=True))
            for (k, parts), head in zip(split.items(), heads, strict=True):
                out[k] = b"".join([head, *map(known.__getitem__, parts[1:])])
        return out

    def _bare(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each run of pre-tokens that follow no space."""
        new = self._missing({p for parts in texts for p in parts}, self.bare)
        bare = self.bare[0]
        self._fill(bare, new, "")
        out = [b"".join(map(bare.__getitem__, parts)) for parts in texts]
        self._forget(self.bare, new)
        return out

    def _spaced(self, spans: list[str]) -> list[bytes]:
        """The ids of each of these different spans where it follows a space."""
        got = list(map(self.spaced[0].get, spans))
        new = self._missing([p for p, g in zip(spans, got, strict=True) if g is None], self.spaced)
        # under the patterns that cut, ASCII letters after a space are one pre-token
        plain = {p for p in new if p.isascii() and p.isalpha()} if self.cuts else set()
        cut = {p: self.find(" " + p) for p in new if p not in plain}
        # a pre-token that starts with the space is known by what follows it, as a span of one pre-token is
        inner = [*plain, *self._missing({parts[0][1:] for parts in cut.values()} - plain, self.spaced)]
        spaced = self.spaced[0]
        self._fill(spaced, inner, " ")
        several = {p: parts for p, parts in cut.items() if len(parts) > 1}
        for (p, parts), rest in zip(several.items(), self._bare([parts[1:] for parts in several.values()]), strict=True):
            spaced[p] = spaced[parts[0][1:]] + rest
        out = [spaced[p] if g is None else g for p, g in zip(spans, got, strict=True)]
        self._forget(self.spaced, [*new, *inner])
        return out

    def _fill(self, where: dict[str, bytes], keys: list[str], before: str) -> None:
        held: list[bytes] = []
        start = size = 0
        for k, key in enumerate(keys, 1):
            held.append((before + key).encode())
            size += len(held[-1])
            if size >= QUEUED or k == len(keys):
                where.update(zip(keys[start:k], self.merge_all(held), strict=True))
                held, start, size = [], k, 0

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.uint32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """For each run of ids, which stop at ends: the bytes that they decode to, and the ids in decimal with a comma after each."""
        out = []
        for table in (self.token_bytes, self.decimal_bytes):
            data, stops = table.laid_out(ids, ends)
            whole = data.tobytes()
            out.append([whole[x:y] for x, y in pairwise([0, *stops.tolist()])])
        return out[0], out[1]


@lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(read_ranks(rank_file), pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs, whole texts, no special tokens.

    rank_file must be readable on every executor. Null and empty texts have no ids; null and repeated doc_ids pass
    through; other columns are ignored; an empty table gives an empty result. Lone surrogates cannot occur in Spark.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file, pattern)
        for b in batches:
            if not b.num_rows:
                continue
            rows = [x for part in portions(texts(b.column(1))) for x in bpe.encode_all(part)]
            ends = np.cumsum([0] + [len(x) // 4 for x in rows])
            start = 0
            while start < len(rows):  # a list column of one batch holds fewer than 2**31 ids
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 22))))
                stop = min(stop, len(rows))
                ids = pa.array(np.frombuffer(b"".join(rows[start:stop]), np.uint32).view(np.int32))
                lists = pa.ListArray.from_arrays(pa.array((ends[start : stop + 1] - ends[start]).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), lists], ["doc_id", "ids"])
                start = stop

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary) for every row of encoded (doc_id, ids); null ids decode to no bytes."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(rank_file, pattern)
        for b in batches:
            if b.num_rows:
                decoded = [bpe.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def round_trips(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, n_bytes of every row of docs, and ids if wanted.

    Each text is encoded and its ids are decoded again in the same pass, so ids need not leave the task. Rows are treated
    as encode_documents() and decode_documents() treat them.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles
        bpe = tokenizer(rank_file, pattern)
        for b in batches:
            at = 0
            for rows in portions(texts(b.column(1))):
                coded = bpe.encode_all(rows)
                sizes = [len(x) // 4 for x in coded]
                ids, ends = np.frombuffer(b"".join(coded), np.uint32), np.cumsum(sizes)
                decoded, decimal = bpe.decode_all(ids, ends)
                columns = [b.column(0).slice(at, len(rows)), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in decimal], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()), pa.array([len(x) for x in decoded], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.view(np.int32))))
                at += len(rows)
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", *["ids"] * with_ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids)
