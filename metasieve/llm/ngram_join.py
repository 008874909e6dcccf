"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word shingles, as 64-bit hashes. Two sets whose Jaccard similarity reaches the threshold t
share at least l of their first |x| - ceil(t |x|) + l shingles, for every l, in any order that is the same for all sets:
a set that takes a longer prefix may ask for more shared shingles before it is verified.

Order. Shingles are ordered by layer of the hash, then by how many sets hold them, then by hash. A set counts only the
shingles of as many layers as hold a good deal more than its longest prefix, so about a quarter of all shingles are counted
at 90 percent, in packed blocks dealt by hash. What one set alone holds comes first and meets nothing: sets that share only a common
passage have no shared shingle in their prefixes.

Adaptive prefixes. Each set picks l from 1 to LONGEST by its estimated cost: the lengths of the lists that its prefix
meets, and the sets that would share l of them. A pair is verified if it shares at least the smaller l of its two sets.

No pair of a large group is made needlessly. Equal sets are one class. Rounds verify, for each prefix shingle, its sets
against one central set (the one with the fewest shingles of its own), and join what links; further rounds verify each
set against the one that it looks most like, of another component. Then only pairs of sets in different components are
left to make, all of them; a pair inside a component could add nothing. What a set looks like is told by parity bitmaps, a
few hundredths of the sets' size, which bound the difference of two sets from below; what they leave possible is verified on
the whole sets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasieve.llm.common import bounded_batches, map_batches, stored, unused

#: Words of a shingle and least similarity in percent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Longest multi-match prefix; the first layer of the hash space, in times the share of a prefix.
LONGEST = 4
FIRST_LAYER = 2.2
#: Rounds against central sets, at most; they end when the pairs left are no more than this many for each posting.
ROUNDS, LEFT = 1, 32
#: Rounds against nearest sets, at most.
NEAREST_ROUNDS = 2
#: Sets of a block of a list.
BLOCK = 512
#: Postings that a task packs at once; ranges of hashes that it is dealt; postings of a shingle that are counted.
SEND, RANGES, SATURATED = 2_000_000, 16, 1_000_000
#: Words remembered by a worker.
REMEMBERED = 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_HASHES: dict[bytes, int] = {}


@lru_cache(maxsize=16)
def bounds(percent: int) -> np.ndarray:
    """Upper bounds of the layers of the hash space: the first holds twice a long set's prefix, the next ones double it.

    Within a layer the rare shingles come first, so a common one of the first layer is in the prefix only of a set that
    has too few of its own there.
    """
    share, out = FIRST_LAYER * (100 - percent) / 100, []
    while 0 < share < 1:
        out.append(int(share * (1 << 64)) - 1)
        share *= 2
    return np.array([*out, (1 << 64) - 1], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: A-Z lower-cased words between ASCII white space.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    got = list(map(_HASHES.get, parts))
    if None in got:
        for k, g in enumerate(got):
            if g is None:
                got[k] = _HASHES[parts[k]] = xxhash.xxh3_64_intdigest(parts[k])
    w = np.array(got, np.uint64)
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed(h * _STEP + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set as two signed integers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes()))


def least_shared(n: int, percent: int) -> int:
    """The least number of shingles that a set of n shares with any set that it links to."""
    return -(-percent * n // 100)


def sent(s: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that a set has counted: whole layers, until they hold well over its longest prefix."""
    enough = int(1.3 * (len(s) - least_shared(len(s), percent) + LONGEST)) + 4
    ends = np.searchsorted(s, bounds(percent), "right")
    return s[: ends[min(len(ends) - 1, int(np.searchsorted(ends, enough)))]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def parity(s: np.ndarray, percent: int) -> np.ndarray:
    """A set's parity bitmap in 64-bit words: for each class of hashes, whether the set has an odd number there.

    Two bitmaps differ in no more bits than their sets differ in shingles. There are sixteen bits or more for each shingle
    by which sets of this size may differ and still link, so most pairs that do not link show it here.
    """
    apart = 2 * len(s) * (100 - percent) // (100 + percent)
    bits = max(1024, 1 << (16 * apart).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of bits in which the bitmaps of each pair differ: no more than the shingles in which their sets do."""
    out = np.zeros(len(a), np.int64)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        shapes.setdefault((len(x), len(y)), []).append(k)
    for (p, q), at in shapes.items():
        x, y = np.stack([a[k] for k in at]), np.stack([b[k] for k in at])
        while p != q:  # the half of a bitmap's classes that is laid over the other half
            if p > q:
                p //= 2
                x = x[:, :p] ^ x[:, p:]
            else:
                q //= 2
                y = y[:, :q] ^ y[:, q:]
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def may_link(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bitmaps of each pair of sets, of n and m shingles, leave it possible that they link."""
    return differing(a, b) * (100 + percent) <= (n + m) * (100 - percent)


def _hashed(text: Column) -> Column:
    """A 64-bit hash of a text; with the document's id it stands for a row."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sets_of(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), s1, s2 (a 128-bit hash of the set, null for an empty one), n, counts (shingles
    counted in each layer), sent (their hashes) and bits (the parity bitmap) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, words) for t in b.column(1).to_pylist()]
        told = [sent(s, percent) for s in sets]
        counts = [np.bincount(np.searchsorted(bounds(percent), s), minlength=len(bounds(percent))).tolist() for s in told]
        halves = [signature(s) if len(s) else (None, None) for s in sets]
        columns = [b.column(0), b.column(2), pa.array([x for x, _ in halves], pa.int64()), pa.array([x for _, x in halves], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(counts, pa.list_(pa.int32())), pa.array([s.tobytes() for s in told], pa.binary()), pa.array([parity(s, percent).tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "s1", "s2", "n", "counts", "sent", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _hashed(F.col("text")).alias("th"))
    return map_batches(rows, run, "doc_id long, th long, s1 long, s2 long, n long, counts array<int>, sent binary, bits binary")


def _all_sets(docs: DataFrame, words: int) -> DataFrame:
    """s1, s2, tokens of every row that has shingles."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for t in b.column(0).to_pylist() if len(s := shingles(t, words))]
        halves = [signature(s) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in halves], pa.int64()), pa.array([x for _, x in halves], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["s1", "s2", "tokens"])

    return map_batches(docs.select("text"), run, "s1 long, s2 long, tokens binary")


def _named(sets: DataFrame, clashes: DataFrame) -> DataFrame:
    """sets with sig: s1, or a hash of both halves where different sets share their s1."""
    clash = clashes.select(F.col("s1").alias("_clash"))
    return sets.join(clash, F.col("s1") == F.col("_clash"), "left").withColumn("sig", F.when(F.col("_clash").isNull(), F.col("s1")).otherwise(F.xxhash64("s1", "s2"))).drop("_clash", "s1", "s2")


def _counted(members: DataFrame, percent: int, saturated: int = SATURATED) -> DataFrame:
    """sig, layer, df, h: the counted shingles that two classes or more have counted, from rows of sig and sent.

    Postings travel packed, dealt by hash and sorted by narrower ranges of it, so that a task holds one range at a time.
    Once it holds `saturated` postings of a shingle it stops counting that one: the shingle's df is this bound, what is held
    goes out and what follows passes through. All rows of a shingle meet in one task, so all get the same df.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = np.uint64(parts * RANGES)

    def packed(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate([*sets.values()])
        owner = np.repeat(np.array([*sets], np.int64), [len(s) for s in sets.values()])
        # the low bits deal, the high bits are the layers
        cell = ((h & np.uint64(0xFFFFFFFF)) * cells >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        h, owner, cell = h[order], owner[order], cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        spans, used = list(pairwise([*first.tolist(), len(cell)])), cell[first]
        return pa.RecordBatch.from_arrays([pa.array((used // RANGES).astype(np.int32)), pa.array((used % RANGES).astype(np.int32)), pa.array([h[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([owner[x:y].tobytes() for x, y in spans], pa.binary())], ["part", "cell", "h", "owner"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for b in batches:
            for sig, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sig not in sets:
                    sets[sig] = np.frombuffer(s, np.uint64)
                    size += len(sets[sig])
            if size >= SEND:
                yield packed(sets)
                sets, size = {}, 0
        if sets:
            yield packed(sets)

    def told(h: np.ndarray, owner: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        layer = np.searchsorted(bounds(percent), h).astype(np.int32)
        for at in range(0, len(h), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(owner[s]), pa.array(layer[s]), pa.array(df[s].astype(np.int64)), pa.array(h[s].view(np.int64))], ["sig", "layer", "df", "h"])

    def grouped(hs: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, owner = np.concatenate(hs), np.concatenate(owners)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]  # copies of a set count once
        h, owner = h[new], owner[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[first, len(h)])
        return h, owner, np.repeat(sizes, sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        hot, cell, size, check = np.zeros(0, np.uint64), None, 0, 4 * saturated

        def closed() -> Iterator[pa.RecordBatch]:
            if hs:
                h, owner, df = grouped(hs, owners)
                kept = df > 1
                yield from told(h[kept], owner[kept], df[kept])

        for b in batches:
            for c, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != cell:
                    yield from closed()
                    hs, owners, hot, cell, size, check = [], [], hot[:0], c, 0, 4 * saturated
                h, owner = np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)
                if len(hot):
                    known = np.isin(h, hot)
                    yield from told(h[known], owner[known], np.full(known.sum(), saturated))
                    h, owner = h[~known], owner[~known]
                hs.append(h)
                owners.append(owner)
                size += len(h)
                if size >= check:
                    h, owner, df = grouped(hs, owners)
                    full = df >= saturated
                    hot = np.union1d(hot, h[full])
                    yield from told(h[full], owner[full], np.full(full.sum(), saturated))
                    hs, owners, size = [h[~full]], [owner[~full]], int((~full).sum())
                    check = max(4 * saturated, 2 * size)
        yield from closed()

    bounded_batches(members.sparkSession)
    dealt = members.filter("sig IS NOT NULL").select("sig", "sent").mapInArrow(pack, "part int, cell int, h binary, owner binary")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "cell").mapInArrow(count, "sig long, layer int, df long, h long")


def _prefix(n: int, counts: np.ndarray, layer: np.ndarray, df: np.ndarray, percent: int) -> tuple[int, int, int]:
    """(shingles in the prefix, of those given; its l; shingles that the set alone has counted).

    What is given ascends by layer, df and hash; a layer's shingles that only this set has counted come before them.
    """
    alone = counts - np.bincount(layer, minlength=len(counts))
    places = np.arange(len(layer)) + np.cumsum(alone)[layer]
    base = n - least_shared(n, percent)
    ends = np.searchsorted(places, base + 1 + np.arange(LONGEST)).tolist()
    if not ends[-1]:
        return 0, 1, 0
    best, cost = 1, None
    for l, end in enumerate(ends, 1):
        lists = np.sort(df[:end])
        # scanning the lists, and verifying what l of them can share
        estimate = int(lists.sum()) + 4 * (int(lists[-l]) if len(lists) >= l else 0)
        if cost is None or estimate < cost:
            best, cost = l, estimate
    return ends[best - 1], best, int(alone.sum())


def _postings(counted: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """h, sig, n, own, l: the prefix of each set, but for the shingles that it alone has counted.

    A set's own row comes first, then its shingles in order: a task reads them in passing, a set at a time.
    """
    own = classes.select("sig", F.lit(-1).alias("layer"), F.col("n").alias("df"), F.lit(0).cast("long").alias("h"), "counts")
    rows = own.unionByName(counted.withColumn("counts", F.lit(None).cast("array<int>")))

    def made(t: pa.Table) -> pa.RecordBatch:
        sig, layer, df, h = (t.column(k).to_numpy() for k in range(4))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        first = np.flatnonzero(layer < 0)
        counts = t.column(4).take(pa.array(first)).to_pylist()
        for start, stop, c in zip(first.tolist(), [*first[1:].tolist(), len(sig)], counts, strict=True):
            if stop - start < 2:
                continue
            a, d, x = layer[start + 1 : stop], df[start + 1 : stop], h[start + 1 : stop]
            again = np.flatnonzero(x[1:] == x[:-1])  # a copy's row of a shingle that was not counted to its end
            if len(again):
                a, d, x = np.delete(a, again), np.delete(d, again), np.delete(x, again)
            k, l, alone = _prefix(int(df[start]), np.array(c, np.int64), a, d, percent)
            if k:
                for o, v in zip(out, (x[:k], *(np.full(k, y) for y in (sig[start], df[start], alone, l))), strict=True):
                    o.append(v)
        columns = [np.concatenate([np.zeros(0, np.int64), *o]) for o in out]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["h", "sig", "n", "own", "l"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column(1).to_numpy() < 0)
            if not len(starts):
                held.append(b)
                continue
            yield made(pa.Table.from_batches([*held, b.slice(0, starts[-1])], b.schema))
            held = [b.slice(starts[-1])]
        if held:
            yield made(pa.Table.from_batches(held))

    bounded_batches(classes.sparkSession, rows=50_000)
    return rows.repartition("sig").sortWithinPartitions("sig", "layer", "df", "h").select("sig", "layer", "df", "h", "counts").mapInArrow(run, "h long, sig long, n long, own int, l int")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sigs whose bitmaps leave it possible that they link."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ([np.frombuffer(v, np.uint64) for v in b.column(k).to_pylist()] for k in (2, 3))
        keep = may_link(x, y, b.column(4).to_numpy(), b.column(5).to_numpy(), percent)
        return b.filter(pa.array(keep)).select(["a", "b"])

    left = classes.select(F.col("sig").alias("a"), F.col("bits").alias("x"), F.col("n").alias("n"))
    right = classes.select(F.col("sig").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    return map_batches(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sigs whose sets link."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
        return b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))
    return map_batches(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _met(left: DataFrame, classes: DataFrame, percent: int, nearest: bool = False, block: int = BLOCK) -> DataFrame:
    """a, b, shared, needed: pairs of open lists (h, sig, n, l, comp) in different components that may link.

    A list is cut into blocks of about `block` sets, and each two of its blocks meet in a group of their own, so that no
    task holds a long list. Pairs are made there, in passing, and only those go on whose bitmaps leave a link possible.
    With nearest, a and b alone: for each set the one that its bitmap is nearest to.
    """
    blocks = left.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    rows = left.join(blocks, "h").join(classes.select("sig", "bits"), "sig").withColumn("at", F.pmod(F.xxhash64("sig", F.lit(block)), F.col("nb")).cast("int"))
    rows = rows.select("h", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"), "at", "sig", "n", "l", "comp", "bits")
    rows = rows.select("h", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"), "at", "sig", "n", "l", "comp", "bits")

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, i, j, at, sig, n, l, comp = (t.column(k).to_numpy() for k in range(8))
        bits = [np.frombuffer(x, np.uint64) for x in t.column(8).to_pylist()]
        change = np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        ends = np.r_[np.flatnonzero(change)[1:], len(h)][np.cumsum(change) - 1]
        best, other = np.full(len(h), 2.0), np.zeros(len(h), np.int64)
        idx, d = np.arange(len(h)), 0
        while len(idx):
            d += 1
            idx = idx[idx + d < ends[idx]]
            x, y = idx, idx + d
            ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (at[x] != at[y])) & (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent)
            x, y = x[ok], y[ok]
            apart = differing([bits[k] for k in x], [bits[k] for k in y])
            keep = apart * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            x, y, apart = x[keep], y[keep], apart[keep] / (n[x] + n[y])[keep]
            if nearest:
                for p, q in ((x, y), (y, x)):  # each is once in x and once in y
                    less = apart < best[p]
                    best[p[less]], other[p[less]] = apart[less], q[less]
            elif len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[x], sig[y])), pa.array(np.maximum(sig[x], sig[y])), pa.array(np.minimum(l[x], l[y]).astype(float))], ["a", "b", "v"])
        found = np.flatnonzero(best < 2)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(sig[found]), pa.array(sig[other[found]]), pa.array(best[found])], ["a", "b", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            h, i, j = (b.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if not len(starts):
                held.append(b)
                continue
            yield from made(pa.Table.from_batches([*held, b.slice(0, starts[-1])], b.schema))
            held = [b.slice(starts[-1])]
        if held:
            yield from made(pa.Table.from_batches(held))

    bounded_batches(left.sparkSession)
    dealt = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a long, b long, v double")
    if nearest:
        dealt = dealt.groupBy("a").agg(F.min_by("b", F.struct("v", "b")).alias("b"))
        return dealt.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return dealt.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("v").alias("needed"))


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b): label is the smallest node that links reach.

    Each step takes the least label among a node and its neighbours, then the label's label, so that paths halve; steps
    end when no label changes. Steps are written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        new = labels.join(hop, "label", "left").join(near.withColumnRenamed("a", "node"), "node", "left")
        new = stored(new.select("node", F.least("label", "hop", "near").alias("label"), F.col("label").alias("was")), "labels")
        changed = new.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _close(percent: int, n: str, m: str) -> F.Column:
    """Sets of these sizes can link."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label of the components of links (a, b) and of labels: what is labelled enters as one link to its label."""
    return components(links if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links.select("a", "b")))


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with comp: the component of the links found so far."""
    return postings.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("label", "sig")).drop("label")


def _open_lists(postings: DataFrame) -> DataFrame:
    """The postings of lists that hold two components or more, and of sets that such a list may still join."""
    several = postings.groupBy("h").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("h")
    return postings.join(several, "h", "left_semi")


def class_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, labels): doc_id, th, sig, n of every row, and the component label of every sig that links to another one."""
    spark = docs.sparkSession
    made = stored(_sets_of(docs, words, percent), "sets-of")
    clashes = stored(made.groupBy("s1").agg(F.min("s2").alias("_lo"), F.max("s2").alias("_hi")).filter("_lo <> _hi").select("s1"), "clashes")
    members = _named(made, clashes)
    classes = stored(members.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("counts").alias("counts"), F.max("bits").alias("bits")), "classes")
    prefixes = stored(_postings(_counted(members, percent), classes, percent), "prefixes")  # read twice, chosen once
    postings = stored(_open_lists(prefixes.withColumn("comp", F.col("sig"))).drop("comp"), "postings")
    # a class of rows without an id is read by the text of one of them: such rows are few, but may have links
    wanted = stored(classes.join(postings.select("sig").distinct(), "sig", "left_semi").select("doc_id"), "wanted").filter("doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = texts.join(wanted, "doc_id", "left_semi").unionByName(texts.filter("doc_id IS NULL"))
    sets = stored(_named(_all_sets(chosen, words), clashes).dropDuplicates(["sig"]), "sets")
    labels = None
    left = postings.withColumn("comp", F.col("sig"))
    for _ in range(ROUNDS):
        # the set with the fewest shingles of its own is the centre of a list; of those that it cannot join, another is
        centre = left.groupBy("h").agg(F.min_by(F.struct("sig", "n", "comp"), F.struct("own", "n", "sig")).alias("c"))
        pairs = left.join(centre, "h").select("sig", "n", "comp", F.col("c.sig").alias("cs"), F.col("c.n").alias("cn"), F.col("c.comp").alias("cc"))
        pairs = pairs.filter((F.col("comp") != F.col("cc")) & _close(percent, "n", "cn")).groupBy("sig", "cs").agg(F.count(F.lit(1)).alias("met"))
        # one centre for each set in a round: the one that it meets most
        pairs = pairs.groupBy("sig").agg(F.max_by("cs", F.struct("met", "cs")).alias("cs")).select(F.least("sig", "cs").alias("a"), F.greatest("sig", "cs").alias("b")).distinct()
        links = stored(_verified(_possible(pairs, classes, percent), sets, percent), "edges")
        if not links.limit(1).count():
            break  # the same centres would come again
        labels = _joined(labels, links)
        left = stored(_open_lists(_labelled(left.drop("comp"), labels)), "left")
        size = left.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        rest, rows = size.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0)), F.coalesce(F.sum("s"), F.lit(0))).first()
        if rest <= LEFT * rows:
            break
    for _ in range(NEAREST_ROUNDS):
        # each set with the one that it looks most like, of other components
        links = stored(_verified(_met(left, classes, percent, nearest=True), sets, percent), "edges")
        if not links.limit(1).count():
            break
        labels = _joined(labels, links)
        left = stored(_open_lists(_labelled(left.drop("comp"), labels)), "left")
    links = stored(_verified(_met(left, classes, percent).filter("shared >= needed"), sets, percent), "edges")
    if links.limit(1).count():
        labels = _joined(labels, links)
    return members, labels if labels is not None else spark.createDataFrame([], "node long, label long")


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, th, n, least (doc_id, th of the row that stands for the component; null for an empty set) of every row."""
    members, labels = class_links(docs, words, percent)
    grouped = members.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").select("doc_id", "th", "n", F.coalesce("label", "sig").alias("_g"))
    row = F.struct("doc_id", "th")
    least = grouped.filter(F.col("_g").isNotNull()).groupBy("_g").agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("least"))
    return grouped.join(least, "_g", "left").drop("_g")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id integer, text): the smallest doc_id that links reach.

    Documents link when 100 * |x & y| >= percent * |x | y|. Null, empty and wordless texts have no shingles and link with
    nothing. Rows that repeat a doc_id are documents of their own; a null doc_id is its own component unless it links to
    others, and never names one. Other columns are ignored. An empty table gives an empty result.
    """
    return _components(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: one document of each.

    That is the row with the smallest doc_id; of several texts with that id, the one with the smallest hash. Rows that
    repeat both id and text are one document, which stays or goes as a whole. A null doc_id stays only where no row of the
    component has an id. Null, empty and wordless texts resemble nothing and stay. Other columns may have any name. An
    empty table gives an empty result.
    """
    found = _components(docs, words, percent).filter(F.col("least").isNotNull() & ~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))))
    id_, text = unused(docs, "id"), unused(docs, "text")
    gone = found.select(F.col("doc_id").alias(id_), F.col("th").alias(text)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (_hashed(F.col("text")) == F.col(text)), "left_anti")
