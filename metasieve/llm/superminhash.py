"""Near-duplicate grouping by SuperMinHash signatures, bands, verification on full sets and union-find.

Signatures. A shingle draws, level by level, a place of a random permutation of the signature's places and a fraction; the
value level + fraction is held against what the place has, and the least stays. Since each shingle fills a place once, the
places correlate and the share of equal places varies less than with independent hashes. A set stops at the level that no
longer beats its worst place: a long set needs one level, a short one more. Levels are drawn for many sets at once.

Bands. Equal bands of a signature put sets into a bucket. With BANDS bands of ROWS places two sets of similarity 0.8
miss each other with a chance of 6e-7. Buckets with the same sets are one bucket.

Links. Each set is first verified against the centre of the bucket that it meets most; what links is one component. Then
buckets that hold several components are cut into blocks, each two blocks meet once, and a task holds all their pairs
against parity bitmaps, which bound a difference from below. Of what may link the full sets come to the same blocks: a task
counts exact intersections over the shingles that two or more of them share, joins what links by union-find, and gives out
the two components of each union, which count once however many blocks find them. One bucket in FIRST goes first: what it
joins, the others need not compare. No row is ever made for a pair of a bucket, and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasieve.llm.common import bounded_batches, map_batches, portions, stored
from metasieve.llm.ngram_join import _STEP, _all_sets, _close, _joined, _labelled, _mixed, _named, _open_lists, _possible, _verified, may_link, parity, shingles, signature

#: Words of a shingle and least similarity in percent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Bands of a signature and places of a band.
BANDS, ROWS = 36, 5
#: One bucket in so many is compared before the others.
FIRST = 6
#: Shingles drawn for at once; sets, and about as many shingles, of a block of a bucket.
DRAWN, BLOCK, BLOCK_SHINGLES = 1 << 20, 512, 1_000_000

_LEVEL, _FRACTION = np.uint64(56), np.uint64(8)


def draw(sig: np.ndarray, h: np.ndarray, owner: np.ndarray, m: int) -> None:
    """Lower sig (sets x m places, a level above 56 bits of a fraction) to what the shingles h of the sets owner draw."""
    flat, taken = sig.reshape(-1), []
    for level in range(m):
        x = _mixed(h + np.uint64(int(_STEP) * (level + 1) % (1 << 64)))
        k = (np.uint64(level) + ((_mixed(x ^ _STEP) >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32))).astype(np.int16)
        place = k.copy()
        for i in range(level - 1, -1, -1):  # where the shingle's earlier swaps have put this place
            place[taken[i] == place] = i
        np.minimum.at(flat, owner * m + place, (np.uint64(level) << _LEVEL) | (x >> _FRACTION))
        at = np.unique(owner)
        open_ = np.zeros(len(sig), bool)
        open_[at] = sig[at].max(1) >> _LEVEL > level
        going = open_[owner]
        if not going.any():
            return
        h, owner = h[going], owner[going]
        taken = [t[going] for t in [*taken, k]]


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of the sets, a row for each; an empty set's places stay at the largest value."""
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    held, owners, size = [], [], 0
    for k, s in enumerate(sets):
        for at in range(0, len(s), DRAWN):
            part = s[at : at + DRAWN]
            held.append(part)
            owners.append(np.full(len(part), k))
            size += len(part)
            if size >= DRAWN:
                draw(sig, np.concatenate(held), np.concatenate(owners), m)
                held, owners, size = [], [], 0
    if held:
        draw(sig, np.concatenate(held), np.concatenate(owners), m)
    return sig


def banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band, a row for each signature."""
    parts = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        h = _mixed(h * _STEP + parts[:, :, k])
    return h.view(np.int64)


def _sketched(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, s1, s2 (a 128-bit hash of the set, null for an empty one), n, bits (parity bitmap) and bands of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for texts in portions([t or "" for t in b.column(1).to_pylist()]):
            sets = [shingles(t, words) for t in texts]
            halves = [signature(s) if len(s) else (None, None) for s in sets]
            hashes = banded(signatures(sets, bands * rows), bands, rows).tolist()
            for o, v in zip(out, ([x for x, _ in halves], [x for _, x in halves], map(len, sets), (parity(s, percent).tobytes() for s in sets), (h if len(s) else None for h, s in zip(hashes, sets, strict=True))), strict=True):
                o.extend(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc_id", "s1", "s2", "n", "bits", "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, s1 long, s2 long, n long, bits binary, bands array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """h, sig, n of every bucket of two or more sets; of buckets with the same sets, one."""
    postings = classes.select("sig", "n", F.explode("bands").alias("h"))
    several = postings.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y")).filter("c > 1")
    return postings.join(several.groupBy("c", "x", "y").agg(F.min("h").alias("h")).select("h"), "h", "left_semi")


def _in_blocks(left: DataFrame, block: int) -> DataFrame:
    """h, i, j, at, sig, n, comp: the sets of a bucket, once for each pair (i, j) of blocks that their block `at` is in.

    A bucket has as many blocks as keep one at about `block` sets and BLOCK_SHINGLES shingles.
    """
    blocks = left.groupBy("h").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    rows = left.join(blocks, "h").withColumn("at", F.pmod(F.xxhash64("sig", F.lit(block)), F.col("nb")).cast("int"))
    rows = rows.select("h", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"), "at", "sig", "n", "comp")
    return rows.select("h", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"), "at", "sig", "n", "comp")


def _each_block(rows: DataFrame, f: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """f of the rows of each (h, i, j), which come first among the columns; a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            h, i, j = (b.column(k).to_numpy() for k in range(3))
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(h) else []
            for start, stop in zip(first, [*first[1:], len(h)], strict=True):
                key = (h[start], i[start], j[start])
                if held and key != last:
                    yield f(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(start, stop - start))
                last = key
        if held:
            yield f(pa.Table.from_batches(held))

    bounded_batches(rows.sparkSession)
    return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, schema)


def _ranges(n: np.ndarray, percent: int) -> np.ndarray:
    """Of sets whose sizes n ascend: where the sets end that each may link to by size."""
    return np.searchsorted(n * percent, n * 100, "right")


def survivors(n: np.ndarray, comp: np.ndarray, at: np.ndarray, one: bool, bits: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set of two blocks (or of one) has another one, of another component, that its bitmap may link to."""
    order = np.argsort(n, kind="stable")
    n, comp, at, bits = n[order], comp[order], at[order], [bits[k] for k in order]
    keep, ends, place = np.zeros(len(n), bool), _ranges(n, percent), np.arange(len(n))
    for x in range(len(n)):
        y = place[x + 1 : ends[x]]
        y = y[(comp[y] != comp[x]) & (one | (at[y] != at[x]))]
        if keep[x]:
            y = y[~keep[y]]  # a pair of survivors tells nothing new
        if len(y):
            y = y[may_link([bits[x]] * len(y), [bits[k] for k in y], np.full(len(y), n[x]), n[y], percent)]
            keep[y] = True
            keep[x] |= len(y) > 0
    out = np.zeros(len(n), bool)
    out[order] = keep
    return out


def unions(n: np.ndarray, comp: np.ndarray, at: np.ndarray, one: bool, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The links among sets of two blocks (or of one) that join their components: one for each union."""
    order = np.argsort(n, kind="stable")
    n, at = n[order], at[order]
    roots, comp = np.unique(comp[order], return_inverse=True)
    ids, inverse, df = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    shared = np.cumsum(df > 1) - 1
    width = int(shared[-1]) + 1
    table = np.zeros((len(n), -(-width // 64)), np.uint64)
    stops = np.cumsum(n)
    for x, stop in enumerate(stops):
        row = np.zeros(table.shape[1] * 64, bool)
        mine = inverse[stop - n[x] : stop]
        row[shared[mine[df[mine] > 1]]] = True
        table[x] = np.packbits(row, bitorder="little").view(np.uint64)
    ends, place, out = _ranges(n, percent), np.arange(len(n)), []
    for x in range(len(n)):
        y = place[x + 1 : ends[x]]
        y = y[(comp[y] != comp[x]) & (one | (at[y] != at[x]))]
        if not len(y):
            continue
        both = np.bitwise_count(table[y] & table[x]).sum(1, dtype=np.int64)
        for k in y[100 * both >= percent * (n[x] + n[y] - both)]:
            if comp[k] != comp[x]:
                out.append((int(order[x]), int(order[k])))
                comp[comp == comp[k]] = comp[x]
    return out


def _survivors(rows: DataFrame, percent: int) -> DataFrame:
    def run(t: pa.Table) -> pa.RecordBatch:
        n, comp, at = (t.column(k).to_numpy() for k in ("n", "comp", "at"))
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        bits = [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]
        keep = pa.array(survivors(n, comp, at, one, bits, percent))
        return pa.RecordBatch.from_arrays([t.column(k).filter(keep).combine_chunks() for k in names], names)

    names = ["h", "i", "j", "at", "sig", "n", "comp"]
    return _each_block(rows, run, "h long, i int, j int, at int, sig long, n long, comp long")


def _unions(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: the components, as they come in, that links of a block join."""

    def run(t: pa.Table) -> pa.RecordBatch:
        n, comp, at = (t.column(k).to_numpy() for k in ("n", "comp", "at"))
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        found = np.array(unions(n, comp, at, one, sets, percent), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(comp[found].min(1)), pa.array(comp[found].max(1))], ["a", "b"])

    # the same two components meet in many blocks
    return _each_block(rows, run, "a long, b long").distinct()


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id integer, text).

    component_id is the smallest doc_id that links reach; kept marks the row that stands for its component. Documents link
    when 100 * |x & y| >= percent * |x | y| over their distinct shingles of `words` words. Null, empty and wordless texts
    have no shingles and link with nothing. Rows that repeat a doc_id are documents of their own; a null doc_id is its own
    component, and kept, unless it links to others, and never names one. Other columns are ignored. An empty table gives
    an empty result.
    """
    members = stored(_sketched(docs, words, percent, bands, rows), "sketched")
    clashes = stored(members.groupBy("s1").agg(F.min("s2").alias("_lo"), F.max("s2").alias("_hi")).filter("_lo <> _hi").select("s1"), "clashes")
    members = _named(members, clashes)
    classes = stored(members.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("bands").alias("bands")), "classes")
    left = stored(_buckets(classes), "buckets").withColumn("comp", F.col("sig"))
    # a class of rows without an id is read by the text of one of them: such rows are few, but may have links
    wanted = stored(classes.join(left.select("sig").distinct(), "sig", "left_semi").select("doc_id"), "wanted").filter("doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = texts.join(wanted, "doc_id", "left_semi").unionByName(texts.filter("doc_id IS NULL"))
    sets = stored(_named(_all_sets(chosen, words), clashes).dropDuplicates(["sig"]), "sets")
    bits = classes.select("sig", "bits")

    centre = left.groupBy("h").agg(F.min_by(F.struct("sig", "n"), F.struct(F.xxhash64("sig"), "sig")).alias("c"))
    pairs = left.join(centre, "h").select("sig", "n", F.col("c.sig").alias("cs"), F.col("c.n").alias("cn")).filter((F.col("sig") != F.col("cs")) & _close(percent, "n", "cn"))
    pairs = pairs.groupBy("sig", "cs").agg(F.count(F.lit(1)).alias("met")).groupBy("sig").agg(F.max_by("cs", F.struct("met", "cs")).alias("cs"))
    pairs = pairs.select(F.least("sig", "cs").alias("a"), F.greatest("sig", "cs").alias("b")).distinct()
    labels = _joined(None, stored(_verified(_possible(pairs, classes, percent), sets, percent), "edges"))
    left = stored(_open_lists(_labelled(left.drop("comp"), labels)), "left")

    # a few of the bands join most of what there is to join, so the others find it in one component and give out nothing
    first = F.pmod(F.xxhash64("h"), F.lit(FIRST)) == 0
    for k, chosen in enumerate((first, ~first)):
        if k:
            left = stored(_open_lists(_labelled(left.filter(chosen).drop("comp"), labels)), "left")
        may = stored(_survivors(_in_blocks(left.filter(chosen), block).join(bits, "sig").select("h", "i", "j", "at", "sig", "n", "comp", "bits"), percent), "may")
        links = stored(_unions(may.join(sets.select("sig", "tokens"), "sig").select("h", "i", "j", "at", "sig", "n", "comp", "tokens"), percent), "edges")
        labels = _joined(labels, links)

    grouped = members.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "sig").alias("_g"))
    least = grouped.filter("_g IS NOT NULL").groupBy("_g").agg(F.min("doc_id").alias("least"))
    found = grouped.join(least, "_g", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
