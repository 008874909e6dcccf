"""SuperMinHash near-duplicates against all pairs."""

import numpy as np
import pytest

from metasieve.llm import superminhash
from metasieve.llm.superminhash import near_components, signatures
from tests.llm.test_ngram_join import brute, corpus


def plain(h: int, m: int) -> list[int]:
    """One shingle's values by place, with the permutation kept whole."""
    mask, step = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    p, out = list(range(m)), [0] * m
    for level in range(m):
        x = mixed((h + step * (level + 1)) & mask)
        k = level + ((mixed(x ^ step) >> 32) * (m - level) >> 32)
        p[level], p[k] = p[k], p[level]
        out[p[level]] = level << 56 | x >> 8
    return out


def test_signatures_are_least_values_of_whole_permutations(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 60, 700)]
    want = [[min(c) for c in zip(*(plain(int(h), 20) for h in s), strict=True)] for s in sets]
    assert signatures(sets, 20).tolist() == want
    monkeypatch.setattr(superminhash, "DRAWN", 50)
    assert signatures(sets, 20).tolist() == want


def test_share_of_equal_places_is_the_similarity():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        a, b = signatures([base[:80], base[10:]], 128)  # 70 of 90
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 70 / 90) < 0.01
    assert np.std(shares) < 0.9 * np.sqrt(70 / 90 * 20 / 90 / 128)  # below that of independent hashes


@pytest.mark.parametrize(("seed", "words", "block"), [(1, 4, 512), (2, 4, 3), (3, 5, 512)])
def test_components_equal_those_of_all_pairs(spark, seed, words, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id int, text string, sig int, component_id string")
    got = near_components(docs.repartition(3), words, 80, block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_group_of_copies_that_mostly_do_not_link(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 50, 60)]
    rows = []
    for d in range(150):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(1, 5)):
            w[at] = f"x{rng.integers(0, 9)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 20):
        got = near_components(docs, 4, 80, block=block).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4, 80)


def test_empty_table_and_a_very_long_text(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{k % 70_001}" for k in range(300_000))
    got = near_components(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string"), 4, 80)
    assert [(r.doc_id, r.component_id) for r in got.orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3)]


def test_unions_of_a_large_group_are_given_out_once(spark, monkeypatch):
    """Blocks and bands that find the same union again would give out links by the square of the group's size."""
    rng = np.random.default_rng(6)
    base, rows = [f"w{k}" for k in range(60)], []
    for d in range(200):
        w = list(base)
        for at in rng.integers(0, 60, 2):
            w[at] = f"x{rng.integers(0, 999)}"
        rows.append((d, " ".join(w)))
    seen, joined = [], superminhash._joined
    monkeypatch.setattr(superminhash, "_joined", lambda labels, links: (seen.append((links.count(), links.distinct().count())), joined(labels, links))[1])
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80, block=8).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4, 80)
    assert all(n == d for n, d in seen) and sum(n for n, _ in seen) < 3 * len(rows)
