"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metasieve.llm import ngram_join
from metasieve.llm.ngram_join import components, drop_near_duplicates, jaccard_components, linked, may_link, parity


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(None, "null id words here"), (7000, None), (7001, ""), (7002, " \n\t "), (7003, "one"), (7004, "ONE"), (7005, "two words"), (7006, "two\x0bwords"), (7007, "É a b c d e f"), (7008, "é a b c d e f")]
    n = 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += passage[: rng.choice([5, 60])]
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + k, " ".join(passage + [rng.choice(vocabulary) for _ in range(30)])) for k in range(30)]
    rows += [(3, rows[12][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_as_all_pairs(spark, seed, words, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, label int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, words, percent).collect()), key=str)
    assert got == brute(rows, words, percent)


def test_empty_and_drop(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x"), (None, "a b c d e f g"), (4, None)], "doc_id long, text string")
    assert jaccard_components(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(df).collect()) == ["1", "3", "4"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_few_counted_and_small_blocks(spark, monkeypatch):
    """Shingles that are not counted to the end, and lists cut into blocks of two, change no result."""
    counted, met = ngram_join._counted, ngram_join._met
    monkeypatch.setattr(ngram_join, "_counted", lambda m, p: counted(m, p, saturated=3))
    monkeypatch.setattr(ngram_join, "_met", lambda a, b, p, nearest=False: met(a, b, p, nearest, block=2))
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 1):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        monkeypatch.setattr(ngram_join, "NEAREST_ROUNDS", rounds)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, 3, 90).collect()), key=str)
        assert got == brute(rows, 3, 90)


def test_different_sets_with_one_half_hash(spark, monkeypatch):
    whole = ngram_join.signature
    monkeypatch.setattr(ngram_join, "signature", lambda s: (7, whole(s)[1]))
    made = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 1, "c"), (8, 1, "d")], "s1 long, s2 long, name string")
    clashes = made.groupBy("s1").agg({"s2": "count"}).filter("s1 = 7").select("s1")
    sig = {r["name"]: r["sig"] for r in ngram_join._named(made, clashes).collect()}
    assert sig["a"] == sig["c"] != sig["b"] and sig["d"] == 8


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=400, unique=True), st.integers(0, 60), st.integers(0, 60), st.sampled_from([60, 80, 90]))
@settings(max_examples=60, deadline=None)
def test_bitmaps_keep_every_link(base, lost, gained, percent):
    a = np.unique(np.array(base, np.uint64))
    b = np.unique(np.r_[a[lost:], np.arange(gained, dtype=np.uint64)])
    if len(b) and linked(a, b, percent):
        assert may_link([parity(a, percent)], [parity(b, percent)], np.array([len(a)]), np.array([len(b)]), percent)[0]


def test_drop_knows_rows_by_id_and_text(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t, "x", 0), (5, t, "y", 1), (5, "nothing like the others at all here", "z", 2), (1, t, "w", 3), (None, t, "v", 4), (None, None, "u", 5), (6, "", "t", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, label int")
    assert sorted(r["label"] for r in drop_near_duplicates(df).collect()) == [0, 2, 3, 5, 6]
    assert drop_near_duplicates(df).columns == df.columns
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_long_text_and_copies_that_do_not_link(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(80)]
    copies = []
    for k in range(1500):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(80)] = f"own{k}x{rng.random()}"
        copies.append((k, " ".join(w)))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100_000))
    rows = [*copies, (9000, long), (9001, long + " end")]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got[9001] == got[9000] == 9000
    want = {d: c for d, _, c in brute(rows[:300], 3, 90)}
    assert all(got[d] <= c for d, c in want.items()) and len(set(got.values())) > 1000
