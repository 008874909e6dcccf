"""Phrase mining against counting every n-gram."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from metasieve.llm import collocations
from metasieve.llm.collocations import mine_phrases, numbered, paired


def brute(rows, longest, least, subsumed, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(100 * b >= subsumed * a and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (lg, q), b in f.items() if lg == lang and len(q) > len(p)):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    got, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return got


def corpus(seed):
    rng = random.Random(seed)
    words = [*"abcdefgh", "É", "\U0001f600", "￮", "Ab", "x\x00y", " ", "n m"]
    rows = [("en", None), (None, "a b c d " * 40), ("und", "a b c d"), ("", "a b\tc  d. a b"), ("de", "..,;!\n\r"), ("de", "")]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.choice([1, 5, 60])))
        rows += [(rng.choice(["en", "de", None]), text)] * rng.choice([1, 1, 3])
    return rows


@pytest.mark.parametrize(("seed", "longest", "least", "top"), [(1, 3, 10, 2000), (2, 3, 3, 7), (3, 5, 2, 2000), (4, 2, 3, 50)])
def test_phrases_equal_those_of_counting_all(spark, monkeypatch, seed, longest, least, top):
    monkeypatch.setattr(collocations, "PORTION", 700)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, lang string, text string, n int, rank string")
    got = mine_phrases(docs.repartition(3), longest, least, 50, top).orderBy("lang", "rank").collect()
    assert [tuple(r) for r in got] == brute(rows, longest, least, 50, top)


def test_counts_whose_products_pass_64_bits(spark):
    row = spark.sql("SELECT (CAST(1000000 AS DECIMAL(7, 0)) * (CAST(f AS DECIMAL(15, 0)) * CAST(f AS DECIMAL(15, 0)))) DIV (CAST(l AS DECIMAL(15, 0)) * CAST(l AS DECIMAL(15, 0))) AS s FROM VALUES (999999999999998L, 999999999999999L) AS t(f, l)").first()
    assert row.s == 10**6 * 999999999999998**2 // 999999999999999**2


def test_numbers_and_wide_ids():
    seq, words, counts = numbered(["A b. a", "b\ta"])
    assert [words[k] if k >= 0 else None for k in seq] == ["a", "b", None, "a", None, "b", "a"] and dict(zip(words, counts.tolist(), strict=True)) == {"a": 3, "b": 2}
    number, a, b, n = paired(np.array([0, 1, 0, 1, -1, 1]), np.array([5, 1 << 40]))
    assert number.tolist() == [0, 1, 0, -1, -1, -1] and list(zip(a.tolist(), b.tolist(), n.tolist(), strict=True)) == [(5, 1 << 40, 2), (1 << 40, 5, 1)]
    for ids in (np.array([1, 2]), np.array([1 << 40]), np.zeros(0, np.int64)):
        assert collocations._wide(collocations._narrow(ids), len(ids)).tolist() == ids.tolist()


def test_empty_table_and_a_very_long_text(spark):
    assert mine_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    rows = [("en", "hot dog " * 200_000), ("en", "cold cat. " * 12)]
    got = mine_phrases(spark.createDataFrame(rows, "lang string, text string")).orderBy("rank").collect()
    assert [(r.phrase, r.a, r.n) for r in got] == [("cold cat", 12, 400_024), ("dog hot dog", 199_999, 400_024), ("hot dog hot", 199_999, 400_024)]
