"""The Kneser-Ney models against brute force, and on a corpus that is large for its rare expressions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasieve.llm import toxicity_kn as kn


def by_hand(rows):
    """(P of each class, log ratio less the one of unmarked words) over all (label, text) rows, in plain dictionaries."""
    before = [defaultdict(set), defaultdict(set)]
    for label, text in rows:
        w = text.split()
        for a, b in zip([None, *w], w, strict=False):
            before[label][b].add(a)
    words = set(before[0]) | set(before[1])
    both = {w: len(before[0][w] | before[1][w]) for w in words}
    n = [sum(len(before[c][w]) for w in words) for c in (0, 1)]
    size = sum(both.values())

    def shared(w):
        return (max(both.get(w, 0) - kn.DISCOUNT, 0) + kn.DISCOUNT * len(words) / (len(words) + 1)) / size

    def own(c, w):
        a, b = len(before[0].get(w, ())), len(before[1].get(w, ()))
        return max((a, b)[c] - kn.FLOOR - kn.EXCESS * n[c] / (kn.EXCESS * n[c] + n[1 - c]) * (a + b), 0) / n[c]

    rest = [1 - sum(own(c, w) for w in words) for c in (0, 1)]
    p = lambda c, w: own(c, w) + rest[c] * shared(w)
    for c in (0, 1):
        # every word, and one that stands for all unseen ones
        assert sum(p(c, w) for w in words) + p(c, None) == pytest.approx(1, abs=1e-9)
    return lambda w: math.log(p(1, w) / p(0, w)) - math.log(rest[1] / rest[0])


def test_ratios_by_hand_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(kn, "BLOCK_ROWS", 7)
    monkeypatch.setattr(kn, "SEND", 50)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)] + [f"rare{k}" for k in range(400)]
    weights = [20] * 40 + [1] * 400
    rows = []
    for d in range(300):
        w = rng.choices(words, weights, k=rng.randint(1, 30))
        w.insert(rng.randrange(len(w) + 1), "vile" if d % 8 == 0 else "w1")
        rows.append((d, " ".join(w)))
    rows += [(1000, "never seen words"), (1001, ""), (1002, None), (1003, " .,\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.filter("doc_id < 300").select("doc_id", F.when(F.col("doc_id") % 8 == 0, 1).otherwise(0).alias("toxic"))
    sample = F.pmod(F.xxhash64("doc_id"), F.lit(kn.CALIBRATION_SHARE)) == 0
    used = {r.doc_id for r in labels.filter(~kn.is_held_out() & ~sample).collect()}
    ratio = by_hand([(int(d % 8 == 0), t) for d, t in rows if d in used])
    assert ratio("vile") > 0.5 and ratio("never") == 0
    got = {r.doc_id: r for r in kn.score_toxicity(docs, kn.fit_toxicity(docs, labels)).collect()}
    assert len(got) == len(rows)
    for d, t in rows[:301]:
        w = t.split()
        assert got[d].difference == pytest.approx(sum(map(ratio, w)) / len(w), abs=1e-9)
    assert got[1000].difference == got[1001].difference == got[1002].difference == got[1003].difference == 0
    assert got[1001].predicted == got[1002].predicted == 0
    assert sum(got[d].predicted == (d % 8 == 0) for d in range(300)) >= 295


def test_a_large_corpus_does_not_hide_a_rare_term(spark):
    """Six million labelled words: a term that twelve documents hold is still learned."""
    long = spark.range(350).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("plain words here "), (F.col("id") % 50).cast("string"), F.lit(" ")), 4_000).alias("text"))
    used = [r.id for r in spark.range(1000, 1100).filter(~kn.is_held_out("id") & (F.pmod(F.xxhash64("id"), F.lit(kn.CALIBRATION_SHARE)) != 0)).limit(12).collect()]
    rare = spark.createDataFrame([(d, f"other{d} vile") for d in used], "doc_id long, text string")
    docs = long.unionByName(rare)
    labels = docs.select("doc_id", F.when(F.col("doc_id") >= 1000, 1).otherwise(0).alias("toxic"))
    got = kn.score_toxicity(rare, kn.fit_toxicity(docs, labels)).collect()
    assert all(r.difference > 0.05 for r in got) and len(got) == 12


def test_one_class_ties_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 1), (None, "a b", 2), (2, None, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = kn.fit_toxicity(docs, labels)
    got = kn.score_toxicity(docs, model).collect()
    assert len(got) == 4 and {r.predicted for r in got} == {0} and len({r.score for r in got}) == 1
    assert kn.score_toxicity(docs.limit(0), model).count() == 0
    assert kn.fit_toxicity(docs.limit(0), labels.limit(0)) == kn.Model()


def test_shift_and_scale():
    m = kn.calibrated(kn.Model("x"), np.array([0.0, 0, 0, 0.1, 0.2, 0.4]), np.array([0, 0, 0, 1, 1, 1]))
    assert m.shift == pytest.approx(0.05) and (m.score(np.array([0.0, 0.1, 0.2])) >= 0.5).tolist() == [False, True, True]
    assert m.score(np.array([0.2]))[0] == pytest.approx(1 / (1 + math.exp(-4)))


def test_shift_and_scale_of_any_number_of_rows(spark):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        n = (3, 40, 9000)[seed % 3]
        labels = rng.integers(0, 2, n)
        labels[:2] = 0, 1
        differences = np.round(rng.normal(labels * 0.4, 0.5), seed)
        want = kn.calibrated(kn.Model("x"), differences, labels)
        got = kn.calibrated_on(kn.Model("x"), spark.createDataFrame([(float(d), int(c)) for d, c in zip(differences, labels, strict=True)], "difference double, label int").repartition(3))
        assert (got.shift, got.scale) == pytest.approx((want.shift, want.scale))


def test_no_labelled_document_is_left_out_of_a_large_table(spark):
    """Of 60,000 labelled documents one in ten sets shift and scale: more than the 4000 that once did."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 4 == 0, "vile ").otherwise("kind "), F.repeat(F.lit("word "), (F.col("id") % 7).cast("int")), (F.col("id") % 50).cast("string"), F.when(F.col("id") % 4 == 0, " vile").otherwise("")).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    model = kn.fit_toxicity(docs, labels)
    share = labels.filter(~kn.is_held_out() & (F.pmod(F.xxhash64("doc_id"), F.lit(kn.CALIBRATION_SHARE)) == 0))
    rows = kn.score_toxicity(docs, model).join(share, "doc_id").select("difference", "toxic").collect()
    want = kn.calibrated(model, np.array([r.difference for r in rows]), np.array([r.toxic for r in rows]))
    assert len(rows) > 4000 and (model.shift, model.scale) == pytest.approx((want.shift, want.scale))
