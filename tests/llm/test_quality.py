"""Terms, cosines and votes of the quality classifier against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from metasieve.llm import quality_knn as q

TEXTS = ["", " \n ", "Plain words, as they come. And more of them", "SHOUTED!! WORDS!! ALL!! THE!! WAY!!", "a | table | of | cells", "same same same same", "Éa é123 x", "x" * 50_000, "one\ntwo  three\tfour", "w" * 300 + " end"]


def test_terms_by_hand():
    got = q.features(TEXTS)
    for t, x in zip(TEXTS, got, strict=True):
        data = t.encode()
        pairs = Counter((int(q.BYTE_CLASS[a]), int(q.BYTE_CLASS[b])) for a, b in zip(data, data[1:], strict=False))
        for (a, b), n in pairs.items():
            assert x[a * q.CLASSES + b] == pytest.approx(math.sqrt(n / (len(data) - 1)), rel=1e-5)
        assert (x[: q.CLASSES**2] > 0).sum() == len(pairs)
        words = t.split() or [""]
        shape = lambda w: re.sub(r"(.)\1+", r"\1", "".join("A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "0" if c in "0123456789" else "a" if c.isalpha() else c for c in w))
        shapes = Counter((shape(w), k > 0 and words[k - 1] == w) for k, w in enumerate(words))
        want = Counter()
        for (s, again), n in shapes.items():
            want[int(q.shape_numbers([{v: k for k, v in ((w, shape(w)) for w in words)}[s]])[0]) + again] += n
        assert {k: float(v) for k, v in enumerate(x[q.CLASSES**2 :]) if v} == pytest.approx({k: math.sqrt(n / len(words)) for k, n in want.items()}, rel=1e-5)
    assert q.shape_numbers(["Word"]) == q.shape_numbers(["Other"]) != q.shape_numbers(["WORD"])


def test_cosines_and_votes_by_hand():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["plain", "Words", "OF!!", "a|b", "12", "é"]) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    x = q.features(texts)
    labels = np.array([rng.randint(0, 1) for _ in texts], float)
    m = q.fit(x, labels)
    got = m.scores(q.features([*texts[:20], ""]))
    for t, g in zip([*texts[:20], ""], got, strict=True):
        v = (q.features([t])[0] * m.weights) @ m.projection
        near = []
        for u, y in zip(m.vectors, m.labels, strict=True):
            near.append((float(v @ u) / max(1e-12, math.sqrt(float(v @ v)) * math.sqrt(float(u @ u))), y))
        near.sort(key=lambda p: -p[0])
        w = [(max(c, 0) ** q.SHARPNESS, y) for c, y in near[: q.NEIGHBOURS]]
        want = (sum(a * y for a, y in w) + q.PRIOR * labels.mean()) / (sum(a for a, _ in w) + q.PRIOR)
        # equal similarities at the last place may vote either way
        if near[q.NEIGHBOURS - 1][0] - near[q.NEIGHBOURS][0] > 1e-5:
            assert g == pytest.approx(want, abs=2e-3)
    assert (q.fit(x[:0], labels[:0]).scores(x[:3]) == 0.5).all()


def test_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    assert len(q.fit_quality(docs, labels, sample=7).labels) <= 7
    assert q.score_quality(docs.limit(0), q.fit_quality(docs, labels)).count() == 0
