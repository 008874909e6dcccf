"""Deduplication, decontamination, url filter and classifiers against brute force, with nulls, ties and odd columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasieve.llm.decontam import Matcher, find_leaks, myers
from metasieve.llm.exact_dedup import drop_duplicates_exact, exact_dedup
from metasieve.llm.line_dedup import LineRuns, dedup_lines, line_hashes
from metasieve.llm.quality_knn import fit_quality, keep_good, score_quality
from metasieve.llm.toxicity_kn import fit_toxicity, score_toxicity
from metasieve.llm.url_filter import LIMIT, STRICT, TERMS, filter_urls, read_terms

SCHEMA = "doc_id long, text string, _t string, n_docs int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)


def test_exact(spark):
    rows = [(5, "a b"), (2, "a\t\n b"), (9, "a b "), (1, None), (3, ""), (None, "q"), (None, "q"), (7, "q"), (4, " "), (2, "a b"), (8, "x" * 300_000)]
    got = exact_dedup(frame(spark, rows)).collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in rows:
        groups[norm(t)].append(d)
    want = [(d, min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = drop_duplicates_exact(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 4, 7, 8, 9]
    assert exact_dedup(frame(spark, rows).limit(0)).count() == 0
    assert sorted(map(str, exact_dedup(frame(spark, rows), salt_rows=2).collect())) == sorted(map(str, got))


def test_exact_compares_contents(spark, monkeypatch):
    """Texts that share a digest stay apart, also in groups of several salts."""
    from metasieve.llm import exact_dedup as module

    monkeypatch.setattr(module.F, "sha2", lambda c, n: F.lit("same"))
    rows = [(d, f"text {d % 3}") for d in range(30)] + [(99, "alone")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(frame(spark, rows), salt_rows=4).collect()}
    assert got == {**{d: (d % 3, 10) for d in range(30)}, 99: (99, 1)}


@pytest.mark.parametrize("salt_docs", [1000, 2])
def test_lines(spark, monkeypatch, salt_docs):
    monkeypatch.setattr("metasieve.llm.line_dedup.SALT_DOCS", salt_docs)
    rng = random.Random(3)
    lines = [f"A common line {k} that is longer than forty characters É" for k in range(8)] + ["short", "", " \t"]
    rows = [(d, "\n".join(rng.choice(lines) + rng.choice(["", " ", "\x0b"]) for _ in range(rng.choice([1, 3, 9])))) for d in rng.sample(range(-50, 200), 60)] + [(300, None), (301, ""), (302, "\n")]
    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(d)
    want = {d: "\n".join(x for x in (t or "").split("\n") if not (len(holders[key(x)]) >= 5 and d != max(holders[key(x)]))) for d, t in rows}
    for batches in (1, 3):
        got = {r.doc_id: r for r in dedup_lines(frame(spark, rows), batches=batches).collect()}
        assert {d: r.text for d, r in got.items()} == want
        assert all(r.n_lines == len((dict(rows)[d] or "").split("\n")) for d, r in got.items())
    assert dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_line_runs(spark):
    docs = frame(spark, [(k, f"this line is number {k // 2} and has more than forty characters") for k in range(10)])
    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        batch = line_hashes(docs.filter(F.col("doc_id") % 5 == k))
        assert runs.fresh_lines(batch).count() == (2 if k == 0 else runs.fresh_lines(batch).count())
        runs.add(batch)
    assert sorted((r.n_docs, r.last_id) for r in runs.common().collect()) == [(2, 1), (2, 3), (2, 5), (2, 7), (2, 9)]
    assert max(runs.levels) >= 1 and runs.fresh_lines(line_hashes(docs)).count() == 0
    again = LineRuns(spark, runs.folder, fanout=2)  # as a later job opens it
    assert again.levels == runs.levels
    again.add(line_hashes(frame(spark, [(50, "this line is number 3 and has more than forty characters"), (51, "a line that no other batch has, of forty characters")])))
    assert sorted((r.n_docs, r.last_id) for r in again.common().collect()) == [(1, 51), (2, 1), (2, 3), (2, 5), (2, 9), (3, 50)]
    assert [(r.n_docs, r.last_id) for r in again.common(3).collect()] == [(3, 50)]
    again.drop()
    assert LineRuns(spark, runs.folder).tables() == []


def test_runs_are_read_in_order(spark):
    """The merge of a batch with the runs sorts the batch alone, and shuffles it once."""
    docs = frame(spark, [(k, f"this line is number {k} and has more than forty characters") for k in range(50)])
    runs = LineRuns(spark, fanout=9)
    runs.add(line_hashes(docs))
    runs.add(line_hashes(docs))
    from metasieve.llm.line_dedup import merged, sorted_buckets

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with sorted_buckets(spark):
            plan = merged([runs.run(t) for t in runs.tables()])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Sort [" not in plan and "Exchange" not in plan and "SortMergeJoin" in plan
    runs.drop()


def test_lines_of_odd_rows(spark):
    """Repeated and null ids are documents of their own, one long line in five rows of two ids goes but for the largest id."""
    line = "A line that is longer than forty characters, for sure"
    rows = [(1, line), (1, line), (1, line), (2, line + "\n" + line), (2, line), (None, line), (3, "x" * 200_000), (4, None)]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped) for r in dedup_lines(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1)] * 3 + [(2, 2, 0), (2, 1, 0), (None, 1, 1), (3, 1, 0), (4, 1, 0)], key=str)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_myers_and_pigeonhole(spark):
    rng = random.Random(5)
    for _ in range(60):
        p, t = [rng.choice("abcd") for _ in range(rng.randint(1, 9))], [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        assert myers(p, t) == [min(edit(p, t[i : j + 1]) for i in range(j + 2)) for j in range(len(t))]
    item = [f"w{rng.randrange(30)}" for _ in range(20)]
    m = Matcher([(1, " ".join(item)), (2, "Ünique, words"), (3, None or ""), (4, "!!")])
    for _ in range(60):
        w = list(item)
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["zz"], [w[k], "yy"]])
        text = [f"v{k}" for k in range(rng.randint(0, 9))] + w + ["end"]
        least = min(edit(item, text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
        found = {r[0]: r for r in m.matches(" ".join(text).upper())}
        assert (1 in found) == (least <= 4) and (least > 4 or found[1][1] == least)
        if 1 in found:
            assert edit(item, text[found[1][4] : found[1][5] + 1]) == least
    docs = frame(spark, [(1, "so ünique -- WORDS here"), (2, None), (None, "ünique words"), (3, "unique words"), (3, "")])
    bench = spark.createDataFrame([(7, "Ünique, words", 1), (8, None, 1), (9, "", 1)], "item_id long, text string, doc_id int")
    assert sorted(str((r.doc_id, r.item_id)) for r in find_leaks(docs, bench, block_chars=3).collect()) == ["(1, 7)", "(None, 7)"]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        "http://a.example.org/es/1?x=cheap#farm": ("a.example.org", "/es/1", "example.org/es/", "block"), "HTTP://EXAMPLE.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://x.org/": ("x.org", "/", "org/", "allow"), "https://x.org": ("x.org", "", None, "allow"), "https://borg/fr/": ("borg", "/fr/", None, "allow"), "http://a.com/fr/casino": ("a.com", "/fr/casino", "com/fr/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"), "http://a.net/CASINO": ("a.net", "/CASINO", None, "block"), "http://a.net/casinos": ("a.net", "/casinos", None, "allow"),
        "http://cheap.net/loan": ("cheap.net", "/loan", None, "block"), "http://cheap.net/cheap": ("cheap.net", "/cheap", None, "allow"), "no scheme xxx": ("", "", None, "block"), "http://": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == [*cases.values()]
    assert filter_urls(df.limit(0)).count() == 0


def test_urls_by_weights(spark):
    """Strict hits, distinct soft terms and their weights against a plain search, with very long urls and repeated rows."""
    rng = random.Random(12)
    words = [*rng.sample(sorted(TERMS), 25), "page", "Éa", "casinox", "1poker", "X", "BETS"]
    urls = ["http://a.net/" + "".join(rng.choice(words) + rng.choice("-/._a0É?") for _ in range(rng.choice([1, 2, 4, 9]))) for _ in range(300)]
    urls += [urls[0], urls[0], "http://a.net/" + "page-" * 200_000 + "Casino", "http://a.net/" + "cheap/" * 100_000, "http://a.net/free/bets", "http://a.net/ads/track"]
    df = spark.createDataFrame([(i, u, 0, 0) for i, u in enumerate(urls)], "page_id int, url string, soft_hits int, rule int")
    lower = lambda u: re.sub("[A-Z]", lambda m: m[0].lower(), u)
    want = []
    for u in urls:
        found = {t: len(re.findall(f"(?<![a-z0-9]){t}(?![a-z0-9])", lower(u))) for t in TERMS}
        strict, soft = sum(n for t, n in found.items() if TERMS[t] == STRICT), [TERMS[t] for t, n in found.items() if n and TERMS[t] != STRICT]
        want.append((strict, len(soft), sum(soft), "block" if strict or sum(soft) >= LIMIT else "allow"))
    got = sorted(filter_urls(df).collect())
    assert [(r.strict_hits, r.soft_hits, r.soft_weight, r.verdict) for r in got] == want
    assert [w[3] for w in want[-4:]] == ["block", "allow", "block", "allow"] and {w[3] for w in want[:300]} == {"allow", "block"}


def test_url_terms(spark, tmp_path):
    """A vocabulary from a file: repeated terms, blank lines; terms and weights that cannot be."""
    (tmp_path / "terms.tsv").write_text('Foo\tstrict\nbar\t3\nbar\t1\n"q\t2\n\n \t2\nfoo\t2\n')
    terms = read_terms(spark, str(tmp_path / "terms.tsv"))
    assert terms == {"foo": STRICT, "bar": 3, '"q': 2}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.net/foo", "http://a.net/bar", 'http://a.net/bar?"q', "http://a.net/casino"])], "page_id long, url string")
    assert [r.verdict for r in sorted(filter_urls(df, terms).collect())] == ["block", "allow", "block", "allow"]
    assert [r.verdict for r in filter_urls(df, {}).collect()] == ["allow"] * 4
    for bad in ({"": 1}, {"Foo": 1}, {"foo": LIMIT}, {"foo": -1}):
        with pytest.raises(ValueError):
            filter_urls(df, bad)
    (tmp_path / "bad.tsv").write_text("foo\tmany\n")
    with pytest.raises(Exception):
        filter_urls(df, read_terms(spark, str(tmp_path / "bad.tsv")))


def test_classifiers(spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for d in range(600):
        w = [rng.choice(words) for _ in range(40)]
        bad, toxic = d % 4 == 0, d % 3 == 0
        if toxic:
            w[::8] = ["vile"] * 5
        rows.append((d, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)))
        labels.append((d, int(not bad), int(toxic), "x"))
    docs = frame(spark, [*rows, (None, None), (1000, ""), (1001, "word1 " * 50_000), (3, rows[3][1])])
    lab = spark.createDataFrame([*labels, (None, 1, 0, "x"), (1000, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    truth = {d: (q, t) for d, q, t, _ in labels}
    scored = score_quality(docs, fit_quality(docs, lab, sample=200)).collect()
    toxic = score_toxicity(docs, fit_toxicity(docs, lab)).collect()
    assert len(scored) == len(toxic) == 604 and all(0 <= r.score <= 1 for r in [*scored, *toxic])
    for got, k in ((scored, 0), (toxic, 1)):
        held = [(r.predicted, truth[r.doc_id][k]) for r in got if r.held_out and r.doc_id in truth]
        assert np.mean([p == t for p, t in held]) > 0.95 and len(held) > 80
    kept = keep_good(docs, fit_quality(docs, lab, sample=200))
    assert kept.columns == docs.columns and kept.count() < 500
    none = lab.limit(0)
    assert score_quality(docs, fit_quality(docs, none)).filter("score = 0.5").count() == 604
    assert score_toxicity(docs, fit_toxicity(docs, none)).filter("difference = 0").count() == 604
