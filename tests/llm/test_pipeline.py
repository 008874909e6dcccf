"""The pipeline over a small corpus whose outcome is known."""

import random

import corpus_pipeline
from metasieve.llm.byte_bpe import ByteBpe, read_ranks

import public_tokenizers as P


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = {d: text(60) for d in range(200)}
    junk = {d: text(60).upper().replace(" ", "!! ") for d in range(200, 300)}
    item = text(30)
    docs = good | junk | {300: good[5].replace(" ", "  \n", 3), 301: good[7] + " more", 302: text(20) + " " + item.upper() + " " + text(20)}
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 200), 0) for d in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # junk goes, the copy and the near copy go for the smaller ids, the leak goes, all else stays
    assert set(got) == set(good)
    bpe = ByteBpe(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    assert all(list(got[d].ids) == bpe.encode(t) and got[d].n_bytes == len(t.encode()) for d, t in good.items())


def test_stages_with_odd_rows_and_names(spark, tmp_path):
    """Nulls, empty texts, repeated ids, equal rows and columns whose names operators use, through each stage."""
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, t), (5, t), (5, "another text of a few words that nothing else is like at all here"), (None, t), (None, None), (2, None), (3, ""), (1, t)]
    names = ("_gone", "_gone_sha", "_leak", "_key", "t", "d", "s", "row", "keep_id", "sig", "x", "Id")
    docs = spark.createDataFrame([(d, x, *range(k, k + len(names))) for k, (d, x) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words that nothing else is like"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        "quality classifier": [0, 1, 2, 3, 4, 5, 6, 7],
        "exact dedup": [0, 2, 5, 7],
        "n-gram Jaccard join": [0, 2, 4, 5, 6, 7],
        "benchmark decontamination": [0, 1, 3, 4, 5, 6, 7],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted(r["_gone"] for r in got.collect()) == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert coded.count() == 8 and coded.filter("n_tokens = 0").count() == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
