"""Rules at their edges: votes with bad inputs, bias intervals, quantiles, linkage, mappings and planned subgroups."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from metasieve.functions import text as tx
from metasieve.functions.distributions import t_critical, t_ppf
from metasieve.operators import analysis, bias, harmonize, pooling, screening
from metasieve.plans.queries import QUERIES


def test_validation_of_votes(spark):
    rows = [("maybe", None), ("maybe", 130), ("maybe", 30), ("include\n", 55), (" EXCLUDE\t", 70), ("maybe", 90), (None, None), ("human_review", 61), ("exclude", -3), ("include", None)]
    df = spark.createDataFrame([(k, d, c) for k, (d, c) in enumerate(rows)], "k int, d string, c int")
    got = {r.k: r for r in df.select("k", screening.valid_vote(F.col("d"), F.col("c")).alias("v"), screening.valid_arbitration(F.col("d"), F.col("c")).alias("a"), screening.valid_fulltext(F.col("d"), F.col("c")).alias("f")).collect()}
    assert [tuple(got[k].v) for k in range(10)] == [("include", 0), ("include", 100), ("include", 10), ("include", 55), ("exclude", 70), ("include", 70), ("include", 0), ("include", 41), ("exclude", 0), ("include", 50)]
    assert [tuple(got[k].a) for k in range(10)] == [("human_review", 50), ("human_review", 0), ("human_review", 30), ("human_review", 55), ("exclude", 70), ("human_review", 0), ("human_review", 50), ("human_review", 61), ("human_review", 0), ("human_review", 50)]
    assert [tuple(got[k].f) for k in range(10)] == [("include", 0), ("include", 0), ("include", 0), ("include", 55), ("exclude", 70), ("include", 0), ("include", 0), ("include", 0), ("exclude", 0), ("include", 50)]


def effects(spark):
    y, se = [0.1, 0.05, 0.02, 0.8, 1.0, 1.2, 1.5], [0.05, 0.04, 0.06, 0.3, 0.35, 0.4, 0.45]
    return spark.createDataFrame([("o", k, f"s{k}", a, b) for k, (a, b) in enumerate(zip(y, se, strict=True))], "outcome string, ord int, study_id string, effect double, se double"), np.array(y), np.array(se)


def test_trim_and_fill_by_hand(spark):
    df, y, se = effects(spark)
    got = bias.trim_and_fill(df).first()
    original = pooling.pool_vectors(y, se, "REML", False)
    mu = original["pooled_effect"]
    right, left = (y > mu).sum(), (y < mu).sum()
    k0 = max(0, len(y) - 2 * min(right, left)) if right != left else max(0, len(y) - 2 * left)
    far = np.argsort(y if right < left else -y, kind="stable")[:k0]
    adjusted = pooling.pool_vectors(np.r_[y, 2 * mu - y[far]], np.r_[se, se[far]], "REML", False)
    want = (k0, mu, original["ci_lower"], original["ci_upper"], adjusted["pooled_effect"], adjusted["ci_lower"], adjusted["ci_upper"])
    assert (got.n_imputed, got.original_effect, got.original_ci_lower, got.original_ci_upper, got.adjusted_effect, got.ci_lower, got.ci_upper) == pytest.approx(want)
    assert got.original_ci_upper - got.original_effect == pytest.approx(1.96 * original["pooled_se"])


def test_reml_that_does_not_converge_says_so(monkeypatch):
    monkeypatch.setattr(pooling, "abs", lambda x: 1.0, raising=False)
    assert pooling.reml(np.array([0.1, 0.9, 0.4]), np.array([0.01, 0.02, 0.01]))[1] is False


def test_sensitivity_is_pooling_of_the_rest(spark):
    df, y, se = effects(spark)
    for method in ("DL", "REML"):
        for r in pooling.leave_one_out(df, method=method).collect():
            want = pooling.random_effects(df.filter(F.col("ord") != r.omitted_index), method=method).first()
            assert (r.pooled_effect, r.ci_lower, r.ci_upper, r.i2, r.tau2) == pytest.approx((want.pooled_effect, want.ci_lower, want.ci_upper, want.i2, want.tau2))
    assert [r.k for r in sorted(pooling.cumulative(df).collect(), key=lambda r: r.added_index)] == list(range(1, 8))
    assert pooling.leave_one_out(df.limit(1)).count() == 0 and pooling.leave_one_out(df.limit(0)).count() == 0


def test_quantiles_beyond_the_table(spark):
    for df in (1, 200, 201, 350, 5000):
        assert spark.range(1).select(t_critical(F.lit(df)).alias("t")).first().t == pytest.approx(t_ppf(0.975, df), abs=2e-10)


def plain_linkage(x, below):
    groups = [[i] for i in range(len(x))]
    d = np.clip(1 - x @ x.T, 0, 2)
    while len(groups) > 1:
        pairs = [(np.mean([d[a, b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        least, i, j = min(pairs)
        if least >= below:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_linkage_by_chains_is_the_plain_rule():
    rng = np.random.default_rng(5)
    for n in (1, 2, 12, 30):
        x = rng.normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for below in (0.05, 0.3, 0.9):
            label = np.array(harmonize.average_linkage(x.copy(), below))
            assert sorted(np.flatnonzero(label == c).tolist() for c in set(label.tolist())) == plain_linkage(x, below)


def test_the_last_cluster_of_a_name_wins(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "outcome_name string")
    clusters = spark.createDataFrame([("B", ["x"], 0), ("A", ["X"], 1)], "canonical string, members array<string>, position int")
    assert {r.outcome_name: r.canonical_outcome for r in harmonize.apply_mapping(rows, clusters).collect()} == {"x": "A", "y": "y"}
    with pytest.raises(ValueError):
        harmonize.apply_mapping(rows, clusters.drop("position"))


def test_planned_subgroups(spark):
    arm = "struct<name:string,n:bigint,mean:double,sd:double,se:double,ci_lower:double,ci_upper:double,events:bigint,total:bigint>"
    rows = [("o", k, f"s{k}", ("a", 50, 120.0 + k, 10.0, None, None, None, None, None), ("b", 50, 130.0 + 3 * k, 11.0, None, None, None, None, None), {"subgroup_r": "xy"[k % 2], "subgroup_one": "z"} if k else None) for k in range(6)]
    df = spark.createDataFrame(rows, f"outcome string, ord int, study_id string, arm1 {arm}, arm2 {arm}, subgroups map<string,string>")
    out = analysis.analyze(df)
    assert {(r.variable, r.subgroup): r.k for r in out["subgroups"].collect()} == {("subgroup_r", "x"): 2, ("subgroup_r", "y"): 3, ("subgroup_r", "unknown"): 1, ("subgroup_one", "z"): 5, ("subgroup_one", "unknown"): 1}
    assert {r.variable: r.n_subgroups for r in out["subgroup_tests"].collect()} == {"subgroup_r": 3, "subgroup_one": 2}
    planned = out["plan"].withColumn("method", F.lit("DL")).withColumn("apply_hksj", F.lit(False))
    got = analysis.analyze(df, planned)
    assert got["results"].first().tau2_method_used == "DL" and out["results"].first().tau2_method_used in ("REML", "DL_fallback")
    loo = {r.omitted_index: r for r in got["leave_one_out"].collect()}
    want = pooling.leave_one_out(analysis.planned_effects(df, planned), method="DL", hksj=False).collect()
    assert all(loo[r.omitted_index].ci_lower == pytest.approx(r.ci_lower) for r in want) and len(loo) == 6


def test_ties_in_the_order_keep_one_title(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "a ", 2), (2, "", 3), (2, "", 4)], "ord int, title string, _key int")
    got = screening.dedup_by_title(df).collect()
    assert len(got) == 3 and screening.dedup_by_title(df).columns == df.columns


@pytest.mark.parametrize("part", [1024, 7])
def test_blocks_of_any_size_cluster_as_the_plain_rule(spark, part):
    rng = np.random.default_rng(part)
    centres = rng.normal(size=(6, 8))
    rows = [("r", f"n{k:03d}", k, (centres[k % 6] + rng.normal(scale=0.35, size=8)).tolist()) for k in range(60)] + [("s", "only", 0, [1.0] + [0.0] * 7), ("s", "zero", 1, [0.0] * 8)]
    got = harmonize.cluster_by_vector(spark.createDataFrame(rows, "review string, name string, ord int, vector array<double>"), "review", part=part).collect()
    want = plain_linkage(harmonize.unit([r[3] for r in rows[:60]]), 0.2)
    assert sorted(sorted(int(n[1:]) for n in r.members) for r in got if r.review == "r") == want
    assert sorted(r.members for r in got if r.review == "s") == [["only"], ["zero"]]


def test_names_without_vectors_cluster_by_spelling(spark):
    names = spark.createDataFrame([("Pain score", 0), ("pain  SCORE ", 1), ("pain scores", 2), ("Mortality", 3), (" mortality", 4), ("QoL", 5)], "name string, ord long")
    got = {tuple(r.members): (r.canonical, r.position) for r in harmonize.cluster_names(names).collect()}
    assert got == {("Pain score", "pain  SCORE ", "pain scores"): ("Pain score", 0), ("Mortality", " mortality"): ("Mortality", 3), ("QoL",): ("QoL", 5)}
    vectors = spark.createDataFrame([("Pain score", [1.0, 0.0]), ("pain  SCORE ", [1.0, 0.1]), ("Mortality", [0.0]), (" mortality", None), ("QoL", [0.0, 0.0])], "name string, vector array<double>")
    got = {tuple(r.members) for r in harmonize.cluster_names(names, vectors).collect()}
    assert got == {("Pain score", "pain  SCORE "), ("pain scores",), ("Mortality", " mortality"), ("QoL",)}


def test_harmonize_with_a_review(spark):
    rows = spark.createDataFrame([(0, "Pain"), (1, "pain "), (2, "Death"), (3, None)], "ord long, outcome_name string")
    review = lambda text: spark.createDataFrame([(text,)], "response string")
    clusters, data, left = harmonize.harmonize(rows)
    assert {r.outcome_name: r.canonical_outcome for r in data.collect()} == {"Pain": "Pain", "pain ": "Pain", "Death": "Death", None: None} and left.count() == 0 and clusters.count() == 2
    _, data, left = harmonize.harmonize(rows, review=review('```json\n{"clusters": {"Pain (VAS)": ["Pain", "pain "]}, "unmapped": ["Death"]}\n```'))
    assert {r.outcome_name: r.canonical_outcome for r in data.collect()} == {"Pain": "Pain (VAS)", "pain ": "Pain (VAS)", "Death": "Death", None: None} and [r.name for r in left.collect()] == ["Death"]
    clusters, data, left = harmonize.harmonize(rows, review=review("sorry"))
    assert {r.canonical for r in clusters.collect()} == {"Pain", "Death"} and left.count() == 0
    empty = harmonize.harmonize(rows.limit(0))
    assert all(df.count() == 0 for df in empty)


def test_rows_are_effects_or_rejected_with_a_reason(spark):
    kind = "outcome string, ord int, study_id string, arm1 struct<n:long,mean:double,sd:double,se:double,ci_lower:double,ci_upper:double,events:long,total:long>, arm2 struct<n:long,mean:double,sd:double,se:double,ci_lower:double,ci_upper:double,events:long,total:long>"
    full, none = (10, 2.0, 1.0, None, None, None, 3, 10), (10,) + (None,) * 7
    rows = spark.createDataFrame([("smd", 0, "a", full, full), ("smd", 1, "b", none, full), ("smd", 2, "c", full, none), ("smd", 3, "d", (1, 2.0, 1.0, None, None, None, 3, 10), (1, 2.0, 1.0, None, None, None, 3, 10)), ("or", 0, "a", full, full), ("or", 1, "b", (10, None, None, None, None, None, 0, 10), full), ("hr", 0, "a", full, full), ("smd", 4, "e", (9, 2.0, None, 0.5, None, None, None, None), full), ("other", 0, "x", full, full)], kind)
    plan = spark.createDataFrame([("smd", "SMD"), ("or", "logOR"), ("hr", "HR")], "outcome string, effect_type string").withColumns({"method": F.lit("DL"), "apply_hksj": F.lit(True)})
    counts = Observation("rows")
    judged = analysis.judged_effects(rows, plan, counts)
    got = {(r.outcome, r.ord): (r.effect, r.reason) for r in judged.collect()}
    reasons = {k: v[1] for k, v in got.items()}
    assert reasons == {("smd", 0): None, ("smd", 1): "no data", ("smd", 2): "missing: arm2.mean, arm2.sd", ("smd", 3): "outside the domain", ("smd", 4): None, ("or", 0): None, ("or", 1): "outside the domain", ("hr", 0): "unknown effect type"}
    assert all((e is None) == (r is not None) for e, r in got.values())
    assert counts.get == {"n_effects": 3, "n_rejected": 5}
    assert analysis.rejected(judged).count() == 5 and analysis.planned_effects(rows, plan).count() == 3


def test_sizes_and_ranges_across_outcomes(spark):
    arm = lambda n, mean=None, sd=None: (n, mean, sd)
    rows = spark.createDataFrame([("s", "a", "w1", 0, arm(10, 5.0, 1.0), arm(9)), ("s", "b", "w1", 1, arm(10, 99.0), arm(8)), ("s", "a", "w2", 2, arm(7, 5.0, 6.0), arm(9)), ("t", "a", None, 0, arm(None), arm(4, -1.0)), ("t", "c", None, 1, arm(3), arm(4))], "study_id string, outcome string, timepoint string, ord int, arm1 struct<n:long,mean:double,sd:double>, arm2 struct<n:long,mean:double,sd:double>")
    ranges = spark.createDataFrame([("a", 0.0, 10.0)], "outcome string, low double, high double")
    got = {(r.study_id, r.ord): r.issues for r in analysis.cross_check_rows(rows, ranges).collect()}
    assert got == {("s", 0): ["n_differs"], ("s", 1): ["n_differs"], ("s", 2): ["sd_implausible"], ("t", 0): ["mean_outside"], ("t", 1): []}
    assert all(not r.issues or r.issues == ["n_differs"] for r in analysis.cross_check_rows(rows).collect())



def test_pairs_of_a_block_do_not_depend_on_its_parts(spark):
    vectors = [[1.0, 0.0], [1.0, 1.0], [0.0, 0.0], None, [1.0, None], [1.0, 2.0, 3.0], [-1.0, 0.0], [2.0, 2.0]]
    rows = [(b, k, vectors[k]) for b in (1, 2) for k in range(len(vectors))] + [(None, 1, [1.0, 0.0]), (None, 2, [1.0, 0.0]), (1, None, [1.0, 0.0]), (1, 7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "block int, k long, v array<double>")

    def cosine(x, y):
        if x is None or y is None or None in x or None in y or len(x) != len(y) or not any(x) or not any(y):
            return None
        return round(sum(p * q for p, q in zip(x, y, strict=True)) / (sum(p * p for p in x) ** 0.5 * sum(q * q for q in y) ** 0.5), 9)

    want = sorted(((a[0], a[1], b[1], cosine(a[2], b[2])) for a in rows for b in rows if a[0] == b[0] and None not in (a[0], a[1], b[1]) and a[1] < b[1]), key=str)
    for part in (1024, 3, 1):
        got = harmonize.cosine_pairs(df, "k", "v", "block", part=part).collect()
        assert sorted(((r.block, r.a, r.b, None if r.similarity is None else round(r.similarity, 9)) for r in got), key=str) == want
        assert all(abs(r.distance - (2.0 if r.similarity is None else 1 - r.similarity)) < 1e-9 for r in got)



def test_long_table_takes_time_by_its_rows(spark):
    cells = [["h", "k"], *([f"a{k}"] if k % 4 == 0 else [f"a{k}", " b\n"] for k in range(6000))]
    df = spark.createDataFrame([(cells,)], "t array<array<string>>")
    start = time.monotonic()
    got = df.select(tx.table_to_markdown(F.col("t")).alias("md")).first().md
    assert time.monotonic() - start < 30  # widths that each row works out anew take minutes
    assert got == "\n".join(["| h | k |", "| --- | --- |", *(f"| a{k} |  |" if k % 4 == 0 else f"| a{k} | b |" for k in range(6000))])



def test_large_blocks_may_have_any_column_name_and_none(spark):
    rng = np.random.default_rng(3)
    rows = [(b, f"n{k}", k, [float(x) for x in rng.normal(k % 5 * 3, 1.0, 4)]) for b in (1, 2, None) for k in range(40)]
    answers = []
    for name in ("label", "block", "near"):
        v = spark.createDataFrame(rows, f"{name} int, name string, ord int, vector array<double>")
        for part in (1024, 7):
            got = harmonize.cluster_by_vector(v, name, part=part)
            assert got.columns == [name, "canonical", "members", "position"]
            answers.append(sorted(((r[0], r.canonical, tuple(r.members), r.position) for r in got.collect()), key=str))
    assert all(a == answers[0] for a in answers) and 3 < len(answers[0]) < len(rows)



def test_inverted_index_of_each_row_and_back(spark, tmp_path):
    texts = ["b a\tb  c a b", "", None, " \n ", "a\x0bb a\x0bb", "x", " ".join(f"w{k % 97}" for k in range(20_000))]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    index = df.limit(1).select(tx.inverted_index(F.split(F.lit("b a b c"), " ")).alias("i")).first().i
    assert index == {"a": [1], "b": [0, 2], "c": [3]}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["inverted_abstract"](spark, str(tmp_path))
    want = [(k // 2, None if t is None else " ".join(w for w in re.split("[\t\n\f\r ]+", t) if w)) for k, t in enumerate(texts)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()



def test_pairs_of_large_blocks_take_few_bytes_and_are_dealt_over_tasks(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(rng.normal(size=(1000, 64)).tolist())], "label int, vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = QUERIES["cosine_pairs"](spark, str(tmp_path))
    pairs.coalesce(1).write.parquet(str(tmp_path / "pairs"))
    written, n = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")), 1000 * 999 // 2
    assert spark.read.parquet(str(tmp_path / "pairs")).selectExpr("count(*)", "count(DISTINCT a, b)", "count(similarity)").first() == (n, n, n)
    assert written < 5 * n
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = harmonize.cosine_pairs(df, "vec_id", "embedding", "label", part=100)
        tasks = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(tasks) > 9 and sum(tasks) == n and max(tasks) < n / 4



def test_similarities_are_rounded_as_spark_does(spark):
    x = [0.0, -0.0, 1.0, -1.0, 0.123455, -0.123455, 0.000005, -0.000005, 4.9e-6, -4.9e-6, 1.0000000000000002, *np.random.default_rng(7).uniform(-1, 1, 200).tolist()]
    x += [(k * 10 + 5) / 1e6 for k in range(-99_999, 100_000, 1999)]
    x += np.nextafter(x, 2).tolist() + np.nextafter(x, -2).tolist()
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(F.round("x", 5)).collect()]
    assert list(map(str, harmonize._rounded(np.array(x), 5).tolist())) == list(map(str, want))
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 2.0]), (1, 3, None)], "block int, k long, v array<double>")
    got = harmonize.cosine_pairs(df, "k", "v", "block", digits=2).collect()
    assert sorted((r.a, r.b, r.similarity, round(r.distance, 9)) for r in got if r.a + r.b == 3) == [(1, 2, 0.45, 0.55)] and [r.similarity for r in got if r.b == 3] == [None, None]
