"""Answers of every shape, extraction in rounds with a restart, screening in batches, settings and prompts."""

import json

import pytest
from pyspark.sql import functions as F

from metasieve.functions import text as tx
from metasieve.plans import config, extraction
from metasieve.plans.review import ReviewRun


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ('[{"a": 1}, {"a": 2}]', [{"a": 1}, {"a": 2}]), ('{"extractions": [{"a": 1}]}', [{"a": 1}]), ('{"outcomes": [{"a": 1}]}', [{"a": 1}]), ('{"a": 1}', [{"a": 1}]), ('{"extractions": {"a": 1}}', [{"a": 1}]),
        ('{"outcomes": [1], "extractions": [2]}', [2]), ("[]", []), ("5", [5]), ('"x"', ["x"]), ('{"extractions": null}', None), ("null", None), ("oops", None), (None, None), ("```json\n[1]\n```", [1]),
    ],
)
def test_items_of_any_shape(spark, response, want):
    got = spark.range(1).select(tx.items(tx.answer(F.lit(response).cast("string")), "extractions", "outcomes").alias("x")).first().x
    assert (got if got is None else [json.loads(x) for x in got]) == want


class Script:
    """A responder that fails where told: (study, round, attempt, try) -> response; what is asked is kept."""

    def __init__(self, spark, broken):
        self.spark, self.broken, self.asked = spark, broken, []

    def __call__(self, prompts):
        good = {1: '{"primary_outcomes": ["p"], "secondary_outcomes": null}', 2: '{"extractions": [{"arm1": {"n": 1}, "arm2": {"n": 2}}]}', 3: '{"checks_passed": true, "issues": [1]}', 4: '{"bindings": [{"match_confidence": 0.7}, {"match_confidence": 0.69}, {}]}'}
        rows = []
        for p in prompts.collect():
            self.asked.append(p)
            rows += [(p.key, t, self.broken.get((p.key, int(p.phase[-1]), p.attempt, t), good[int(p.phase[-1])])) for t in (2, 1)]
        return self.spark.createDataFrame(rows, "key string, attempt int, response string")


def run(spark, tmp_path, broken, studies):
    script = Script(spark, broken)
    kept = ReviewRun(spark, str(tmp_path))
    found = extraction.extract(spark.createDataFrame(studies, "study_id string, content string"), '{"population": "adults"}', script, kept.keep, {2: "be exact"})
    return {r.study_id: r for r in found.collect()}, script.asked, kept


@pytest.mark.parametrize("number", [1, 2, 3, 4])
def test_a_failure_in_any_round_restarts_all_rounds_once(spark, tmp_path, number):
    both = {("a", number, 1, 1): "no", ("a", number, 1, 2): "no"}
    never = {("b", number, k, t): "no" for k in (1, 2) for t in (1, 2)}
    retried = {("c", number, 1, 1): "no"}
    got, asked, kept = run(spark, tmp_path, both | never | retried, [(k, "text") for k in "abc"])
    assert (got["a"].attempts, got["a"].rounds_completed, got["a"].error) == (2, 4, None)
    assert (got["b"].attempts, got["b"].rounds_completed, got["b"].error) == (2, number - 1, f"round {number}: no answer parses")
    assert (got["c"].attempts, got["c"].error, len(got["c"].evidence_spans), len(got["c"].low_confidence_spans)) == (1, None, 3, 2)
    assert sorted(int(p.phase[-1]) for p in asked if p.key == "a") == sorted([*range(1, number + 1), 1, 2, 3, 4])
    assert f"extraction_attempt2_round{number}" in kept.tables


def test_prompts_hold_what_earlier_rounds_parsed(spark, tmp_path):
    body = "x " * 100
    got, asked, _ = run(spark, tmp_path, {("a", 3, 1, 1): "[]"}, [("a", body + "\nReferences\n1. Z"), ("n", None)])
    p = {int(p.phase[-1]): p for p in asked if p.key == "n"}
    assert '## Outcomes to Extract\n["p"]' in p[2].user and '"primary_outcomes":["p"]' in p[2].user and p[2].system == "be exact" and p[1].system == ""
    assert '"arm1":{"n":1}' in p[3].user and "PDF Content" not in p[3].user and p[4].max_tokens == 2048
    assert got["a"].error == "round 3: the answer has no use" or got["a"].attempts == 2
    assert "References" not in next(p.user for p in asked if p.key == "a")
    rows = extraction.extracted_rows(spark.createDataFrame([("s", ['{"arm1": {"n": 3}}'], None)], "study_id string, extractions array<string>, error string"), "arm1 struct<n:long>").collect()
    assert [(r.study_id, r.ord, r.arm1.n) for r in rows] == [("s", 0, 3)]


def test_batches_hold_every_study_once(spark):
    sizes = [30, 30, 30, 500, 10, 10, 95, 5, 1]
    rows = spark.createDataFrame([("g", k, n, f"t{k}", None) for k, n in enumerate(sizes)] + [("h", 99, 1, None, "a")], "g string, study_id long, n long, title string, abstract string")
    packed = extraction.pack(rows, "g", "study_id", F.col("n"), 100).orderBy("g", "study_id")
    assert [(r.batch, r.place) for r in packed.collect()] == [(0, 0), (0, 1), (0, 2), (0, 3), (5, 0), (6, 0), (6, 1), (7, 0), (7, 1), (0, 0)]
    asked = extraction.screening_prompts(packed, "g", "{}", "{}")
    assert {(r.g, r.batch): r.n for r in asked.collect()} == {("g", 0): 4, ("g", 5): 1, ("g", 6): 2, ("g", 7): 2, ("h", 0): 1}
    answers = spark.createDataFrame([("g", 0, '[{"decision": "exclude", "confidence": 90}, {"decision": "maybe", "confidence": 50}]'), ("g", 5, "broken"), ("g", 6, '{"votes": [{"decision": "Exclude"}, {"decision": "include", "confidence": 300}, {"decision": "exclude"}]}')], "g string, batch long, response string")
    got = {r.study_id: (r.decision, r.confidence, r.parse_error) for r in extraction.batch_votes(packed, "g", answers, "screener1").collect()}
    assert got == {0: ("exclude", 90, False), 1: ("include", 30, False), 2: ("include", 0, True), 3: ("include", 0, True), 4: ("include", 0, True), 5: ("exclude", 50, False), 6: ("include", 100, False), 7: ("include", 0, True), 8: ("include", 0, True), 99: ("include", 0, True)}


def test_a_large_group_is_packed_over_many_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").alias("g"), F.col("id").alias("study_id"), (F.col("id") % 13 * 10).alias("n")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.study_id): (r.batch, r.place) for r in extraction.pack(rows, "g", "study_id", F.col("n"), 250).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total, places = {}, {}, {}
    for k in range(3000):
        g = "hot" if k < 2900 else None
        batch = total.get(g, 0) // 250
        want[g, k] = (batch, places.get((g, batch), 0))
        places[g, batch] = want[g, k][1] + 1
        total[g] = total.get(g, 0) + k % 13 * 10
    assert got == want


def test_settings_and_prompts(tmp_path):
    for name, text in (("a.yaml", "x: 1\ny: 2"), ("b.yaml", "y: 3"), ("empty.yaml", ""), ("p.yaml", "system_prompt: hi\nprompt: no"), ("q.yaml", "prompt: ho"), ("r.yaml", "just text"), ("s.yaml", "- 1")):
        (tmp_path / name).write_text(text)
    at = lambda n: str(tmp_path / n)
    assert config.load_config([at("a.yaml"), at("none.yaml"), at("empty.yaml"), at("b.yaml")]) == {"x": 1, "y": 3}
    assert [config.load_prompt(at(n)) for n in ("p.yaml", "q.yaml", "r.yaml", "s.yaml", "none.yaml")] == ["hi", "ho", "just text", "", ""]
