"""Screening, quality, text, harmonization, writing, sources and the model boundary on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasieve.functions import text as tx
from metasieve.operators import cost, harmonize, quality, screening, writing
from metasieve.plans import responders
from metasieve.sources import bibliography, documents
from metasieve.streaming import usage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    t = lambda s: F.lit(s)
    assert one(spark, tx.truncate_at_paragraph(t("a" * 60 + "\n\n" + "b" * 60), 100)) == "a" * 60 + tx.CUT_PARAGRAPH
    assert one(spark, tx.truncate_at_paragraph(t("a" * 60 + ". " + "b" * 60), 100)) == "a" * 60 + "." + tx.CUT_SENTENCE
    assert one(spark, tx.truncate_at_paragraph(t("a" * 120), 100)) == "a" * 100 + tx.CUT_HARD
    body = "x " * 200
    assert one(spark, tx.strip_references(t(body + "\n8. References\n1. A"))) == body.rstrip()
    assert one(spark, tx.strip_references(t("Intro\nReferences\n" + body))) == "Intro\nReferences\n" + body
    assert one(spark, tx.priority_sections(t("Methods\nabc\nResults: d\nDiscussion\ne"))) == "Methods\nabc\n\n---\n\nResults: d"
    assert one(spark, tx.priority_sections(t("nothing"))) is None
    assert one(spark, tx.strip_fences(t(" ```json\n{\"a\": 1}\n``` "))) == '{"a": 1}'
    assert one(spark, tx.parse_json(t("oops"), t('{"a": 2}'), "a int")).a == 2 and one(spark, tx.parse_json(t("oops"), None, "a int")) is None
    assert one(spark, tx.table_to_markdown(F.array(F.array(t("h"), t("k")), F.array(t(" a\nb "))))) == "| h | k |\n| --- | --- |\n| a b |  |"
    assert one(spark, tx.table_to_markdown(F.array(F.array(t(" "))))) is None
    assert one(spark, tx.abstract_from_index(F.create_map(t("b"), F.array(F.lit(1)), t("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"
    assert one(spark, tx.estimate_pages(t("<!-- PAGE 1 -->\na\n<!-- PAGE 2 -->\nb"))) == 2 and one(spark, F.size(tx.pages_of(t("<!-- PAGE 1 -->\na\n<!-- PAGE 2 -->\nb")))) == 2
    assert one(spark, tx.keywords(t("The trial and THE Trials of it"))) == ["trial", "trials"]


def test_screening_truth_table(spark):
    cases = [(d1, c1, d2, c2) for d1 in ("include", "exclude") for d2 in ("include", "exclude") for c1 in (79, 80) for c2 in (79, 80)]
    votes = spark.createDataFrame([(i, s, d, c) for i, (d1, c1, d2, c2) in enumerate(cases) for s, d, c in (("screener1", d1, c1), ("screener2", d2, c2))], "study_id int, screener_id string, decision string, confidence int")
    arb = spark.createDataFrame([(i, "exclude", 70) for i in range(0, len(cases), 2)], "study_id int, decision string, confidence int")
    for r in screening.screen(votes, arb).collect():
        d1, c1, d2, c2 = cases[r.study_id]
        if "include" in (d1, d2):
            assert (r.final_decision, r.needed) == ("include", False) and r.method == ("dual_include" if d1 == d2 else "union_include")
        elif c1 >= 80 and c2 >= 80:
            assert (r.final_decision, r.method, r.confidence) == ("exclude", "dual_exclude_high_confidence", 80)
        else:
            assert r.needed and (r.final_decision, r.method) == (("exclude", "arbiter") if r.study_id % 2 == 0 else ("human_review", "arbiter_missing"))


def test_prescreen_and_dedup(spark):
    df = spark.createDataFrame([(1, "A study in mice", None), (2, " a STUDY\tin people ", "rct"), (3, "A study\tin people", "x"), (4, None, "rct"), (5, "", "rct")], "ord int, title string, abstract string")
    assert sorted(r.ord for r in screening.dedup_by_title(df).collect()) == [1, 2, 4, 5]
    got = {r.ord: r.reason for r in screening.prescreen(df, ["Mice"], ["RCT"]).collect()}
    assert got == {1: "exclusion_keyword_match", 2: None, 3: "no_required_keyword", 4: None, 5: None}
    assert screening.prescreen(df).filter("status = 'passed'").count() == 5


def test_quality(spark):
    low = ["low"] * 5
    v = spark.createDataFrame([(1, *low), (2, *low[:4], "high"), (3, *low[:4], None), (4, *low[:4], "medium")], "id int, " + ", ".join(f"{d} string" for d in quality.ROB_DOMAINS))
    got = {r.id: r for r in quality.assess_rob(v).collect()}
    assert (got[1].overall, got[2].overall, got[3].overall) == ("low", "high", None) and "missing" in got[3].error and "invalid" in got[4].error
    s = {(r.domain, r.level): r.proportion for r in quality.summarize_rob(quality.assess_rob(v.filter("id < 3"))).collect()}
    assert s["overall", "low"] == s["overall", "high"] == 0.5
    g = spark.createDataFrame([(1, *["no_concern"] * 5, "rct"), (2, "serious", *["no_concern"] * 4, "rct"), (3, "no_concern", "no_concern", None, "no_concern", "no_concern", "rct"), (4, *["very_serious"] * 5, "cohort")], "id int, " + ", ".join(f"{d} string" for d in quality.GRADE_DOMAINS) + ", study_design string")
    got = {r.id: r for r in quality.assess_grade(g).collect()}
    assert (got[1].grade, got[2].grade, got[4].grade, got[4].certainty) == ("high", "moderate", "very_low", 1) and got[3].grade is None and got[2].downgrades == {"risk_of_bias": 1}


def test_writing(spark):
    s = spark.createDataFrame([("r", "We found 12 studies. It works."), ("m", "[x section could not be generated]"), ("e", None)], "section string, text string")
    c = spark.createDataFrame([("r", 0, "12 studies", "CONTRADICTED", "10 studies"), ("r", 1, "It works", "UNSUPPORTED", None), ("r", 2, "We found", "UNSUPPORTED", None), ("r", 3, "gone", "CONTRADICTED", None), ("m", 0, "x", "UNSUPPORTED", None)], "section string, claim_idx int, text string, verdict string, corrected_text string")
    out = writing.revise_sections(s, c)
    got = {r.section: r for r in out.collect()}
    assert got["r"].revised_text == "We found 10 studies. It works [CITATION NEEDED]." and got["m"].revised_text == "[x section could not be generated]" and got["e"].revised_text == ""
    assert writing.needs_revision(out) and not writing.needs_revision(out.filter("section <> 'r'"))


def test_cost(spark):
    log = spark.createDataFrame([("p1", "a", 1000, 100, 0.1), ("p1", "b", 300, 50, 0.1), (None, None, 150, 50, 0.02)], "phase string, agent string, input_tokens long, output_tokens long, cost double")
    r = cost.cost_report(log, 2).filter("level = 3").first()
    assert (r.calls, r.tokens, r.cost, r.cost_per_study) == (3, 1650, 0.22, 0.11)
    e = cost.estimate_remaining(log, "p1", ("p1", "p2", "p3")).first()
    assert e.estimate == pytest.approx(0.44) and cost.estimate_remaining(log, "zz").first().reason == "unknown phase"


def test_clusters(spark):
    x = np.array([[1, 0], [0.99, 0.14], [0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(set(harmonize.average_linkage(x))) == 2 and len(set(harmonize.average_linkage(x, 3.0))) == 1
    v = spark.createDataFrame([("r", n, i, [float(a) for a in x[i]]) for i, n in enumerate(["blood pressure", "BP", "death"])], "review string, name string, ord int, vector array<double>")
    assert {(r.canonical, tuple(r.members)) for r in harmonize.cluster_by_vector(v, "review").collect()} == {("BP", ("blood pressure", "BP")), ("death", ("death",))}


def test_sources(spark, tmp_path):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>Spring 2019</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi">10.1/a</ELocationID><Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText>two</AbstractText></Abstract><AuthorList><Author><LastName>Roe</LastName><ForeName>Kim</ForeName></Author><Author><LastName>Poe</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    (tmp_path / "a.xml").write_text(xml)
    r = bibliography.read_pubmed(spark, str(tmp_path / "a.xml")).first()
    assert (r.study_id, r.title, r.abstract, r.authors, r.year, r.doi, r.journal) == ("PMID_7", "T", "AIM: one two", ["Roe, Kim", "Poe"], "2019", "10.1/a", "J")
    work = {"id": "https://x/W1", "doi": "https://doi.org/10.1/b", "title": None, "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": f"n{i}"}} for i in range(12)]}
    (tmp_path / "w.json").write_text(json.dumps(work))
    w = bibliography.read_openalex(spark, str(tmp_path / "w.json"))
    r = w.first()
    assert (r.study_id, r.doi, r.title, r.abstract, len(r.authors), r.year, r.is_oa) == ("OA_W1", "10.1/b", "", "a b", 10, "2020", False)
    both = bibliography.search([("PubMed", bibliography.read_pubmed(spark, str(tmp_path / "a.xml"))), ("Scopus", w), ("openalex", w)])
    assert both.count() == 2
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4" + b" " * 2000)
    (tmp_path / "q.pdf").write_bytes(b"<html>" + b" " * 2000)
    files = documents.read_files(spark, str(tmp_path))
    assert {r.path[-5:]: r.ok for r in files.collect()} == {"p.pdf": True, "q.pdf": False}
    assert documents.extract_pages(files, lambda b, n: ["one", "two"]).first().text == "<!-- PAGE 1 -->\none\n\n<!-- PAGE 2 -->\ntwo"


def test_usage_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"timestamp": 1, "phase": "p", "agent": "a", "input_tokens": 3, "output_tokens": 4, "cost": 0.5}\n\n{"timestamp": 2, "cost": 0.25}\n')
    assert usage.read_log(spark, str(tmp_path / "log")).filter("phase = 'unknown'").count() == 1
    q = usage.running_costs(usage.stream_log(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("costs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.phase, r.calls, r.cost) for r in spark.table("costs").collect()} == {("p", 1, 0.5), ("unknown", 1, 0.25)}


def test_responders(spark):
    asked = responders.prompts(spark.createDataFrame([(1, "t"), (2, "u"), (3, "v")], "id int, title string"), "id", "fast", "s", "title")
    first = spark.createDataFrame([("1", "{\"a\": 1}", 1000, 0, False), ("2", None, 0, 0, True)], "key string, response string, input_tokens int, output_tokens int, failed boolean")
    second = spark.createDataFrame([("2", "x", 0, 1000, False)], first.schema)
    got = {r.key: r for r in responders.routed(asked, first, second).collect()}
    assert (got["1"].cost, got["2"].cost, got["2"].fallback_used) == (0.0003, 0.0025, True) and got["3"].error
    tries = spark.createDataFrame([("1", 1, "bad"), ("1", 2, "{\"a\": 5}"), ("2", 1, "bad")], "key string, attempt int, response string")
    out = {r.key: r for r in responders.parsed(tries, "a int").collect()}
    assert out["1"].value.a == 5 and out["2"].parse_error
