"""Tables of pages, written sections and their check, staged runs, figures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from metasieve.operators import writing
from metasieve.plans import manuscript
from metasieve.plans.review import ReviewRun
from metasieve.plans.stages import Loop, Stage, StagedRun
from metasieve.sources import tables


def by_cells(rows):
    """The grid by asking of each place which cell covers it: row by row, a cell at the first place that none covers."""
    placed = []
    covers = lambda c, y, x: c[0] <= y < c[0] + c[2] and c[1] <= x < c[1] + c[3]
    for y, row in enumerate(rows):
        x = 0
        for text, columns, down in row:
            while any(covers(c, y, x) for c in placed):
                x += 1
            placed.append((y, x, min(down or len(rows), len(rows) - y), columns, text))
            x += columns
    width = max((c[1] + c[3] for c in placed), default=0)
    at = lambda y, x: next((c[4] if (c[0], c[1]) == (y, x) else "" for c in placed if covers(c, y, x)), "")
    return [[at(y, x) for x in range(width)] for y in range(len(rows))]


def test_grids_equal_those_found_place_by_place():
    rng = random.Random(1)
    for _ in range(300):
        rows = [[(f"{y}.{k}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 0])) for k in range(rng.randrange(4))] for y in range(rng.randrange(5))]
        assert tables.grid(rows) == by_cells(rows)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []), ("", []), ("<p>no</p>", []), ("<table></table>", [[]]), ("<table><tr><td>a<td>b<tr><td>c", [[["a", "b"], ["c", ""]]]), ("<table><td>loose</table>", [[["loose"]]]),
        ("<table><tr><th colspan='2'>h</th></tr><tr><td rowspan=0>x</td><td>1</td></tr><tr><td>2</td></tr></table>", [[["h", ""], ["x", "1"], ["", "2"]]]),
        ("<table><tr><td>a<script>bad</script><br>b &lt;</td><td colspan=x>c</td></tr></table>", [[["a\nb <", "c"]]]),
        ("<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>", [[["i"]], [["o"]]]),
    ],
)
def test_tables_of_html(html, want):
    assert tables.html_tables(html) == want


def test_tables_stand_behind_the_text_of_their_page(spark):
    pages = spark.createDataFrame([("s", 2, "two", [[["a", "b"], ["1", None]], [["", " "]]]), ("s", 1, " \n", None), ("t", 1, None, [[["x"]], [["y"]]])], "study_id string, page int, text string, tables array<array<array<string>>>")
    got = {r.study_id: r.text for r in tables.marked_pages(pages).collect()}
    assert got["s"] == "<!-- PAGE 1 -->\n\n<!-- PAGE 2 -->\n\ntwo\n\n| a | b |\n| --- | --- |\n| 1 |  |"
    assert got["t"] == "<!-- PAGE 1 -->\n\n| x |\n| --- |\n\n| y |\n| --- |"
    found = tables.find_tables(spark.createDataFrame([(1, None), (1, "<table><tr><td>é</table>" + "x" * 300_000)], "page_id int, html string")).collect()
    assert sorted(len(r.tables) for r in found) == [0, 1] and tables.find_tables(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_sections_lean_on_earlier_ones_and_are_checked(spark, tmp_path):
    asked = []

    def ask(prompts):
        rows = []
        for p in prompts.collect():
            asked.append(p)
            answer = {"writer_synthesis": '{"narrative_skeleton": {"methods": "how"}}', "writer_results": "no json", "writer_abstract": "{}", "fact_check": '{"claims": [{"text": "METHODS", "verdict": "CONTRADICTED", "corrected_text": "Means"}, {"text": "text", "verdict": "UNSUPPORTED"}]}'}.get(p.phase, json.dumps({"text": p.phase[7:].upper() + " text"}))
            rows += [(p.key, 1, "broken"), (p.key, 2, answer), (p.key, 3, '{"text": "too late"}')]
        return spark.createDataFrame(rows, "key string, attempt int, response string")

    run = ReviewRun(spark, str(tmp_path))
    reports = spark.createDataFrame([("r1", '{"p": 1}', "{}", "[]", None)], "report string, pico string, statistics string, extractions string, quality string")
    sections = manuscript.write_sections(reports, ask, run.keep)
    text = {r.section: r.text for r in sections.collect()}
    assert text == {"methods": "METHODS text", "results": "[results section could not be generated]", "discussion": "DISCUSSION text", "introduction": "INTRODUCTION text", "abstract": ""}
    assert [p.phase for p in asked] == ["writer_synthesis", *(f"writer_{s}" for s in manuscript.SECTIONS)]
    prompt = {p.phase: p.user for p in asked}
    assert "Statistical Results" not in prompt["writer_methods"] and "## Thesis for This Section\nhow" in prompt["writer_methods"] and "Quality" not in prompt["writer_methods"]
    assert "### Methods\nMETHODS text" in prompt["writer_results"] and "[results section could not be generated]" in prompt["writer_discussion"]
    revised, claims = manuscript.check_sections(sections, ask, run.keep)
    got = {r.section: (r.revised_text, r.n_contradicted, r.n_unsupported) for r in revised.collect()}
    assert got["methods"] == (f"Means text {writing.TAG}", 1, 1) and got["discussion"] == (f"DISCUSSION text {writing.TAG}", 1, 1)
    assert got["results"] == (text["results"], 0, 0) and got["abstract"] == ("", 0, 0) and claims.count() == 6 and not writing.needs_revision(revised)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop", [None, 0, 2, 4, 6])
def test_a_stopped_run_goes_on_to_the_same_tables(spark, tmp_path, stop):
    ran = []

    def stage(name, f, fail_at=None):
        def run(tables):
            ran.append(name)
            if stop is not None and len(ran) == stop + 1 and not stopped:
                raise Stopped
            return f(tables)

        return Stage(name, run)

    stopped = []
    stages = [
        stage("extract", lambda t: t["seed"].withColumn("n", F.lit(t["flags"].first().n + 1 if "flags" in t else 0))),
        stage("analyse", lambda t: t["extract"].withColumn("m", F.col("n") * 10)),
        stage("flags", lambda t: t["analyse"].select("n")),
        stage("write", lambda t: t["flags"].join(t["analyse"], "n")),
    ]
    loops = [Loop("flags", "extract", lambda t: t["flags"].first().n < 5, most=2)]
    given = {"seed": spark.createDataFrame([(1,)], "id int")}
    run = StagedRun(spark, str(tmp_path))
    if stop is not None:
        with pytest.raises(Stopped):
            run.execute(stages, loops, given)
        stopped.append(True)
        ran.pop()
    done = StagedRun(spark, str(tmp_path)).execute(stages, loops, given)
    assert ran == ["extract", "analyse", "flags"] * 3 + ["write"]  # each step once, whatever stopped
    assert done["write"].first().asDict() == {"n": 2, "id": 1, "m": 20}
    assert sorted((r.step, r.name, r.version) for r in run.manifest().collect())[-2:] == [(8, "flags", 3), (9, "write", 1)]
    assert StagedRun(spark, str(tmp_path)).execute(stages, loops, given)["write"].count() == 1 and len(ran) == 10


def test_stages_that_changed_are_refused(spark, tmp_path):
    one = Stage("a", lambda t: spark.range(1))
    StagedRun(spark, str(tmp_path)).execute([one])
    with pytest.raises(ValueError, match="changed"):
        StagedRun(spark, str(tmp_path)).execute([Stage("b", lambda t: spark.range(1))])
    with pytest.raises(ValueError, match="names"):
        StagedRun(spark, str(tmp_path / "x")).execute([one, one])


def test_figures(spark):
    names = ("identified", "duplicates_removed", "after_dedup", "prescreen_excluded", "after_prescreen", "screened", "screen_excluded", "human_review", "sought", "not_retrieved", "fulltext_assessed", "fulltext_excluded", "included")
    counts = spark.createDataFrame([("r", tuple(range(13))), ("s", (0,) * 13)], f"run string, counts struct<{','.join(f'{n}:long' for n in names)}>")
    text = {r.run: r.t for r in counts.select("run", writing.prisma_text(F.col("counts")).alias("t")).collect()}["r"].split("\n")
    assert text[:2] == ["PRISMA 2020 Flow Diagram", "=" * 50] and text[4] == "  Records identified from databases: 0" and text[-1] == "  Studies included in review: 12" and len(text) == 21
    rows = writing.prisma_layout(counts).collect()
    assert sum(r.run == "r" and r.kind != "arrow" for r in rows) == 9 and sum(r.run == "s" and r.kind != "arrow" for r in rows) == 8
    arrows = sorted((r.y, r.y + r.h) for r in rows if r.run == "r" and r.kind == "arrow")
    assert arrows[-1] == pytest.approx((14.55, 13.75)) and len(arrows) == 4
    bars = writing.cost_bars(spark.createDataFrame([("b", "y", 2.0), ("b", "x", 1.0), ("a", "x", 4.0)], "phase string, agent string, cost double")).collect()
    assert {(r.phase, r.agent): (r.x, r.bottom, r.top) for r in bars} == {("a", "x"): (0, 0.0, 4.0), ("b", "x"): (1, 0.0, 1.0), ("b", "y"): (1, 1.0, 3.0)}
