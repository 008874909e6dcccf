"""The project folder and its commands."""

import json

import pytest

from metasieve import __main__ as cli
from metasieve.plans.project import Project


@pytest.fixture
def project(spark, tmp_path):
    arm = lambda mean, sd: {"n": 40, "mean": mean, "sd": sd}
    write = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows))
    ids = [f"s{k}" for k in range(8)]
    write("pico.json", {"population": "older adults", "intervention": "light therapy", "comparator": "placebo", "outcome": ["sleep"], "exclusion_keywords": ["mice"]})
    write("studies.json", [{"study_id": s, "title": f"Trial {s}" + (" in mice" if s == "s7" else ""), "abstract": "", "ord": k} for k, s in enumerate(ids)] + [{"study_id": "copy", "title": " TRIAL s0 ", "abstract": "", "ord": 99}])
    write("votes.json", [{"study_id": s, "screener_id": f"screener{k}", "decision": "exclude" if s == "s6" else "include", "confidence": 90} for s in ids for k in (1, 2)])
    write("extractions.json", [{"study_id": s, "ord": k, "outcome_name": "Sleep" if k % 2 else " sleep ", "arm1": arm(10.0 + k / 4, 2.0), "arm2": arm(9.0, 2.0)} for k, s in enumerate(ids)])
    write("rob_votes.json", [{"study_id": s, "randomization_process": "high" if s == "s0" else "low"} for s in ids])
    claims = {"claims": [{"text": "a", "verdict": "SUPPORTED"}, {"text": "b", "verdict": "CONTRADICTED", "corrected_text": "c"}]}
    outcome = Project(spark, str(tmp_path)).run((1, 4))["results"].first().outcome
    said = [("writer_synthesis", outcome, {"key_findings": []}), ("writer_methods", outcome, {"text": "a b"}), ("writer_results", outcome, {"text": "r"}), ("fact_check", f"{outcome}\u001fmethods", claims)]
    write("answers.json", [{"key": k, "phase": p, "attempt": 1, "response": json.dumps(r), "input_tokens": 1, "output_tokens": 1, "failed": False} for p, k, r in said])
    (tmp_path / "cost_log.jsonl").write_text("\n".join(json.dumps({"phase": p, "agent": "x", "input_tokens": 10, "output_tokens": 5, "cost": 0.5}) for p in ("a", "b")) + "\n\n")
    return tmp_path


def test_run_resume_validate_plot_cost(spark, project, capsys):
    go = lambda *a: cli.main([a[0], "--project", str(project), *a[1:]], spark)
    assert go("validate") == 1  # the run so far has no sections
    assert go("run", "--phases", "5-6", "--resume") == 0
    it = Project(spark, str(project))
    assert it.runs().count() == 1
    counts = it.table("prisma").first().counts
    assert (counts.identified, counts.duplicates_removed, counts.prescreen_excluded, counts.screened, counts.screen_excluded, counts.included) == (9, 1, 1, 7, 1, 6)
    result = it.table("results").first()
    assert result.k == 6 and result.error is None and it.table("leave_one_out").count() == 6
    assert it.table("risk_of_bias").filter("overall = 'high'").count() == 1 and it.table("certainty").count() == 1
    written = {r.section: r.text for r in it.table("sections").collect()}
    assert written["methods"] == "a b" and written["discussion"] == "[discussion section could not be generated]" and len(written) == 5
    assert {r.section: r.revised_text for r in it.table("manuscript").collect()}["methods"] == "a c"
    capsys.readouterr()
    assert go("validate") == 0
    said = capsys.readouterr().out
    assert "methods         1 supported, 1 contradicted, 0 unsupported" in said and "WARNING: 1 contradicted" in said
    assert go("plot", "--type", "prisma") == 0 and "Studies included in review: 6" in capsys.readouterr().out
    assert go("plot", "--type", "forest") == 0 and go("plot", "--type", "funnel") == 0
    assert spark.read.json(f"{project}/figures/forest").count() == 7 and spark.read.json(f"{project}/figures/funnel").count() == 100
    assert go("cost") == 0 and "TOTAL" in (said := capsys.readouterr().out) and "1.0000" in said


def test_interactive_and_refusals(spark, project, tmp_path_factory, capsys):
    args = lambda: cli.parser().parse_args(["interactive", "--project", str(project)])
    it = Project(spark, str(project))
    answers = iter(["", "", "n"])
    assert cli.interactive(it, args(), lambda _: next(answers)) == 0 and it.runs().count() == 1
    assert "Completeness: 70 of 100" in capsys.readouterr().out
    empty = str(tmp_path_factory.mktemp("empty"))
    assert cli.main(["run", "--project", empty, "--phases", "3-4"], spark) == 1
    assert cli.main(["plot", "--project", empty, "--type", "forest"], spark) == 1 and cli.main(["cost", "--project", empty], spark) == 0
    asked = iter(["Does light help?", "", "", ""])
    assert cli.interactive(Project(spark, empty), args(), lambda _: next(asked)) == 1  # no studies
    assert cli.main([], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["run", "--project", empty, "--phases", "x"], spark)


def test_a_project_without_tables(spark, tmp_path):
    tables = Project(spark, str(tmp_path)).run()
    assert all(df.count() == 0 for name, df in tables.items() if name != "prisma") and tables["prisma"].first().counts.included == 0
