"""A review as a project folder: its input tables, its runs, and what can be asked of them.

The folder, which all executors reach, holds JSON files or folders of them: pico, studies, votes, arbitrations, extractions,
rob_votes, answers (of models) and cost_log. What is missing counts as empty. A run is a StagedRun of its own below `output`;
`runs` names them, so a later command finds the latest one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.operators import analysis, cost, harmonize, quality, screening, writing
from metasieve.operators.pooling import leave_one_out
from metasieve.plans.manuscript import check_sections, write_sections
from metasieve.plans.responders import Responder
from metasieve.plans.stages import Stage, StagedRun
from metasieve.sources.documents import read_json
from metasieve.sources.scratch import stored
from metasieve.streaming.usage import LOG, with_defaults

#: The input tables and their columns.
INPUTS = {
    "pico": "population string, intervention string, comparator string, outcome array<string>, inclusion_criteria array<string>, exclusion_criteria array<string>, study_design string, timing string, follow_up string, exclusion_keywords array<string>, required_keywords array<string>",
    "studies": "study_id string, title string, abstract string, ord long",
    "votes": "study_id string, screener_id string, decision string, confidence int",
    "arbitrations": "study_id string, decision string, confidence int",
    "extractions": f"study_id string, ord long, outcome_name string, arm1 {analysis.ARM}, arm2 {analysis.ARM}, subgroups map<string,string>",
    "rob_votes": "study_id string, " + ", ".join(f"{d} string" for d in quality.ROB_DOMAINS),
    "answers": "key string, phase string, attempt int, response string, input_tokens long, output_tokens long, failed boolean",
    "cost_log": LOG,
}
PHASES = 6
PRISMA = ("identified", "deduplicated", "prescreen_excluded", "screened", "screen_excluded", "human_review", "included")


def answers_of(answers: DataFrame) -> Responder:
    """A responder that looks prompts up in a table of answers, by key and phase."""
    return lambda asked: asked.select("key", "phase").join(answers, ["key", "phase"])


def prisma_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row, counts: the flow of a run's tables. No full texts are assessed here: what is included was assessed."""
    decided = tables["screening"]
    counted = {
        "identified": tables["studies"], "deduplicated": tables["deduplicated"], "prescreen_excluded": tables["prescreened"].filter("status = 'excluded'"), "screened": decided,
        "screen_excluded": decided.filter("final_decision = 'exclude'"), "human_review": decided.filter("final_decision = 'human_review'"), "included": tables["included"],
    }
    named = None
    for name, df in counted.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        named = one if named is None else named.unionByName(one)
    c = named.agg(*(F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in PRISMA))
    n = {name: F.col(name) for name in PRISMA}
    zero = F.lit(0).cast("long")
    return c.select(screening.prisma_counts(n["identified"], n["deduplicated"], n["prescreen_excluded"], n["screened"], n["screen_excluded"], n["human_review"], n["included"], zero, n["included"], zero).alias("counts"))


def certainty_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    assessed = tables["risk_of_bias"]
    known = F.col("error").isNull()
    share = assessed.agg(F.coalesce(F.count_if(known & (F.col("overall") == "high")) / F.nullif(F.count_if(known), F.lit(0)), F.lit(0.0)).alias("proportion_high"))
    rows = tables["results"].join(F.broadcast(share))  # one row
    return quality.assess_grade(quality.grade_inputs(rows, F.col("proportion_high")).drop("error"))


def reports_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A report for each outcome, as write_sections() takes it."""
    r = tables["results"]
    pico = tables["pico"].agg(F.first(F.to_json(F.struct("*"))).alias("pico"))
    graded = tables["certainty"].select("outcome", F.to_json(F.struct("certainty", "grade")).alias("quality"))
    rows = r.select(F.col("outcome").alias("report"), F.to_json(F.struct(*r.columns)).alias("statistics"), F.lit(None).cast("string").alias("extractions"))
    return rows.join(F.broadcast(pico)).join(graded.withColumnRenamed("outcome", "report"), "report", "left")  # one row of pico


def revised_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    keyed = tables["sections"].select(F.concat_ws("\u001f", F.col("report").cast("string"), "section").alias("section"), "text")
    out = writing.revise_sections(keyed, tables["claims"].drop("evidence"))
    at = lambda k: F.split_part("section", F.lit("\u001f"), F.lit(k))
    return out.select(at(1).alias("report"), at(2).alias("section"), *(c for c in out.columns if c != "section"))


def planned(rows: DataFrame) -> DataFrame:
    return analysis.default_plan(analysis.data_profile(rows))


def loo_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    chosen = tables["effects"].filter("reason IS NULL").join(tables["plan"].filter("run_loo").select("outcome"), "outcome", "left_semi")
    return leave_one_out(chosen, ("outcome",), F.col("method"), F.col("apply_hksj"))


def usable(tables: Mapping[str, DataFrame]) -> DataFrame:
    return tables["effects"].filter("reason IS NULL").drop("reason", "effect_type")


def stages(ask: Responder, exclusion: list[str] = (), required: list[str] = ()) -> list[tuple[int, Stage]]:
    """(phase, stage) of a review in order: screening, full decisions, harmonization, statistics, quality, writing."""
    passed = lambda t: t["prescreened"].filter("status = 'passed'")
    chosen = lambda t: t["extractions"].join(t["included"].select("study_id"), "study_id", "left_semi")
    steps = [
        (1, "deduplicated", lambda t: screening.dedup_by_title(t["studies"])),
        (1, "prescreened", lambda t: screening.prescreen(t["deduplicated"], exclusion, required)),
        (2, "screening", lambda t: screening.screen(t["votes"].join(passed(t).select("study_id"), "study_id", "left_semi"), t["arbitrations"])),
        (2, "included", lambda t: screening.included(passed(t).drop("status", "reason"), t["screening"])),
        (2, "prisma", prisma_of),
        (3, "outcome_clusters", lambda t: harmonize.harmonize(chosen(t))[0]),
        (3, "harmonized", lambda t: harmonize.apply_mapping(chosen(t), t["outcome_clusters"]).withColumn("outcome", F.col("canonical_outcome"))),
        (4, "plan", lambda t: planned(t["harmonized"])),
        (4, "effects", lambda t: analysis.judged_effects(t["harmonized"], t["plan"])),
        (4, "results", lambda t: analysis.execute(t["harmonized"], t["plan"], usable(t))),
        (4, "leave_one_out", loo_of),
        (4, "flags", lambda t: quality.anomaly_flags(t["results"])),
        (5, "risk_of_bias", lambda t: quality.assess_rob(t["rob_votes"].join(t["included"].select("study_id"), "study_id", "left_semi"), default_missing=True)),
        (5, "certainty", certainty_of),
        (6, "sections", lambda t: write_sections(reports_of(t), ask, _kept)),
        (6, "claims", lambda t: check_sections(t["sections"], ask, _kept)[1]),
        (6, "manuscript", revised_of),
    ]
    return [(phase, Stage(name, run)) for phase, name, run in steps]


def _kept(name: str, df: DataFrame) -> DataFrame:
    return stored(df, name)


class Project:
    """A project folder, its inputs and its runs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def given(self, name: str) -> DataFrame:
        """An input table; an empty one where the project has none. Studies without a place in the order come first."""
        for at in (f"{self.path}/{name}.json", f"{self.path}/{name}.jsonl", f"{self.path}/{name}"):
            try:
                df = self.spark.read.schema(INPUTS[name]).json(at) if name == "cost_log" or at.endswith("l") else read_json(self.spark, at, INPUTS[name])
                break
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        else:
            df = self.spark.createDataFrame([], INPUTS[name])
        return df.withColumn("ord", F.coalesce("ord", F.lit(0))) if "ord" in df.columns else df

    def runs(self) -> DataFrame:
        """run, started of the project's runs."""
        try:
            return self.spark.read.schema("run string, started double").json(f"{self.path}/runs")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "run string, started double")

    def latest(self) -> StagedRun | None:
        found = self.runs().agg(F.max_by("run", F.struct("started", "run")).alias("run")).first().run
        return None if found is None else StagedRun(self.spark, f"{self.path}/output/{found}")

    def table(self, name: str) -> DataFrame | None:
        """A table of the latest run, in its latest version; None where it has none."""
        run = self.latest()
        path = None if run is None else run.manifest().filter(F.col("name") == name).agg(F.max_by("path", "step").alias("path")).first().path
        return None if path is None else self.spark.read.parquet(path)

    def run(self, phases: tuple[int, int] = (1, PHASES), resume: bool = False, ask: Responder | None = None) -> dict[str, DataFrame]:
        """All tables up to the last phase. A resumed run keeps what is whole; phases after the first need one to go on from."""
        first, last = phases
        if not 1 <= first <= last <= PHASES:
            raise ValueError(f"phases are 1 to {PHASES}, in order")
        run = self.latest() if resume else None
        if run is None:
            if first > 1:
                raise ValueError("a run that starts after phase 1 has to resume an earlier one")
            name = uuid.uuid4().hex
            self.spark.createDataFrame([(name, time.time())], "run string, started double").coalesce(1).write.mode("append").json(f"{self.path}/runs")
            run = StagedRun(self.spark, f"{self.path}/output/{name}")
        given = {name: self.given(name) for name in INPUTS}
        words = given["pico"].select("exclusion_keywords", "required_keywords").first()  # a project has one question
        found = stages(ask or answers_of(given["answers"]), *((x or []) for x in (words or (None, None))))
        return run.execute([s for phase, s in found if phase <= last], given=given)

    def costs(self) -> DataFrame:
        """cost_report() of the project's log, for the studies of its latest run, or all that are given."""
        return cost.cost_report(with_defaults(self.given("cost_log")), self.given("studies").count())

    def validate(self, ask: Responder | None = None) -> DataFrame | None:
        """section, n_supported, n_contradicted, n_unsupported of the written sections, checked anew; None without sections.

        The claims are kept in the project's `validation`.
        """
        sections = self.table("sections")
        if sections is None:
            return None
        _, claims = check_sections(sections, ask or answers_of(self.given("answers")), _kept)
        claims.write.mode("overwrite").json(f"{self.path}/validation")
        says = lambda v: F.count_if(F.col("verdict") == v)
        found = claims.groupBy(F.split_part("section", F.lit("\u001f"), F.lit(2)).alias("section")).agg(says("SUPPORTED").alias("n_supported"), says("CONTRADICTED").alias("n_contradicted"), says("UNSUPPORTED").alias("n_unsupported"))
        counts = ("n_supported", "n_contradicted", "n_unsupported")
        return sections.select("section").distinct().join(found, "section", "left").fillna(0, list(counts))

    def plot(self, kind: str) -> DataFrame | None:
        """The table of a figure (prisma, forest, funnel), kept in the project's `figures`; None without its inputs."""
        if kind == "prisma":
            flow = self.table("prisma")
            out = None if flow is None else writing.prisma_layout(flow)
        else:
            effects, results = self.table("effects"), self.table("results")
            if effects is None or results is None:
                return None
            pooled = results.filter("error IS NULL")
            effects = effects.filter("reason IS NULL")
            out = writing.forest_rows(effects, pooled) if kind == "forest" else writing.funnel_grid(effects, pooled)
        if out is not None:
            out.write.mode("overwrite").json(f"{self.path}/figures/{kind}")
        return out
