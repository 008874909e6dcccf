"""A review run: stages from studies to results, each written before the next reads it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.operators import analysis, harmonize, quality, screening
from metasieve.sources.scratch import scratch_dir


@dataclass
class ReviewRun:
    """The named tables of a run, in a folder that all executors reach; a stage never overwrites its input."""

    spark: SparkSession
    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self.tables[name]

    def resume(self, name: str) -> DataFrame:
        """A table that an earlier run kept."""
        self.tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self.tables[name]


def new_run(spark: SparkSession) -> ReviewRun:
    """A run in a folder of its own below spark.checkpoint.dir; a local master without one takes a temporary folder."""
    return ReviewRun(spark, scratch_dir(spark, "run"))


def screen(run: ReviewRun, studies: DataFrame, votes: DataFrame, arbitrations: DataFrame, exclusion: list[str] = (), required: list[str] = ()) -> DataFrame:
    """Deduplication, prescreening and dual screening; gives the included studies."""
    unique = run.keep("deduplicated", screening.dedup_by_title(studies))
    passed = run.keep("prescreened", screening.prescreen(unique, exclusion, required)).filter("status = 'passed'").drop("status", "reason")
    results = run.keep("screening", screening.screen(votes.join(passed.select("study_id"), "study_id", "left_semi"), arbitrations))
    return run.keep("included", screening.included(passed, results))


def analyse(run: ReviewRun, extractions: DataFrame, clusters: DataFrame | None = None, plan: DataFrame | None = None) -> dict[str, DataFrame]:
    """Harmonization, statistics and flags of the extracted rows (outcome_name, ord, study_id, arm1, arm2)."""
    if clusters is None:
        clusters, data, left = harmonize.harmonize(extractions)
        run.keep("outcome_clusters", clusters)
        run.keep("unmapped", left)
    else:
        data = harmonize.apply_mapping(extractions, clusters)
    rows = run.keep("harmonized", data).withColumn("outcome", F.col("canonical_outcome"))
    found = analysis.analyze(rows, plan)
    return {k: run.keep(k, df) for k, df in found.items()}


def rate(run: ReviewRun, rob_votes: DataFrame, max_iterations: int = 3) -> tuple[DataFrame, bool]:
    """Risk of bias and certainty of the kept results; whether a critical flag asks for extraction again.

    Callers loop at most max_iterations times.
    """
    assessed = run.keep("risk_of_bias", quality.assess_rob(rob_votes, default_missing=True))
    share = assessed.agg(F.coalesce(F.count_if(F.col("error").isNull() & (F.col("overall") == "high")) / F.nullif(F.count_if(F.col("error").isNull()), F.lit(0)), F.lit(0.0)).alias("proportion_high"))
    rows = run.tables["results"].join(F.broadcast(share))  # one row
    graded = run.keep("certainty", quality.assess_grade(quality.grade_inputs(rows, F.col("proportion_high")).drop("error")))
    return graded, max_iterations > 0 and quality.needs_re_extraction(run.tables["flags"])
