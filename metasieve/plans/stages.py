"""A run of declared stages: each output is a version of its own, recorded once it is whole, so a stopped run goes on.

Stages are functions of tables; Spark does their work. What is decided on the driver is a branch: whether a stage is
repeated, by a condition on the tables so far, a bounded number of times.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """name of its output, and a function from the tables so far."""

    name: str
    run: Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Loop:
    """After a stage, back to an earlier one while the condition holds, at most `most` times."""

    after: str
    back_to: str
    when: Callable[[Tables], bool]
    most: int = 3


class StagedRun:
    """Stages over a folder that all executors reach. A table name always means its latest version."""

    MANIFEST = "step int, name string, version int, path string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """step, name, version, path of the outputs that are whole."""
        try:
            return self.spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], self.MANIFEST)

    def execute(self, stages: Sequence[Stage], loops: Sequence[Loop] = (), given: Tables = {}) -> dict[str, DataFrame]:  # noqa: B006
        """The tables after all stages. Steps that the manifest has are read, not run; the rest runs and is recorded."""
        names = [s.name for s in stages]
        if len(set(names)) < len(names) or any(names.index(x.back_to) > names.index(x.after) for x in loops):
            raise ValueError("stages need names of their own, loops go back")
        done = {r.step: r for r in self.manifest().collect()}  # a row for each step of a run
        tables, versions, turns, step, at = dict(given), {}, [0] * len(loops), 0, 0
        while at < len(stages):
            stage = stages[at]
            version = versions[stage.name] = versions.get(stage.name, 0) + 1
            path = f"{self.path}/{stage.name}/v{version}"
            if step in done and done[step].name != stage.name:
                raise ValueError(f"step {step} was {done[step].name}, not {stage.name}: the stages have changed")
            if step not in done:
                stage.run(tables).write.mode("overwrite").parquet(path)
                self.spark.createDataFrame([(step, stage.name, version, path)], self.MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
            tables[stage.name] = self.spark.read.parquet(path)
            step, at = step + 1, at + 1
            for k, loop in enumerate(loops):
                if loop.after == stage.name and turns[k] < loop.most and loop.when(tables):
                    turns[k] += 1
                    at = names.index(loop.back_to)
                    break
        return tables
