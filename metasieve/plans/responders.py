"""The model boundary: prompts go out as a table, responses come back as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasieve.functions.text import parse_json
from metasieve.operators.cost import call_cost

#: A responder takes prompts (key, tier, system, user) and gives responses (key, attempt, response, input_tokens, output_tokens, failed).
Responder = Callable[[DataFrame], DataFrame]

#: What each role reads of a run: fixed values.
SCOPES = {
    "screener": ("pico", "screening_criteria"), "arbiter": ("pico", "screening_criteria"), "fulltext_screener": ("pico", "screening_criteria"),
    "extractor": ("pico", "included_studies"), "harmonizer": ("pico", "extractions"), "statistician": ("pico", "harmonized_data", "analysis_plan"),
    "writer": ("pico", "statistics_results", "quality_assessments", "evidence_synthesis", "included_studies"), "pico_interviewer": ("pico",), "strategy_generator": ("pico", "screening_criteria"),
}


def context_for(run: dict[str, DataFrame], role: str) -> dict[str, DataFrame]:
    """The tables of a run that a role reads; an unknown role reads all."""
    return {k: run[k] for k in SCOPES.get(role, tuple(run)) if k in run}


def prompts(rows: DataFrame, key: str, tier: str, system: str, *columns: str) -> DataFrame:
    """key, tier, system, user: the columns of each row as JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.lit(tier).alias("tier"), F.lit(system).alias("system"), F.to_json(F.struct(*columns)).alias("user"))


def routed(asked: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """key, tier, response, fallback_used, cost, error: the primary model's response, else the fallback's, at the tier's rate."""
    take = lambda df, p: df.filter("NOT failed").select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("response", "input_tokens", "output_tokens")))
    j = asked.join(take(primary, "p"), "key", "left").join(take(fallback, "f"), "key", "left")
    either = lambda c: F.when(F.col("p_response").isNotNull(), F.col(f"p_{c}")).otherwise(F.col(f"f_{c}"))
    response = either("response")
    return j.select("key", "tier", response.alias("response"), (F.col("p_response").isNull() & F.col("f_response").isNotNull()).alias("fallback_used"), call_cost(F.col("tier"), either("input_tokens"), either("output_tokens")).alias("cost"), F.when(response.isNull(), "all models failed").alias("error"))


def parsed(responses: DataFrame, schema: str, default: Column | None = None) -> DataFrame:
    """key, value, parse_error: the first attempt of each key that parses, else the default."""
    tried = responses.withColumn("_v", parse_json(F.col("response"), None, schema))
    best = tried.groupBy("key").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("attempt"))).alias("value"))
    return best.select("key", F.coalesce("value", default) if default is not None else F.col("value"), F.col("value").isNull().alias("parse_error")).toDF("key", "value", "parse_error")


def refined_pico_score(rescored: Column, reported: Column) -> Column:
    """The higher of the computed score and the model's."""
    return F.greatest(rescored, F.coalesce(reported, F.lit(0)))
