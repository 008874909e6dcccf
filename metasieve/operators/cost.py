"""Usage and cost roll-ups over the call log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers and their prices for 1000 tokens in and out: fixed values.
TIER_RATES = {"fast": (0.0003, 0.0025), "smart": (0.003, 0.015), "strategic": (0.015, 0.075)}
PHASES = ("phase1", "phase2", "phase3", "phase4", "phase5", "phase6")


def call_cost(tier: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """The price of a call at its tier's rates, to 6 decimals; null for an unknown tier. A fallback costs its tier's rate."""
    out = F.lit(None).cast("double")
    for name, (per_in, per_out) in TIER_RATES.items():
        out = F.when(tier == name, F.round(input_tokens / 1000 * per_in + output_tokens / 1000 * per_out, 6)).otherwise(out)
    return out


def with_defaults(log: DataFrame) -> DataFrame:
    """A replayed log: an unknown phase or agent is "unknown", missing numbers are 0."""
    filled = {c: F.coalesce(c, F.lit("unknown")) for c in ("phase", "agent")} | {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cost")}
    return log.withColumns(filled)


def cost_rollup(log: DataFrame) -> DataFrame:
    """phase, agent, level, calls, input_tokens, output_tokens, tokens, cost: level 0 an agent, 1 a phase, 3 all."""
    out = with_defaults(log).rollup("phase", "agent").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    return out.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))


def cost_report(log: DataFrame, n_studies: int = 0) -> DataFrame:
    """cost_rollup() with cost_per_study and tokens_per_study on the total, where there are studies."""
    total = F.col("level") == 3
    per = lambda c: F.when(total & F.lit(n_studies > 0), F.col(c) / F.lit(max(1, n_studies)))
    return cost_rollup(log).withColumn("cost_per_study", per("cost")).withColumn("tokens_per_study", per("tokens"))


def estimate_remaining(log: DataFrame, current_phase: str, phases: Sequence[str] = PHASES) -> DataFrame:
    """One row: current_phase, cost_so_far, n_completed, n_remaining, estimate, reason.

    Completed are the recorded phases up to the current one; each remaining phase costs as much as they did on average.
    """
    at = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    here = phases.index(current_phase) + 1 if current_phase in phases else 0
    seen = with_defaults(log).agg(F.sum("cost").alias("cost_so_far"), F.count_distinct(F.when((at > 0) & (at <= here), F.col("phase"))).alias("n_completed"))
    remaining = len(phases) - here
    reason = F.when(F.lit(here == 0), "unknown phase").when(F.col("n_completed") == 0, "no completed phase")
    return seen.select(F.lit(current_phase).alias("current_phase"), F.coalesce("cost_so_far", F.lit(0.0)).alias("cost_so_far"), "n_completed", F.lit(remaining).alias("n_remaining"), F.when(reason.isNull(), F.col("cost_so_far") * remaining / F.nullif(F.col("n_completed"), F.lit(0))).alias("estimate"), reason.alias("reason"))


def cost_table(report: DataFrame) -> DataFrame:
    """line: the report's rows as text, phases and agents in order, subtotals after their agents."""
    key = F.struct(F.col("phase").isNull(), "phase", F.col("agent").isNull(), "agent")
    name = F.when(F.col("level") == 3, "TOTAL").when(F.col("level") == 1, F.concat(F.col("phase"), F.lit(" subtotal"))).otherwise(F.concat_ws(" / ", "phase", "agent"))
    line = F.format_string("%-40s %8d %12d %10.4f", name, "calls", "tokens", F.col("cost").cast("double"))
    return report.select(key.alias("position"), line.alias("line"))
