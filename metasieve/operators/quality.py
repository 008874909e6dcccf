"""Risk of bias, certainty of evidence and anomaly flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five domains and the levels, best first: fixed values.
ROB_DOMAINS = ("randomization_process", "deviations_from_intervention", "missing_outcome_data", "measurement_of_outcome", "selection_of_reported_result")
ROB_LEVELS = ("low", "some_concerns", "high")
GRADE_DOMAINS = ("risk_of_bias", "inconsistency", "indirectness", "imprecision", "publication_bias")
GRADE_STEPS = {"no_concern": 0, "serious": 1, "very_serious": 2}
GRADE_LABELS = {4: "high", 3: "moderate", 2: "low", 1: "very_low"}
STARTING = {"rct": 4, "observational": 2}

#: Thresholds of the flags and of the certainty inputs.
HIGH_I2, DOMINANT_WEIGHT, FEW_STUDIES = 90.0, 0.40, 3


def assess_rob(votes: DataFrame, default_missing: bool = False) -> DataFrame:
    """votes with overall, n_high, n_some_concerns, n_low and error.

    The domains are columns. A missing or unknown level is an error without a result, unless default_missing replaces
    missing ones by some_concerns, as for assessments that could not be made.
    """
    if default_missing:
        votes = votes.withColumns({d: F.coalesce(F.col(d), F.lit("some_concerns")) for d in ROB_DOMAINS})
    missing = F.array_compact(F.array(*(F.when(F.col(d).isNull(), d) for d in ROB_DOMAINS)))
    invalid = F.array_compact(F.array(*(F.when(~F.col(d).isin(*ROB_LEVELS), d) for d in ROB_DOMAINS)))
    error = F.when(F.size(missing) > 0, F.concat(F.lit("missing domains: "), F.array_join(missing, ", "))).when(F.size(invalid) > 0, F.concat(F.lit("invalid level: "), F.array_join(invalid, ", ")))
    count = {level: F.size(F.array_compact(F.array(*(F.when(F.col(d) == level, d) for d in ROB_DOMAINS)))) for level in ROB_LEVELS}
    overall = F.when(count["high"] > 0, "high").when(count["some_concerns"] > 0, "some_concerns").otherwise("low")
    ok = F.col("error").isNull()
    return votes.withColumn("error", error).withColumns({"overall": F.when(ok, overall), **{f"n_{level}": F.when(ok, count[level]) for level in ROB_LEVELS}})


def summarize_rob(assessed: DataFrame) -> DataFrame:
    """domain, level, n, proportion over the assessed studies, with overall as a domain; every level is listed."""
    good = assessed.filter(F.col("error").isNull())
    entries = F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(d).alias("level")) for d in ("overall", *ROB_DOMAINS))))
    counted = good.select(entries.alias("e")).groupBy(F.col("e.domain").alias("domain")).agg(F.count(F.lit(1)).alias("k"), *(F.count_if(F.col("e.level") == x).alias(x) for x in ROB_LEVELS))
    listed = F.explode(F.array(*(F.struct(F.lit(x).alias("level"), F.col(x).alias("n")) for x in ROB_LEVELS)))
    return counted.select("domain", "k", listed.alias("l")).select("domain", "l.level", "l.n", (F.col("l.n") / F.col("k")).alias("proportion"))


def assess_grade(judged: DataFrame) -> DataFrame:
    """judged with starting_certainty, total_downgrade, certainty, grade, downgrades (domain to steps) and error.

    The domains and study_design are columns. A null indirectness, then other nulls, then unknown levels are errors. An
    unknown design starts as observational ones do; certainty does not fall below 1.
    """
    others = [d for d in GRADE_DOMAINS if d != "indirectness"]
    missing = F.array_compact(F.array(*(F.when(F.col(d).isNull(), d) for d in others)))
    invalid = F.array_compact(F.array(*(F.when(~F.col(d).isin(*GRADE_STEPS), d) for d in GRADE_DOMAINS)))
    error = F.when(F.col("indirectness").isNull(), "indirectness must be judged by a reviewer").when(F.size(missing) > 0, F.concat(F.lit("missing domains: "), F.array_join(missing, ", "))).when(F.size(invalid) > 0, F.concat(F.lit("invalid level: "), F.array_join(invalid, ", ")))

    def steps(d: str) -> Column:
        return F.when(F.col(d) == "very_serious", 2).when(F.col(d) == "serious", 1).otherwise(0)

    total = sum((steps(d) for d in GRADE_DOMAINS), F.lit(0))
    start = F.when(F.lower("study_design") == "rct", STARTING["rct"]).otherwise(STARTING["observational"])
    certainty = F.greatest(F.lit(1), start - total)
    grade = F.lit(None).cast("string")
    for c, label in GRADE_LABELS.items():
        grade = F.when(certainty == c, label).otherwise(grade)
    downgrades = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, GRADE_DOMAINS)), F.array(*map(steps, GRADE_DOMAINS))), lambda _, v: v > 0)
    ok = F.col("error").isNull()
    return judged.withColumn("error", error).withColumns({"starting_certainty": F.when(ok, start), "total_downgrade": F.when(ok, total), "certainty": F.when(ok, certainty), "grade": F.when(ok, grade), "downgrades": F.when(ok, downgrades)})


def grade_inputs(results: DataFrame, proportion_high: Column | float, study_design: str = "rct") -> DataFrame:
    """results (k, i2, ci_lower, ci_upper, taf_flip, egger_sig, error) with the five judgements and study_design.

    proportion_high is the share of studies with a high overall risk of bias. Outcomes with an error are left out.
    """
    high = proportion_high if isinstance(proportion_high, Column) else F.lit(float(proportion_high))
    crosses = (F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)
    three = lambda very, serious: F.when(very, "very_serious").when(serious, "serious").otherwise("no_concern")
    return results.filter(F.col("error").isNull()).withColumns({
        "risk_of_bias": three(high >= 0.5, high >= 0.25),
        "inconsistency": three(F.col("i2") >= 75, F.col("i2") >= 50),
        "indirectness": F.lit("no_concern"),
        "imprecision": three(crosses & (F.col("k") < FEW_STUDIES), crosses),
        "publication_bias": three(F.coalesce("taf_flip", F.lit(False)), F.coalesce("egger_sig", F.lit(False))),
        "study_design": F.lit(study_design),
    })


def anomaly_flags(results: DataFrame) -> DataFrame:
    """outcome, position, type, severity, description, action_taken: one row for each flag of an outcome, in order.

    results has outcome, k, i2, weights, ci_lower, ci_upper, pi_lower, pi_upper, taf_flip, egger_sig, has_loo and error;
    outcomes with an error have no flag.
    """
    heaviest = F.array_max("weights")
    excludes = (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)
    includes = (F.col("pi_lower") <= 0) & (F.col("pi_upper") >= 0)
    i2_text = F.format_string("%.1f", F.bround("i2", 1))
    weight_text = F.format_string("%.1f", F.bround(heaviest * 100, 1))
    rules = [
        (F.col("i2") > HIGH_I2, "high_heterogeneity", "warning", F.concat(F.lit("I2 is "), i2_text, F.lit("%")), F.when(F.coalesce("has_loo", F.lit(False)), "leave-one-out analysis was run").otherwise("leave-one-out analysis is advised")),
        (heaviest > DOMINANT_WEIGHT, "weight_dominance", "warning", F.concat(F.lit("one study has "), weight_text, F.lit("% of the weight")), F.lit("reported")),
        (F.col("k") < FEW_STUDIES, "underpowered", "info", F.concat(F.lit("only "), F.col("k").cast("string"), F.lit(" studies")), F.lit("reported")),
        (F.coalesce("taf_flip", F.lit(False)), "trim_fill_direction_flip", "critical", F.lit("trim-and-fill turns the direction of the effect"), F.lit("reported")),
        (F.coalesce("egger_sig", F.lit(False)), "publication_bias_detected", "warning", F.lit("Egger's test is significant"), F.lit("reported")),
        (excludes & includes, "prediction_interval_warning", "info", F.lit("the prediction interval includes no effect"), F.lit("reported")),
    ]
    flags = F.array(*(F.when(c, F.struct(F.lit(i).alias("position"), F.lit(t).alias("type"), F.lit(s).alias("severity"), d.alias("description"), a.alias("action_taken"))) for i, (c, t, s, d, a) in enumerate(rules)))
    return results.filter(F.col("error").isNull()).select("outcome", F.inline(F.array_compact(flags)))


def needs_re_extraction(flags: DataFrame, resolved: Sequence[str] = ()) -> bool:
    """Whether a critical flag is left whose type is not among the resolved ones."""
    return not flags.filter((F.col("severity") == "critical") & ~F.col("type").isin(*resolved) if resolved else F.col("severity") == "critical").isEmpty()
