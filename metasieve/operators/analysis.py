"""From extracted rows to statistics: imputation, effects, profile, plan and execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from metasieve.functions.effects import effect_of, impute_sd
from metasieve.operators.bias import egger, trim_and_fill
from metasieve.operators.pooling import leave_one_out, random_effects, subgroup_effects
from metasieve.operators.quality import anomaly_flags
from metasieve.sources.scratch import stored

#: Studies from which a step is planned.
REML_FROM, LOO_FROM, BIAS_FROM = 3, 3, 10

ARM = "struct<name:string,n:bigint,mean:double,sd:double,se:double,ci_lower:double,ci_upper:double,events:bigint,total:bigint>"


def long_table(studies: DataFrame) -> DataFrame:
    """study_id, ord and one row for each extraction, from the nested layout (extractions) or the flat one."""
    if "extractions" in studies.columns:
        return studies.select("study_id", F.posexplode("extractions").alias("_p", "_e")).select("study_id", F.col("_p").alias("ord"), "_e.*")
    return studies if "ord" in studies.columns else studies.withColumn("ord", F.lit(0))


def imputed(rows: DataFrame) -> DataFrame:
    """rows (arm1, arm2 structs) with missing SDs taken from the SE or the interval, without rows that have no data at all."""
    for arm in ("arm1", "arm2"):
        a = F.col(arm)
        rows = rows.withColumn(arm, a.withField("sd", impute_sd(a["n"], a["sd"], a["se"], a["ci_lower"], a["ci_upper"])))
    return rows.filter(F.coalesce(F.col("arm1.mean"), F.col("arm1.sd"), F.col("arm1.events").cast("double")).isNotNull())


def data_profile(rows: DataFrame) -> DataFrame:
    """outcome, k (rows), study_ids, has_binary, has_continuous, subgroup_vars; rows without an outcome are left out.

    Kinds are judged before imputation, so an outcome with SEs alone is of neither kind.
    """
    named = rows.filter(F.coalesce("outcome", F.lit("")) != "")
    binary = F.col("arm1.events").isNotNull() & F.col("arm1.total").isNotNull()
    continuous = F.col("arm1.mean").isNotNull() & F.col("arm1.sd").isNotNull()
    subgroups = F.flatten(F.collect_set(F.map_keys("subgroups"))) if "subgroups" in rows.columns else F.array().cast("array<string>")
    return named.groupBy("outcome").agg(F.count(F.lit(1)).alias("k"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "study_id"))), lambda x: x["study_id"]).alias("study_ids"), F.coalesce(F.bool_or(binary), F.lit(False)).alias("has_binary"), F.coalesce(F.bool_or(continuous), F.lit(False)).alias("has_continuous"), F.array_sort(F.array_distinct(subgroups)).alias("subgroup_vars"))


def default_plan(profile: DataFrame) -> DataFrame:
    """outcome, k, effect_type, method, apply_hksj, subgroup_variables, run_loo, run_egger, run_trim_and_fill."""
    return profile.select("outcome", "k", F.when(F.col("has_continuous"), "SMD").otherwise("logOR").alias("effect_type"), F.when(F.col("k") >= REML_FROM, "REML").otherwise("DL").alias("method"), F.lit(True).alias("apply_hksj"), F.col("subgroup_vars").alias("subgroup_variables"), (F.col("k") >= LOO_FROM).alias("run_loo"), (F.col("k") >= BIAS_FROM).alias("run_egger"), (F.col("k") >= BIAS_FROM).alias("run_trim_and_fill"))


#: What each type of effect is computed from.
NEEDS = {"SMD": ("n", "mean", "sd"), "MD": ("n", "mean", "sd"), "logRR": ("events", "total"), "logOR": ("events", "total"), "RD": ("events", "total")}


def judged_effects(rows: DataFrame, plan: DataFrame, counts: Observation | None = None) -> DataFrame:
    """outcome, ord, study_id, effect_type, effect, se, reason, method, apply_hksj (and subgroups) of every planned row.

    A row has an effect, or the reason why it has none: `no data`, `unknown effect type`, `missing: ` with the fields that
    its type needs, or `outside the domain` of the formula. counts, if given, observes n_effects and n_rejected in passing.
    """
    joined = rows.join(plan.select("outcome", "effect_type", "method", "apply_hksj"), "outcome")
    # each step behind a generator is computed once for each row and in a method of its own; see effects.apart
    a = {k: F.col(k) for k in ("arm1", "arm2")}
    sd = {k: impute_sd(v["n"], v["sd"], v["se"], v["ci_lower"], v["ci_upper"]) for k, v in a.items()}
    once = joined.withColumn("_a", F.explode(F.array(F.struct(*(F.struct(v["n"].alias("n"), v["mean"].alias("mean"), sd[k].alias("sd"), v["events"].alias("events"), v["total"].alias("total")).alias(k) for k, v in a.items())))))
    fields = ("n", "mean", "sd", "events", "total")
    e, found = once.withColumns({f"_{k}_{f}": F.col(f"_a.{k}.{f}").cast("double") for k in a for f in fields}), []
    arm = lambda k: {f: F.col(f"_{k}_{f}") for f in fields}
    empty = F.coalesce("_arm1_mean", "_arm1_sd", "_arm1_events").isNull()
    for kind in NEEDS:
        x, field = effect_of(kind, arm("arm1"), arm("arm2"))
        e = e.withColumn(f"_{kind}", F.explode(F.array(F.when((F.col("effect_type") == kind) & ~empty, x))))
        found.append(F.when(F.col(f"_{kind}").isNotNull(), F.struct(F.col(f"_{kind}.{field}").alias("effect"), F.col(f"_{kind}.se").alias("se"))))
    e = e.withColumn("_e", F.coalesce(*found))
    wanted = lambda f: F.col("effect_type").isin([kind for kind, needs in NEEDS.items() if f in needs])
    missing = F.concat_ws(", ", *(F.when(F.col(f"_{k}_{f}").isNull() & wanted(f), f"{k}.{f}") for k in a for f in fields))
    reason = F.when(empty, "no data").when(~F.coalesce(F.col("effect_type").isin(list(NEEDS)), F.lit(False)), "unknown effect type").otherwise(F.coalesce(F.concat(F.lit("missing: "), F.nullif(missing, F.lit(""))), F.lit("outside the domain")))
    out = e.select("outcome", "ord", "study_id", "effect_type", F.col("_e.effect").alias("effect"), F.col("_e.se").alias("se"), F.when(F.col("_e").isNull(), reason).alias("reason"), "method", "apply_hksj", *(["subgroups"] if "subgroups" in rows.columns else []))
    if counts is not None:
        out = out.observe(counts, F.count_if(F.col("reason").isNull()).alias("n_effects"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))
    return out


def rejected(judged: DataFrame) -> DataFrame:
    """outcome, ord, study_id, effect_type, reason of the rows of judged_effects() that have no effect."""
    return judged.filter("reason IS NOT NULL").select("outcome", "ord", "study_id", "effect_type", "reason")


def planned_effects(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """outcome, ord, study_id, effect, se, method, apply_hksj (and subgroups, where rows have them) of the rows whose planned effect can be computed, by imputed arms."""
    return judged_effects(rows, plan).filter("reason IS NULL").drop("reason", "effect_type")


def cross_check_rows(rows: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """study_id, outcome, timepoint, ord, issues: what the extracted rows of a study fail, beside the checks of one row alone.

    rows has outcome, ord, study_id, timepoint, arm1, arm2. An arm's n must be the same for all outcomes of a timepoint
    (`n_differs`); by ranges (outcome, low, high) a mean must lie in its range (`mean_outside`), and an SD within what
    values in that range can have, half its width (`sd_implausible`). Missing values and ranges fail nothing.
    """
    sides = F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"{a}.n").alias("n")) for a in ("arm1", "arm2")))
    long = rows.select("study_id", "timepoint", F.inline(sides)).filter("n IS NOT NULL")
    spread = long.groupBy("study_id", "timepoint", "arm").agg((F.min("n") != F.max("n")).alias("differs")).groupBy("study_id", "timepoint").agg(F.bool_or("differs").alias("_differs"))
    known = rows.join(spread.withColumnsRenamed({"study_id": "_s", "timepoint": "_t"}), F.col("study_id").eqNullSafe(F.col("_s")) & F.col("timepoint").eqNullSafe(F.col("_t")), "left")
    known = known.join(ranges.select("outcome", "low", "high"), "outcome", "left") if ranges is not None else known.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    outside = lambda a: (F.col(f"{a}.mean") < F.col("low")) | (F.col(f"{a}.mean") > F.col("high"))
    wide = lambda a: F.col(f"{a}.sd") > (F.col("high") - F.col("low")) / 2
    rules = [("n_differs", F.col("_differs")), ("mean_outside", outside("arm1") | outside("arm2")), ("sd_implausible", wide("arm1") | wide("arm2"))]
    return known.select("study_id", "outcome", "timepoint", "ord", F.array_compact(F.array(*(F.when(c, name) for name, c in rules))).alias("issues"))


def planned_subgroups(effects: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pooled effects of the subgroups, tests between them) of planned effects, by outcome and variable.

    A study without a label is in the subgroup "unknown"; variables with one label in an outcome have no rows.
    """
    asked = plan.select("outcome", F.explode("subgroup_variables").alias("variable"))
    labelled = effects.join(asked, "outcome").withColumn("subgroup", F.coalesce(F.col("subgroups")[F.col("variable")], F.lit("unknown")))
    over = Window.partitionBy("outcome", "variable")
    several = labelled.withColumn("_lo", F.min("subgroup").over(over)).withColumn("_hi", F.max("subgroup").over(over)).filter("_lo <> _hi").drop("_lo", "_hi")
    return subgroup_effects(several, ("outcome", "variable"), "subgroup", F.col("method"), F.col("apply_hksj"))


def execute(rows: DataFrame, plan: DataFrame, effects: DataFrame | None = None) -> DataFrame:
    """One row for each planned outcome: its pooled result, Egger's test, trim-and-fill, has_loo and error.

    An outcome without usable rows has k 0 and an error. The steps run where they are planned, on groups that allow them.
    effects may give the planned_effects() of the rows, where they are at hand.
    """
    effects = planned_effects(rows, plan) if effects is None else effects
    pooled = random_effects(effects, ("outcome",), F.col("method"), F.col("apply_hksj"))
    wanted = lambda flag: effects.join(plan.filter(flag).select("outcome"), "outcome", "left_semi")
    test = egger(wanted("run_egger")).select("outcome", F.col("p_value").alias("egger_p"), F.col("significant").alias("egger_sig"))
    fill = trim_and_fill(wanted("run_trim_and_fill")).select("outcome", "n_imputed", "adjusted_effect", F.col("direction_flipped").alias("taf_flip"))
    out = plan.select("outcome", "effect_type", "method", "run_loo").join(pooled, "outcome", "left").join(test, "outcome", "left").join(fill, "outcome", "left")
    return out.withColumn("error", F.when(F.col("k").isNull(), "no usable data").otherwise(F.col("error"))).withColumn("k", F.coalesce("k", F.lit(0))).withColumn("has_loo", F.col("run_loo") & (F.col("k") >= 2)).drop("run_loo")


def analyze(rows: DataFrame, plan: DataFrame | None = None) -> dict[str, DataFrame]:
    """profile, plan, rejected, results, leave_one_out, flags, and subgroups with subgroup_tests where rows have subgroups; all empty for empty input."""
    profile = data_profile(rows)
    plan = default_plan(profile) if plan is None else plan
    judged = stored(judged_effects(rows, plan), "effects")  # computed once, read by each step
    effects = judged.filter("reason IS NULL").drop("reason", "effect_type")
    results = execute(rows, plan, effects)
    loo = leave_one_out(effects.join(plan.filter("run_loo").select("outcome"), "outcome", "left_semi"), ("outcome",), F.col("method"), F.col("apply_hksj"))
    out = {"profile": profile, "plan": plan, "rejected": rejected(judged), "results": results, "leave_one_out": loo, "flags": anomaly_flags(results)}
    if "subgroups" in rows.columns and "subgroup_variables" in plan.columns:
        out["subgroups"], out["subgroup_tests"] = planned_subgroups(effects, plan)
    return out


#: Confidence below which an evidence span is reviewed.
SPAN_CONFIDENCE = 0.7


def low_confidence_spans(spans: DataFrame, threshold: float = SPAN_CONFIDENCE) -> DataFrame:
    """The spans whose match_confidence, 0 where it is missing, is below the threshold."""
    return spans.filter(F.coalesce("match_confidence", F.lit(0.0)) < threshold)


def field_count(rows: DataFrame) -> DataFrame:
    """rows with n_fields: the fields of arm1 and arm2, names included, that are not null."""
    fields = [F.col(f"{arm}.{f.name}") for arm in ("arm1", "arm2") for f in rows.schema[arm].dataType.fields]
    return rows.withColumn("n_fields", sum((F.when(c.isNotNull(), 1).otherwise(0) for c in fields), F.lit(0)))
