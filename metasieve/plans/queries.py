"""Queries of the review operators over the benchmark tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.functions import effects as fx
from metasieve.functions import text as tx
from metasieve.functions.distributions import critical_values
from metasieve.operators import analysis, bias, cost, harmonize, pooling, quality, screening, writing
from metasieve.plans import responders
from metasieve.plans.bindings import ARMS, arms, plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- effects ---------------------------------------------------------------------------------------------------------

A = f"arms AS ({plain(ARMS)})"
SMD = f"""{A},
s1 AS (SELECT *, n1 + n2 - 2 AS df, sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / nullif(n1 + n2 - 2, 0)) AS sp FROM arms WHERE sd1 IS NOT NULL AND sd2 IS NOT NULL),
s2 AS (SELECT *, (mean1 - mean2) / sp AS d, 1 - 3.0 / (4 * df - 1) AS j FROM s1 WHERE df > 0 AND sp > 0),
eff AS (SELECT outcome, ord, study_id, subgroup, d * j AS effect, d AS cohens_d, j AS correction_factor,
  sqrt((n1 + n2) * 1.0 / (n1 * n2) + d * j * d * j / (2.0 * df)) * j AS se FROM s2)"""


def smd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.apart(arms(spark, sf_dir), "e", fx.hedges_g("n1", "mean1", "sd1", "n2", "mean2", "sd2"))
    return e.select("outcome", "ord", "study_id", "subgroup", F.col("e.g").alias("effect"), F.col("e.se").alias("se"), "e.cohens_d", "e.correction_factor")


def _effect(spark: SparkSession, sf_dir: str, e: Column, *fields: str) -> DataFrame:
    rows = fx.apart(arms(spark, sf_dir), "e", e)
    return rounded(rows.select("outcome", "ord", *(F.col(f"e.{f}").alias(f) for f in fields)), *fields)


def _effect_sql(se: str, body: str, where: str, *fields: tuple[str, str]) -> str:
    cols = ", ".join(f"round({x}, 6) AS \"{n}\"" for n, x in fields)
    return f"WITH {A}, v AS (SELECT *, {body} FROM arms WHERE {where}), w AS (SELECT *, {se} AS s FROM v) SELECT outcome, ord, {cols} FROM w"


@query(f"WITH {SMD} SELECT outcome, ord, round(effect, 6) AS g, round(se, 6) AS se, round(effect - 1.96 * se, 6) AS ci_lower, round(effect + 1.96 * se, 6) AS ci_upper, round(correction_factor, 6) AS correction_factor, round(cohens_d, 6) AS cohens_d FROM eff")
def effect_smd(spark, sf_dir):
    return _effect(spark, sf_dir, fx.hedges_g("n1", "mean1", "sd1", "n2", "mean2", "sd2"), "g", "se", "ci_lower", "ci_upper", "correction_factor", "cohens_d")


@query(_effect_sql("sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2)", "mean1 - mean2 AS e", "sd1 IS NOT NULL AND sd2 IS NOT NULL", ("md", "e"), ("se", "s"), ("ci_lower", "e - 1.96 * s"), ("ci_upper", "e + 1.96 * s")))
def effect_md(spark, sf_dir):
    return _effect(spark, sf_dir, fx.mean_difference("n1", "mean1", "sd1", "n2", "mean2", "sd2"), "md", "se", "ci_lower", "ci_upper")


_RR = ("sqrt(1.0 / events1 - 1.0 / n1 + 1.0 / events2 - 1.0 / n2)", "ln((events1 * 1.0 / n1) / (events2 * 1.0 / n2)) AS e", "events1 > 0 AND events2 > 0 AND n1 > 0 AND n2 > 0")


@query(_effect_sql(*_RR, ("log_rr", "e"), ("se", "s"), ("ci_lower", "e - 1.96 * s"), ("ci_upper", "e + 1.96 * s")))
def effect_logrr(spark, sf_dir):
    return _effect(spark, sf_dir, fx.log_risk_ratio("events1", "n1", "events2", "n2"), "log_rr", "se", "ci_lower", "ci_upper")


@query(_effect_sql(*_RR, ("rr", "exp(e)"), ("ci_lower", "exp(e - 1.96 * s)"), ("ci_upper", "exp(e + 1.96 * s)"), ("log_rr", "e"), ("se_log", "s")))
def effect_rr(spark, sf_dir):
    return _effect(spark, sf_dir, fx.risk_ratio("events1", "n1", "events2", "n2"), "rr", "ci_lower", "ci_upper", "log_rr", "se_log")


@query(_effect_sql("sqrt(1.0 / events1 + 1.0 / (n1 - events1) + 1.0 / events2 + 1.0 / (n2 - events2))", "ln((events1 * 1.0 * (n2 - events2)) / ((n1 - events1) * 1.0 * events2)) AS e", "events1 > 0 AND events2 > 0 AND n1 > events1 AND n2 > events2", ("or", "exp(e)"), ("log_or", "e"), ("se", "s"), ("ci_lower", "exp(e - 1.96 * s)"), ("ci_upper", "exp(e + 1.96 * s)")))
def effect_or(spark, sf_dir):
    return _effect(spark, sf_dir, fx.odds_ratio(F.col("events1"), F.col("n1") - F.col("events1"), F.col("events2"), F.col("n2") - F.col("events2")), "or", "log_or", "se", "ci_lower", "ci_upper")


@query(_effect_sql("sqrt((events1 * 1.0 / n1) * (1 - events1 * 1.0 / n1) / n1 + (events2 * 1.0 / n2) * (1 - events2 * 1.0 / n2) / n2)", "events1 * 1.0 / n1 - events2 * 1.0 / n2 AS e", "n1 > 0 AND n2 > 0", ("rd", "e"), ("se", "s"), ("ci_lower", "e - 1.96 * s"), ("ci_upper", "e + 1.96 * s")))
def effect_rd(spark, sf_dir):
    return _effect(spark, sf_dir, fx.risk_difference("events1", "n1", "events2", "n2"), "rd", "se", "ci_lower", "ci_upper")


@query(f"WITH {A}, v AS (SELECT outcome, ord, n1, CASE WHEN ord % 3 = 0 THEN sd1 END AS sd, CASE WHEN ord % 3 = 1 THEN sd1 / sqrt(n1) END AS se, mean1 - sd1 / 10 AS lo, mean1 + sd1 / 10 AS hi FROM arms) SELECT outcome, ord, round(coalesce(sd, se * sqrt(n1), sqrt(n1) * (hi - lo) / 3.92), 4) AS sd FROM v")
def impute_sd(spark, sf_dir):
    """Arms of which a third have an SD, a third an SE and the rest an interval."""
    v = arms(spark, sf_dir).select("outcome", "ord", "n1", F.expr("CASE WHEN ord % 3 = 0 THEN sd1 END").alias("sd"), F.expr("CASE WHEN ord % 3 = 1 THEN sd1 / sqrt(n1) END").alias("se"), F.expr("mean1 - sd1 / 10").alias("lo"), F.expr("mean1 + sd1 / 10").alias("hi"))
    return v.select("outcome", "ord", F.round(fx.impute_sd("n1", "sd", "se", "lo", "hi"), 4).alias("sd"))


_SESD = "CASE WHEN ord % 2 = 0 THEN 'se' ELSE 'sd' END AS kind, CASE WHEN ord % 4 < 2 THEN sd1 ELSE sd1 / n1 END AS v, mean1 / CASE WHEN ord % 4 = 0 THEN 3 WHEN ord % 4 = 3 THEN 0.5 ELSE 1 END AS m"


@query(f"""WITH {A}, v AS (SELECT outcome, ord, n1, {_SESD} FROM arms WHERE sd1 IS NOT NULL),
c AS (SELECT *, CASE WHEN n1 > 3 AND v > 0 AND m > 0 AND kind = 'se' AND v / m >= 1.5 AND v / sqrt(n1) / m > 0.01 AND v / sqrt(n1) / m < 1.5 THEN 'se_was_sd'
  WHEN n1 > 3 AND v > 0 AND m > 0 AND kind = 'sd' AND v / m < 0.01 AND v * sqrt(n1) / m > 0.01 AND v * sqrt(n1) / m < 1.5 THEN 'sd_was_se' END AS reason FROM v)
SELECT outcome, ord, round(CASE reason WHEN 'se_was_sd' THEN v / sqrt(n1) WHEN 'sd_was_se' THEN v * sqrt(n1) ELSE v END, 4) AS value, reason IS NOT NULL AS was_corrected, round(v, 4) AS original, reason FROM c""")
def se_sd_correction(spark, sf_dir):
    v = arms(spark, sf_dir).filter("sd1 IS NOT NULL").selectExpr("outcome", "ord", "n1", *_SESD.split(", "))
    c = v.withColumn("c", fx.check_se_sd("v", "n1", "kind", "m"))
    return c.select("outcome", "ord", F.round("c.value", 4).alias("value"), "c.was_corrected", F.round("c.original", 4).alias("original"), "c.reason")


@query(f"""WITH {A} SELECT outcome, ord, events1 > n1 - 40 OR events2 > n2 - 40 AS over_total, sign(mean1 - mean2) * sign(events1 * 1.0 / n1 - events2 * 1.0 / n2) < 0 AS direction FROM arms WHERE sd1 IS NOT NULL AND sd2 IS NOT NULL""")
def cross_check(spark, sf_dir):
    """Totals lowered by 40, and directions compared between the two kinds of outcome."""
    a = lambda k: {"n": F.col(f"n{k}"), "mean": F.col(f"mean{k}"), "sd": F.col(f"sd{k}"), "events": F.col(f"events{k}"), "total": F.col(f"n{k}") - 40}
    failed = fx.cross_checks(a(1), a(2), F.col("mean1") - F.col("mean2"), F.col("events1") / F.col("n1") - F.col("events2") / F.col("n2"))
    rows = arms(spark, sf_dir).filter("sd1 IS NOT NULL AND sd2 IS NOT NULL").withColumn("f", failed)
    return rows.select("outcome", "ord", F.array_contains("f", "events_exceed_total").alias("over_total"), F.array_contains("f", "direction").alias("direction"))


# ---- pooling ---------------------------------------------------------------------------------------------------------

TCRIT = "tcrit(df, t) AS (VALUES " + ", ".join(f"({k}, {t}::DOUBLE)" for k, t in enumerate(critical_values(), 1)) + ")"


def pool_sql(source: str, *keys: str, hksj: bool = True) -> str:
    """CTEs that pool source by keys into `pooled`; TCRIT comes before."""
    k = ", ".join(keys)
    limit = "CASE WHEN k > 1 THEN t ELSE 1.96 END" if hksj else "1.96"
    se = "CASE WHEN k > 1 THEN se0 * sqrt(r / (k - 1)) ELSE se0 END" if hksj else "se0"
    return f"""
p0 AS (SELECT {k}, count(*) AS k, sum(1 / (se * se)) AS sw, sum(effect / (se * se)) / sum(1 / (se * se)) AS mu, sum(1 / (se * se * se * se)) AS sw2 FROM {source} GROUP BY {k}),
p1 AS (SELECT {k}, p0.k, p0.sw, p0.sw2, p0.mu, sum((effect - mu) * (effect - mu) / (se * se)) AS q FROM {source} JOIN p0 USING ({k}) GROUP BY {k}, p0.k, p0.sw, p0.sw2, p0.mu),
p2 AS (SELECT *, CASE WHEN k > 1 THEN greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) ELSE 0 END AS tau2 FROM p1),
p3 AS (SELECT {k}, sum(1 / (se * se + tau2)) AS swr, sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS m FROM {source} JOIN p2 USING ({k}) GROUP BY {k}),
p4 AS (SELECT {k}, p2.k AS k, p2.q AS q, p2.tau2 AS tau2, p3.swr AS swr, p3.m AS m, sum((effect - m) * (effect - m) / (se * se + tau2)) AS r FROM {source} JOIN p2 USING ({k}) JOIN p3 USING ({k}) GROUP BY {k}, p2.k, p2.q, p2.tau2, p3.swr, p3.m),
p5 AS (SELECT p4.*, sqrt(1 / swr) AS se0, t, CASE WHEN q > 0 THEN greatest(0, (q - greatest(k - 1, 1)) / q * 100) ELSE 0 END AS i2 FROM p4 LEFT JOIN tcrit ON df = k - 1),
pooled AS (SELECT {k}, k, q, tau2, i2, se0, m AS pooled_effect, {se} AS pooled_se, m - {limit} * {se} AS ci_lower, m + {limit} * {se} AS ci_upper FROM p5)"""


POOLED_FIELDS = ("pooled_effect", "pooled_se", "ci_lower", "ci_upper", "tau2", "i2", "q")
_POOLED = ", ".join(f"round({c}, 6) AS {c}" for c in POOLED_FIELDS)


@query(f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome')} SELECT outcome, k, {_POOLED} FROM pooled")
def meta_dl_hksj(spark, sf_dir):
    return rounded(pooling.random_effects(smd(spark, sf_dir), method="DL").select("outcome", "k", *POOLED_FIELDS), *POOLED_FIELDS)


@query(f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome', hksj=False)} SELECT outcome, k, {_POOLED} FROM pooled")
def meta_dl_z(spark, sf_dir):
    return rounded(pooling.random_effects(smd(spark, sf_dir), method="DL", hksj=False).select("outcome", "k", *POOLED_FIELDS), *POOLED_FIELDS)


@query()
def meta_reml(spark, sf_dir):
    return pooling.random_effects(smd(spark, sf_dir))


@query(f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome')}, w AS (SELECT outcome, ord, (1 / (se * se + tau2)) / sum(1 / (se * se + tau2)) OVER (PARTITION BY outcome) AS w FROM eff JOIN pooled USING (outcome)) SELECT outcome, ord, round(w.w, 6) AS weight FROM (SELECT outcome, ord, w, eff.se FROM w JOIN eff USING (outcome, ord)) w".replace("(1 / (se * se + tau2)) / sum(1 / (se * se + tau2))", "(1 / (eff.se * eff.se + tau2)) / sum(1 / (eff.se * eff.se + tau2))"))
def meta_weights(spark, sf_dir):
    e = smd(spark, sf_dir)
    w = pooling.random_effects(e, method="DL").select("outcome", F.posexplode("weights").alias("_i", "weight"))
    ords = e.groupBy("outcome").agg(F.sort_array(F.collect_list("ord")).alias("o")).select("outcome", F.posexplode("o").alias("_i", "ord"))
    return rounded(w.join(ords, ["outcome", "_i"]).select("outcome", "ord", "weight"), "weight")


@query(f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome')} SELECT outcome, k, round(q, 6) AS q, k - 1 AS df, round(i2, 6) AS i2 FROM pooled")
def cochran_q(spark, sf_dir):
    return rounded(pooling.cochran_q(smd(spark, sf_dir), ["outcome"]).select("outcome", "k", "q", "df", "i2"), "q", "i2")


@query(f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome')} SELECT outcome, round(i2, 6) AS i2 FROM pooled")
def i_squared(spark, sf_dir):
    fe = pooling.fixed_effect(smd(spark, sf_dir), ["outcome"])
    return fe.select("outcome", F.round(pooling.i_squared(F.col("q"), F.col("k") - 1), 6).alias("i2"))


@query(f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome')} SELECT outcome, k, round(tau2, 8) AS tau2 FROM pooled")
def dl_tau2(spark, sf_dir):
    return pooling.fixed_effect(smd(spark, sf_dir), ["outcome"]).select("outcome", "k", F.round("tau2_dl", 8).alias("tau2"))


@query(f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome')} SELECT outcome, round(pooled_effect - c.t * sqrt(tau2 + se0 * se0), 6) AS pi_lower, round(pooled_effect + c.t * sqrt(tau2 + se0 * se0), 6) AS pi_upper FROM pooled JOIN tcrit c ON c.df = k - 2")
def prediction_interval(spark, sf_dir):
    return rounded(pooling.random_effects(smd(spark, sf_dir), method="DL").filter("k >= 3").select("outcome", "pi_lower", "pi_upper"), "pi_lower", "pi_upper")


_SUB = f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome', 'subgroup')}"


@query(f"{_SUB} SELECT outcome, subgroup, k, {_POOLED} FROM pooled")
def subgroup_effects(spark, sf_dir):
    pooled, _ = pooling.subgroup_effects(smd(spark, sf_dir), method="DL")
    return rounded(pooled.select("outcome", "subgroup", "k", *POOLED_FIELDS), *POOLED_FIELDS)


@query(f"{_SUB}, b AS (SELECT outcome, count(*) AS n_subgroups, sum(pooled_effect / (pooled_se * pooled_se)) / sum(1 / (pooled_se * pooled_se)) AS mb FROM pooled GROUP BY outcome) SELECT outcome, n_subgroups, round(sum((pooled_effect - mb) * (pooled_effect - mb) / (pooled_se * pooled_se)), 5) AS q_between, n_subgroups - 1 AS df FROM pooled JOIN b USING (outcome) GROUP BY outcome, n_subgroups")
def subgroup_q_between(spark, sf_dir):
    _, between = pooling.subgroup_effects(smd(spark, sf_dir), method="DL")
    return between.select("outcome", "n_subgroups", F.round("q_between", 5).alias("q_between"), "df")


@query(f"WITH {SMD}, rest AS (SELECT e.outcome, o.ord AS omitted_index, o.study_id AS omitted, e.effect, e.se FROM eff e JOIN eff o ON e.outcome = o.outcome AND e.ord <> o.ord), {TCRIT}, {pool_sql('rest', 'outcome', 'omitted_index', 'omitted')} SELECT outcome, omitted_index, omitted, round(pooled_effect, 6) AS pooled_effect, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, round(i2, 6) AS i2, round(tau2, 6) AS tau2 FROM pooled")
def leave_one_out(spark, sf_dir):
    return rounded(pooling.leave_one_out(smd(spark, sf_dir), method="DL"), "pooled_effect", "ci_lower", "ci_upper", "i2", "tau2")


@query(f"WITH {SMD}, rest AS (SELECT e.outcome, o.ord AS added_index, o.study_id AS added, e.effect, e.se FROM eff e JOIN eff o ON e.outcome = o.outcome AND e.ord <= o.ord), {TCRIT}, {pool_sql('rest', 'outcome', 'added_index', 'added')} SELECT outcome, added_index, added, k, round(pooled_effect, 6) AS pooled_effect, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, round(i2, 6) AS i2 FROM pooled")
def cumulative(spark, sf_dir):
    return rounded(pooling.cumulative(smd(spark, sf_dir), method="DL"), "pooled_effect", "ci_lower", "ci_upper", "i2")


# ---- bias, profile, plan, flags --------------------------------------------------------------------------------------

_EGGER = f"WITH {SMD}, r AS (SELECT outcome, count(*) AS k, regr_intercept(effect / se, 1 / se) AS b0, regr_slope(effect / se, 1 / se) AS b1, regr_sxx(effect / se, 1 / se) AS sxx, regr_syy(effect / se, 1 / se) AS syy, regr_r2(effect / se, 1 / se) AS r2 FROM eff GROUP BY outcome), e AS (SELECT *, sqrt((1 - r2) * syy / sxx / (k - 2)) AS s FROM r WHERE k >= 3)"


@query(f"{_EGGER} SELECT outcome, k, round(b0, 5) AS intercept, round(b1, 5) AS slope, round(s, 5) AS se, round(b0 / s, 4) AS t FROM e")
def egger(spark, sf_dir):
    e = bias.egger(smd(spark, sf_dir))
    return e.select("outcome", "k", F.round("intercept", 5).alias("intercept"), F.round("slope", 5).alias("slope"), F.round("se", 5).alias("se"), F.round("t", 4).alias("t"))


@query()
def egger_p(spark, sf_dir):
    return bias.egger(smd(spark, sf_dir))


@query()
def trim_fill(spark, sf_dir):
    return bias.trim_and_fill(smd(spark, sf_dir))


def extraction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms as extracted rows: every third outcome, by its first digit, is binary only."""
    a = arms(spark, sf_dir).withColumn("binary", F.expr("CAST(substring(outcome, 1, 1) AS INT) % 3 = 0"))
    arm = lambda k: F.struct(F.lit(k).cast("string").alias("name"), F.col(f"n{k}").alias("n"), F.when(~F.col("binary"), F.col(f"mean{k}")).alias("mean"), F.when(~F.col("binary") & (F.col("ord") % 4 != 0), F.col(f"sd{k}")).alias("sd"), F.when(~F.col("binary"), F.col(f"sd{k}") / F.sqrt(f"n{k}")).alias("se"), F.lit(None).cast("double").alias("ci_lower"), F.lit(None).cast("double").alias("ci_upper"), F.when(F.col("binary"), F.col(f"events{k}")).alias("events"), F.when(F.col("binary"), F.col(f"n{k}")).alias("total"))
    return a.select("outcome", "ord", "study_id", arm(1).alias("arm1"), arm(2).alias("arm2"), F.create_map(F.lit("subgroup_region"), F.col("subgroup")).alias("subgroups"))


_PROFILE = f"WITH {A}, p AS (SELECT outcome, count(*) AS k, bool_or(CAST(substring(outcome, 1, 1) AS INT) % 3 = 0 AND events1 IS NOT NULL) AS has_binary, bool_or(CAST(substring(outcome, 1, 1) AS INT) % 3 <> 0 AND ord % 4 <> 0 AND sd1 IS NOT NULL) AS has_continuous, count(DISTINCT study_id) AS n_studies FROM arms GROUP BY outcome)"


@query(f"{_PROFILE} SELECT outcome, k, has_binary, has_continuous, n_studies FROM p")
def data_profile(spark, sf_dir):
    p = analysis.data_profile(extraction_rows(spark, sf_dir))
    return p.select("outcome", "k", "has_binary", "has_continuous", F.size(F.array_distinct("study_ids")).cast("long").alias("n_studies"))


@query(f"{_PROFILE} SELECT outcome, k, CASE WHEN has_continuous THEN 'SMD' ELSE 'logOR' END AS effect_type, CASE WHEN k >= 3 THEN 'REML' ELSE 'DL' END AS method, true AS apply_hksj, 'subgroup_region' AS subgroup_variables, k >= 3 AS run_loo, k >= 10 AS run_egger, k >= 10 AS run_trim_and_fill FROM p")
def default_plan(spark, sf_dir):
    plan = analysis.default_plan(analysis.data_profile(extraction_rows(spark, sf_dir)))
    return plan.withColumn("subgroup_variables", F.array_join("subgroup_variables", ","))


@query("SELECT event_id FROM events WHERE event_id % 10 = 0 OR value < 70")
def low_confidence_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 10 <> 0 THEN value / 100 END AS match_confidence")
    return analysis.low_confidence_spans(spans).select("event_id")


@query(f"""WITH {A} SELECT outcome, ord, (CASE WHEN CAST(substring(outcome, 1, 1) AS INT) % 3 = 0 THEN 2 + (n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (events1 IS NOT NULL)::INT + (events2 IS NOT NULL)::INT + (n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT
ELSE 2 + (n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (mean1 IS NOT NULL)::INT + (mean2 IS NOT NULL)::INT + (sd1 IS NOT NULL)::INT + (sd2 IS NOT NULL)::INT + CASE WHEN ord % 4 <> 0 THEN (sd1 IS NOT NULL)::INT + (sd2 IS NOT NULL)::INT ELSE 0 END END)::INT AS n_fields FROM arms""")
def field_count(spark, sf_dir):
    return analysis.field_count(extraction_rows(spark, sf_dir)).select("outcome", "ord", "n_fields")


@query("SELECT event_id::VARCHAR AS key, event_id % 7 <> 0 AND event_id % 5 = 0 AS fallback_used, CASE WHEN event_id % 7 = 0 AND event_id % 5 = 0 THEN 'all models failed' END AS error, CASE WHEN event_id % 5 <> 0 THEN round(event_id % 10 * 100 * 0.003 / 1000 * 10, 6) WHEN event_id % 7 <> 0 THEN 0.015 END AS cost FROM events")
def routed_responses(spark, sf_dir):
    """Primary answers fail for every fifth key, fallback answers for every seventh."""
    e = table(spark, sf_dir, "events")
    asked = responders.prompts(e, "event_id", "smart", "system", "props")
    first = e.selectExpr("CAST(event_id AS STRING) AS key", "props AS response", "event_id % 10 * 1000 AS input_tokens", "0 AS output_tokens", "event_id % 5 = 0 AS failed")
    second = e.selectExpr("CAST(event_id AS STRING) AS key", "props AS response", "0 AS input_tokens", "1000 AS output_tokens", "event_id % 7 = 0 AS failed")
    return responders.routed(asked, first, second).select("key", "fallback_used", "error", "cost")


@query()
def analyze_results(spark, sf_dir):
    return analysis.analyze(extraction_rows(spark, sf_dir))["results"].drop("weights", "method_log")


_FLAG_SOURCE = f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome', 'subgroup')}, f AS (SELECT p.outcome || '/' || p.subgroup AS outcome, p.k, p.i2, p.ci_lower, p.ci_upper, p.pooled_effect - c.t * sqrt(tau2 + se0 * se0) AS pi_lower, p.pooled_effect + c.t * sqrt(tau2 + se0 * se0) AS pi_upper, w.w, p.pooled_effect < -0.05 AS taf_flip, p.pooled_effect > 0.05 AS egger_sig FROM pooled p LEFT JOIN tcrit c ON c.df = p.k - 2 JOIN (SELECT outcome, subgroup, max(x) AS w FROM (SELECT eff.outcome, eff.subgroup, (1 / (eff.se * eff.se + tau2)) / sum(1 / (eff.se * eff.se + tau2)) OVER (PARTITION BY eff.outcome, eff.subgroup) AS x FROM eff JOIN pooled q ON eff.outcome = q.outcome AND eff.subgroup = q.subgroup) GROUP BY outcome, subgroup) w ON w.outcome = p.outcome AND w.subgroup = p.subgroup)"


def flag_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.random_effects(smd(spark, sf_dir), ("outcome", "subgroup"), "DL")
    return pooled.withColumn("outcome", F.concat_ws("/", "outcome", "subgroup")).withColumns({"taf_flip": F.col("pooled_effect") < -0.05, "egger_sig": F.col("pooled_effect") > 0.05, "has_loo": F.lit(False)})


@query(f"""{_FLAG_SOURCE}
SELECT outcome, 0 AS position, 'high_heterogeneity' AS type, 'warning' AS severity FROM f WHERE i2 > 90
UNION ALL SELECT outcome, 1, 'weight_dominance', 'warning' FROM f WHERE w > 0.4
UNION ALL SELECT outcome, 2, 'underpowered', 'info' FROM f WHERE k < 3
UNION ALL SELECT outcome, 3, 'trim_fill_direction_flip', 'critical' FROM f WHERE taf_flip
UNION ALL SELECT outcome, 4, 'publication_bias_detected', 'warning' FROM f WHERE egger_sig
UNION ALL SELECT outcome, 5, 'prediction_interval_warning', 'info' FROM f WHERE (ci_lower > 0 OR ci_upper < 0) AND pi_lower <= 0 AND pi_upper >= 0""")
def anomaly_flags(spark, sf_dir):
    return quality.anomaly_flags(flag_source(spark, sf_dir)).select("outcome", "position", "type", "severity")


_ROB = "CASE (s_suppkey * {m}) % {d} WHEN 0 THEN 'high' WHEN 1 THEN 'some_concerns' WHEN 2 THEN {odd} ELSE 'low' END"
_ROB_COLUMNS = [(d, _ROB.format(m=m, d=7 + k, odd="'medium'" if k == 4 else "'low'")) for k, (d, m) in enumerate(zip(quality.ROB_DOMAINS, (3, 5, 7, 11, 13), strict=True))]


def rob_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", *(f"{e} AS {d}" for d, e in _ROB_COLUMNS))


_ROB_SQL = f"WITH v AS (SELECT s_suppkey, {', '.join(f'{e} AS {d}' for d, e in _ROB_COLUMNS)} FROM supplier), a AS (SELECT *, selection_of_reported_result = 'medium' AS bad, {' + '.join(f'({d} = {chr(39)}high{chr(39)})::INT' for d in quality.ROB_DOMAINS)} AS h, {' + '.join(f'({d} = {chr(39)}some_concerns{chr(39)})::INT' for d in quality.ROB_DOMAINS)} AS s, {' + '.join(f'({d} = {chr(39)}low{chr(39)})::INT' for d in quality.ROB_DOMAINS)} AS l FROM v)"


@query(f"{_ROB_SQL} SELECT s_suppkey, CASE WHEN bad THEN NULL WHEN h > 0 THEN 'high' WHEN s > 0 THEN 'some_concerns' ELSE 'low' END AS overall, CASE WHEN NOT bad THEN h END AS n_high, CASE WHEN NOT bad THEN s END AS n_some_concerns, CASE WHEN NOT bad THEN l END AS n_low, bad AS invalid FROM a")
def rob2_overall(spark, sf_dir):
    return quality.assess_rob(rob_votes(spark, sf_dir)).select("s_suppkey", "overall", "n_high", "n_some_concerns", "n_low", F.col("error").isNotNull().alias("invalid"))


@query(f"""{_ROB_SQL}, g AS (SELECT *, CASE WHEN h > 0 THEN 'high' WHEN s > 0 THEN 'some_concerns' ELSE 'low' END AS overall FROM a WHERE NOT bad),
e AS ({' UNION ALL '.join(f"SELECT '{d}' AS domain, {d} AS level FROM g" for d in ("overall", *quality.ROB_DOMAINS))}), lv(level) AS (VALUES ('low'), ('some_concerns'), ('high'))
SELECT d.domain, lv.level, count(e.level) AS n, round(count(e.level) * 1.0 / (SELECT count(*) FROM g), 6) AS proportion FROM (SELECT DISTINCT domain FROM e) d CROSS JOIN lv LEFT JOIN e ON e.domain = d.domain AND e.level = lv.level GROUP BY d.domain, lv.level""")
def rob2_summary(spark, sf_dir):
    return rounded(quality.summarize_rob(quality.assess_rob(rob_votes(spark, sf_dir))), "proportion")


_GRADE_SQL = f"""{_FLAG_SOURCE}, j AS (SELECT outcome, CASE WHEN i2 >= 75 THEN 2 WHEN i2 >= 50 THEN 1 ELSE 0 END AS inc, CASE WHEN ci_lower <= 0 AND ci_upper >= 0 THEN CASE WHEN k < 3 THEN 2 ELSE 1 END ELSE 0 END AS imp, CASE WHEN taf_flip THEN 2 WHEN egger_sig THEN 1 ELSE 0 END AS pub FROM f)
SELECT outcome, 4 AS starting_certainty, 1 + inc + imp + pub AS total_downgrade, greatest(1, 4 - (1 + inc + imp + pub)) AS certainty, CASE greatest(1, 4 - (1 + inc + imp + pub)) WHEN 4 THEN 'high' WHEN 3 THEN 'moderate' WHEN 2 THEN 'low' ELSE 'very_low' END AS grade FROM j"""


@query(_GRADE_SQL)
def grade(spark, sf_dir):
    """With 30 % of the studies at a high risk of bias."""
    judged = quality.grade_inputs(flag_source(spark, sf_dir), 0.3)
    return quality.assess_grade(judged.drop("error")).select("outcome", "starting_certainty", "total_downgrade", "certainty", "grade")


# ---- screening -------------------------------------------------------------------------------------------------------


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study_id"), F.col("doc_id").alias("ord"), F.col("text").alias("title"), F.col("source").alias("abstract"))


@query("WITH k AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS key FROM documents), f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key) SELECT doc_id AS study_id FROM k JOIN f USING (key) WHERE key = '' OR doc_id = first")
def dedup_title(spark, sf_dir):
    return screening.dedup_by_title(studies(spark, sf_dir)).select("study_id")


@query("WITH t AS (SELECT doc_id AS study_id, lower(coalesce(text, '') || ' ' || coalesce(source, '')) AS x FROM documents), r AS (SELECT study_id, CASE WHEN contains(x, 'idiot') OR contains(x, 'src7') THEN 'exclusion_keyword_match' WHEN NOT (contains(x, 'the') OR contains(x, 'que')) THEN 'no_required_keyword' END AS reason FROM t) SELECT study_id, reason, CASE WHEN reason IS NULL THEN 'passed' ELSE 'excluded' END AS status FROM r")
def prescreen(spark, sf_dir):
    return screening.prescreen(studies(spark, sf_dir), ["Idiot", "SRC7", ""], ["the", "que"]).select("study_id", "reason", "status")


def votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Votes and arbitrations made from the labels, with confidences by arithmetic and some unknown decisions."""
    lab = table(spark, sf_dir, "labels")
    v1 = lab.selectExpr("doc_id AS study_id", "'screener1' AS screener_id", "CASE WHEN doc_id % 17 = 0 THEN ' Maybe' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'INCLUDE ' ELSE 'exclude' END AS decision", "(doc_id * 37) % 121 AS confidence")
    v2 = lab.selectExpr("doc_id AS study_id", "'screener2' AS screener_id", "CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN 'include' ELSE 'exclude' END AS decision", "(doc_id * 53) % 101 AS confidence")
    arb = lab.filter("doc_id % 4 <> 0").selectExpr("doc_id AS study_id", "CASE doc_id % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' ELSE 'unsure' END AS decision", "(doc_id * 29) % 101 AS confidence")
    return v1.unionByName(v2), arb


_VOTES_SQL = """WITH v AS (SELECT doc_id AS study_id,
  CASE WHEN doc_id % 17 = 0 THEN 'include' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'include' ELSE 'exclude' END AS d1,
  CASE WHEN doc_id % 17 = 0 THEN greatest(0, least(100, (doc_id * 37) % 121 - 20)) ELSE least(100, (doc_id * 37) % 121) END AS c1,
  CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN 'include' ELSE 'exclude' END AS d2, (doc_id * 53) % 101 AS c2,
  CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 3 = 2 OR (doc_id * 29) % 101 < 60 THEN 'human_review' WHEN doc_id % 3 = 0 THEN 'include' ELSE 'exclude' END END AS da,
  CASE WHEN doc_id % 3 = 2 AND (doc_id * 29) % 101 >= 60 THEN 0 ELSE (doc_id * 29) % 101 END AS ca FROM labels),
n AS (SELECT *, NOT (d1 = 'include' OR d2 = 'include' OR (c1 >= 80 AND c2 >= 80)) AS needed FROM v),
s AS (SELECT study_id, d1, c1, d2, c2, needed,
  CASE WHEN d1 = 'include' OR d2 = 'include' THEN 'include' WHEN NOT needed THEN 'exclude' ELSE coalesce(da, 'human_review') END AS final_decision,
  CASE WHEN d1 = 'include' AND d2 = 'include' THEN 'dual_include' WHEN d1 = 'include' OR d2 = 'include' THEN 'union_include' WHEN NOT needed THEN 'dual_exclude_high_confidence' WHEN da IS NULL THEN 'arbiter_missing' ELSE 'arbiter' END AS method,
  CASE WHEN d1 = 'include' AND d2 = 'include' THEN greatest(c1, c2) WHEN d1 = 'include' THEN c1 WHEN d2 = 'include' THEN c2 WHEN NOT needed THEN least(c1, c2) WHEN da IS NULL THEN 0 ELSE ca END AS confidence FROM n)
"""


_RAW_VOTE = "CASE o_orderkey % 6 WHEN 0 THEN concat('include', {n}) WHEN 1 THEN ' EXCLUDE ' WHEN 2 THEN 'maybe' WHEN 3 THEN concat({t}, 'human_review') WHEN 4 THEN '' END AS d, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 130 WHEN 2 THEN -5 WHEN 3 THEN 30 WHEN 4 THEN 59 ELSE 60 + o_orderkey % 41 END AS c"


@query(f"""WITH v AS (SELECT o_orderkey, {_RAW_VOTE.format(n="chr(10)", t="chr(9)")} FROM orders),
w AS (SELECT *, coalesce(regexp_replace(regexp_replace(lower(d), '^\\s+', ''), '\\s+$', ''), '') AS x, greatest(0, least(100, coalesce(c, 50))) AS k FROM v)
SELECT o_orderkey, CASE WHEN x IN ('include', 'exclude') THEN x ELSE 'include' END AS vote, CASE WHEN x IN ('include', 'exclude') THEN k ELSE greatest(0, least(100, coalesce(c, 0) - 20)) END AS vote_confidence,
  CASE WHEN k < 60 OR x NOT IN ('include', 'exclude', 'human_review') THEN 'human_review' ELSE x END AS arbiter, CASE WHEN k < 60 OR x IN ('include', 'exclude', 'human_review') THEN k ELSE 0 END AS arbiter_confidence,
  CASE WHEN x IN ('include', 'exclude') THEN x ELSE 'include' END AS fulltext, CASE WHEN x IN ('include', 'exclude') THEN k ELSE 0 END AS fulltext_confidence FROM w""")
def vote_validation(spark, sf_dir):
    """Unknown, empty and missing decisions with outer white space, and confidences that are missing or out of bounds."""
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_RAW_VOTE.format(n="'\n'", t="'\t'").replace("AS d, ", "AS d|").split("|"))
    d, c = F.col("d"), F.col("c")
    kinds = (("vote", screening.valid_vote), ("arbiter", screening.valid_arbitration), ("fulltext", screening.valid_fulltext))
    return v.select("o_orderkey", *(x for n, f in kinds for x in (f(d, c)["decision"].alias(n), f(d, c)["confidence"].alias(f"{n}_confidence"))))


@query(f"{_VOTES_SQL} SELECT study_id, needed FROM s")
def needs_arbiter(spark, sf_dir):
    return screening.screen(*votes(spark, sf_dir)).select("study_id", "needed")


@query(f"{_VOTES_SQL} SELECT * FROM s")
def resolve_screening(spark, sf_dir):
    return screening.screen(*votes(spark, sf_dir))


@query(f"{_VOTES_SQL} SELECT study_id FROM s WHERE final_decision = 'include' AND study_id IN (SELECT doc_id FROM documents)")
def included_studies(spark, sf_dir):
    return screening.included(studies(spark, sf_dir), screening.screen(*votes(spark, sf_dir))).select("study_id")


@query("SELECT d.doc_id AS study_id, CASE WHEN d.doc_id % 6 = 0 OR l.doc_id IS NULL THEN 'include' WHEN d.doc_id % 11 = 0 THEN 'include' WHEN quality = 1 THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN d.doc_id % 6 = 0 OR l.doc_id IS NULL OR d.doc_id % 11 = 0 THEN 0 ELSE 90 END AS confidence, CASE WHEN d.doc_id % 6 = 0 THEN 'no full text available' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def fulltext_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study_id"), F.expr("CASE WHEN doc_id % 6 <> 0 THEN text END").alias("content"))
    v = table(spark, sf_dir, "labels").selectExpr("doc_id AS study_id", "CASE WHEN doc_id % 11 = 0 THEN 'unsure' WHEN quality = 1 THEN 'include' ELSE 'exclude' END AS decision", "90 AS confidence")
    return screening.screen_fulltext(docs, v).select("study_id", "decision", "confidence", "reason")


@query(f"""{_VOTES_SQL}, r AS (SELECT count(*) AS raw, count(DISTINCT lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''))) AS dd FROM documents),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE final_decision = 'exclude') AS ex, count(*) FILTER (WHERE final_decision = 'human_review') AS hr, count(*) FILTER (WHERE final_decision = 'include') AS inc FROM s)
SELECT raw AS identified, raw - dd AS duplicates_removed, dd AS after_dedup, dd - n AS prescreen_excluded, n AS after_prescreen, n AS screened, ex AS screen_excluded, hr AS human_review, n - ex AS sought, hr AS not_retrieved, inc AS fulltext_assessed, 0 AS fulltext_excluded, inc AS included FROM r, c""")
def prisma_counts(spark, sf_dir):
    st = studies(spark, sf_dir)
    a = st.agg(F.count(F.lit(1)).alias("raw")).withColumn("one", F.lit(1))
    b = screening.dedup_by_title(st).agg(F.count(F.lit(1)).alias("dd")).withColumn("one", F.lit(1))
    c = screening.screen(*votes(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("final_decision") == d).alias(d) for d in ("exclude", "human_review", "include"))).withColumn("one", F.lit(1))
    row = a.join(b, "one").join(c, "one")
    col = F.col
    return row.select(F.inline(F.array(screening.prisma_counts(col("raw"), col("dd"), col("dd") - col("n"), col("n"), col("exclude"), col("human_review"), col("include"), F.lit(0).cast("long"), col("include"), col("human_review")))))


@query("SELECT p_partkey, (CASE WHEN length(p_name) - length(replace(p_name, ' ', '')) > 0 THEN 20 ELSE 10 END) + (CASE WHEN p_type LIKE '% %' THEN 20 ELSE 10 END) + (CASE WHEN p_size % 2 = 0 THEN 15 ELSE 0 END) + (CASE WHEN p_size % 3 = 0 THEN 15 ELSE 0 END) + (CASE WHEN p_size % 5 = 0 THEN 15 ELSE 0 END) + 10 + (CASE WHEN p_size % 7 = 0 THEN 5 ELSE 0 END) AS score FROM part")
def pico_score(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS population", "p_type AS intervention", "CASE WHEN p_size % 2 = 0 THEN 'c' END AS comparator", "CASE WHEN p_size % 3 = 0 THEN array('o') ELSE array('') END AS outcome", "CASE WHEN p_size % 5 = 0 THEN array('x') END AS inclusion_criteria", "CAST(NULL AS ARRAY<STRING>) AS exclusion_criteria", "'rct' AS study_design", "'' AS timing", "CASE WHEN p_size % 7 = 0 THEN 'year' END AS follow_up")
    return screening.pico_score(p).select("p_partkey", "score")


# ---- text ------------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]{{3,}}')), lambda w: w NOT IN ({_STOP}))), ' ') AS keywords FROM documents")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.keywords(F.col("text")), " ").alias("keywords"))


@query(f"""WITH p AS (SELECT list_filter(list_distinct(regexp_extract_all(lower('Adults with thonre inthere of edthon ' || 'wasoner anthe'), '[a-zA-Z]{{3,}}')), lambda w: w NOT IN ({_STOP})) AS p),
k AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]{{3,}}')), lambda w: w NOT IN ({_STOP})) AS t FROM documents)
SELECT doc_id, round(len(list_intersect(t, p)) * 1.0 / len(t), 6) AS overlap_ratio FROM k, p WHERE len(t) > 3 AND len(list_intersect(t, p)) * 1.0 / len(t) < 0.1""")
def pico_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("d", tx.pico_drift(F.col("text"), F.lit("Adults with thonre inthere of edthon wasoner anthe"))).filter("d IS NOT NULL")
    return rounded(d.select("doc_id", "d.overlap_ratio"), "overlap_ratio")


#: A text cut in three, with the headings of an article between the parts.
_THIRD = "CAST(floor(length(coalesce(text, '')) / 3.0) AS INT)"
_WRAP = f"concat('Intro\\nMethods\\n', substring(coalesce(text, ''), 1, {_THIRD}), '\\nResults: ', substring(coalesce(text, ''), {_THIRD} + 1, {_THIRD}), '\\nDiscussion\\n', substring(coalesce(text, ''), 2 * {_THIRD} + 1, length(coalesce(text, ''))))"


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(x, '(?is)(methods?\\b.*?)\\n\\s*(?:results?|discussion|references)\\b', 1), '\\s+$', ''), '^\\s+', '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_extract(x, '(?is)(results?\\b.*?)\\n\\s*(?:discussion|conclusion|references)\\b', 1), '\\s+$', ''), '^\\s+', '') AS sections FROM (SELECT doc_id, " + _WRAP.replace("\\n", "' || chr(10) || '") + " AS x FROM documents)")
def priority_sections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.priority_sections(F.expr(_WRAP)).alias("sections"))


@query("""WITH t AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS x FROM documents), c AS (SELECT doc_id, x, x[:700] AS cut FROM t),
p AS (SELECT *, CASE WHEN contains(cut, chr(10) || chr(10)) THEN 700 - strpos(reverse(cut), chr(10) || chr(10)) - 1 ELSE -1 END AS para, greatest(CASE WHEN contains(cut, '.' || chr(10)) THEN 700 - strpos(reverse(cut), chr(10) || '.') - 1 ELSE -1 END, CASE WHEN contains(cut, '! ') THEN 700 - strpos(reverse(cut), ' !') - 1 ELSE -1 END) AS sent FROM c)
SELECT doc_id, CASE WHEN length(x) <= 700 THEN x WHEN para > 350 THEN regexp_replace(x[:para], '\\s+$', '') || chr(10) || chr(10) || '[... truncated at paragraph boundary]' WHEN sent > 350 THEN regexp_replace(x[:sent + 1], '\\s+$', '') || chr(10) || chr(10) || '[... truncated at sentence boundary]' ELSE regexp_replace(cut, '\\s+$', '') || chr(10) || chr(10) || '[... truncated]' END AS text FROM p""")
def truncate_paragraph(spark, sf_dir):
    x = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_at_paragraph(x, 700).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN text || chr(10) || 'Reference 1' WHEN length(text) + 1 >= ceil(0.6 * (length(text) + 17)) THEN regexp_replace(text, '\\s+$', '') ELSE text || chr(10) || chr(10) || 'References' || chr(10) || '1. A' END AS text FROM documents")
def strip_references(spark, sf_dir):
    x = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat(text, '\\n\\nReferences\\n1. A') ELSE concat(text, '\\nReference 1') END")
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_references(x).alias("text"))


@query("SELECT doc_id, greatest(1, length(text) // 3500)::INT AS pages, greatest(2048, least(32768, 2048 + 80 * greatest(1, length(text) // 3500)))::INT AS skeleton, greatest(2048, least(32768, 1024 + 600 * (doc_id % 60)))::INT AS extraction FROM documents")
def token_budget(spark, sf_dir):
    pages = tx.estimate_pages(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages"), tx.token_budget("skeleton", pages).alias("skeleton"), tx.token_budget("extraction", F.col("doc_id") % 60).alias("extraction"))


@query("SELECT doc_id, CASE WHEN length(text) // 3 <= 100 OR length(text) <= 300 THEN text ELSE text[:150] || chr(10) || chr(10) || '[... compressed ...]' || chr(10) || chr(10) || right(text, 150) END AS text FROM documents")
def compress_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.compress_context(F.col("text"), 100).alias("text"))


@query("SELECT p_brand, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || CASE WHEN p_size % 4 = 0 THEN '' ELSE p_size::VARCHAR END || ' |', chr(10) ORDER BY p_partkey) AS md FROM part GROUP BY p_brand")
def markdown_table(spark, sf_dir):
    row = F.when(F.col("p_size") % 4 == 0, F.array("p_name")).otherwise(F.array("p_name", F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("rs"))
    return rows.select("p_brand", tx.table_to_markdown(F.concat(F.array(F.array(F.lit("name"), F.lit("size"))), F.transform("rs", lambda x: x["r"]))).alias("md"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS abstract FROM documents")
def inverted_abstract(spark, sf_dir):
    """Every text turned into an inverted index and back."""
    # white space as the SQL has it, without the vertical tab; a text that is missing stays so
    words = F.filter(F.split(F.regexp_replace("text", r"[\t\n\f\r ]+", " "), " "), lambda w: w != "")
    abstract = tx.abstract_from_index(tx.inverted_index(words))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), abstract).alias("abstract"))


# ---- harmonization ---------------------------------------------------------------------------------------------------


@query("SELECT lower(p_type) AS key, min_by(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END, p_partkey) AS canonical, count(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END) AS n_members FROM part GROUP BY lower(p_type)")
def fallback_cluster(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END AS outcome_name")
    c = harmonize.cluster_by_spelling(harmonize.outcome_names(rows))
    return c.select(F.lower("canonical").alias("key"), "canonical", F.size("members").cast("long").alias("n_members"))


@query("WITH c(canonical, raw) AS (VALUES ('Economy goods', 'economy'), ('Standard goods', 'standard')) SELECT p_partkey, coalesce(c.canonical, p_type) AS canonical_outcome FROM part LEFT JOIN c ON lower(p_type) = c.raw")
def harmonize_mapping(spark, sf_dir):
    clusters = spark.createDataFrame([("Economy things", ["ECONOMY"], 0), ("Economy goods", ["Economy", "econ"], 1), ("Standard goods", ["STANDARD"], 2)], "canonical string, members array<string>, position int")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("outcome_name"))
    return harmonize.apply_mapping(rows, clusters).select("p_partkey", "canonical_outcome")


@query("SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine_pairs(spark, sf_dir):
    return harmonize.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", digits=5).drop("distance")


@query()
def upgma(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.concat(F.lit("outcome "), F.col("vec_id")).alias("name"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return harmonize.cluster_by_vector(v, "label").drop("position")


# ---- cost ------------------------------------------------------------------------------------------------------------

_LOG = "event_type AS phase, concat('agent', CAST(user_id % 5 AS {s})) AS agent, event_id % 1000 AS input_tokens, event_id % 300 AS output_tokens, value AS cost"


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_LOG.format(s="STRING").split(", ", 1)[:1], "concat('agent', CAST(user_id % 5 AS STRING)) AS agent", "event_id % 1000 AS input_tokens", "event_id % 300 AS output_tokens", "value AS cost")


_LOG_SQL = f"WITH l AS (SELECT {_LOG.format(s='VARCHAR')} FROM events)"


@query(f"{_LOG_SQL} SELECT phase, agent, CAST(GROUPING(phase, agent) AS INT) AS level, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, (sum(input_tokens) + sum(output_tokens))::BIGINT AS tokens, round(sum(cost), 4) AS cost FROM l GROUP BY ROLLUP (phase, agent)")
def cost_rollup(spark, sf_dir):
    return cost.cost_rollup(usage_log(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


@query(f"{_LOG_SQL} SELECT 'error' AS current_phase, round(sum(cost), 4) AS cost_so_far, count(DISTINCT CASE WHEN phase IN ('signup', 'view', 'click', 'error') THEN phase END) AS n_completed, 2 AS n_remaining, round(sum(cost) * 2 / 4, 4) AS estimate FROM l")
def cost_estimate(spark, sf_dir):
    e = cost.estimate_remaining(usage_log(spark, sf_dir), "error", ("signup", "view", "click", "error", "purchase", "refund"))
    return e.select("current_phase", F.round("cost_so_far", 4).alias("cost_so_far"), "n_completed", "n_remaining", F.round("estimate", 4).alias("estimate"))


@query("SELECT event_id, round((event_id % 1000) * 100 / 1000 * CASE user_id % 3 WHEN 0 THEN 0.0003 WHEN 1 THEN 0.003 ELSE 0.015 END + (event_id % 300) * 100 / 1000 * CASE user_id % 3 WHEN 0 THEN 0.0025 WHEN 1 THEN 0.015 ELSE 0.075 END, 6) AS cost FROM events")
def tier_cost(spark, sf_dir):
    tier = F.expr("CASE user_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'smart' ELSE 'strategic' END")
    return table(spark, sf_dir, "events").select("event_id", cost.call_cost(tier, F.col("event_id") % 1000 * 100, F.col("event_id") % 300 * 100).alias("cost"))


@query(f"{_LOG_SQL} SELECT round(sum(cost) / 20, 4) AS cost_per_study, round((sum(input_tokens) + sum(output_tokens)) / 20, 4) AS tokens_per_study FROM l")
def cost_report(spark, sf_dir):
    r = cost.cost_report(usage_log(spark, sf_dir), 20).filter("level = 3")
    return r.select(F.round("cost_per_study", 4).alias("cost_per_study"), F.round("tokens_per_study", 4).alias("tokens_per_study"))


# ---- answers, writing, plots -----------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_parse_default(spark, sf_dir):
    """Fenced answers, broken ones with a retry, and broken ones without."""
    first = F.expr("CASE event_id % 3 WHEN 0 THEN concat('```json\\n', props, '\\n```') ELSE concat('Sorry: ', props) END")
    retry = F.expr("CASE WHEN event_id % 3 = 1 THEN props END")
    return table(spark, sf_dir, "events").select("event_id", tx.parse_json(first, retry, "k bigint")["k"].alias("k"))


_CLAIMS = [("'zzzz'", "CONTRADICTED", "'x'"), ("substring(text, 1, 5)", "CONTRADICTED", "'ten'"), ("substring(text, 21, 6)", "UNSUPPORTED", "NULL"), ("substring(text, 31, 6)", "UNSUPPORTED", "NULL")]


@query("""WITH r AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, CASE WHEN text <> '' THEN replace(text, text[1:5], 'ten') ELSE text END AS t, text[21:26] AS c, text[31:36] AS d, text <> '' AND NOT starts_with(text, '[') AS ok FROM r),
b AS (SELECT *, CASE WHEN c <> '' AND contains(t, c) AND NOT contains(t, '[CITATION NEEDED]') THEN replace(t, c, c || ' [CITATION NEEDED]') ELSE t END AS u FROM a)
SELECT doc_id, CASE WHEN NOT ok THEN text WHEN d <> '' AND contains(u, d) AND NOT contains(u, '[CITATION NEEDED]') THEN replace(u, d, d || ' [CITATION NEEDED]') ELSE u END AS revised_text,
  0 AS n_supported, CASE WHEN ok THEN 2 ELSE 0 END AS n_contradicted, CASE WHEN ok THEN (c <> '')::INT + (d <> '')::INT ELSE 0 END AS n_unsupported FROM b""")
def factcheck_fold(spark, sf_dir):
    """Claims on the places of each text that are not empty."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    claims = None
    for i, (t, v, c) in enumerate(_CLAIMS):
        one = docs.selectExpr("doc_id AS section", f"{i} AS claim_idx", f"{t} AS text", f"'{v}' AS verdict", f"CAST({c} AS STRING) AS corrected_text").filter("text <> ''")
        claims = one if claims is None else claims.unionByName(one)
    revised = writing.revise_sections(docs.select(F.col("doc_id").alias("section"), "text"), claims)
    return revised.select(F.col("section").alias("doc_id"), "revised_text", "n_supported", "n_contradicted", "n_unsupported")


@query("SELECT conv_id AS section, count(*) FILTER (WHERE turn % 3 = 0) AS \"SUPPORTED\", count(*) FILTER (WHERE turn % 3 = 1) AS \"CONTRADICTED\", count(*) FILTER (WHERE turn % 3 = 2) AS \"UNSUPPORTED\" FROM conversations GROUP BY conv_id")
def verdict_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id AS section", "CASE turn % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS verdict")
    return writing.verdict_counts(c)


_PLOT = f"WITH {SMD}, {TCRIT}, {pool_sql('eff', 'outcome')}"


@query(f"{_PLOT} SELECT outcome, k - row_number() OVER (PARTITION BY outcome ORDER BY ord) AS y, study_id AS label, round(effect, 6) AS effect, round(effect - 1.96 * eff.se, 6) AS lo, round(effect + 1.96 * eff.se, 6) AS hi, 'study' AS kind FROM eff JOIN pooled USING (outcome) UNION ALL SELECT outcome, -1, 'Pooled', round(pooled_effect, 6), round(ci_lower, 6), round(ci_upper, 6), 'pooled' FROM pooled")
def forest_rows(spark, sf_dir):
    e = smd(spark, sf_dir)
    return rounded(writing.forest_rows(e, pooling.random_effects(e, method="DL")), "effect", "lo", "hi")


@query(f"{_PLOT}, m AS (SELECT outcome, max(se) * 1.2 AS top FROM eff GROUP BY outcome) SELECT outcome, step::INT AS step, round(0.001 + (top - 0.001) * step / 99, 6) AS se, round(pooled_effect - 1.96 * (0.001 + (top - 0.001) * step / 99), 6) AS lo, round(pooled_effect + 1.96 * (0.001 + (top - 0.001) * step / 99), 6) AS hi FROM m JOIN pooled USING (outcome), range(100) r(step)")
def funnel_grid(spark, sf_dir):
    e = smd(spark, sf_dir)
    return rounded(writing.funnel_grid(e, pooling.random_effects(e, method="DL")), "se", "lo", "hi")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm summaries to pooled effects, one row for each outcome."""
    return meta_dl_hksj(spark, sf_dir)
