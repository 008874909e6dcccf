"""Heterogeneity and pooling of effects, one result per group of keys.

Input is long: keys, ord, study_id, effect, se, a row for each study of an outcome, which is small beside what the effects
were computed from. Effects are read once and shuffled once on the keys; means, squares about them and weights are
windows over that one partitioning. Only REML, which iterates, takes a group's vectors to an Arrow function. A group with
an se that is not positive gets an error and no numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metasieve.functions.distributions import chi2_sf_col, t_critical, t_ppf
from metasieve.functions.effects import Z95

#: What tau squared is where the DerSimonian-Laird start is 0: a fixed value.
REML_AT_ZERO = 1e-10


def i_squared(q: Column, df: Column) -> Column:
    """max(0, (q - df) / q * 100); 0 where q or df is not positive."""
    return F.when((q > 0) & (df > 0), F.greatest(F.lit(0.0), (q - df) / q * 100)).otherwise(0.0)


def prediction_interval(pooled: Column, tau2: Column, se: Column, k: Column) -> Column:
    """lower, upper, t_critical, pi_se; null for fewer than three studies. se is used as given."""
    t = t_critical(k - 2)
    pi_se = F.sqrt(tau2 + se * se)
    return F.when(k >= 3, F.struct((pooled - t * pi_se).alias("lower"), (pooled + t * pi_se).alias("upper"), t.alias("t_critical"), pi_se.alias("pi_se")))


def _with_fixed(effects: DataFrame, keys: list[str]) -> DataFrame:
    """effects with k, bad, mu, q and tau2_dl of their group beside each row."""
    w = Window.partitionBy(*keys)
    inverse = F.when(F.col("se") > 0, 1 / (F.col("se") * F.col("se")))
    rows = effects.withColumn("_w", inverse)
    rows = rows.withColumns({"k": F.count(F.lit(1)).over(w), "bad": F.max(F.when(F.col("se") > 0, 0).otherwise(1)).over(w), "_sw": F.sum("_w").over(w), "_swy": F.sum(F.col("_w") * F.col("effect")).over(w), "_sw2": F.sum(F.col("_w") * F.col("_w")).over(w)})
    rows = rows.withColumn("mu", F.col("_swy") / F.col("_sw")).withColumn("q", F.sum(F.col("_w") * (F.col("effect") - F.col("mu")) * (F.col("effect") - F.col("mu"))).over(w))
    c = F.col("_sw") - F.col("_sw2") / F.col("_sw")
    tau2 = F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.nullif(c, F.lit(0.0)))).otherwise(0.0)
    return rows.withColumn("tau2_dl", tau2).drop("_w", "_sw", "_swy", "_sw2")


def fixed_effect(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, bad, mu (inverse-variance mean), q and the DerSimonian-Laird tau2_dl of each group."""
    keys = list(keys)
    return _with_fixed(effects.select(*keys, "effect", "se"), keys).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("k", "bad", "mu", "q", "tau2_dl")))


def cochran_q(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k, q, df, p_value, i2."""
    fe = fixed_effect(effects, keys).filter("bad = 0").withColumn("df", F.col("k") - 1)
    return fe.select(*keys, "k", "q", "df", F.when(F.col("df") > 0, chi2_sf_col("q", "df")).otherwise(1.0).alias("p_value"), i_squared(F.col("q"), F.col("df")).alias("i2"))


def reml(y: np.ndarray, v: np.ndarray) -> tuple[float, bool]:
    """(tau squared, converged) by Fisher scoring, then Newton steps on the restricted likelihood's derivative.

    Where the DerSimonian-Laird estimate is 0 the result is REML_AT_ZERO, whatever the likelihood.
    """
    w = 1 / v
    mu = (w * y).sum() / w.sum()
    q, c = (w * (y - mu) ** 2).sum(), w.sum() - (w * w).sum() / w.sum()
    tau = max(0.0, (q - (len(y) - 1)) / c) if c > 0 else 0.0
    if tau == 0:
        return REML_AT_ZERO, True
    for _ in range(500):
        w = 1 / (v + tau)
        mu = (w * y).sum() / w.sum()
        new = max(0.0, (w * w * ((y - mu) ** 2 - v)).sum() / (w * w).sum() + 1 / w.sum())
        if abs(new - tau) <= 1e-13 * max(1.0, tau):
            return new, True
        tau = new
    return tau, False


def _with_tau(effects: DataFrame, keys: list[str], method: str | Column, hksj: bool | Column) -> DataFrame:
    """_with_fixed() with _hksj, tau2 and tau2_method_used: REML, DL_fallback where that fails, DL, or none_k1."""
    asked = F.lit(method) if isinstance(method, str) else method
    rows = effects.select(*keys, "ord", "effect", "se", (F.lit(hksj) if isinstance(hksj, bool) else hksj).alias("_hksj"), asked.alias("_method"))
    if not isinstance(method, str) or method == "REML":
        schema = T.StructType([*rows.schema.fields, T.StructField("tau2_reml", T.DoubleType())])

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            se = pdf["se"].to_numpy(float)
            tau, ok = reml(pdf["effect"].to_numpy(float), se * se) if len(pdf) > 1 and (se > 0).all() and pdf["_method"].iloc[0] == "REML" else (0.0, True)
            return pdf.assign(tau2_reml=tau if ok else np.nan)

        rows = rows.groupBy(*keys).applyInPandas(solve, schema)
    else:
        rows = rows.withColumn("tau2_reml", F.lit(None).cast("double"))
    rows = _with_fixed(rows, keys)
    restricted = F.col("_method") == "REML"
    solved = F.when(restricted, F.nanvl("tau2_reml", F.lit(None).cast("double")))
    used = F.when(F.col("k") == 1, "none_k1").when(~restricted, "DL").when(solved.isNull(), "DL_fallback").otherwise("REML")
    return rows.withColumn("tau2", F.when(F.col("k") == 1, 0.0).otherwise(F.coalesce(solved, "tau2_dl"))).withColumn("tau2_method_used", used)


def random_effects(effects: DataFrame, keys: Sequence[str] = ("outcome",), method: str | Column = "REML", hksj: bool | Column = True, with_weights: bool = True) -> DataFrame:
    """The pooled effect of each group: keys, k, pooled_effect, pooled_se, ci_lower, ci_upper, tau2, tau2_method_used, i2, q, q_p, pi_lower, pi_upper, weights (in ord's order), method_log, error.

    With hksj the se is the Knapp-Hartung one, without a floor, and limits use t(k - 1); else, and for one study, 1.96.
    The prediction interval uses the unadjusted se. method and hksj may be columns of effects, the same for all rows of a
    group.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    rows = _with_tau(effects, keys, method, hksj).withColumn("_w", F.when(F.col("se") > 0, 1 / (F.col("se") * F.col("se") + F.col("tau2"))))
    rows = rows.withColumns({"_sw": F.sum("_w").over(w), "_swy": F.sum(F.col("_w") * F.col("effect")).over(w)}).withColumn("pooled_effect", F.col("_swy") / F.col("_sw"))
    square = (F.col("effect") - F.col("pooled_effect")) * (F.col("effect") - F.col("pooled_effect"))
    sums = [F.first(c).alias(c) for c in ("k", "bad", "q", "tau2", "tau2_dl", "tau2_method_used", "pooled_effect", "_sw", "_hksj")] + [F.sum(F.col("_w") * square).alias("_r")]
    if with_weights:
        sums.append(F.sort_array(F.collect_list(F.struct("ord", (F.col("_w") / F.col("_sw")).alias("w")))).alias("_ws"))
    out = rows.groupBy(*keys).agg(*sums)
    se0 = F.sqrt(1 / F.col("_sw"))
    adjusted = (F.col("k") > 1) & F.col("_hksj")
    se = F.when(adjusted, se0 * F.sqrt(F.col("_r") / F.nullif(F.col("k") - 1, F.lit(0)))).otherwise(se0)
    half = F.when(adjusted, t_critical(F.col("k") - 1)).otherwise(F.lit(Z95)) * se
    pi = prediction_interval(F.col("pooled_effect"), F.col("tau2"), se0, F.col("k"))
    log = F.array_compact(F.array(F.concat(F.lit("tau2: "), F.col("tau2_method_used")), F.when(adjusted, "HKSJ adjustment applied"), F.when((F.col("tau2_method_used") == "REML") & (F.col("tau2_dl") == 0), "tau2 held at the REML start")))
    ok = F.col("bad") == 0
    numbers = {"pooled_effect": F.col("pooled_effect"), "pooled_se": se, "ci_lower": F.col("pooled_effect") - half, "ci_upper": F.col("pooled_effect") + half, "tau2": F.col("tau2"), "tau2_method_used": F.col("tau2_method_used"), "i2": i_squared(F.col("q"), F.greatest(F.col("k") - 1, F.lit(1))), "q": F.col("q"), "q_p": F.when(F.col("k") > 1, chi2_sf_col("q", (F.col("k") - 1).cast("double"))).otherwise(1.0), "pi_lower": pi["lower"], "pi_upper": pi["upper"]}
    if with_weights:
        numbers["weights"] = F.transform("_ws", lambda x: x["w"])
    return out.select(*keys, "k", *(F.when(ok, c).alias(n) for n, c in numbers.items()), log.alias("method_log"), F.when(~ok, "standard errors must be > 0").alias("error"))


def subgroup_effects(effects: DataFrame, keys: Sequence[str] = ("outcome",), subgroup: str = "subgroup", method: str | Column = "REML", hksj: bool | Column = True) -> tuple[DataFrame, DataFrame]:
    """(the pooled effect of each subgroup, keys with n_subgroups, q_between, df, p_between).

    A study without a label is in the subgroup "unknown"; q_between weighs by the subgroups' own, adjusted, se.
    """
    keys = list(keys)
    labelled = effects.withColumn(subgroup, F.coalesce(F.col(subgroup).cast("string"), F.lit("unknown")))
    pooled = random_effects(labelled, [*keys, subgroup], method, hksj)
    w = 1 / F.nullif(F.col("pooled_se") * F.col("pooled_se"), F.lit(0.0))
    good = pooled.filter(F.col("error").isNull())
    over = Window.partitionBy(*keys)
    near = good.withColumn("_b", w).withColumns({"n_subgroups": F.count(F.lit(1)).over(over), "_mu": F.sum(F.col("_b") * F.col("pooled_effect")).over(over) / F.sum("_b").over(over)})
    q = near.groupBy(*keys, "n_subgroups").agg(F.sum(F.col("_b") * (F.col("pooled_effect") - F.col("_mu")) ** 2).alias("_q"))
    several = F.col("n_subgroups") > 1
    between = q.select(*keys, "n_subgroups", F.when(several, F.col("_q")).otherwise(0.0).alias("q_between"), (F.col("n_subgroups") - 1).alias("df"))
    return pooled, between.withColumn("p_between", F.when(F.col("df") > 0, chi2_sf_col("q_between", F.col("df").cast("double"))).otherwise(1.0))


def _repeated(effects: DataFrame, keys: list[str], names: tuple[str, str], fields: dict[str, T.DataType], several: int, method: str | Column, hksj: bool | Column, chosen) -> DataFrame:
    """For each study of a group, the group's studies that chosen(place) picks, pooled: one pass over a group in one task.

    A group is the studies of one outcome. Its rows are pooled k times there, in memory of its size, and not joined with
    each other. Groups of fewer than `several` studies have no rows; where an se is not positive the numbers are null.
    """
    rows = effects.select(*keys, "ord", "study_id", "effect", "se", (F.lit(method) if isinstance(method, str) else method).alias("_method"), (F.lit(hksj) if isinstance(hksj, bool) else hksj).alias("_hksj"))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(names[0], rows.schema["ord"].dataType), T.StructField(names[1], rows.schema["study_id"].dataType), *(T.StructField(n, t) for n, t in fields.items())])

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        y, se, n = pdf["effect"].to_numpy(float), pdf["se"].to_numpy(float), len(pdf)
        out = []
        for k in range(n if n >= several else 0):
            at = chosen(n, k)
            got = pool_vectors(y[at], se[at], pdf["_method"].iloc[0], bool(pdf["_hksj"].iloc[0])) if (se[at] > 0).all() else {"k": len(at)}
            out.append((*(pdf[c].iloc[0] for c in keys), pdf["ord"].iloc[k], pdf["study_id"].iloc[k], *(got.get(f) for f in fields)))
        return pd.DataFrame(out, columns=schema.names)

    return rows.groupBy(*keys).applyInPandas(pool, schema)


def leave_one_out(effects: DataFrame, keys: Sequence[str] = ("outcome",), method: str | Column = "REML", hksj: bool | Column = True) -> DataFrame:
    """keys, omitted_index, omitted and the pooled result of the other studies, for groups of two studies or more."""
    fields = {f: T.DoubleType() for f in ("pooled_effect", "ci_lower", "ci_upper", "i2", "tau2")}
    return _repeated(effects, list(keys), ("omitted_index", "omitted"), fields, 2, method, hksj, lambda n, k: np.delete(np.arange(n), k))


def cumulative(effects: DataFrame, keys: Sequence[str] = ("outcome",), method: str | Column = "REML", hksj: bool | Column = True) -> DataFrame:
    """keys, added_index, added, k and the pooled result of the studies up to each one in ord's order."""
    fields = {"k": T.LongType()} | {f: T.DoubleType() for f in ("pooled_effect", "ci_lower", "ci_upper", "i2")}
    return _repeated(effects, list(keys), ("added_index", "added"), fields, 1, method, hksj, lambda n, k: np.arange(k + 1))


def pool_vectors(y: np.ndarray, se: np.ndarray, method: str = "REML", hksj: bool = True) -> dict:
    """random_effects() of one group as plain numbers, for operators that re-pool inside a grouped function."""
    v = se * se
    k = len(y)
    w = 1 / v
    mu = (w * y).sum() / w.sum()
    q, c = (w * (y - mu) ** 2).sum(), w.sum() - (w * w).sum() / w.sum()
    dl = max(0.0, (q - (k - 1)) / c) if k > 1 and c > 0 else 0.0
    tau2, ok = (0.0, True) if k == 1 else reml(y, v) if method == "REML" else (dl, True)
    tau2 = tau2 if ok else dl
    w = 1 / (v + tau2)
    pooled, se0 = (w * y).sum() / w.sum(), (1 / w.sum()) ** 0.5
    adjusted = hksj and k > 1
    s = se0 * ((w * (y - pooled) ** 2).sum() / (k - 1)) ** 0.5 if adjusted else se0
    half = (_t95(k - 1) if adjusted else Z95) * s
    df = max(k - 1, 1)
    return {"k": k, "pooled_effect": pooled, "pooled_se": s, "ci_lower": pooled - half, "ci_upper": pooled + half, "tau2": tau2, "i2": max(0.0, (q - df) / q * 100) if q > 0 else 0.0}


@lru_cache(maxsize=1000)
def _t95(df: int) -> float:
    return t_ppf(0.975, df)
