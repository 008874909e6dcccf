"""Small-study effects: Egger's regression and trim-and-fill."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metasieve.functions.distributions import t_sf_col
from metasieve.operators.pooling import pool_vectors


def egger(effects: DataFrame, keys: Sequence[str] = ("outcome",)) -> DataFrame:
    """keys, k, intercept, slope, se, t, p_value, significant (p < 0.10), intercept_se, t_corrected.

    The regression is of effect / se on 1 / se. t divides the intercept by the slope's standard error, for results equal
    to those users have; t_corrected divides by the intercept's own. Groups of fewer than three studies, with an se that
    is not positive or with equal ones have no row.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    rows = effects.select(*keys, (1 / F.nullif(F.col("se"), F.lit(0.0))).alias("_x"), (F.col("effect") / F.nullif(F.col("se"), F.lit(0.0))).alias("_y"), "se")
    rows = rows.withColumns({"k": F.count(F.lit(1)).over(w), "_lo": F.min("se").over(w), "_hi": F.max("se").over(w)}).filter("k >= 3 AND _lo > 0 AND _lo <> _hi")
    rows = rows.withColumns({"intercept": F.regr_intercept("_y", "_x").over(w), "slope": F.regr_slope("_y", "_x").over(w)})
    miss = F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_x")
    out = rows.groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("k", "intercept", "slope")), F.regr_sxx("_y", "_x").alias("_sxx"), F.avg("_x").alias("_mx"), F.sum(miss * miss).alias("_sse"))
    s2 = F.col("_sse") / F.nullif(F.col("k") - 2, F.lit(0))
    out = out.withColumn("se", F.sqrt(s2 / F.col("_sxx"))).withColumn("intercept_se", F.sqrt(s2 * (1 / F.col("k") + F.col("_mx") ** 2 / F.col("_sxx"))))
    out = out.withColumn("t", F.col("intercept") / F.nullif(F.col("se"), F.lit(0.0))).withColumn("t_corrected", F.col("intercept") / F.nullif(F.col("intercept_se"), F.lit(0.0)))
    out = out.withColumn("p_value", 2 * t_sf_col(F.abs("t"), (F.col("k") - 2).cast("double")))
    return out.select(*keys, "k", "intercept", "slope", "se", "t", "p_value", (F.col("p_value") < 0.10).alias("significant"), "intercept_se", "t_corrected")


def trim_and_fill(effects: DataFrame, keys: Sequence[str] = ("outcome",), hksj: bool = False) -> DataFrame:
    """keys, k, n_imputed, k_total, original_effect, original_ci_lower, original_ci_upper, adjusted_effect, adjusted ci_lower, ci_upper, direction_flipped, warning.

    One pass about the REML mean: the side with fewer effects is the suppressed one (ties: the left), k0 = max(0,
    k - 2 * its count), and the k0 most extreme effects of the other side are mirrored with their se. Equal distances are
    taken in ord's order. Intervals are normal ones unless hksj is set. Groups of fewer than three studies or with an se that is not positive have no row.
    """
    keys = list(keys)
    fields = [("k", T.LongType()), ("n_imputed", T.LongType()), ("k_total", T.LongType()), ("original_effect", T.DoubleType()), ("original_ci_lower", T.DoubleType()), ("original_ci_upper", T.DoubleType()), ("adjusted_effect", T.DoubleType()), ("ci_lower", T.DoubleType()), ("ci_upper", T.DoubleType()), ("direction_flipped", T.BooleanType()), ("warning", T.StringType())]
    schema = T.StructType([effects.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        y, se = pdf["effect"].to_numpy(float), pdf["se"].to_numpy(float)
        key = [pdf[k].iloc[0] for k in keys]
        if len(y) < 3 or not (se > 0).all():
            return pd.DataFrame([(*key, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, "")], columns=schema.names).head(0)
        original = pool_vectors(y, se, "REML", False)
        mu = original["pooled_effect"]
        d = y - mu
        right, left = int((d > 0).sum()), int((d < 0).sum())
        suppressed_right = right < left
        k0 = max(0, len(y) - 2 * (right if suppressed_right else left))
        far = np.argsort(d if suppressed_right else -d, kind="stable")[:k0]
        adjusted = pool_vectors(np.r_[y, 2 * mu - y[far]], np.r_[se, se[far]], "REML", hksj)
        flipped = bool((mu > 0) != (adjusted["pooled_effect"] > 0))
        warning = "the direction of the effect changes after trim-and-fill" if flipped else None
        return pd.DataFrame([(*key, len(y), k0, len(y) + k0, mu, original["ci_lower"], original["ci_upper"], adjusted["pooled_effect"], adjusted["ci_lower"], adjusted["ci_upper"], flipped, warning)], columns=schema.names)

    return effects.select(*keys, "ord", "effect", "se").groupBy(*keys).applyInPandas(fill, schema)
