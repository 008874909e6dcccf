"""Effect sizes of two-arm studies as column expressions.

Each function takes columns (or names) and gives a struct; it is null where the inputs lie outside the formula's domain,
so a bad row falls out of what follows and no other row with it. Confidence limits use the constant 1.96.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _d(*xs: Column | str | float) -> list[Column]:
    return [_c(x).cast("double") for x in xs]


def _interval(ok: Column, effect: Column, se: Column, name: str, **more: Column) -> Column:
    """The struct of an effect and its limits, null unless ok holds and both are numbers.

    A lambda binds the effect and its error: written out, a formula would be copied into each field, beyond what the
    compiler takes as one method.
    """
    def made(v: Column) -> Column:
        e, s = v["e"], v["s"]
        known = F.coalesce(v["ok"], F.lit(False)) & e.isNotNull() & ~F.isnan(e) & s.isNotNull() & ~F.isnan(s)
        return F.when(known, F.struct(e.alias(name), s.alias("se"), (e - Z95 * s).alias("ci_lower"), (e + Z95 * s).alias("ci_upper"), *(v[k].alias(k) for k in more)))

    bound = F.struct(ok.alias("ok"), effect.alias("e"), se.alias("s"), *(v.alias(k) for k, v in more.items()))
    return F.get(F.transform(F.array(bound), made), F.lit(0))


def _over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def hedges_g(n1, mean1, sd1, n2, mean2, sd2) -> Column:
    """g, se, ci_lower, ci_upper, correction_factor, cohens_d; null unless n1 + n2 > 2 and the pooled SD is positive."""
    n1, mean1, sd1, n2, mean2, sd2 = _d(n1, mean1, sd1, n2, mean2, sd2)
    df = n1 + n2 - 2
    variance = _over((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2, df)
    ok = (df > 0) & (variance > 0) & (n1 > 0) & (n2 > 0)
    d = _over(mean1 - mean2, F.sqrt(F.when(variance > 0, variance)))
    j = 1 - _over(F.lit(3.0), 4 * df - 1)
    g = d * j
    se = F.sqrt(_over(n1 + n2, n1 * n2) + _over(g * g, 2 * df)) * j
    return _interval(ok, g, se, "g", correction_factor=j, cohens_d=d)


def mean_difference(n1, mean1, sd1, n2, mean2, sd2) -> Column:
    """md, se, ci_lower, ci_upper; se may be 0."""
    n1, mean1, sd1, n2, mean2, sd2 = _d(n1, mean1, sd1, n2, mean2, sd2)
    return _interval((n1 > 0) & (n2 > 0), mean1 - mean2, F.sqrt(_over(sd1 * sd1, n1) + _over(sd2 * sd2, n2)), "md")


def log_risk_ratio(a, n1, c, n2) -> Column:
    """log_rr, se, ci_lower, ci_upper; null unless all counts are positive."""
    a, n1, c, n2 = _d(a, n1, c, n2)
    ok = (a > 0) & (n1 > 0) & (c > 0) & (n2 > 0)
    v = _over(F.lit(1.0), a) - _over(F.lit(1.0), n1) + _over(F.lit(1.0), c) - _over(F.lit(1.0), n2)
    ratio = F.when(ok, _over(a, n1) / _over(c, n2))
    return _interval(ok & (v >= 0), F.ln(ratio), F.sqrt(F.when(v >= 0, v)), "log_rr")


def risk_ratio(a, n1, c, n2) -> Column:
    """rr, ci_lower, ci_upper (both exponentiated), log_rr, se_log."""
    x = log_risk_ratio(a, n1, c, n2)
    return F.when(x.isNotNull(), F.struct(F.exp(x["log_rr"]).alias("rr"), F.exp(x["ci_lower"]).alias("ci_lower"), F.exp(x["ci_upper"]).alias("ci_upper"), x["log_rr"].alias("log_rr"), x["se"].alias("se_log")))


def odds_ratio(a, b, c, d) -> Column:
    """or, log_or, se (of the logarithm), ci_lower, ci_upper (exponentiated); null unless all cells are positive."""
    a, b, c, d = _d(a, b, c, d)
    ok = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    ratio = F.when(ok, _over(a * d, b * c))
    log, se = F.ln(ratio), F.sqrt(_over(F.lit(1.0), a) + _over(F.lit(1.0), b) + _over(F.lit(1.0), c) + _over(F.lit(1.0), d))
    return F.when(ok, F.struct(ratio.alias("or"), log.alias("log_or"), se.alias("se"), F.exp(log - Z95 * se).alias("ci_lower"), F.exp(log + Z95 * se).alias("ci_upper")))


def risk_difference(a, n1, c, n2) -> Column:
    """rd, se, ci_lower, ci_upper; se is 0 where both risks are 0 or 1."""
    a, n1, c, n2 = _d(a, n1, c, n2)
    p1, p2 = _over(a, n1), _over(c, n2)
    v = _over(p1 * (1 - p1), n1) + _over(p2 * (1 - p2), n2)
    return _interval((n1 > 0) & (n2 > 0) & (v >= 0), p1 - p2, F.sqrt(F.when(v >= 0, v)), "rd")


def impute_sd(n, sd, se, ci_lower, ci_upper) -> Column:
    """sd; else se * sqrt(n); else sqrt(n) * (ci_upper - ci_lower) / 3.92, where n is known and not 0."""
    n, sd, se, lo, hi = _d(n, sd, se, ci_lower, ci_upper)
    root = F.sqrt(F.when(n > 0, n))
    return F.coalesce(sd, se * root, root * (hi - lo) / 3.92)


def effect_of(kind: str, arm1: dict[str, Column], arm2: dict[str, Column]) -> tuple[Column, str]:
    """(the struct of one type: SMD, MD, logRR, logOR or RD; its field that is the effect); null for inputs out of its domain.

    An arm is a dict of columns n, mean, sd, events, total.
    """
    continuous = (arm1["n"], arm1["mean"], arm1["sd"], arm2["n"], arm2["mean"], arm2["sd"])
    risk = (arm1["events"], arm1["total"], arm2["events"], arm2["total"])
    if kind == "SMD":
        return hedges_g(*continuous), "g"
    if kind == "MD":
        return mean_difference(*continuous), "md"
    if kind == "logOR":
        return odds_ratio(arm1["events"], arm1["total"] - arm1["events"], arm2["events"], arm2["total"] - arm2["events"]), "log_or"
    return (log_risk_ratio(*risk), "log_rr") if kind == "logRR" else (risk_difference(*risk), "rd")


def effect_for(effect_type: Column, arm1: dict[str, Column], arm2: dict[str, Column]) -> Column:
    """effect, se of the planned type (see effect_of); null for another type."""
    out = F.lit(None).cast("struct<effect:double,se:double>")
    for kind in ("SMD", "MD", "logRR", "logOR", "RD"):
        x, e = effect_of(kind, arm1, arm2)
        out = F.when(effect_type == kind, F.when(x.isNotNull(), F.struct(x[e].alias("effect"), x["se"].alias("se")))).otherwise(out)
    return out


def check_se_sd(value, n, reported_as, reference_mean) -> Column:
    """value, was_corrected, original, reason: an SE that was an SD, or the other way round, judged by its share of the mean.

    Only where n > 3, value > 0 and reference_mean > 0; other rows come back unchanged.
    """
    v, n, m = _d(value, n, reference_mean)
    root = F.sqrt(F.when(n > 0, n))
    usable = F.coalesce((n > 1) & (root > F.sqrt(F.lit(3.0))) & (v > 0) & (m > 0), F.lit(False))
    as_se, as_sd = _over(_over(v, root), m), _over(v * root, m)
    kind = _c(reported_as)
    was_sd = usable & (kind == "se") & (_over(v, m) >= 1.5) & (as_se > 0.01) & (as_se < 1.5)
    was_se = usable & (kind == "sd") & (_over(v, m) < 0.01) & (as_sd > 0.01) & (as_sd < 1.5)
    was_sd, was_se = F.coalesce(was_sd, F.lit(False)), F.coalesce(was_se, F.lit(False))
    fixed = F.when(was_sd, _over(v, root)).when(was_se, v * root).otherwise(v)
    return F.struct(fixed.alias("value"), (was_sd | was_se).alias("was_corrected"), v.alias("original"), F.when(was_sd, "se_was_sd").when(was_se, "sd_was_se").alias("reason"))


def cross_checks(arm1: dict[str, Column], arm2: dict[str, Column], reported: Column, computed: Column, tolerance: float = 0.01) -> Column:
    """Names of the checks that a row fails: events within totals, SDs not negative, direction and size of the effect."""
    rules = [
        ("events_exceed_total", (arm1["events"] > arm1["total"]) | (arm2["events"] > arm2["total"])),
        ("negative_sd", (arm1["sd"] < 0) | (arm2["sd"] < 0)),
        ("direction", F.signum(reported) * F.signum(computed) < 0),
        ("effect_differs", F.abs(reported - computed) > tolerance),
    ]
    return F.filter(F.array(*(F.when(c, name) for name, c in rules)), lambda x: x.isNotNull())


def apart(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that later expressions read and do not repeat, without the rows where it is null.

    Optimisers copy a projected expression into each that uses it; behind a generator it is computed once for each row.
    """
    return df.select("*", F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name))
