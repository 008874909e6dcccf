"""Effects, pooling, bias tests and analysis against plain numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasieve.functions import effects as fx
from metasieve.functions.distributions import chi2_sf, t_critical, t_ppf, t_sf
from metasieve.operators import analysis, bias, pooling

Y, SE, GROUPS = [0.5, 0.3, 0.8, 0.1, 0.6], [0.1, 0.15, 0.2, 0.12, 0.18], ["A", "A", "B", "B", "B"]


def table(spark, sets):
    rows = [(o, i, f"S{i}", g[i] if g else None, float(a), float(b)) for o, y, se, g in sets for i, (a, b) in enumerate(zip(y, se, strict=True))]
    return spark.createDataFrame(rows, "outcome string, ord int, study_id string, subgroup string, effect double, se double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_effects(spark):
    L = F.lit
    g = one(spark, fx.hedges_g(L(50), L(103.0), L(5.5), L(50), L(100.0), L(4.5)))
    assert 0 < g.correction_factor < 1 and g.ci_lower < g.g < g.ci_upper
    assert one(spark, fx.hedges_g(L(1), L(1.0), L(1.0), L(1), L(2.0), L(1.0))) is None
    assert one(spark, fx.hedges_g(L(5), L(1.0), L(0.0), L(5), L(2.0), L(0.0))) is None
    assert one(spark, fx.mean_difference(L(50), L(10.0), L(3.0), L(50), L(8.0), L(3.0))).md == 2.0
    assert one(spark, fx.risk_ratio(L(20), L(100), L(10), L(100))).rr == pytest.approx(2.0)
    assert one(spark, fx.odds_ratio(L(20), L(80), L(10), L(90)))["or"] == pytest.approx(20 * 90 / (80 * 10))
    assert one(spark, fx.risk_difference(L(30), L(100), L(20), L(100))).rd == pytest.approx(0.10)
    assert one(spark, fx.risk_difference(L(0), L(10), L(0), L(10))).se == 0
    assert one(spark, fx.log_risk_ratio(L(0), L(10), L(1), L(10))) is None and one(spark, fx.odds_ratio(L(0), L(1), L(1), L(1))) is None
    assert one(spark, fx.impute_sd(L(25), L(None).cast("double"), L(2.0), L(None).cast("double"), L(None).cast("double"))) == 10


def test_se_sd(spark):
    check = lambda v, n, kind, m: one(spark, fx.check_se_sd(F.lit(v), F.lit(n), F.lit(kind), F.lit(m).cast("double")))
    assert (check(15.0, 100, "se", 10.0).value, check(15.0, 100, "se", 10.0).reason) == (1.5, "se_was_sd")
    assert (check(0.5, 100, "sd", 100.0).value, check(0.5, 100, "sd", 100.0).reason) == (5.0, "sd_was_se")
    for args in ((15.0, 100, "se", None), (1.5, 100, "se", 100.0), (15.0, 100, "sd", 100.0), (15.0, 1, "se", 10.0)):
        assert not check(*args).was_corrected


def test_distributions(spark):
    assert t_ppf(0.975, 1) == pytest.approx(12.7062047, rel=1e-7) and t_ppf(0.975, 30) == pytest.approx(2.0422725, rel=1e-7)
    assert t_sf(2.0, 10) == pytest.approx(0.036694017, rel=1e-7)
    closed = math.exp(-25.43 / 2) * sum((25.43 / 2) ** i / math.factorial(i) for i in range(12))
    assert chi2_sf(25.43, 24) == pytest.approx(closed, rel=1e-10) and chi2_sf(200, 3) == pytest.approx(4.2e-43, rel=0.05)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    got = {r.d: r.t for r in spark.createDataFrame([(d,) for d in (0, 1, 200, 500)], "d int").select("d", t_critical(F.col("d")).alias("t")).collect()}
    assert got[0] is None and got[1] == pytest.approx(12.7062047, rel=1e-7) and got[500] == pytest.approx(t_ppf(0.975, 500), abs=1e-6)


def test_pooling(spark):
    zero = ([0.1, 0.1, 0.1], [0.2, 0.2, 0.2])
    df = table(spark, [("all", Y, SE, GROUPS), ("two", Y[:2], SE[:2], None), ("one", Y[:1], SE[:1], None), ("bad", [0.1, 0.2], [0.1, 0.0], None), ("zero", *zero, None)])
    got = {r.outcome: r for r in pooling.random_effects(df).collect()}
    r = got["all"]
    y, v = np.array(Y), np.array(SE) ** 2

    def likelihood(t):
        w = 1 / (v + t)
        mu = (w * y).sum() / w.sum()
        return 0.5 * (np.log(v + t).sum() + (w * (y - mu) ** 2).sum() + math.log(w.sum()))

    best = min(np.linspace(0, 1, 20001), key=likelihood)
    assert r.tau2 == pytest.approx(best, abs=1e-4) and r.tau2_method_used == "REML"
    w = 1 / (v + r.tau2)
    mu = (w * y).sum() / w.sum()
    assert r.pooled_effect == pytest.approx(mu) and r.weights == pytest.approx(list(w / w.sum())) and sum(r.weights) == pytest.approx(1)
    se = math.sqrt(1 / w.sum()) * math.sqrt((w * (y - mu) ** 2).sum() / 4)
    assert r.pooled_se == pytest.approx(se) and r.ci_upper == pytest.approx(mu + t_ppf(0.975, 4) * se)
    assert r.pi_upper == pytest.approx(mu + t_ppf(0.975, 3) * math.sqrt(r.tau2 + 1 / w.sum()))
    assert 0 <= r.i2 <= 100 and got["two"].pi_lower is None
    assert got["one"].pooled_effect == 0.5 and got["one"].tau2_method_used == "none_k1" and got["one"].q_p == 1
    assert got["bad"].pooled_effect is None and "standard errors" in got["bad"].error
    assert got["zero"].tau2 == pooling.REML_AT_ZERO
    assert pooling.random_effects(df.limit(0)).count() == 0


def test_sensitivity(spark):
    df = table(spark, [("all", Y, SE, GROUPS), ("same", Y, SE, ["A"] * 5)])
    loo = pooling.leave_one_out(df, method="DL").filter("outcome = 'all'").collect()
    assert len(loo) == 5
    plain = pooling.pool_vectors(np.array(Y[1:]), np.array(SE[1:]), "DL")
    assert next(r for r in loo if r.omitted_index == 0).pooled_effect == pytest.approx(plain["pooled_effect"])
    cum = sorted(pooling.cumulative(df, method="DL").filter("outcome = 'all'").collect(), key=lambda r: r.added_index)
    assert [r.k for r in cum] == [1, 2, 3, 4, 5] and cum[0].pooled_effect == 0.5
    pooled, between = pooling.subgroup_effects(df)
    got = {r.outcome: r for r in between.collect()}
    assert got["all"].n_subgroups == 2 and got["same"].q_between == 0 and got["same"].p_between == 1 and pooled.count() == 3


def test_bias(spark):
    y, se = [0.3, 0.7, 0.35, 0.65, 0.4, 0.6, 0.42, 0.58, 0.48, 0.52], [0.1, 0.1, 0.15, 0.15, 0.2, 0.2, 0.25, 0.25, 0.3, 0.3]
    df = table(spark, [("balanced", y, se, None), ("equal", Y, [0.2] * 5, None), ("few", Y[:2], SE[:2], None)])
    got = {r.outcome: r for r in bias.egger(df).collect()}
    assert set(got) == {"balanced"} and got["balanced"].p_value > 0.05
    x, z = 1 / np.array(se), np.array(y) / np.array(se)
    slope, intercept = np.polyfit(x, z, 1)
    s = math.sqrt(((z - intercept - slope * x) ** 2).sum() / 8 / ((x - x.mean()) ** 2).sum())
    assert got["balanced"].t == pytest.approx(intercept / s, rel=1e-6)
    taf = {r.outcome: r for r in bias.trim_and_fill(df).collect()}
    assert "few" not in taf and taf["balanced"].k_total == 10 + taf["balanced"].n_imputed <= 13


def test_analysis(spark):
    arm = lambda n, m, sd, e=None, t=None: ("a", n, m, sd, None, None, None, e, t)
    rows = [("bp", i, f"S{i}", arm(50 + 5 * i, 120.0 + i, 10 + 0.5 * i), arm(50 + 5 * i, 130.0 + i, 11 + 0.5 * i)) for i in range(5)]
    rows += [("death", i, f"S{i}", arm(None, None, None, 5 + i, 100), arm(None, None, None, 12 + i, 100)) for i in range(2)]
    rows += [("none", 0, "S0", arm(10, None, None), arm(10, None, None)), ("", 0, "S9", arm(1, 1.0, 1.0), arm(1, 1.0, 1.0))]
    df = spark.createDataFrame(rows, f"outcome string, ord int, study_id string, arm1 {analysis.ARM}, arm2 {analysis.ARM}")
    out = analysis.analyze(df)
    got = {r.outcome: r for r in out["results"].collect()}
    assert got["bp"].pooled_effect < 0 and got["bp"].effect_type == "SMD" and got["bp"].method == "REML"
    assert got["death"].effect_type == "logOR" and got["death"].pooled_effect < 0 and got["death"].method == "DL"
    assert got["none"].k == 0 and got["none"].error == "no usable data" and "" not in got
    flags = {(r.outcome, r.type) for r in out["flags"].collect()}
    assert ("death", "underpowered") in flags and ("death", "weight_dominance") in flags and not any(o == "none" for o, _ in flags)
    assert {r.omitted for r in out["leave_one_out"].collect()} == {f"S{i}" for i in range(5)}
