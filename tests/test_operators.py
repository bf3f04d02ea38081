"""Operators on Spark: against kernels, properties, and partition independence."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from impulsia.functions import linalg as L
from impulsia.operators import bootstrap as B
from impulsia.operators import decompose as D
from impulsia.operators import estimate as E
from impulsia.operators import inference as I
from impulsia.operators import panel as P
from impulsia.operators import series as S
from impulsia.operators import structural as R
from impulsia.operators import tidy as T

NAMES = ["a", "b", "c"]


def values(n=240, seed=2):
    rng = np.random.default_rng(seed)
    y = np.zeros((n, 3))
    for t in range(1, n):
        y[t] = 0.5 * y[t - 1] + 0.1 * y[t - 1][::-1] + rng.standard_normal(3) @ np.array([[1, 0.4, 0], [0, 1, 0.3], [0, 0, 1]])
    return y + 500


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(t + 1, *map(float, r)) for t, r in enumerate(values())], "t long, a double, b double, c double").repartition(5).cache()


@pytest.fixture(scope="module")
def var(series):
    return E.fit_var(series, NAMES, 2)


def array(df, key, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy(key).collect()])


def test_moment_fit_equals_the_kernel(var):
    beta, u, sigma = L.fit(values(), 2)
    assert np.allclose(var.beta, beta, atol=1e-6) and np.allclose(var.sigma, sigma)
    assert np.allclose(array(var.residuals(), "t", [f"u_{n}" for n in NAMES]), u, atol=1e-6)


def test_exogenous_columns_and_no_constant(series):
    ex = series.withColumn("x", F.sin(F.col("t") * F.col("t")))
    y, x = values(), np.sin(np.arange(1, 241.0) ** 2)[:, None]
    assert np.allclose(E.fit_var(ex, NAMES, 1, exog=["x"]).beta, L.fit(y, 1, 1, x)[0], atol=1e-6)
    assert np.allclose(E.fit_varx(ex, NAMES, ["x"], 2).beta, L.fit_with_lagged_exog(y, x, 2)[0], atol=1e-6)
    assert np.allclose(E.fit_var(series, NAMES, 1, c=0).beta, L.fit(y, 1, 0)[0], atol=1e-6)
    with pytest.raises(ValueError):
        E.fit_var(series, NAMES, 1, c=2)


@pytest.mark.parametrize("lags", [0, 3])
def test_ols_equals_the_kernel(series, lags):
    y = values()
    got, want = E.ols(series, "a", ["b", "c"], lags=lags), L.ols(y[:, 0], y[:, 1:], lags=lags)
    for k in ("r2", "r2adj", "f", "f_robust"):
        assert got[k] == pytest.approx(want[k], rel=1e-6)
    assert E.ols(series, "a", ["b"], lags="auto")["f_robust"] > 0


def test_lag_selection(series):
    y, t = values(), 240
    for p, aic, bic, hq in E.lag_selection(series, NAMES, 3):
        u = L.fit(y, p)[1]
        a, b = np.log(np.linalg.det(u.T @ u / t)), (9 * p + 3) / t
        assert (aic, bic, hq) == pytest.approx((a + 2 * b, a + np.log(t) * b, a + 2 * b * np.log(np.log(t))))
    assert E.best_lags([(1, 3.0, 2.0, 2.0), (2, 3.0, 1.0, 2.0)]) == {"aic": 1, "bic": 2, "hq": 1}


def test_series_operators(spark, series):
    assert np.allclose(array(S.differenced(series, NAMES), "t", NAMES), np.diff(values(), axis=0))
    assert np.allclose(array(S.demeaned(series, NAMES), "t", NAMES).mean(0), 0, atol=1e-9)
    assert np.allclose(array(S.wide(S.long(series, NAMES), NAMES), "t", NAMES), values())
    facts = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 03:10:00", "y", 2.0), (None, "x", 9.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    by = facts.where("ts is not null").groupBy("k", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("v").alias("v"))
    full = S.gap_filled(by, "hour", by.select("k"), ["v"])
    assert full.count() == 8 and full.agg(F.sum("v")).first()[0] == 3.0
    assert S.periods(facts, "ts", "hour", {"v": F.sum("v")}, drop_last=True).count() == 1


def test_decompositions(spark, var):
    irf = R.responses(spark, R.cholesky_irf(var, 10), NAMES)
    shares = D.variance_shares(irf)
    assert all(r["s"] == pytest.approx(1) for r in shares.groupBy("variable", "horizon").agg(F.sum("share").alias("s")).collect())
    zero = irf.withColumn("value", F.lit(0.0))
    assert {round(r["share"], 9) for r in D.variance_shares(zero).collect()} == {round(1 / 3, 9)}
    chol = np.linalg.cholesky(var.sigma)
    shocks = D.structural_shocks(var, chol, NAMES)
    full = R.responses(spark, R.cholesky_irf(var, 240), NAMES)
    hist = D.historical(full, shocks, ["a"]).groupBy("t").pivot("shock", NAMES).agg(F.first("value"))
    _, u, _ = var.arrays()
    for j, n in enumerate(NAMES):
        want = L.contributions(var.wold(237), chol[:, j], L.shock_series(u, var.sigma, chol[:, j]))[:, 0]
        assert np.allclose(array(hist, "t", [n])[:, 0], want)
    one = D.one_shock_shares(var, chol[:, 0], 10)
    assert one["check"] == pytest.approx(1)
    assert np.allclose(one["share"], array(shares.where("shock = 'a'").groupBy("horizon").pivot("variable", NAMES).agg(F.first("share")), "horizon", NAMES))
    freq = D.spectral_shares(irf, irf.where("shock = 'a'").drop("shock"), 64, 2, 1e9).collect()
    want = L.spectral_share(R.cholesky_irf(var, 10), R.cholesky_irf(var, 10)[:, :, 0], L.frequencies(64, 2, 1e9, True))
    assert {r["variable"]: pytest.approx(r["share"]) for r in freq} == dict(zip(NAMES, want, strict=True))
    empty = D.spectral_shares(irf, irf.where("shock = 'a'").drop("shock"), 4, 1e6, 2e6).collect()
    assert [r["share"] for r in empty] == [None] * 3


@pytest.mark.parametrize("scheme", ["residual", "wild"])
def test_bootstrap_is_the_same_on_any_partitions(spark, var, scheme, monkeypatch):
    q = B.plan(var, 6, scheme=scheme)
    one = B.bands(B.replicate(spark, q, 40, B.by_cholesky)).orderBy("variable", "shock", "horizon").collect()
    monkeypatch.setattr(B, "BATCH", 7)
    assert [tuple(r)[:3] for r in one] == [tuple(r)[:3] for r in B.bands(B.replicate(spark, q, 40, B.by_cholesky)).orderBy("variable", "shock", "horizon").collect()]
    two = B.bands(B.replicate(spark, q, 40, B.by_cholesky)).orderBy("variable", "shock", "horizon").collect()
    assert np.allclose([r["upper"] for r in one], [r["upper"] for r in two])
    assert all(r["lower"] <= r["lower2"] <= r["median"] <= r["upper2"] <= r["upper"] for r in one)


def test_bootstrap_identifications(spark, var):
    q = B.plan(var, 5, extra={"target": 0, "scale": (1, 2.0), "cumulate": [2]})
    chol = B.each(B.replicate(spark, B.plan(var, 5), 12, B.by_cholesky))
    assert chol.count() == 12 * 6 * 9 and chol.select("b").distinct().count() == 12
    for f in (B.by_long_run_max, B.by_max_share):
        rows = B.each(B.replicate(spark, q, 8, f)).where("horizon = 0 and variable = 'b'").collect()
        assert all(r["value"] == pytest.approx(2.0) for r in rows)
    bq = B.replicate(spark, dataclasses.replace(q, extra={"scale": (0, 2.0)}), 8, B.by_long_run)
    assert all(r["value"] == pytest.approx(2.0) for r in B.each(bq).where("horizon = 0 and variable = 'a' and shock = 'a'").collect())
    fixed = B.corrected(spark, B.plan(var, 5), 30)
    assert L.stable(fixed.beta, 3, 2, 1) and not np.allclose(fixed.beta, var.beta)


def test_bootstrap_with_an_instrument(spark, var):
    _, u, _ = var.arrays()
    rng = np.random.default_rng(8)
    z = np.where(rng.random(len(u)) < 0.4, u[:, 0] + rng.standard_normal(len(u)), 0.0)
    rows = np.arange(20, len(u))
    q = B.plan(var, 5, scheme="block", z=z[rows], rows=rows, extra={"policy": 0, "variable": 0, "scale_to": 10.0})
    iv = B.replicate(spark, q, 12, B.by_instrument)
    assert all(r["value"] == pytest.approx(1) for r in B.each(iv).where("variable = 'a' and horizon = 0").collect())
    treated = B.replicate(spark, q, 12, B.by_treatment)
    assert all(r["value"] == pytest.approx(10) for r in B.each(treated).where("variable = 'a' and horizon = 0").collect())
    point = R.response(spark, var.wold(5) @ L.treated_impact(u[rows], z[rows], z[rows] != 0, 0, 10.0), NAMES)
    moved = B.recentred(treated, point, ["variable", "horizon"], order_statistic=True)
    assert moved.count() == 18
    with pytest.raises(Exception, match="too few"):
        B.recentred(B.replicate(spark, q, 3, B.by_treatment), point, ["variable", "horizon"], order_statistic=True).collect()
    few = dataclasses.replace(q, z=np.where(np.arange(len(rows)) < 5, 1.0, 0.0))
    assert B.replicate(spark, few, 4, B.by_treatment).count() == 0
    history = B.replicate(spark, q, 3, B.by_history)
    assert B.each(history).count() == 3 * len(u) * 3
    first = dataclasses.replace(q, scheme="wild", z=z, rows=None, extra={"first": np.zeros(2), "cumulate": [1]})
    up = B.each(B.replicate(spark, first, 6, B.by_clean_instrument)).where("variable = 'a' and horizon = 0").collect()
    assert all(r["value"] >= 0 for r in up)


def test_unknown_options_are_errors(var):
    with pytest.raises(ValueError):
        B.plan(var, 3, scheme="none")
    with pytest.raises(ValueError):
        B.plan(var, 3, generator="dice")
    with pytest.raises(ValueError):
        L.shock_series(np.ones((3, 1)), np.eye(1), np.ones(1), normalize="x")


def test_inference(var):
    _, u, _ = var.arrays()
    rng = np.random.default_rng(4)
    lead = np.append(u[1:, 0], 0) + 0.5 * rng.standard_normal(len(u))
    assert I.invertibility(lead, u, 1)["pval"] < 1e-6
    assert I.invertibility(u[:, 0] + rng.standard_normal(len(u)), u, 2)["pval"] > 0.001
    with pytest.raises(ValueError):
        I.invertibility(lead, u, 0)
    assert I.ljung_box(np.cumsum(rng.standard_normal(200)))["pval"] < 1e-6
    z = u[:, 0] + 0.5 * rng.standard_normal(len(u))
    rows = np.arange(len(u))
    strong = I.weak_iv_sets(var, z, rows, 6, 0)
    assert strong["wald"] > 50 and (strong["set_kind"] == "interval").all()
    assert (strong["ar_lower"] <= strong["irf"] + 1e-9).all() and (strong["irf"] <= strong["ar_upper"] + 1e-9).all()
    assert strong["irf"][0, 0] == 1 and strong["ar_lower"][0, 0] == strong["ar_upper"][0, 0] == 1
    weak = I.weak_iv_sets(var, rng.standard_normal(len(u)), rows, 6, 0, lags=2)
    assert set(np.unique(weak["set_kind"].astype(str))) <= {"interval", "complement", "real_line", "empty"} and weak["wald"] < 10
    # The derivative of the moving average in the lag matrices, by finite differences.
    beta, h = var.beta, 4
    base = L.wold(beta, 3, 2, 1, h)[h]
    power = [np.linalg.matrix_power(L.companion(beta, 3, 2), k) for k in range(h)]
    ma = L.wold(beta, 3, 2, 1, h)
    g = sum(I._chain(power[k], ma[h - 1 - k], 3) for k in range(h))
    for i, j in ((0, 0), (2, 4), (1, 3)):
        moved = beta.copy()
        moved[1 + j, i] += 1e-6
        d = (L.wold(moved, 3, 2, 1, h)[h] - base) / 1e-6
        assert np.allclose(g[:, j * 3 + i], d.T.reshape(-1), atol=1e-5)


def test_panels_equal_single_models(spark, series):
    both = series.withColumn("panel", F.lit("p")).unionByName(series.withColumn("panel", F.lit("q")).withColumns({n: F.col(n) * 2 for n in NAMES})).unionByName(series.where("t < 4").withColumn("panel", F.lit("short")))
    got = P.panel_irf(both, "panel", NAMES, 1, 4)
    assert {r["panel"] for r in got.select("panel").distinct().collect()} == {"p", "q"}
    want = R.cholesky_irf(E.fit_var(series, NAMES, 1), 4)
    rows = {(r["variable"], r["shock"], r["horizon"]): r["value"] for r in got.where("panel = 'p'").collect()}
    assert rows["b", "a", 2] == pytest.approx(want[2, 1, 0], rel=1e-6)


def test_tidy_frames(spark, var):
    point = R.responses(spark, R.cholesky_irf(var, 4), NAMES)
    bands = B.bands(B.replicate(spark, B.plan(var, 4), 10, B.by_cholesky))
    both = T.irf_with_bands(point, bands, "a", scale=2.0)
    assert both.columns == ["variable", "horizon", "point", "lower", "upper", "lower2", "upper2"] and both.count() == 15
    assert T.irf_with_bands(point, None).columns == ["variable", "shock", "horizon", "point"]
    summed = {(r["variable"], r["horizon"]): r["point"] for r in T.irf_with_bands(point, None, "a", cumulate=["b"]).collect()}
    assert summed["b", 4] == pytest.approx(R.cholesky_irf(var, 4)[:, 1, 0].sum())
    assert T.mean_with_bands(bands, keys=("variable", "shock", "horizon")).count() == 45
    one = D.variance_shares(point).where("shock = 'a'").drop("shock")
    assert {r["shock"] for r in T.shares(one, "policy").collect()} == {"policy", "Other Shocks"}
    assert len(set(T.PALETTE)) == 15
    with pytest.warns(UserWarning):
        assert T.colours(16) == [*T.PALETTE, T.PALETTE[0]]
    assert T.colours(2, reverse=True) == T.PALETTE[:-3:-1]


def test_generalized_instrument_responses(var):
    _, u, _ = var.arrays()
    z = np.append(0.0, u[:-1, 0]) + u[:, 0]
    irf, psi = R.generalized_iv(var, z, 1, 6)
    assert irf.shape == (7, 3) and psi.shape == (2, 3)
    lo, hi = R.scale_bounds(psi, var.sigma, z)
    assert lo > 0 and hi == pytest.approx(z.std(ddof=1))
    assert D.recoverable_history(irf, z).shape == (len(z), 3)


def test_wide_moments_equal_narrow_ones(series, monkeypatch):
    d = E.lag_matrix(series, NAMES, 2)
    names = E.lag_names(NAMES, 2) + NAMES
    n, mean, cov = E.moments(d, names)
    monkeypatch.setattr(E, "NARROW", 2)
    n2, mean2, cov2 = E.moments(d, names)
    assert n == n2 and np.allclose(mean, mean2) and np.allclose(cov, cov2)
    assert E.moments(d.limit(0), names)[0] == 0


def test_models_of_long_series_aggregate_moments(spark, monkeypatch):
    """The driver's fit and the distributed one are the same, rows with nulls left out of both."""
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=(120, 2)), axis=0) * 0.3
    rows = [(i + 1, None if i == 50 else float(a), float(b), float(a * b)) for i, (a, b) in enumerate(y)]
    series = spark.createDataFrame(rows, "t long, y1 double, y2 double, x double")
    near = E.fit_var(series, ["y1", "y2"], 2, exog=["x"])
    lags = E.lag_selection(series, ["y1", "y2"], 3)
    monkeypatch.setattr(E, "LOCAL", 10)
    far = E.fit_var(series, ["y1", "y2"], 2, exog=["x"])
    assert near.regression.rows == far.regression.rows == 115
    assert np.allclose(near.beta, far.beta) and np.allclose(near.sigma, far.sigma)
    assert np.allclose(lags, E.lag_selection(series, ["y1", "y2"], 3))


def test_history_by_recursion_and_by_join_agree(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(40, 2))
    v = E.fit_var(spark.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(y)], "t long, a double, b double"), ["a", "b"], 2)
    chol = np.linalg.cholesky(v.sigma)
    ran = {(r["t"], r["variable"], r["shock"]): r["value"] for r in D.historical_var(v, chol, ["a", "b"]).collect()}
    irf = R.responses(spark, R.cholesky_irf(v, 37, chol), ["a", "b"])
    joined = {(r["t"], r["variable"], r["shock"]): r["value"] for r in D.historical(irf, D.structural_shocks(v, chol, ["a", "b"])).collect()}
    assert ran.keys() == joined.keys() and all(abs(ran[k] - joined[k]) < 1e-9 for k in ran)


def test_ridge_is_for_failing_matrices_only():
    good, bad = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([[1.0, 1.0], [1.0, 1.0]])
    both = L.cholesky(np.stack([good, bad]))
    assert np.array_equal(both[0], np.linalg.cholesky(good)) and np.allclose(both[1] @ both[1].T, bad, atol=1e-6)


def test_panels_of_any_type(spark):
    rng = np.random.default_rng(6)
    rows = [(k, t, *map(float, rng.normal(size=2))) for k in (1, 2) for t in range(1, 40)]
    got = P.panel_irf(spark.createDataFrame(rows, "shop long, t long, a double, b double"), "shop", ["a", "b"], 1, 3)
    assert dict(got.dtypes)["shop"] == "bigint" and got.count() == 2 * 4 * 4


def test_ranks_follow_the_levels(spark):
    got = T.ranked(spark.createDataFrame([("b",), ("a",), ("z",)], "variable string"), ["b", "a"]).collect()
    assert {r["variable"]: r["variable_rank"] for r in got} == {"b": 1, "a": 2, "z": None}
