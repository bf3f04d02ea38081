"""Dense kernels against direct algebra."""

import math

import numpy as np
import pytest

from impulsia.functions import linalg as L
from impulsia.functions import tails


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    a1, a2 = np.array([[0.5, 0.1, 0.0], [0.0, 0.4, 0.2], [0.1, 0.0, 0.3]]), np.array([[0.1, 0.0, 0.05], [0.0, 0.1, 0.0], [0.0, 0.05, 0.1]])
    s = np.array([[1.0, 0, 0], [0.5, 1, 0], [-0.3, 0.2, 0.7]])
    y = np.zeros((4000, 3))
    for t in range(2, 4000):
        y[t] = [1, 0, -1] + a1 @ y[t - 1] + a2 @ y[t - 2] + s @ rng.standard_normal(3)
    beta, u, sigma = L.fit(y, 2)
    return {"y": y, "beta": beta, "u": u, "sigma": sigma, "a": (a1, a2), "s": s}


def test_fit_recovers_the_process(model):
    assert np.abs(model["beta"][1:4].T - model["a"][0]).max() < 0.06
    assert np.abs(model["sigma"] - model["s"] @ model["s"].T).max() < 0.1
    x = L.design(model["y"], 2)
    assert np.abs(x.T @ model["u"]).max() < 1e-5
    assert np.allclose(np.linalg.lstsq(x, model["y"][2:], rcond=None)[0], model["beta"])


def test_batched_fit_equals_single(model):
    y = np.stack([model["y"][:200], model["y"][500:700]])
    beta, u, sigma = L.fit(y, 2)
    for i in range(2):
        b, e, s = L.fit(y[i], 2)
        assert np.allclose(b, beta[i]) and np.allclose(e, u[i]) and np.allclose(s, sigma[i])


def test_wold_equals_companion_powers(model):
    ma, c = L.wold(model["beta"], 3, 2, 1, 12), L.companion(model["beta"], 3, 2)
    power = np.eye(6)
    for h in range(13):
        assert np.allclose(ma[h], power[:3, :3])
        power = power @ c


def test_long_run_impact(model):
    ma = L.wold(model["beta"], 3, 2, 1, 30)
    k = L.long_run_impact(ma, model["sigma"])
    total = ma.sum(0) @ k
    assert np.allclose(k @ k.T, model["sigma"]) and np.allclose(np.triu(total, 1), 0)


def test_maximising_shocks(model):
    ma, s = L.wold(model["beta"], 3, 2, 1, 20), np.linalg.cholesky(model["sigma"])
    h = L.max_share_vector(ma, s, 1)
    assert h[0] == 0 and np.linalg.norm(h) == pytest.approx(1)
    d = (ma @ s)[:, 1, 1:]
    share = lambda v: sum(((d[: k + 1] @ v) ** 2).sum() for k in range(21))
    best, last = share(h[1:]), np.abs(L.long_run_max(ma, s, 1)[-1, 1])
    for angle in np.linspace(0, np.pi, 50):
        v = np.array([np.cos(angle), np.sin(angle)])
        assert share(v) <= best + 1e-9 and abs(d[-1] @ v) <= last + 1e-9
    assert L.long_run_max(ma, s, 1)[-1, 0] >= 0 and L.max_share(ma, s, 1)[-1, 0] >= 0
    batch = np.stack([ma, ma])
    assert np.allclose(L.max_share(batch, np.stack([s, s]), 1)[1], L.max_share(ma, s, 1))
    assert np.allclose(L.long_run_max(batch, np.stack([s, s]), 1)[1], L.long_run_max(ma, s, 1))


def test_convolution():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((4, 1, 1)), rng.standard_normal((3, 1, 1))
    assert np.allclose(L.convolve(a, b, 6)[:, 0, 0], np.convolve(a[:, 0, 0], b[:, 0, 0]))


def test_simulation_gives_the_series_back(model):
    y = L.simulate(model["y"][:2], model["beta"], model["u"][None], 2)
    assert np.allclose(y[0], model["y"])
    ex = np.sin(np.arange(300.0))[:, None]
    beta, u, _ = L.fit(model["y"][:300], 2, 1, ex)
    assert np.allclose(L.simulate(model["y"][:2], beta, u[None], 2, 1, ex)[0], model["y"][:300])


def test_bias_correction_stays_stable(model):
    beta = model["beta"]
    assert np.allclose(L.bias_corrected(beta, beta, 3, 2, 1), beta)
    far = beta.copy()
    far[1:4] -= np.eye(3)
    fixed = L.bias_corrected(beta, far, 3, 2, 1)
    assert L.stable(fixed, 3, 2, 1) and not np.allclose(fixed, beta)
    wild = beta + 0.0
    wild[1, 0] = 3
    assert L.bias_corrected(wild, beta, 3, 2, 1) is wild


def test_ols_against_direct_formulas():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 2))
    y = 1 + x @ [0.5, -0.2] + rng.standard_normal(80) * (1 + np.abs(x[:, 0]))
    r = L.ols(y, x)
    full = np.column_stack([np.ones(80), x])
    inv = np.linalg.inv(full.T @ full)
    v = inv @ (full.T * r["err"] ** 2) @ full @ inv * 80 / 77
    assert r["f_robust"] == pytest.approx(r["beta"][1:] @ np.linalg.inv(v[1:, 1:]) @ r["beta"][1:] / 2)
    assert r["f"] == pytest.approx((r["r2"] / 2) / ((1 - r["r2"]) / 77))
    assert L.ols(y, x, lags=3)["f_robust"] != pytest.approx(r["f_robust"])


def test_contributions_are_the_companion_recursion(model):
    u, sigma = model["u"][:200], model["sigma"]
    s = np.array([1.0, 0.4, -0.2])
    v = L.shock_series(u, sigma, s)
    hd = L.contributions(L.wold(model["beta"], 3, 2, 1, 199), s, v)
    c, state = L.companion(model["beta"], 3, 2), np.zeros(6)
    for t in range(200):
        state = c @ state
        state[:3] += s * v[t]
        assert np.allclose(state[:3], hd[t])


def test_historical_columns_equal_one_shock_histories(model):
    k = np.linalg.cholesky(model["sigma"])
    u, ma = model["u"][:100], L.wold(model["beta"], 3, 2, 1, 99)
    e = u @ np.linalg.inv(k).T
    for j in range(3):
        assert np.allclose(L.contributions(ma, k[:, j], e[:, j]), L.contributions(ma, k[:, j], L.shock_series(u, model["sigma"], k[:, j])))


def test_block_centring_skips_zeros():
    z = np.array([0, 2.0, 0, 4, 0, 6, 0, 8])[:, None]
    m = L.block_means(z, 3, nonzero=True)[:, 0]
    assert m.tolist() == [np.mean([2, 4, 6]), np.mean([2, 4, 6]), np.mean([4, 6, 8])]
    assert L.block_size(417) == round(5.03 * 417**0.25)


def test_parseval():
    rng = np.random.default_rng(7)
    d = rng.standard_normal((20, 2, 2))
    omega = np.arange(64) * 2 * np.pi / 64
    share = L.spectral_share(d, d[:, :, 0], omega)
    assert np.allclose(share, (d[:, :, 0] ** 2).sum(0) / (d**2).sum((0, 2)))
    assert np.isnan(L.spectral_share(d, d[:, :, 0], L.frequencies(4, 1e6, 2e6, True))).all()
    assert len(L.frequencies(16, 2, 1e9, True)) == 16


def test_tails():
    assert tails.chi2_tail(3.3, 2) == pytest.approx(math.exp(-1.65))
    assert tails.chi2_tail(40, 4) == pytest.approx(math.exp(-20) * 21)
    assert tails.f_tail(2.5, 2, 30) == pytest.approx((30 / (30 + 5)) ** 15)
    assert tails.f_tail(4.0, 1, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
