"""Dense kernels of vector autoregressions, on arrays alone.

Layouts: a series is (T, N), rows in time; coefficients are (K, N), rows [intercept if c] + lag 1 of every variable +
... + lag p + exogenous; moving-average coefficients are (H + 1, N, N), the first index the horizon. Leading batch axes
are allowed where a docstring says so.
"""

from __future__ import annotations

import numpy as np


def lagged(y: np.ndarray, p: int) -> np.ndarray:
    """Lag-major regressors of rows p on: (..., T - p, N p)."""
    t = y.shape[-2]
    return np.concatenate([y[..., p - k : t - k, :] for k in range(1, p + 1)], axis=-1)


def design(y: np.ndarray, p: int, c: int = 1, exog: np.ndarray | None = None) -> np.ndarray:
    """(..., T - p, K); exogenous columns enter at time t, their first p rows unused."""
    blocks = [lagged(y, p)]
    if c:
        blocks.insert(0, np.ones((*y.shape[:-2], y.shape[-2] - p, 1)))
    if exog is not None:
        blocks.append(np.broadcast_to(exog[p:], (*y.shape[:-2], *exog[p:].shape)))
    return np.concatenate(blocks, axis=-1)


def fit(y: np.ndarray, p: int, c: int = 1, exog: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and residual covariance (divisor: rows less coefficients); batched."""
    x, target = design(y, p, c, exog), y[..., p:, :]
    xt = np.swapaxes(x, -1, -2)
    beta = np.linalg.solve(xt @ x, xt @ target)
    u = target - x @ beta
    sigma = np.swapaxes(u, -1, -2) @ u / (x.shape[-2] - x.shape[-1])
    return beta, u, sigma


def fit_with_lagged_exog(y: np.ndarray, ex: np.ndarray, p: int, c: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residuals where exogenous columns enter at t and at lags 1..p, after the lags of y."""
    x = np.concatenate([*([np.ones((len(y) - p, 1))] if c else []), lagged(y, p), ex[p:], lagged(ex, p)], axis=1)
    beta = np.linalg.solve(x.T @ x, x.T @ y[p:])
    return beta, y[p:] - x @ beta


def lag_blocks(beta: np.ndarray, n: int, p: int, c: int = 1) -> np.ndarray:
    """(..., p, N, N): the matrix of each lag, rows equations."""
    rows = beta[..., c : c + n * p, :]
    return np.swapaxes(rows.reshape(*rows.shape[:-2], p, n, n), -1, -2)


def wold(beta: np.ndarray, n: int, p: int, c: int, horizon: int) -> np.ndarray:
    """Moving-average coefficients 0..horizon: each the lagged ones times the lag matrices; batched."""
    a = lag_blocks(beta, n, p, c)
    out = np.zeros((*a.shape[:-3], horizon + 1, n, n))
    out[..., 0, :, :] = np.eye(n)
    for h in range(1, horizon + 1):
        for k in range(1, min(h, p) + 1):
            out[..., h, :, :] += out[..., h - k, :, :] @ a[..., k - 1, :, :]
    return out


def companion(beta: np.ndarray, n: int, p: int, c: int = 1) -> np.ndarray:
    out = np.eye(n * p, k=-n)
    out[:n] = beta[c : c + n * p].T
    return out


def cholesky(sigma: np.ndarray) -> np.ndarray:
    """Lower factor; with a small ridge for each matrix that is no longer positive definite, and for no other."""
    try:
        return np.linalg.cholesky(sigma)
    except np.linalg.LinAlgError:
        if sigma.ndim > 2:
            return np.stack([cholesky(m) for m in sigma])
        return np.linalg.cholesky(sigma + 1e-8 * np.trace(sigma) / len(sigma) * np.eye(len(sigma)))


def long_run_impact(ma: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The impact matrix whose summed responses over the horizons are lower triangular; batched."""
    total = ma.sum(axis=-3)
    return np.linalg.solve(total, cholesky(total @ sigma @ np.swapaxes(total, -1, -2)))


def _signed(response: np.ndarray) -> np.ndarray:
    """(..., H, N) with the first variable's response at the last horizon not negative."""
    return response * np.where(response[..., -1, 0] < 0, -1.0, 1.0)[..., None, None]


def long_run_max(ma: np.ndarray, s: np.ndarray, target: int) -> np.ndarray:
    """(..., H, N): responses to the shock that moves the target most at the last horizon but not through the first column of s; batched."""
    m = (ma[..., -1, target, None, :] @ s)[..., 0, 1:]
    size = np.linalg.norm(m, axis=-1, keepdims=True)
    h = np.concatenate([np.zeros((*m.shape[:-1], 1)), np.where(size > 1e-14, m / np.maximum(size, 1e-300), 0.0)], axis=-1)
    return _signed((ma @ (s @ h[..., None])[..., None, :, :])[..., 0])


def max_share_vector(ma: np.ndarray, s: np.ndarray, target: int) -> np.ndarray:
    """The unit vector, zero first, of largest summed forecast-error share of the target over all horizons; sign free; batched."""
    d = (ma[..., target, None, :] @ s[..., None, :, :])[..., 0, :]
    weights = np.arange(d.shape[-2], 0, -1.0)[:, None, None]
    omega = (weights * d[..., :, None] * d[..., None, :]).sum(axis=-3)
    _, vectors = np.linalg.eigh(omega[..., 1:, 1:])
    top = vectors[..., -1]
    return np.concatenate([np.zeros((*top.shape[:-1], 1)), top], axis=-1)


def max_share(ma: np.ndarray, s: np.ndarray, target: int) -> np.ndarray:
    """(..., H, N): responses to the max-share shock under the sign rule of long_run_max."""
    h = max_share_vector(ma, s, target)
    return _signed((ma @ (s @ h[..., None])[..., None, :, :])[..., 0])


def convolve(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """Coefficients 0..lags-1 of the product of matrix polynomials (lag first)."""
    out = np.zeros((lags, a.shape[1], b.shape[2]))
    for i in range(min(len(a), lags)):
        for j in range(min(len(b), lags - i)):
            out[i + j] += a[i] @ b[j]
    return out


def simulate(first: np.ndarray, beta: np.ndarray, shocks: np.ndarray, p: int, c: int = 1, exog: np.ndarray | None = None) -> np.ndarray:
    """Series from their first p rows on, driven by shocks (B, T - p, N): (B, T, N). exog: (T, M), whose coefficients follow the lags."""
    b, steps, n = shocks.shape
    out = np.empty((b, steps + p, n))
    out[:, :p] = first
    base = np.zeros((steps, n)) + (beta[0] if c else 0)
    if exog is not None:
        base = base + exog[p:] @ beta[c + n * p :]
    # Lags from the farthest on, as they stand in the series.
    a = lag_blocks(beta, n, p, c)[::-1].transpose(0, 2, 1).reshape(p * n, n)
    base = base + shocks
    for t in range(steps):
        out[:, t + p] = out[:, t : t + p].reshape(b, p * n) @ a + base[:, t]
    return out


def stable(beta: np.ndarray, n: int, p: int, c: int) -> bool:
    return bool(np.abs(np.linalg.eigvals(companion(beta, n, p, c))).max() < 1)


def bias_corrected(beta: np.ndarray, mean: np.ndarray, n: int, p: int, c: int) -> np.ndarray:
    """beta less the bias that bootstrap means show, shrunk in steps of a hundredth until stable; an unstable beta, or one that never gets stable, stays."""
    if not stable(beta, n, p, c):
        return beta
    for step in range(101):
        candidate = beta - (mean - beta) * (1 - step / 100)
        if stable(candidate, n, p, c):
            return candidate
    return beta


def ols(y: np.ndarray, x: np.ndarray, c: int = 1, lags: int = 0) -> dict:
    """Least squares with centred R², the F test of all slopes, and its robust form: White's with the sample correction, or Newey-West's with Bartlett weights if lags > 0."""
    x = x.reshape(len(y), -1)
    full = np.column_stack([np.ones(len(y)), x]) if c else x
    t, k = full.shape
    inverse = np.linalg.inv(full.T @ full)
    beta = inverse @ (full.T @ y)
    fitted = full @ beta
    err = y - fitted
    ssr, tss = err @ err, ((y - y.mean()) ** 2).sum()
    slopes = slice(1, k) if c else slice(0, k)
    q = k - (1 if c else 0)
    score = full * err[:, None]
    middle = score.T @ score
    for j in range(1, lags + 1):
        g = score[j:].T @ score[:-j]
        middle = middle + (1 - j / (lags + 1)) * (g + g.T)
    robust = inverse @ middle @ inverse * (t / (t - k))
    plain = inverse * (ssr / (t - k))

    def wald(v: np.ndarray) -> float:
        b = beta[slopes]
        return float(b @ np.linalg.solve(v[slopes, slopes], b) / q) if q else float("nan")

    return {"beta": beta, "fitted": fitted, "err": err, "r2": 1 - ssr / tss, "r2adj": 1 - (t - 1) / (t - k) * ssr / tss, "f": wald(plain), "f_robust": wald(robust), "slope_part": x @ beta[slopes]}


def shock_series(u: np.ndarray, sigma: np.ndarray, s: np.ndarray, size: float = 1.0, normalize: str = "unit") -> np.ndarray:
    """The shock behind an impact vector: divided by s'S⁻¹s and scaled (unit), or by its square root (sd); (T,)."""
    w = np.linalg.solve(sigma, s)
    if normalize == "unit":
        return size * (u @ w) / (s @ w)
    if normalize == "sd":
        return (u @ w) / np.sqrt(s @ w)
    raise ValueError(f"normalize: {normalize!r} is neither 'unit' nor 'sd'")


def contributions(ma: np.ndarray, s: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """(T, N): what the shock series has moved each variable by, through responses ma @ s, up to each time."""
    response = ma @ s
    out = np.zeros((len(shocks), s.shape[0]))
    for h in range(min(len(response), len(shocks))):
        out[h:] += np.outer(shocks[: len(shocks) - h], response[h])
    return out


def moved(a: np.ndarray, s: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """contributions() of responses that the lag matrices a (p, N, N) give, by running through time: T p N^2 steps."""
    p, n = a.shape[:2]
    out = np.zeros((len(shocks) + p, n))
    wide = a[::-1].transpose(0, 2, 1).reshape(p * n, n)
    for t, e in enumerate(shocks):
        out[t + p] = out[t : t + p].reshape(-1) @ wide + s * e
    return out[p:]


def block_size(t: int) -> int:
    """The usual block length for t rows, rounded half away from zero."""
    return int(np.floor(5.03 * t**0.25 + 0.5))


def block_means(x: np.ndarray, size: int, nonzero: bool = False) -> np.ndarray:
    """(size, k): the mean at each place of a block over all overlapping blocks; of the entries that aren't zero only, if asked."""
    last = len(x) - size
    rows = [x[j : j + last + 1] for j in range(size)]
    if not nonzero:
        return np.stack([r.mean(axis=0) for r in rows])
    return np.stack([np.where((n := (r != 0).sum(axis=0)) > 0, r.sum(axis=0) / np.maximum(n, 1), 0.0) for r in rows])


def block_rows(starts: np.ndarray, size: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(B, t) rows that blocks from the starts (B, blocks) take, and the place of each in its block."""
    rows = (starts[..., None] + np.arange(size)).reshape(len(starts), -1)[:, :t]
    return rows, np.tile(np.arange(size), starts.shape[1])[:t]


def iv_impact(u: np.ndarray, z: np.ndarray, policy: int) -> np.ndarray:
    """Two-stage impact vector, 1 at the policy variable: its residual on the instruments without constant, then the others on what these explain; batched over leading axes."""
    z = z[..., None] if z.ndim == u.ndim - 1 else z
    zt = np.swapaxes(z, -1, -2)
    first = z @ np.linalg.solve(zt @ z, zt @ u[..., policy : policy + 1])
    s = (np.swapaxes(first, -1, -2) @ u)[..., 0, :] / (first**2).sum(axis=(-1, -2))[..., None]
    s[..., policy] = 1.0
    return s


def treated_impact(u: np.ndarray, z: np.ndarray, treated: np.ndarray, variable: int, scale: float) -> np.ndarray:
    """Impact vector from the treated rows alone, instrument and residuals demeaned within them, scaled at the variable."""
    uz, zz = u[treated] - u[treated].mean(axis=0), z[treated] - z[treated].mean()
    b = uz.T @ zz / (zz @ zz)
    return b * (scale / b[variable])


def clean_instrument(z: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """The instrument's residual on a constant, p own lags and p lags of y; the first p rows are lost."""
    x = np.column_stack([np.ones(len(z) - p), lagged(z[:, None], p), lagged(y, p)])
    target = z[p:]
    return target - x @ np.linalg.lstsq(x, target, rcond=None)[0]


def frequencies(bins: int, low: float, high: float, fourier: bool) -> np.ndarray:
    """Angular frequencies of cycles of low to high periods: of the Fourier grid k pi / bins, or evenly from end to end."""
    lo, hi = 2 * np.pi / high, 2 * np.pi / low
    if not fourier:
        return np.linspace(lo, hi, bins)
    grid = np.arange(1, bins + 1) * np.pi / bins
    return grid[(grid >= lo) & (grid <= hi)]


def spectral_share(all_: np.ndarray, one: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """(N,): the share of each variable's variance at the frequencies that the one shock (H, N) of all (H, N, N) makes; NaN without frequencies."""
    wave = np.exp(-1j * np.outer(omega, np.arange(len(one))))
    top = (np.abs(wave @ one) ** 2).sum(axis=0)
    whole = (np.abs(np.tensordot(wave, all_, axes=(1, 0))) ** 2).sum(axis=(0, 2))
    with np.errstate(invalid="ignore", divide="ignore"):
        return top / whole
