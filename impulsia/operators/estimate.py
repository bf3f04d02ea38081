"""Estimation from distributed moments.

What is fitted needs means and covariances of regressors and targets only: one aggregation, whatever the number of
rows, gives them; the K x K solve is the driver's. Moments are centred, so that levels far from zero cost no digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impulsia.functions import linalg as L
from impulsia.operators.series import ordered
from impulsia.sources.tables import frame, prepare


def lag_matrix(series: DataFrame, names: Sequence[str], p: int, panel: Sequence[str] = ()) -> DataFrame:
    """series with <name>_l<k>, lag by lag; rows without all lags go."""
    w = ordered(panel)
    out = series.select("*", *(F.lag(n, k).over(w).alias(f"{n}_l{k}") for k in range(1, p + 1) for n in names), F.row_number().over(w).alias("_r"))
    return out.where(F.col("_r") > p).drop("_r")


def lag_names(names: Sequence[str], p: int) -> list[str]:
    return [f"{n}_l{k}" for k in range(1, p + 1) for n in names]


#: Up to so many columns moments are aggregate expressions; beyond, blocks of rows become matrices in workers.
NARROW = 20
#: Partial moments that the driver merges at most.
MERGED = 64


def moments(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows without a null, means, and covariances (divisor: rows)."""
    rows = df.select(*names).dropna()
    if len(names) > NARROW:
        return _wide_moments(rows, len(names))
    k = len(names)
    cells = [F.covar_pop(names[i], names[j]) for i in range(k) for j in range(i + 1)]
    row = rows.agg(F.count(F.lit(1)), *(F.avg(n) for n in names), *cells).first()
    cov = np.zeros((k, k))
    cov[np.tril_indices(k)] = [np.nan if v is None else v for v in row[1 + k :]]
    return row[0], np.array([np.nan if v is None else v for v in row[1 : 1 + k]], float), cov + np.tril(cov, -1).T


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Numbers, means and centred products of parts, as of the whole."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


_PARTIAL = "part int, n long, mean binary, product binary"


def _packed(part: int, m: tuple[int, np.ndarray, np.ndarray]) -> list[pa.Array]:
    return [pa.array([part], pa.int32()), pa.array([m[0]], pa.int64()), pa.array([m[1].tobytes()], pa.binary()), pa.array([m[2].tobytes()], pa.binary())]


def _unpacked(rows) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(n, np.frombuffer(a, float), np.frombuffer(b, float).reshape(len(a) // 8, -1)) for n, a, b in rows]


_FIELDS = ["part", "n", "mean", "product"]


def _wide_moments(rows: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    prepare(rows.sparkSession)

    def partial(batches):
        found = []
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.asarray(c.cast(pa.float64())) for c in batch.columns])
                mean = x.mean(axis=0)
                found.append((len(x), mean, (x - mean).T @ (x - mean)))
        if found:
            yield pa.RecordBatch.from_arrays(_packed(TaskContext.get().partitionId() % MERGED, _merge(found)), names=_FIELDS)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table(_packed(key[0].as_py(), _merge(_unpacked(zip(*(table.column(c).to_pylist() for c in _FIELDS[1:]), strict=True)))), names=_FIELDS)

    got = rows.mapInArrow(partial, _PARTIAL).groupBy("part").applyInArrow(merged, _PARTIAL).collect()
    if not got:
        return 0, np.full(k, np.nan), np.full((k, k), np.nan)
    n, mean, product = _merge(_unpacked([(r["n"], bytes(r["mean"]), bytes(r["product"])) for r in sorted(got, key=lambda r: r["part"])]))
    return n, mean, product / n


@dataclass
class Regression:
    """Coefficients of targets on regressors: rows [intercept if c] + regressors."""

    targets: list[str]
    regressors: list[str]
    c: int
    rows: int
    beta: np.ndarray
    ssr: np.ndarray
    means: np.ndarray
    cov: np.ndarray

    def terms(self) -> list[str]:
        return (["const"] if self.c else []) + self.regressors

    def fitted(self, i: int) -> Column:
        b = self.beta[:, i]
        terms = [F.col(r) * F.lit(float(v)) for r, v in zip(self.regressors, b[self.c :], strict=True)]
        return sum(terms, F.lit(float(b[0]) if self.c else 0.0))

    def residuals(self, df: DataFrame, prefix: str = "u_") -> DataFrame:
        """df with a residual <prefix><target> for each target."""
        return df.withColumns({f"{prefix}{t}": F.col(t) - self.fitted(i) for i, t in enumerate(self.targets)})

    def gram_inverse(self) -> np.ndarray:
        """The inverse of X'X, intercept first."""
        k, n = len(self.regressors), self.rows
        xx = self.cov[:k, :k] * n
        mean = self.means[:k]
        if not self.c:
            return np.linalg.inv(xx + n * np.outer(mean, mean))
        inner = np.linalg.inv(xx)
        out = np.empty((k + 1, k + 1))
        out[1:, 1:] = inner
        out[0, 1:] = out[1:, 0] = -inner @ mean
        out[0, 0] = 1 / n + mean @ inner @ mean
        return out


def regress(df: DataFrame, targets: Sequence[str], regressors: Sequence[str], c: int = 1) -> Regression:
    if c not in (0, 1):
        raise ValueError(f"c: {c!r} is neither 0 nor 1")
    return _solved(targets, regressors, c, *moments(df, [*regressors, *targets]))


def _solved(targets: Sequence[str], regressors: Sequence[str], c: int, n: int, mean: np.ndarray, cov: np.ndarray) -> Regression:
    k = len(regressors)
    second = cov if c else cov + np.outer(mean, mean)
    slopes = np.linalg.solve(second[:k, :k], second[:k, k:])
    beta = np.vstack([mean[k:] - mean[:k] @ slopes, slopes]) if c else slopes
    ssr = n * (second[k:, k:] - second[k:, :k] @ slopes)
    return Regression(list(targets), list(regressors), c, n, beta, ssr, mean, cov)


#: Periods that the driver takes at once, in one job, to fit from; of longer series moments are aggregated.
LOCAL = 100_000


def collected(series: DataFrame, names: Sequence[str]) -> pa.Table | None:
    """t and the columns as doubles by time, in one job; None where there are more than LOCAL rows."""
    got = series.select("t", *(F.col(n).cast("double").alias(n) for n in names)).orderBy("t").limit(LOCAL + 1).toArrow()
    return got if got.num_rows <= LOCAL else None


def _columns(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in names]).reshape(table.num_rows, len(names))


def _lag_moments(y: np.ndarray, ex: np.ndarray | None, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """moments() of lags 1..p, exogenous columns and targets."""
    x = np.column_stack([L.lagged(y, p), *([] if ex is None else [ex[p:]]), y[p:]])
    x = x[~np.isnan(x).any(axis=1)]
    if not len(x):
        k = x.shape[1]
        return 0, np.full(k, np.nan), np.full((k, k), np.nan)
    mean = x.mean(axis=0)
    return len(x), mean, (x - mean).T @ (x - mean) / len(x)


@dataclass
class Var:
    """A fitted vector autoregression."""

    series: DataFrame
    names: list[str]
    p: int
    c: int
    exog: list[str]
    regression: Regression
    _arrays: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.names)

    @property
    def beta(self) -> np.ndarray:
        return self.regression.beta

    @property
    def sigma(self) -> np.ndarray:
        r = self.regression
        return r.ssr / (r.rows - len(r.beta))

    def wold(self, horizon: int) -> np.ndarray:
        return L.wold(self.beta, self.n, self.p, self.c, horizon)

    def design(self) -> DataFrame:
        return lag_matrix(self.series, self.names, self.p)

    def residuals(self) -> DataFrame:
        """t and a residual u_<name> a variable."""
        return self.regression.residuals(self.design()).select("t", *(f"u_{n}" for n in self.names))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Series, residuals and exogenous columns as arrays by time: T rows of a few numbers, for kernels that run through time."""
        if not self._arrays:
            rows = self.series.orderBy("t").select(*self.names, *self.exog).collect()
            data = np.array([list(r) for r in rows], float).reshape(-1, self.n + len(self.exog))
            self._keep(data[:, : self.n], data[:, self.n :] if self.exog else None)
        return self._arrays["y"], self._arrays["u"], self._arrays["ex"]

    def _keep(self, y: np.ndarray, ex: np.ndarray | None) -> None:
        u = y[self.p :] - L.design(y, self.p, self.c, ex) @ self.beta
        self._arrays.update(y=y, u=u, ex=ex)


def fit_var(series: DataFrame, names: Sequence[str], p: int, c: int = 1, exog: Sequence[str] = ()) -> Var:
    """Each variable on [1,] lags 1..p of all and exogenous columns at t. A series of up to LOCAL periods is read once and fitted on the driver; of a longer one moments are aggregated."""
    if c not in (0, 1):
        raise ValueError(f"c: {c!r} is neither 0 nor 1")
    names, exog = list(names), list(exog)
    x, table = lag_names(names, p) + exog, collected(series, [*names, *exog])
    if table is None:
        return Var(series, names, p, c, exog, regress(lag_matrix(series, names, p), names, x, c))
    y, ex = _columns(table, names), _columns(table, exog) if exog else None
    v = Var(series.sparkSession.createDataFrame(table), names, p, c, exog, _solved(names, x, c, *_lag_moments(y, ex, p)))
    v._keep(y, ex)
    return v


def fit_varx(series: DataFrame, names: Sequence[str], exog: Sequence[str], p: int, c: int = 1) -> Regression:
    """As fit_var, with exogenous columns at t and at lags 1..p."""
    d = lag_matrix(series, [*names, *exog], p)
    return regress(d, names, lag_names(names, p) + list(exog) + lag_names(exog, p), c)


def coefficients(r: Regression | Var, spark) -> DataFrame:
    r = r.regression if isinstance(r, Var) else r
    return frame(spark, [(e, t, float(r.beta[i, j])) for j, e in enumerate(r.targets) for i, t in enumerate(r.terms())], "equation string, term string, value double")


def matrix(spark, m: np.ndarray, rows: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return frame(spark, [(a, b, float(m[i, j])) for i, a in enumerate(rows) for j, b in enumerate(cols)], "row string, col string, value double")


def ols(df: DataFrame, target: str, regressors: Sequence[str], c: int = 1, lags: int | str = 0, time: str = "t") -> dict:
    """Summary of one regression: coefficients, centred R², F of all slopes and its robust form (White, or Newey-West of so many lags; "auto": 0.75 T^(1/3)). Moments, and then products of scores, are aggregated."""
    r = regress(df, [target], regressors, c)
    t, k = r.rows, len(r.beta)
    lags = int(np.floor(0.75 * t ** (1 / 3))) if lags == "auto" else int(lags)
    scored = r.residuals(df.dropna(subset=[target, *regressors]))
    terms = ([F.lit(1.0)] if c else []) + [F.col(x) for x in regressors]
    scored = scored.select(time, *((x * F.col(f"u_{target}")).alias(f"s{i}") for i, x in enumerate(terms)))
    w = ordered((), time)
    if lags:
        scored = scored.select("*", *(F.lag(f"s{i}", j).over(w).alias(f"s{i}_{j}") for j in range(1, lags + 1) for i in range(k)))
    sums = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]
    sums += [F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"s{j}_{m}")), F.lit(0.0)) for m in range(1, lags + 1) for i in range(k) for j in range(k)]
    values = np.array(list(scored.agg(*sums).first()), float).reshape(lags + 1, k, k)
    middle = values[0] + sum((1 - m / (lags + 1)) * (values[m] + values[m].T) for m in range(1, lags + 1))
    inverse = r.gram_inverse()
    ssr, tss = float(r.ssr[0, 0]), float(r.cov[-1, -1] * t)
    b, slope = r.beta[c:, 0], slice(c, k)

    def wald(v: np.ndarray) -> float:
        return float(b @ np.linalg.solve(v[slope, slope], b) / len(b))

    return {"regression": r, "beta": r.beta[:, 0], "r2": 1 - ssr / tss, "r2adj": 1 - (t - 1) / (t - k) * ssr / tss, "f": wald(inverse * (ssr / (t - k))), "f_robust": wald(inverse @ middle @ inverse * (t / (t - k))), "rows": t, "ssr": ssr}


def lag_selection(series: DataFrame, names: Sequence[str], pmax: int, c: int = 1, exog: Sequence[str] = ()) -> list[tuple[int, float, float, float]]:
    """(p, AIC, BIC, HQ) of p = 1..pmax, each on the rows that its own lags leave, with the full number of rows in the formulas; the penalty counts an intercept an equation and one coefficient an exogenous column."""
    table, n, m = collected(series, [*names, *exog]), len(names), len(exog)
    t, out = series.count() if table is None else table.num_rows, []
    for p in range(1, pmax + 1):
        if table is None:
            ssr = fit_var(series, names, p, c, exog).regression.ssr
        else:
            ex = _columns(table, exog) if exog else None
            ssr = _solved(names, lag_names(names, p) + list(exog), c, *_lag_moments(_columns(table, names), ex, p)).ssr
        a = float(np.log(np.linalg.det(ssr / t)))
        b = (p * n * n + n + m) / t
        out.append((p, a + 2 * b, a + np.log(t) * b, a + 2 * b * np.log(np.log(t))))
    return out


def best_lags(table: list[tuple[int, float, float, float]]) -> dict[str, int]:
    """The lags of each criterion's smallest value; of ties, the fewest."""
    return {name: min(table, key=lambda r: (r[i], r[0]))[0] for i, name in ((1, "aic"), (2, "bic"), (3, "hq"))}
