"""Identified impulse responses as tidy frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impulsia.functions import linalg as L
from impulsia.operators.estimate import Var
from impulsia.operators.series import cumulated
from impulsia.sources.tables import frame

ALL = "variable string, shock string, horizon int, value double"
ONE = "variable string, horizon int, value double"


def responses(spark: SparkSession, irf: np.ndarray, names: Sequence[str], shocks: Sequence[str] | None = None) -> DataFrame:
    """(H, N, N) as variable, shock, horizon, value."""
    shocks = shocks or names
    return frame(spark, [(v, s, h, float(irf[h, i, j])) for h in range(len(irf)) for i, v in enumerate(names) for j, s in enumerate(shocks)], ALL)


def response(spark: SparkSession, irf: np.ndarray, names: Sequence[str]) -> DataFrame:
    """(H, N) as variable, horizon, value."""
    return frame(spark, [(v, h, float(irf[h, i])) for h in range(len(irf)) for i, v in enumerate(names)], ONE)


def wold_irf(v: Var, horizon: int) -> np.ndarray:
    return v.wold(horizon)


def cholesky_irf(v: Var, horizon: int, s: np.ndarray | None = None) -> np.ndarray:
    """Responses to the shocks of an impact matrix, the lower Cholesky factor unless one is given."""
    return v.wold(horizon) @ (np.linalg.cholesky(v.sigma) if s is None else s)


def long_run_irf(v: Var, horizon: int, scale: tuple[int, float] | None = None) -> np.ndarray:
    """Responses under a long-run restriction; scale (i, size): the i-th shock moves the i-th variable by size at once, and all responses are scaled alike."""
    ma = v.wold(horizon)
    irf = ma @ L.long_run_impact(ma, v.sigma)
    return irf if scale is None else irf / (irf[0, scale[0], scale[0]] / scale[1])


def multiplied(responses_: DataFrame, impact: DataFrame) -> DataFrame:
    """Moving-average rows (row, col, horizon, value) times an impact matrix (row, col, value), as a join and a sum."""
    b = impact.select(F.col("row").alias("col"), F.col("col").alias("shock"), F.col("value").alias("w"))
    return responses_.join(F.broadcast(b), "col").groupBy(F.col("row").alias("variable"), "shock", "horizon").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def convolved(a: DataFrame, b: DataFrame, lags: int) -> DataFrame:
    """The product of two lag polynomials in rows (row, col, lag, value), below lags."""
    right = b.select(F.col("row").alias("col"), F.col("col").alias("col2"), F.col("lag").alias("lag2"), F.col("value").alias("w"))
    joined = a.join(right, "col").where(F.col("lag") + F.col("lag2") < lags)
    return joined.groupBy("row", F.col("col2").alias("col"), (F.col("lag") + F.col("lag2")).alias("lag")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def levels(irf: DataFrame, variables: Sequence[str], by: Sequence[str] = ("variable", "shock")) -> DataFrame:
    """Responses with those of some variables summed up over the horizon."""
    summed = cumulated(irf.where(F.col("variable").isin(list(variables))), "value", by, "horizon")
    return irf.where(~F.col("variable").isin(list(variables))).unionByName(summed)


def generalized_iv(v: Var, z: np.ndarray, r: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit-variance responses (H, N), and psi, to a shock that residuals load on with r leads of the instrument z, aligned with the residuals."""
    _, u, _ = v.arrays()
    x = np.column_stack([np.ones(len(u) - r), *(z[r - j : len(z) - j] for j in range(r + 1))])
    psi = np.linalg.lstsq(x, u[r:], rcond=None)[0][1:]
    size = np.einsum("ji,ik,jk->", psi, np.linalg.inv(v.sigma), psi)
    return L.convolve(v.wold(horizon), psi[:, :, None], horizon + 1)[:, :, 0] / np.sqrt(size), psi


def scale_bounds(psi: np.ndarray, sigma: np.ndarray, z: np.ndarray, points: int = 256) -> tuple[float, float]:
    """Bounds of the scale between responses to an instrument and to its shock: var(z) over the largest spectral size of psi on a grid of frequencies in [0, pi), and sd(z)."""
    theta = np.arange(points) * np.pi / points
    wave = np.exp(-1j * np.outer(theta, np.arange(len(psi)))) @ psi
    size = np.sqrt(np.einsum("fi,ij,fj->f", wave.conj(), np.linalg.inv(sigma), wave).real.max())
    return float(z.var(ddof=1) * size), float(z.std(ddof=1))


STEPS = [
    "Choose variables, transformations and lags; estimate the reduced form.",
    "Clean the instrument of its own lags and those of the variables.",
    "Test whether the shock can be told from present and past variables.",
    "If so, identify it by the usual instrument estimator.",
    "If not, test whether future variables recover it.",
    "If they do, use the estimator with leads; decompose variances by frequency.",
    "If they don't, report relative responses and bounds.",
]
