"""Variance and historical decompositions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impulsia.functions import linalg as L
from impulsia.operators.estimate import Var
from impulsia.sources.tables import frame


def variance_shares(irf: DataFrame) -> DataFrame:
    """variable, shock, horizon, share of the forecast-error variance; even shares where there is none."""
    run = Window.partitionBy("variable", "shock").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy("variable", "horizon")
    out = irf.withColumn("_cum", F.sum(F.col("value") * F.col("value")).over(run)).withColumn("_all", F.sum("_cum").over(at))
    share = F.when(F.col("_all") <= 1e-15, 1 / F.count(F.lit(1)).over(at)).otherwise(F.col("_cum") / F.col("_all"))
    return out.select("variable", "shock", "horizon", share.alias("share"))


def one_shock_shares(v: Var, s: np.ndarray, horizon: int) -> dict:
    """Of the shock behind impact vector s: the vector of a unit-variance shock, its responses (H, N), its series, their variance by the usual divisor, forecast-error variances and shares (H, N)."""
    _, u, _ = v.arrays()
    s0 = s / np.sqrt(s @ np.linalg.solve(v.sigma, s))
    ma = v.wold(horizon)
    irf = ma @ s0
    shock = u @ np.linalg.solve(v.sigma, s0)
    whole = np.cumsum(np.einsum("hij,jk,hik->hi", ma, v.sigma, ma), axis=0)
    return {"impact": s0, "irf": irf, "shock": shock, "check": float(shock @ shock / (len(u) - len(v.beta))), "variance": whole, "share": np.cumsum(irf**2, axis=0) / whole}


def spectral_shares(all_: DataFrame, one: DataFrame, bins: int, low: float, high: float, fourier: bool = True) -> DataFrame:
    """variable, share: of each variable's variance at cycles of low to high periods, what the one shock (variable, horizon, value) makes of all (variable, shock, horizon, value). Null without frequencies in the band."""
    spark = one.sparkSession
    omega = frame(spark, [(float(w),) for w in L.frequencies(bins, low, high, fourier)], "omega double")

    def power(irf: DataFrame, keys: Sequence[str]) -> DataFrame:
        # A few hundred frequencies by a few hundred responses.
        waves = irf.join(F.broadcast(omega), how="cross").groupBy(*keys, "omega")
        by = waves.agg(F.sum(F.col("value") * F.cos(F.col("omega") * F.col("horizon"))).alias("re"), F.sum(F.col("value") * F.sin(F.col("omega") * F.col("horizon"))).alias("im"))
        return by.groupBy("variable").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))

    top, whole = power(one, ["variable"]), power(all_, ["variable", "shock"]).withColumnRenamed("power", "whole")
    return one.select("variable").distinct().join(top, "variable", "left").join(whole, "variable", "left").select("variable", (F.col("power") / F.col("whole")).alias("share"))


def spectral_bounds(all_: DataFrame, one: DataFrame, lower_scale: float, upper_scale: float, bins: int, low: float, high: float, fourier: bool = True) -> DataFrame:
    """variable, lower, upper: bounds of the share that a shock known by its responses to an instrument only makes, from the scales of scale_bounds()."""
    share = spectral_shares(all_, one, bins, low, high, fourier)
    lower, upper = upper_scale**2, (upper_scale**2 / lower_scale) ** 2
    return share.select("variable", (F.col("share") * lower).alias("lower"), (F.col("share") * upper).alias("upper"))


def structural_shocks(v: Var, impact: np.ndarray, shocks: Sequence[str]) -> DataFrame:
    """t, shock, value: the residuals through the inverse of an impact matrix."""
    inverse = np.linalg.inv(impact)
    cols = [sum((F.col(f"u_{n}") * F.lit(float(inverse[j, i])) for i, n in enumerate(v.names)), F.lit(0.0)).alias(s) for j, s in enumerate(shocks)]
    return v.residuals().select("t", *cols).unpivot(["t"], list(shocks), "shock", "value")


def historical(irf: DataFrame, shocks: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """t, variable, shock, value: what each shock up to t contributes at t, by a join of responses and shock series on the shock and the time between. irf: variable, shock, horizon, value with all horizons of the sample; shocks: t, shock, value."""
    if variables is not None:
        irf = irf.where(F.col("variable").isin(list(variables)))
    last = shocks.agg(F.max("t").alias("_last"))
    left = shocks.select("shock", F.col("t").alias("_s"), F.col("value").alias("_e")).join(F.broadcast(last), how="cross").withColumn("_left", F.col("_last") - F.col("_s"))
    lags = irf.withColumnRenamed("shock", "_of")
    # Only what still falls into the sample is made.
    moved = left.join(lags, (F.col("shock") == F.col("_of")) & (F.col("horizon") <= F.col("_left")))
    return moved.groupBy((F.col("_s") + F.col("horizon")).alias("t"), "variable", "shock").agg(F.sum(F.col("value") * F.col("_e")).alias("value"))


def historical_var(v: Var, impact: np.ndarray, shocks: Sequence[str]) -> DataFrame:
    """As historical(), of a model's own shocks through an impact matrix: each is run through the lags in time, T p N^2 steps a shock."""
    _, u, _ = v.arrays()
    e = u @ np.linalg.inv(impact).T
    a = L.lag_blocks(v.beta, v.n, v.p, v.c)
    made = np.stack([L.moved(a, impact[:, j], e[:, j]) for j in range(v.n)], axis=2)
    t, n = len(e), v.n
    at = np.repeat(np.arange(t), n * n)
    columns = [pa.array(at + v.p + 1, pa.int64()), pa.array(np.tile(np.repeat(np.array(v.names), n), t)), pa.array(np.tile(np.array(list(shocks)), t * n)), pa.array(made.reshape(-1))]
    return v.series.sparkSession.createDataFrame(pa.table(columns, names=["t", "variable", "shock", "value"]))


def historical_iv(v: Var, s: np.ndarray) -> np.ndarray:
    """(T - p, N): contributions of the unit-normalised shock behind an impact vector."""
    _, u, _ = v.arrays()
    return L.moved(L.lag_blocks(v.beta, v.n, v.p, v.c), s, L.shock_series(u, v.sigma, s))


def recoverable_history(irf: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """(T, N): contributions of a shock known by its fitted series, brought to unit variance, through its responses (H, N)."""
    shock = fit / fit.std(ddof=1)
    out = np.zeros((len(fit), irf.shape[1]))
    for h in range(min(len(irf), len(fit))):
        out[h:] += np.outer(shock[: len(fit) - h], irf[h])
    return out


def conditional_correlation(irf: DataFrame, a: str, b: str) -> DataFrame:
    """shock, value: the correlation of two variables' movements that each shock makes."""
    both = irf.groupBy("shock", "horizon").pivot("variable", [a, b]).agg(F.first("value"))
    x, y = F.col(a), F.col(b)
    return both.groupBy("shock").agg((F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("value"))


def shares_frame(spark: SparkSession, share: np.ndarray, names: Sequence[str]) -> DataFrame:
    return frame(spark, [(v, h, float(share[h, i])) for h in range(len(share)) for i, v in enumerate(names)], "variable string, horizon int, share double")
