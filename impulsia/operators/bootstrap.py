"""Bootstrap inference: one engine, with schemes of drawing and of identification as its two axes.

Replications are rows of a range, dealt over the cluster; each task draws, simulates, refits and identifies its batch
of replications together in stacked arrays. Draws depend on the seed and the replication alone, not on partitions, so
retried tasks and other cluster sizes give the same numbers. Quantiles interpolate linearly between order statistics.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impulsia.functions import linalg as L
from impulsia.operators.estimate import Var
from impulsia.sources.tables import prepare

log = logging.getLogger("impulsia")

#: A row a cell and batch, with the values of the batch's replications.
DRAWS = "variable string, shock string, horizon int, b array<bigint>, values array<double>"
#: Replications that a task holds at a time.
BATCH = 32
SCHEMES = ("residual", "wild", "block")


def hashed(seed: int, b: Sequence[int], n: int) -> np.ndarray:
    """(B, n) integers below 2^60 that SQL can draw too: the first 15 hex digits of the MD5 of seed:b:i."""
    return np.array([[int(hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest()[:15], 16) for i in range(n)] for k in b], dtype=np.int64)


def counted(seed: int, b: Sequence[int], n: int) -> np.ndarray:
    """(B, n) integers below 2^60 from a counter-based generator of each replication."""
    return np.stack([np.random.Generator(np.random.Philox(key=[seed, k])).integers(0, 1 << 60, n) for k in b])


GENERATORS = {"hash": hashed, "philox": counted}


@dataclass
class Draw:
    """What a batch of replications is made of."""

    u: np.ndarray
    """Shocks (B, T - p, N) to simulate from."""
    z: np.ndarray | None = None
    """Instruments (B, rows) drawn along."""
    extra: dict | None = None


@dataclass
class Plan:
    """All that workers need: small arrays only."""

    y: np.ndarray
    u: np.ndarray
    beta: np.ndarray
    sigma: np.ndarray
    p: int
    c: int
    exog: np.ndarray | None
    names: list[str]
    horizon: int
    seed: int = 7
    generator: str = "philox"
    scheme: str = "residual"
    z: np.ndarray | None = None
    """The instrument at the residual rows of its window."""
    rows: np.ndarray | None = None
    block: int = 0
    extra: dict | None = None


def plan(v: Var, horizon: int, **more) -> Plan:
    y, u, ex = v.arrays()
    made = Plan(y, u, v.beta, v.sigma, v.p, v.c, ex, v.names, horizon, **more)
    if made.scheme not in SCHEMES:
        raise ValueError(f"scheme: {made.scheme!r} is none of {', '.join(SCHEMES)}")
    if made.generator not in GENERATORS:
        raise ValueError(f"generator: {made.generator!r} is none of {', '.join(GENERATORS)}")
    return made


def draw(q: Plan, b: Sequence[int]) -> Draw:
    """residual: rows with replacement; wild: one sign a row, shared by all variables (and the instrument); block: moving blocks of the window's rows, residual and instrument together, centred by the place in the block, the instrument where it isn't zero."""
    t = len(q.u)
    numbers = GENERATORS[q.generator]
    if q.scheme == "residual":
        return Draw(q.u[numbers(q.seed, b, t) % t])
    if q.scheme == "wild":
        sign = np.where(numbers(q.seed, b, t) % 2 == 0, 1.0, -1.0)
        return Draw(q.u * sign[:, :, None], None if q.z is None else q.z * sign)
    rows = np.arange(t) if q.rows is None else q.rows
    own, n = q.u[rows], len(rows)
    size = q.block if q.block > 0 else L.block_size(n)
    starts = numbers(q.seed, b, -(-n // size)) % (n - size + 1)
    at, place = L.block_rows(starts, size, n)
    u = np.repeat(q.u[None], len(b), axis=0)
    u[:, rows] = own[at] - L.block_means(own, size)[place]
    z = None
    if q.z is not None:
        z = q.z[at]
        z = np.where(z != 0, z - L.block_means(q.z[:, None], size, nonzero=True)[place, 0], 0.0)
    return Draw(u, z)


def refit(q: Plan, d: Draw) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Simulated series, coefficients, residuals and covariances of a batch; exogenous columns stay as they were."""
    y = L.simulate(q.y[: q.p], q.beta, d.u, q.p, q.c, q.exog)
    return y, *L.fit(y, q.p, q.c, q.exog)


Identify = Callable[[Plan, Draw, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _ma(q: Plan, beta: np.ndarray) -> np.ndarray:
    return L.wold(beta, len(q.names), q.p, q.c, q.horizon)


def _all(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x, np.ones(len(x), bool)


def by_cholesky(q, d, y, beta, u, sigma):
    return _all(_ma(q, beta) @ L.cholesky(sigma)[:, None])


def by_long_run(q, d, y, beta, u, sigma):
    ma = _ma(q, beta)
    irf = ma @ L.long_run_impact(ma, sigma)[:, None]
    if scale := (q.extra or {}).get("scale"):
        i, size = scale
        irf = irf / (irf[:, :1, i, i] / size)[..., None, None]
    return _all(irf)


def _scaled(q: Plan, irf: np.ndarray) -> np.ndarray:
    if scale := (q.extra or {}).get("scale"):
        i, size = scale
        irf = irf / (irf[:, :1, i] / size)[..., None]
    return irf


def by_long_run_max(q, d, y, beta, u, sigma):
    return _all(_scaled(q, L.long_run_max(_ma(q, beta), L.cholesky(sigma), q.extra["target"])))


def by_max_share(q, d, y, beta, u, sigma):
    return _all(_scaled(q, L.max_share(_ma(q, beta), L.cholesky(sigma), q.extra["target"])))


def by_instrument(q, d, y, beta, u, sigma):
    rows = np.arange(u.shape[1]) if q.rows is None else q.rows
    s = L.iv_impact(u[:, rows], d.z, q.extra["policy"])
    return _all((_ma(q, beta) @ s[:, None, :, None])[..., 0])


def by_history(q, d, y, beta, u, sigma):
    """Contributions over time of the shock that the instrument identifies: time stands for the horizon."""
    rows = np.arange(u.shape[1]) if q.rows is None else q.rows
    s = L.iv_impact(u[:, rows], d.z, q.extra["policy"])
    out = [L.moved(L.lag_blocks(beta[i], len(q.names), q.p, q.c), s[i], L.shock_series(u[i], sigma[i], s[i])) for i in range(len(u))]
    return _all(np.stack(out))


def by_treatment(q, d, y, beta, u, sigma):
    """Treated rows are those with a drawn instrument; a replication of fewer than 15 is left out."""
    rows = np.arange(u.shape[1]) if q.rows is None else q.rows
    out, ok = np.zeros((len(u), q.horizon + 1, len(q.names))), np.zeros(len(u), bool)
    ma = _ma(q, beta)
    for i in range(len(u)):
        treated = np.abs(d.z[i]) > 1e-14
        if treated.sum() >= 15:
            s = L.treated_impact(u[i, rows], d.z[i], treated, q.extra["variable"], q.extra["scale_to"])
            out[i], ok[i] = ma[i] @ s, np.isfinite(s).all()
    return out, ok


def by_clean_instrument(q, d, y, beta, u, sigma):
    """Unit-variance responses to the instrument cleaned anew in each replication; q.z is its whole course after the first p rows, extra["first"] these rows."""
    ma, out = _ma(q, beta), []
    for i in range(len(u)):
        z = L.clean_instrument(np.concatenate([q.extra["first"], d.z[i]]), y[i], q.p)
        s = z @ u[i] / (z @ z)
        s = s / s[0]
        s = s / np.sqrt(s @ np.linalg.solve(sigma[i], s))
        out.append(ma[i] @ s)
    return _all(_first_up(q, np.stack(out)))


def _first_up(q: Plan, irf: np.ndarray) -> np.ndarray:
    irf = _cumulated(irf, q)
    return irf * np.where(irf[:, :1, :1] < 0, -1.0, 1.0)


def by_recovery(q, d, y, beta, u, sigma):
    """Unit-variance responses to a shock that leads of residuals recover; the instrument is made anew from the drawn residuals and noise."""
    r, delta = q.extra["leads"], q.extra["delta"]
    n, ma, out = u.shape[1], _ma(q, beta), []
    for i in range(len(u)):
        e = d.u[i]
        x = np.column_stack([np.ones(n - r), *(e[j : n - r + j] for j in range(r + 1))])
        z = x @ delta + d.extra["noise"][i]
        z = L.clean_instrument(np.concatenate([q.extra["first"], z]), y[i, : len(z) + len(q.extra["first"])], q.p)
        m = len(z)
        xs = np.column_stack([np.ones(m - r), *(z[r - j : m - j] for j in range(r + 1))])
        psi = np.linalg.lstsq(xs, u[i, r:m], rcond=None)[0][1:]
        size = np.einsum("ji,ik,jk->", psi, np.linalg.inv(sigma[i]), psi)
        out.append(L.convolve(ma[i], psi[:, :, None], q.horizon + 1)[:, :, 0] / np.sqrt(size))
    return _all(_first_up(q, np.stack(out)))


def _cumulated(irf: np.ndarray, q: Plan) -> np.ndarray:
    if which := (q.extra or {}).get("cumulate"):
        irf = irf.copy()
        irf[:, :, which] = np.cumsum(irf[:, :, which], axis=1)
    return irf


def _batches(frames, size: int):
    for part in frames:
        ids = part.column(0).to_pylist()
        for i in range(0, len(ids), size):
            yield ids[i : i + size]


def _range(spark: SparkSession, nboot: int) -> DataFrame:
    per = max(1, min(-(-nboot // BATCH), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, nboot, 1, per).withColumnRenamed("id", "b")


def replicate(spark: SparkSession, q: Plan, nboot: int, identify: Identify, draws: Callable[[Plan, Sequence[int]], Draw] = draw) -> DataFrame:
    """Every replication's values, packed: a row a cell (variable, shock, horizon) and batch; shock is null where there is one only. each() unpacks them."""
    log.info("%d replications of %d variables, %d lags, scheme %s, identified %s", nboot, len(q.names), q.p, q.scheme, identify.__name__)
    cumulate = identify not in (by_clean_instrument, by_recovery)
    prepare(spark)

    def run(batches):
        for ids in _batches(batches, BATCH):
            d = draws(q, ids)
            irf, ok = identify(q, d, *refit(q, d))
            irf, kept = (_cumulated(irf, q) if cumulate else irf)[ok], np.array(ids)[ok]
            if not len(kept):
                continue
            several = irf.ndim == 4
            names, cells, k = np.array(q.names), int(np.prod(irf.shape[1:])), len(q.names) if several else 1
            values = np.ascontiguousarray(irf.reshape(len(kept), cells).T).reshape(-1)
            at = np.arange(cells)
            bounds = pa.array(np.arange(cells + 1) * len(kept), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[at // k % len(names)], pa.string()),
                    pa.array(names[at % k], pa.string()) if several else pa.nulls(cells, pa.string()),
                    pa.array(at // (k * len(names)), pa.int32()),
                    pa.ListArray.from_arrays(bounds, pa.array(np.tile(kept, cells), pa.int64())),
                    pa.ListArray.from_arrays(bounds, pa.array(values, pa.float64())),
                ],
                names=["variable", "shock", "horizon", "b", "values"],
            )

    return _range(spark, nboot).mapInArrow(run, DRAWS)


def each(draws: DataFrame) -> DataFrame:
    """b, variable, shock, horizon, value: a row a replication and cell."""
    pairs = F.explode(F.arrays_zip("b", "values")).alias("_p")
    return draws.select("variable", "shock", "horizon", pairs).select("_p.b", "variable", "shock", "horizon", F.col("_p.values").alias("value"))


def mean_coefficients(spark: SparkSession, q: Plan, nboot: int) -> np.ndarray:
    """The mean of refitted coefficients: tasks send sums, a row a coefficient."""

    def run(frames):
        total, count = np.zeros(q.beta.shape), 0
        for ids in _batches(frames, BATCH):
            total += refit(q, draw(q, ids))[1].sum(axis=0)
            count += len(ids)
        n = total.size
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int64()), pa.array(total.reshape(-1)), pa.array(np.full(n, count), pa.int64())], names=["i", "total", "count"])

    prepare(spark)
    sums = _range(spark, nboot).mapInArrow(run, "i long, total double, count long").groupBy("i").agg((F.sum("total") / F.sum("count")).alias("mean"))
    found = np.zeros(q.beta.size)
    for r in sums.collect():
        found[r["i"]] = r["mean"]
    return found.reshape(q.beta.shape)


def corrected(spark: SparkSession, q: Plan, nboot: int) -> Plan:
    """The plan with coefficients corrected for the bias that a first round of replications shows; its residuals stay."""
    import dataclasses

    log.info("bias correction from %d replications", nboot)
    beta = L.bias_corrected(q.beta, mean_coefficients(spark, q, nboot), len(q.names), q.p, q.c)
    if not np.array_equal(beta, q.beta):
        log.info("coefficients corrected, largest root %.4f", np.abs(np.linalg.eigvals(L.companion(beta, len(q.names), q.p, q.c))).max())
    return dataclasses.replace(q, beta=beta)


def _sorted(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All values of each cell, ascending: as many as there are replications."""
    return draws.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("_v"))


def _quantile(p: float) -> Column:
    """Of the ascending values, with linear interpolation."""
    at = (F.size("_v") - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.element_at("_v", low + 1), F.element_at("_v", F.least(low + 2, F.size("_v")))
    return a + (b - a) * (at - low)


def bands(draws: DataFrame, keys: Sequence[str] = ("variable", "shock", "horizon"), wide: float = 90, narrow: float = 68) -> DataFrame:
    """lower, upper (wide), lower2, upper2 (narrow), median and mean by key, all of one pass."""
    probs = {"lower": 0.5 - wide / 200, "upper": 0.5 + wide / 200, "lower2": 0.5 - narrow / 200, "upper2": 0.5 + narrow / 200, "median": 0.5}
    mean = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v) / F.size("_v")
    return _sorted(draws, keys).select(*keys, *(_quantile(p).alias(n) for n, p in probs.items()), mean.alias("mean"))


def recentred(draws: DataFrame, point: DataFrame, keys: Sequence[str], wide: float = 90, narrow: float = 68, order_statistic: bool = False) -> DataFrame:
    """Bands moved from their median to the point estimate (keys, value). With order_statistic the median is the upper middle value; fewer than 10 replications are an error."""
    found = bands(draws, keys, wide, narrow)
    centre: Column = F.col("median")
    if order_statistic:
        mid = F.element_at("_v", F.floor(F.size("_v") / 2).cast("int") + 1)
        enough = F.when(F.size("_v") >= 10, mid).otherwise(F.raise_error(F.lit("too few valid replications")).cast("double"))
        found, centre = found.join(_sorted(draws, keys).select(*keys, enough.alias("_mid")), list(keys)), F.col("_mid")
    found = found.join(point.select(*keys, F.col("value").alias("point")), list(keys))
    shift = F.col("point") - centre
    moved = [(F.col(c) + shift).alias(c) for c in ("lower", "upper", "lower2", "upper2")]
    return found.select(*keys, "point", *moved, F.col("median"), F.col("mean"))


def recovery_draws(q: Plan, b: Sequence[int]) -> Draw:
    """Rows of residuals and noise drawn together; the last residuals, which the instrument's leads reach, stay."""
    r, noise = q.extra["leads"], q.extra["noise"]
    m = len(noise)
    at = GENERATORS[q.generator](q.seed, b, m) % m
    u = np.repeat(q.u[None], len(b), axis=0)
    u[:, :m] = q.u[:m][at]
    return Draw(u, None, {"noise": noise[at]})
