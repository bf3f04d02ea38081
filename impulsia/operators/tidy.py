"""Presentation frames: point estimates with their bands, one row a plotted value."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The default palette, hex. Fixed values, in their order.
PALETTE = ["#910048", "#E5E5E5", "#407EC9", "#FF8200", "#707372", "#00B0B9", "#001E60", "#78BE20", "#8031A7", "#658D1B", "#F2A900", "#E35205", "#DA291C", "#231F20", "#009CDE"]


def colours(n: int, reverse: bool = False) -> list[str]:
    """n colours of the palette, which starts anew, with a warning, where it is too short."""
    own = PALETTE[::-1] if reverse else PALETTE
    if n > len(own):
        warnings.warn(f"{n} colours are asked for, the palette has {len(own)}: some are used again", stacklevel=2)
    return [own[i % len(own)] for i in range(n)]


def ranked(found: DataFrame, levels: Sequence[str], column: str = "variable") -> DataFrame:
    """found with <column>_rank, the place (from 1) of its value among the levels, by which plots and sorts go; a value that is none of them has none."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(column))
    return found.withColumn(f"{column}_rank", F.nullif(at, F.lit(0)).cast("int"))


BANDS = ["lower", "upper", "lower2", "upper2"]


def irf_with_bands(point: DataFrame, found: DataFrame | None, shock: str | None = None, keys: Sequence[str] = ("variable", "shock", "horizon"), scale: float = 1.0, cumulate: Sequence[str] = ()) -> DataFrame:
    """keys, point, and the bands where there are any; of one shock, if named. cumulate: variables whose point responses are summed up (bands are taken as they are)."""
    from impulsia.operators.structural import levels

    point = levels(point, cumulate, [k for k in keys if k != "horizon"]) if cumulate else point
    out = point.select(*keys, (F.col("value") * scale).alias("point"))
    if found is not None:
        out = out.join(found.select(*keys, *((F.col(b) * scale).alias(b) for b in BANDS)), list(keys), "left")
    return out.where(F.col("shock") == shock).drop("shock") if shock is not None else out


def mean_with_bands(found: DataFrame, scale: float = 1.0, keys: Sequence[str] = ("variable", "horizon")) -> DataFrame:
    """As irf_with_bands, around the mean of the replications."""
    return found.select(*keys, (F.col("mean") * scale).alias("point"), *((F.col(b) * scale).alias(b) for b in BANDS))


def sets(found: DataFrame, shock: str, scale: float = 1.0) -> DataFrame:
    """Of weak-instrument sets (variable, horizon, irf, dm_lower, dm_upper, ar_lower, ar_upper): shock, variable, horizon, point and both kinds of bounds, scaled."""
    kept = {"point": "irf", "dm_lo": "dm_lower", "dm_hi": "dm_upper", "ar_lo": "ar_lower", "ar_hi": "ar_upper"}
    return found.select(F.lit(shock).alias("shock"), "variable", "horizon", *((F.col(c) * scale).alias(n) for n, c in kept.items()))


def treatment(found: DataFrame, shock: str, scale: float = 1.0) -> DataFrame:
    """Of recentred treatment bands: shock, variable, horizon, point and bands, scaled."""
    return found.select(F.lit(shock).alias("shock"), "variable", "horizon", *((F.col(c) * scale).alias(c) for c in ("point", *BANDS)))


def shares(found: DataFrame, one_shock: str | None = None) -> DataFrame:
    """horizon, variable, shock, value; with one_shock (found: variable, horizon, share), what the others make is added."""
    if one_shock is None:
        return found.select("horizon", "variable", "shock", F.col("share").alias("value"))
    own = found.select("horizon", "variable", F.lit(one_shock).alias("shock"), F.col("share").alias("value"))
    return own.unionByName(found.select("horizon", "variable", F.lit("Other Shocks").alias("shock"), (1 - F.col("share")).alias("value")))


def history(contributions: DataFrame, shock: str, target: DataFrame) -> DataFrame:
    """Wide: t, variable, the shock's contribution, Residual and Total. target: t, variable, value."""
    own = contributions.groupBy("t", "variable").agg(F.sum(F.when(F.col("shock") == shock, F.col("value"))).alias(shock), F.sum("value").alias("_all"))
    out = own.join(target.select("t", "variable", F.col("value").alias("Total")), ["t", "variable"])
    return out.select("t", "variable", shock, (F.col("Total") - F.col(shock)).alias("Residual"), "Total")


def history_by_shock(contributions: DataFrame, shocks: Sequence[str]) -> DataFrame:
    """Wide: t, variable and one column a shock."""
    return contributions.groupBy("t", "variable").pivot("shock", list(shocks)).agg(F.first("value"))
