"""Aligned multivariate series from fact tables.

A wide series has columns t (1, 2, ... without gaps), ts and one double a variable, and panel columns if there are
several. Facts are aggregated before anything is ordered in time, so windows see periods, not facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(panel: Sequence[str] = (), time: str = "t"):
    return Window.partitionBy(*panel).orderBy(time)


def periods(facts: DataFrame, stamp: str, unit: str, measures: dict[str, Column], panel: Sequence[str] = (), drop_last: bool = False) -> DataFrame:
    """Measures by period of the stamp; with drop_last, without the last period, which may be incomplete."""
    by = facts.where(F.col(stamp).isNotNull()).groupBy(*panel, F.date_trunc(unit, F.col(stamp)).cast("timestamp").alias("ts")).agg(*(m.alias(n) for n, m in measures.items()))
    if drop_last:
        by = by.select("*", F.max("ts").over(Window.partitionBy()).alias("_last")).where("ts < _last").drop("_last")
    return by.select(*panel, F.row_number().over(ordered(panel, "ts")).alias("t"), "ts", *measures)


def gap_filled(by: DataFrame, unit: str, keys: DataFrame, names: Sequence[str], value: float = 0.0) -> DataFrame:
    """Every period from the first to the last for every row of keys, missing measures set to value."""
    ends = by.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    # One row beside each of the keys, which then has its own periods.
    spans = keys.distinct().join(F.broadcast(ends), how="cross")
    grid = spans.select(*keys.columns, F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("ts"))
    full = grid.join(by.select("ts", *keys.columns, *names), ["ts", *keys.columns], "left")
    filled = full.fillna(value, list(names))
    return filled.select(*keys.columns, F.row_number().over(ordered(keys.columns, "ts")).alias("t"), "ts", *names)


def differenced(series: DataFrame, names: Sequence[str], panel: Sequence[str] = ()) -> DataFrame:
    """First differences, named as before; the first row of each panel goes."""
    w = ordered(panel)
    out = series.withColumns({n: F.col(n) - F.lag(n).over(w) for n in names})
    return out.select("*", F.row_number().over(w).alias("_r")).where("_r > 1").drop("_r")


def cumulated(df: DataFrame, name: str, by: Sequence[str], time: str) -> DataFrame:
    return df.withColumn(name, F.sum(name).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))


def demeaned(series: DataFrame, names: Sequence[str], panel: Sequence[str] = ()) -> DataFrame:
    return series.withColumns({n: F.col(n) - F.avg(n).over(Window.partitionBy(*panel)) for n in names})


def long(series: DataFrame, names: Sequence[str], keys: Sequence[str] = ("t",)) -> DataFrame:
    """One row a period and variable; null values stay."""
    return series.unpivot(list(keys), list(names), "variable", "value")


def wide(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = ("t",)) -> DataFrame:
    return rows.groupBy(*keys).pivot("variable", list(names)).agg(F.first("value"))


def zero_for_missing(series: DataFrame, name: str) -> DataFrame:
    return series.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def leads_and_lags(series: DataFrame, name: str, steps: Sequence[int], panel: Sequence[str] = ()) -> DataFrame:
    """name_l<k> for k > 0 periods back, name_f<k> for as many ahead."""
    w = ordered(panel)
    return series.withColumns({f"{name}_{'l' if k > 0 else 'f'}{abs(k)}": F.lag(name, k).over(w) if k > 0 else F.lead(name, -k).over(w) for k in steps})


def window(series: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of t from first to last, both included."""
    return series.where(F.col("t").between(first, last))
