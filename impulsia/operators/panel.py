"""Many models at once: one vector autoregression a panel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from impulsia.functions import linalg as L
from impulsia.sources.tables import prepare


def panel_irf(series: DataFrame, panel: str, names: Sequence[str], p: int, horizon: int, c: int = 1) -> DataFrame:
    """panel, variable, shock, horizon, value of Cholesky responses; a panel of too few rows gives none. Each group is a panel's aggregated periods, so groups stay small however many facts or panels there are."""
    names = list(names)
    prepare(series.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")[names].to_numpy(float)
        columns = [panel, "variable", "shock", "horizon", "value"]
        if len(y) - p <= c + len(names) * p:
            return pd.DataFrame(columns=columns)
        beta, _, sigma = L.fit(y, p, c)
        irf = L.wold(beta, len(names), p, c, horizon) @ L.cholesky(sigma)
        n, at = len(names), horizon + 1
        cells = {"variable": np.tile(np.repeat(names, n), at), "shock": np.tile(names, at * n), "horizon": np.repeat(np.arange(at, dtype=np.int32), n * n), "value": irf.reshape(-1)}
        return pd.DataFrame({panel: [pdf[panel].iloc[0]] * (at * n * n), **cells})[columns]

    cells = [("variable", StringType()), ("shock", StringType()), ("horizon", IntegerType()), ("value", DoubleType())]
    schema = StructType([StructField(panel, series.schema[panel].dataType), *(StructField(n, t) for n, t in cells)])
    return series.groupBy(panel).applyInPandas(one, schema)
