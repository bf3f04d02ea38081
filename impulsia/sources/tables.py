"""Fact tables and frames of small arrays."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder. Months and hours are those of UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A DataFrame of small results, NaN as null."""
    clean = [tuple(None if isinstance(v, float) and np.isnan(v) else v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in clean], schema)


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and keeps each to one BLAS thread."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
