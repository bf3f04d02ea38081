"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: the data folder; BENCH_CPUS: local cores. Each query runs to the end (its rows are written to a no-op
sink) after one warm-up of the session. boot_* queries have the sizes of published timings, on the
hourly events series of as many variables.
"""

from __future__ import annotations

import json
import os
import re
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impulsia.operators import bootstrap as B
from impulsia.operators import estimate as E
from impulsia.operators import series as S
from impulsia.plans import registry
from impulsia.sources.tables import table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def hourly(spark: SparkSession, sf: str, n: int) -> tuple[DataFrame, list[str]]:
    """A wide hourly series of n variables: counts and value sums of the event types, by parity of the user."""
    e = table(spark, sf, "events")
    types = sorted(r[0] for r in e.select("event_type").distinct().collect())
    cells = [(t, k, f) for f in (F.count, F.sum) for t in types for k in (0, 1)][:n]
    names = [f"v{i}" for i in range(len(cells))]
    by = {v: F.coalesce(f(F.when((F.col("event_type") == t) & (F.col("user_id") % 2 == k), F.col("value"))).cast("double"), F.lit(0.0)) for v, (t, k, f) in zip(names, cells, strict=True)}
    return S.periods(e, "ts", "hour", by).cache(), names


def boot(n: int, p: int, horizon: int, reps: int, identify=B.by_cholesky, correct: int = 0, rows: int = 612, instrument: bool = False, **more):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        series, names = hourly(spark, sf, n)
        v = E.fit_var(series.where(F.col("t") <= rows), names, p)
        extra = dict(more)
        if instrument:  # the first residual with noise of its neighbours, every third row
            _, u, _ = v.arrays()
            z = np.where(np.arange(len(u)) % 3 == 0, u[:, 0] + 0.5 * np.roll(u[:, 1], 1), 0.0)
            extra |= {"scheme": "block", "z": z, "rows": np.arange(len(u)), "extra": {"policy": 0, "variable": 0, "scale_to": 10.0}}
        q = B.plan(v, horizon, **extra)
        if correct:
            q = B.corrected(spark, q, correct)
        keys = ("variable", "shock", "horizon") if identify in (B.by_cholesky, B.by_long_run) else ("variable", "horizon")
        return B.bands(B.replicate(spark, q, reps, identify), keys)

    return run


BENCHES = {
    "boot_chol_wild_8x12_1000": boot(8, 12, 48, 1000, scheme="wild"),
    "boot_chol_wild_corrected_8x12_2000": boot(8, 12, 48, 1000, scheme="wild", correct=1000),
    "boot_long_run_2x4_1000": boot(2, 4, 40, 1000, B.by_long_run, rows=183),
    "boot_lrmax_corrected_4x2_3000": boot(4, 2, 40, 2000, B.by_long_run_max, correct=1000, rows=250, extra={"target": 0}),
    "boot_maxshare_corrected_4x2_3000": boot(4, 2, 40, 2000, B.by_max_share, correct=1000, rows=250, extra={"target": 0}),
    "boot_chol_residual_7x12_1000": boot(7, 12, 48, 1000),
    "boot_proxy_6x12_1000": boot(6, 12, 48, 1000, B.by_instrument, rows=417, instrument=True, block=24),
    "boot_history_6x12_500": boot(6, 12, 48, 500, B.by_history, rows=417, instrument=True, block=24),
    "boot_treatment_6x12_10000": boot(6, 12, 48, 10_000, B.by_treatment, rows=417, instrument=True),
} | {n: registry.queries()[n] for n in ("orders_series", "ship_series", "events_hourly", "chol_irf", "fevd", "hist_decomp", "boot_proxy_mbb", "boot_hd_iv", "boot_hetero", "panel_irf", "msw")}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.queries()["boot_chol"](spark, SF_DIR).collect()
    took = {}
    for name, f in BENCHES.items():
        began = time.perf_counter()
        f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
