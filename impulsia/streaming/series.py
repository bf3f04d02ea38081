"""Series from unbounded facts: the periods of operators.series, kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_periods(facts: DataFrame, stamp: str, length: str, measures: dict[str, Column], late: str, panel: Sequence[str] = ()) -> DataFrame:
    """Measures by window of the stamp (a length as "1 hour"); facts later than the watermark are left out, and a window is final once the watermark passes its end. State holds open windows only."""
    by = facts.withWatermark(stamp, late).groupBy(*panel, F.window(stamp, length).alias("_w")).agg(*(m.alias(n) for n, m in measures.items()))
    return by.select(*panel, F.col("_w.start").alias("ts"), *measures)


def append_to(periods: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends final windows to a parquet table that operators.series can order and fit; with once, of what has arrived by now."""
    out = periods.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
