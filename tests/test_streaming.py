"""Streamed periods equal those of a batch, but for windows still open and late facts."""

from pyspark.sql import functions as F

from impulsia.streaming.series import append_to, stream_periods


def test_streamed_periods(spark, tmp_path):
    facts = spark.range(0, 500).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 7).cast("int"))).alias("ts"), (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    facts.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/in")
    append_to(stream_periods(stream, "ts", "1 hour", {"v": F.sum("v")}, "10 minutes", ["k"]), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {(r["k"], r["ts"]): r["v"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["k"], r["ts"]): r["v"] for r in facts.groupBy("k", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("v").alias("v")).collect()}
    last = max(t for _, t in want)
    assert got == {k: v for k, v in want.items() if k[1] < last}
