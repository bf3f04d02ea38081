"""Connected components of an edge list, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm.common import discard, written


def _digest(edges: DataFrame):
    """The number of edges with two sums of hashes: equal for equal edges."""
    sums = (F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1))
    return edges.agg(F.count(F.lit(1)).alias("n"), *sums).first()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for each node of the edges (a, b).

    Alternates large-star and small-star steps: in each, a node's neighbours are tied to the smallest of them, until
    every edge ends at a root; the rounds grow with the logarithm of the longest path. Aggregations alone: a node of
    very many neighbours is pre-aggregated where they are read. Null ends and loops are ignored.
    """
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), "edges")
    before = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        small = written(small.where("a <> b").distinct(), "edges")
        after = _digest(small)
        discard(edges)
        if after == before:
            break
        edges, before = small, after
    return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
