"""Connected components of an edge table, by alternating large and small stars.

Every round is joins and aggregations over edges; nothing is gathered on the driver but two numbers that tell whether
a round changed anything. Each round's edges are a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one orderable type; returns (node, root) for every node that isn't its component's least one."""

    def counted(df: DataFrame, label: str) -> tuple[DataFrame, dict]:
        told = Observation()
        out = keep(df.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), label)
        return out, told.get

    now, before = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, state = counted(small.union(least).distinct(), "small")
        drop(now, large)
        now = new
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
