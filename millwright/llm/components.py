"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import attach_group, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (hi, lo), hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    both = both.union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    near = attach_group(both, ["u"], {"m": (F.min("v"), F.min)}, spread_by=["v"], salts=16)
    near = near.withColumn("m", F.least("u", "m"))
    large = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = attach_group(large, ["hi"], {"m": (F.min("lo"), F.min)}, spread_by=["lo"], salts=16)
    linked = low.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
    return linked.union(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of an edge, the smallest node that it is connected to.

    Each round is a written table; the number of edges does not grow, and the number of rounds grows
    with the logarithm of the longest path. Only a count and a checksum of a round reach the driver.
    """
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    now, before = materialise(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        now, before = materialise(_stars(now), "edges"), state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
