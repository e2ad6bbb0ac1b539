"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm.common import shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternating large-star and small-star steps: every step makes at most as many edges as it reads, and the
    number of steps grows with the logarithm of a component's size. Both are an aggregate and an equi-join on the
    node, so a node with very many neighbours is pre-aggregated and its join side split. Each step's table is
    checkpointed in the shared folder.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u != v").distinct().checkpoint()
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: larger neighbours of u go to the smallest of u and its neighbours
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small-star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), "m").filter("u != m").union(least)
        now = small.select("u", F.col("m").alias("v")).distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
