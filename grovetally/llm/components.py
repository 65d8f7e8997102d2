"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node and label (the least node of its component) of every node in ``links`` (a, b).

    Every round writes the edges to the shared folder; only counts reach the driver.
    """
    edges = ws.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    step, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = ws.keep(large, f"{name}large{step}")
        small = large.join(_least(large), "u")
        moved = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.keep(moved.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), f"{name}{step + 1}")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        ws.drop(f"{name}{step}", f"{name}large{step}")
        step += 1
        if state == before or not state["n"]:
            break
        edges, before = after, state
    return after.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
