"""States in sequence: what changed from one to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(states: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """For every state whether each field equals the one before it; the first is left out."""
    window = Window.partitionBy(key).orderBy(order)
    before = states.select("*", *(F.lag(f).over(window).alias(f"_{f}") for f in fields), F.row_number().over(window).alias("_row"))
    return before.filter("_row > 1").select(key, order, *(F.col(f).eqNullSafe(F.col(f"_{f}")).alias(f"same_{f}") for f in fields))


def path_history(states: DataFrame, key: str, order: str, shown: list[str]) -> DataFrame:
    """Every key's states in order as one text."""
    item = F.struct(order, F.concat_ws(":", *(F.col(c).cast("string") for c in shown)).alias("t"))
    return states.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "|").alias("history"))


def node_reuse(nodes: DataFrame) -> DataFrame:
    """Per state (state_no, node_key, summary): nodes, those found in the state before, and false ones."""
    before = nodes.select((F.col("state_no") + 1).alias("state_no"), "node_key", F.col("summary").alias("was")).withColumn("hit", F.lit(1))
    joined = nodes.join(before, ["state_no", "node_key"], "left")
    return joined.groupBy("state_no").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("hit").alias("reused"), F.count_if(F.col("hit").isNotNull() & ~F.col("summary").eqNullSafe(F.col("was"))).alias("false_reuse")
    ).filter("state_no > 0")
