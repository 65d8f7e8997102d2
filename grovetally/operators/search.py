"""Name search and breakdown by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p


def matches(nodes: DataFrame, query: str) -> DataFrame:
    """Rows whose name holds the query, case aside; an empty query finds nothing."""
    if not query:
        return nodes.limit(0)
    return nodes.filter(F.contains(F.lower(p.basename(F.col("path"))), F.lower(F.lit(query))))


def keep_set(nodes: DataFrame, query: str) -> DataFrame:
    """Paths of matches, of everything above them, and the root."""
    found = matches(nodes, query).select("path")
    above = found.select(F.explode(F.concat(p.ancestors(F.col("path")), F.array("path"))).alias("path"))
    root = nodes.sparkSession.range(1).select(F.lit(p.ROOT).alias("path"))
    return above.unionByName(root).distinct() if query else above.distinct()


def top_hits(nodes: DataFrame, query: str, metric: str, k: int) -> DataFrame:
    """The k matches of largest metric, and how many there are."""
    found = matches(nodes, query)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.coalesce(metric, F.lit(0)).desc(), "path").limit(k).join(F.broadcast(total))


def by_extension(entries: DataFrame, folder: str = p.ROOT) -> DataFrame:
    """Totals of the leaves below a directory by extension."""
    leaves = entries.filter(p.inside(F.col("path"), folder)).filter("entry_kind <> 'dir'")
    ext = p.extension(p.basename(F.col("path")), F.col("entry_kind")).alias("ext")
    return leaves.groupBy(ext).agg(p.full_sum(F.col("logical_size")).alias("value_logical"), p.null_sum(F.col("allocated_size")).alias("value_allocated"), F.count(F.lit(1)).alias("file_count"))
