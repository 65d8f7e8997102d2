"""Totals over a hierarchy of paths, and moves within it.

``entries`` has path, entry_kind, file_id, logical_size and allocated_size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as p
from ..scratch import Scratch


def directories(entries: DataFrame) -> DataFrame:
    """Every directory: dir rows, everything above any row, and the root."""
    above = entries.select(p.parent(F.col("path")).alias("path")).distinct()
    above = above.select(F.explode(F.concat(p.ancestors(F.col("path")), F.array("path"))).alias("path"))
    named = entries.filter("entry_kind = 'dir'").select("path")
    root = entries.sparkSession.range(1).select(F.lit(p.ROOT).alias("path"))
    return above.unionByName(named).unionByName(root).distinct()


def path_summed(entries: DataFrame) -> DataFrame:
    """Totals below every directory, each path counted; empty directories are 0.

    Leaves are summed by the directory that holds them before its ancestors are
    exploded, so the exploded rows are directories times depth, not leaves.
    """
    leaves = entries.filter("entry_kind <> 'dir'").withColumn("parent", p.parent(F.col("path")))
    held = leaves.groupBy("parent").agg(
        p.full_sum(F.col("logical_size")).alias("logical"), p.full_sum(F.col("allocated_size")).alias("allocated"), F.count_if(F.col("allocated_size").isNull()).alias("unknown"), F.count(F.lit(1)).alias("items")
    )
    above = F.array_distinct(F.concat(p.ancestors(F.col("parent")), F.array("parent")))
    spread = held.select(F.explode(above).alias("path"), "logical", "allocated", "unknown", "items")
    # Totals beyond a long stay at the largest one.
    totals = spread.groupBy("path").agg(p.full_sum(F.col("logical")).alias("l"), p.full_sum(F.col("allocated")).alias("a"), F.sum("unknown").alias("u"), F.sum("items").alias("i"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return directories(entries).join(totals, "path", "left").select(
        "path", zero("l").alias("value_logical"), F.when(zero("u") == 0, zero("a")).alias("value_allocated"), zero("i").alias("item_count")
    )


def listed_directories(entries: DataFrame) -> DataFrame:
    """The directories that have a row, and the root."""
    root = entries.sparkSession.range(1).select(F.lit(p.ROOT).alias("path"))
    return entries.filter("entry_kind = 'dir'").select("path").unionByName(root).distinct()


def contributions(entries: DataFrame) -> DataFrame:
    """path (a listed directory), file_id and s (path, sizes): each file id once below each directory, by its least path.

    Within one directory the least path of an id stands for it, further up too.
    Ancestors without a row of their own, and so without a total, are left out.
    """
    files = entries.filter("entry_kind = 'file'").select("path", "file_id", "logical_size", "allocated_size")
    near = files.groupBy(p.parent(F.col("path")).alias("parent"), "file_id").agg(F.min_by(F.struct("path", "logical_size", "allocated_size"), F.col("path")).alias("s"))
    above = F.array_distinct(F.concat(p.ancestors(F.col("parent")), F.array("parent")))
    spread = near.select(F.explode(above).alias("path"), "file_id", "s").join(listed_directories(entries), "path", "left_semi")
    return spread.groupBy("path", "file_id").agg(F.min_by("s", F.col("s.path")).alias("s"))


def unique_inode(entries: DataFrame) -> DataFrame:
    """Totals of every listed directory with each file id once; empty directories are 0."""
    totals = contributions(entries).groupBy("path").agg(
        p.full_sum(F.col("s.logical_size")).alias("l"), p.null_sum(F.col("s.allocated_size")).alias("a"), F.count(F.lit(1)).alias("n")
    )
    zero = lambda c: F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col(c)).cast("long")
    out = listed_directories(entries).join(totals, "path", "left")
    return out.select("path", zero("l").alias("unique_logical"), zero("a").alias("unique_allocated"), zero("n").alias("unique_files"))


def children(entries: DataFrame, folder: str) -> DataFrame:
    """Rows directly inside a directory."""
    return entries.filter(p.parent(F.col("path")) == folder)


def top_children(nodes: DataFrame, metric: str, k: int) -> DataFrame:
    """The k largest children of every directory and how many there are besides."""
    group = Window.partitionBy("parent")
    ranked = nodes.filter(F.col("path") != p.ROOT).withColumn("parent", p.parent(F.col("path"))).withColumn("name", p.basename(F.col("path")))
    ranked = ranked.withColumn("rank", F.row_number().over(group.orderBy(F.coalesce(metric, F.lit(0)).desc(), "name")))
    kept = ranked.filter(F.col("rank") <= k)
    counts = nodes.filter(F.col("path") != p.ROOT).groupBy(p.parent(F.col("path")).alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    return kept.join(counts, "parent").withColumn("overflow", F.greatest(F.col("n") - k, F.lit(0))).drop("n")


def percent_of_parent(nodes: DataFrame, metric: str) -> DataFrame:
    """Hundredths of a percent of the parent's total; null at the root or where that is 0."""
    up = nodes.select(F.col("path").alias("parent"), F.col(metric).alias("of"))
    joined = nodes.withColumn("parent", p.parent(F.col("path"))).join(up, "parent", "left")
    return joined.select("path", F.when(F.col("of") > 0, F.expr(f"{metric} * 10000 div of")).alias("percent_x100"))


# Fixed value: directories of this name are the system's own and not part of a listing.
PRIVATE = ".fseventsd"


def expand_edges(edges: DataFrame, root: int, most_depth: int = 128) -> tuple[DataFrame, DataFrame]:
    """Paths of a tree given as (parent_id, name, file_id, entry_kind), and what was not followed.

    Breadth first; a directory is expanded once, under its least path of least
    depth.  Every level is written to the shared folder, so a level costs a join of
    the edges with the directories before it, however deep it lies.
    """
    spark, ws = edges.sparkSession, Scratch(edges.sparkSession, "expand")
    edges = ws.keep(edges.filter(F.col("name") != PRIVATE), "edges")
    at = ws.keep(spark.createDataFrame([(root, "")], "file_id long, path string"), "front0")
    found, skips = [], []
    for level in range(most_depth + 1):
        step = edges.join(at.withColumnsRenamed({"file_id": "parent_id", "path": "up"}), "parent_id")
        path = F.when(F.col("up") == "", F.col("name")).otherwise(F.concat_ws("/", "up", "name")).alias("path")
        step = ws.keep(step.select(path, "file_id", "entry_kind", "up", F.lit(level + 1).alias("depth")), f"level/depth={level}")
        if step.isEmpty():
            break
        if level == most_depth:
            skips.append(step.select(F.col("up").alias("path"), F.lit(f"depth_cap_reached({most_depth})").alias("reason")).distinct())
            break
        found.append(level)
        dirs = step.filter("entry_kind = 'dir'")
        # One table of all fronts so far, read anew: its plan does not grow.
        seen = spark.read.schema("file_id long, path string").parquet(*(f"{ws.root}/front{k}" for k in range(level + 1)))
        fresh = dirs.groupBy("file_id").agg(F.min("path").alias("path")).join(seen.select("file_id"), "file_id", "left_anti")
        at = ws.keep(fresh, f"front{level + 1}")
        again = dirs.join(at.withColumnRenamed("path", "_p"), "file_id", "left").filter("_p IS NULL OR _p <> path")
        again = again.select("path", F.concat(F.lit("drec_cycle(file_id="), F.col("file_id").cast("string"), F.lit(")")).alias("reason"))
        ws.keep(again, f"again{level}")
        skips.append(f"{ws.root}/again{level}")
    schema = "path string, file_id long, entry_kind string, up string, depth int"
    rows = spark.read.schema(schema).parquet(*(f"{ws.root}/level/depth={k}" for k in found)) if found else spark.createDataFrame([], schema)
    files = [x for x in skips if isinstance(x, str)]
    lost = spark.read.schema("path string, reason string").parquet(*files) if files else spark.createDataFrame([], "path string, reason string")
    for frame in (x for x in skips if not isinstance(x, str)):
        lost = lost.unionByName(frame)
    return rows.select("path", "file_id", "entry_kind", "depth"), lost


def digests(entries: DataFrame, columns: list[str], part: int = 1024) -> DataFrame:
    """path and digest of every directory: SHA-256 over its rows in order of path, and those over its directories'.

    A directory's own lines are digested in parts by hash of the path, so that no
    row holds a whole directory; parts and directories below are joined in order.
    Levels are combined from the deepest up; each is written to the shared folder.
    """
    ws = Scratch(entries.sparkSession, "digest")
    line = F.concat_ws("|", "path", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    own = entries.select(p.parent(F.col("path")).alias("up"), F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long").alias("h"), F.struct("path", line.alias("x")).alias("row"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda r: r["x"]), "\n")
    parts = own.groupBy("up", (F.col("h") % part).alias("k")).agg(F.sha2(joined("row"), 256).alias("x"))
    rows = parts.groupBy("up").agg(F.sha2(joined(F.struct("k", "x")), 256).alias("own"))
    dirs = ws.keep(directories(entries).join(rows.withColumnRenamed("up", "path"), "path", "left").select("path", F.coalesce("own", F.lit("")).alias("own"), p.depth(F.col("path")).alias("depth")), "own")
    deepest = dirs.agg(F.max("depth")).first()[0]
    below = dirs.limit(0).select(F.col("path").alias("up"), F.col("own").alias("below"))
    for level in range(deepest, -1, -1):
        here = dirs.filter(F.col("depth") == level).join(below.withColumnRenamed("up", "path"), "path", "left")
        here = ws.keep(here.select("path", F.sha2(F.concat_ws(":", "own", F.coalesce("below", F.lit(""))), 256).alias("digest")), f"level/{level}")
        below = here.filter(F.col("path") != p.ROOT).groupBy(p.parent(F.col("path")).alias("up")).agg(F.sha2(joined(F.struct("path", F.concat_ws("|", "path", "digest").alias("x"))), 256).alias("below"))
    return entries.sparkSession.read.schema("path string, digest string").parquet(*(f"{ws.root}/level/{k}" for k in range(deepest + 1)))
