"""Snapshot listings of two command-line tools as rows, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: snapshots of this prefix belong to the system.
SYSTEM_PREFIX = "com.apple.os.update-"


def user_visible(name: Column) -> Column:
    return ~F.startswith(name, F.lit(SYSTEM_PREFIX))


def names_of_lines(lines: DataFrame) -> DataFrame:
    """One name per line (source, line_no, value); headers, notes and blank lines left out."""
    name = F.trim("value")
    kept = lines.select("source", "line_no", name.alias("name")).filter((F.col("name") != "") & ~F.startswith("name", F.lit("NOTE:")) & ~F.endswith("name", F.lit(":")))
    return kept.select("source", "name", user_visible(F.col("name")).alias("user_visible"), F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("long").alias("xid"))


def names_of_blocks(lines: DataFrame) -> DataFrame:
    """Blocks that begin with ``+--`` and a UUID, with Name: and XID: lines."""
    opens = F.startswith(F.trim("value"), F.lit("+--")).cast("int")
    numbered = lines.withColumn("block", F.sum(opens).over(Window.partitionBy("source").orderBy("line_no")))
    field = lambda name: F.max(F.nullif(F.regexp_extract("value", rf"^\W*{name}:\s*(.*?)\s*$", 1), F.lit("")))
    uuid = F.max(F.nullif(F.regexp_extract("value", r"\+--\s*([0-9A-Fa-f-]{36})", 1), F.lit("")))
    blocks = numbered.filter("block > 0").groupBy("source", "block").agg(field("Name").alias("name"), uuid.alias("uuid"), field("XID").cast("long").alias("xid"))
    return blocks.filter("name IS NOT NULL").select("source", "name", user_visible(F.col("name")).alias("user_visible"), "uuid", "xid")


def verdict(snapshots: DataFrame) -> DataFrame:
    """One row: visible and system snapshots of all listings, and what that means for totals."""
    counts = snapshots.agg(F.count_if("user_visible").alias("visible"), F.count_if(~F.col("user_visible")).alias("excluded"))
    return counts.withColumn("verdict", F.when(F.col("visible") > 0, "snapshots_may_hold_space").otherwise("no_user_snapshots"))
