"""Listings that another tool wrote: one JSON document with all its entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, entry_kind string, file_id long, logical_size long, symlink_target string"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``{"entries": [...]}`` documents; keys that are not asked for are passed over."""
    documents = spark.read.schema(f"entries array<struct<{', '.join(x.replace(' ', ': ') for x in ENTRY.split(', '))}>>").option("multiLine", True).json(path)
    return documents.select(F.explode("entries").alias("e")).select("e.*")


def comparable(rows: DataFrame) -> DataFrame:
    """What two tools must agree on: kind and id always, sizes of files and links, targets of links; not the root."""
    kind = F.col("entry_kind")
    return rows.filter("path <> '.'").select(
        "path", "entry_kind", "file_id", F.when(kind.isin("file", "symlink"), F.col("logical_size")).alias("logical_size"), F.when(kind == "symlink", F.col("symlink_target")).alias("symlink_target")
    )
