"""What a scan writes: envelopes, slim rows, summaries, and tables that are found again by signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLIM = ["path", "entry_kind", "logical_size", "symlink_target"]


def slim(entries: DataFrame, keep_allocated: bool = False) -> DataFrame:
    """The columns a viewer needs."""
    return entries.select(*SLIM, *(["allocated_size"] if keep_allocated else []))


def envelope(entries: DataFrame, aggregates: DataFrame, skips: DataFrame) -> DataFrame:
    """One JSON line per row, tagged and in order: header, entries, aggregates, skips, trailer with counts."""
    spark = entries.sparkSession
    line = lambda frame, rank, tag, key: frame.select(F.lit(rank).alias("rank"), F.col(key).alias("key"), F.to_json(F.struct(F.lit(tag).alias("record"), *frame.columns)).alias("value"))
    counts = [f.agg(F.count(F.lit(1)).alias(n)) for f, n in ((entries, "entry_count"), (aggregates, "aggregate_count"), (skips, "skip_count"))]
    trailer = counts[0].join(counts[1]).join(counts[2]).select(F.lit(4).alias("rank"), F.lit("").alias("key"), F.to_json(F.struct(F.lit("trailer").alias("record"), F.lit(True).alias("done"), "*")).alias("value"))
    header = spark.range(1).select(F.lit(0).alias("rank"), F.lit("").alias("key"), F.lit('{"record":"header"}').alias("value"))
    rows = header.unionByName(line(entries, 1, "entry", "path")).unionByName(line(aggregates, 2, "aggregate", "path")).unionByName(line(skips, 3, "skip", "path")).unionByName(trailer)
    return rows.orderBy("rank", "key").select("value")


def summary(entries: DataFrame, aggregates: DataFrame, skips: DataFrame) -> DataFrame:
    """Counts of the three lists, and of skips by reason as text."""
    by_reason = skips.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = by_reason.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "n"))), ",").alias("reasons"))
    counts = [f.agg(F.count(F.lit(1)).alias(n)) for f, n in ((entries, "entries"), (aggregates, "directories"), (skips, "skipped"))]
    return counts[0].join(counts[1]).join(counts[2]).join(reasons)


def signature(directories: DataFrame) -> DataFrame:
    """One row that changes when a directory (path, mtime_ns, ctime_ns) appears, goes or changes, in any order."""
    sign = F.conv(F.substring(F.md5(F.concat_ws("|", "path", "mtime_ns", "ctime_ns")), 1, 15), 16, 10).cast("long")
    return directories.agg(F.coalesce(F.bit_xor(sign), F.lit(0)).alias("signature"), F.count(F.lit(1)).alias("directories"))


def save_scan(entries: DataFrame, folder: str, key: str, sign: int) -> None:
    """Write a scan under its key and signature; Spark's commit makes it appear whole."""
    entries.write.mode("overwrite").parquet(f"{folder}/key={key}/signature={sign}")


def find_scan(spark: SparkSession, folder: str, key: str, sign: int) -> DataFrame | None:
    """The scan of that key and signature, if it was committed; any failure to read it is a miss."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{folder}/key={key}/signature={sign}")
    except AnalysisException:
        return None
