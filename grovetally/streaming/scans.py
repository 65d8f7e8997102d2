"""Scans that arrive in pieces: running totals and progress with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import paths as p


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 8) -> DataFrame:
    """Entry rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def extension_totals(stream: DataFrame) -> DataFrame:
    """Running totals of leaves by extension; state is one row per extension."""
    leaves = stream.filter("entry_kind <> 'dir'")
    ext = p.extension(p.basename(F.col("path")), F.col("entry_kind")).alias("ext")
    return leaves.groupBy(ext).agg(F.sum("logical_size").cast("long").alias("value_logical"), F.count(F.lit(1)).alias("file_count"))


def directory_totals(stream: DataFrame) -> DataFrame:
    """Running path-summed totals; state is one row per directory."""
    leaves = stream.filter("entry_kind <> 'dir'")
    spread = leaves.select(F.explode(p.ancestors(F.col("path"))).alias("path"), "logical_size", "allocated_size")
    return spread.groupBy("path").agg(F.sum("logical_size").cast("long").alias("value_logical"), p.null_sum(F.col("allocated_size")).alias("value_allocated"), F.count(F.lit(1)).alias("item_count"))


def write_frames(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch as JSON lines in a folder of its number; a batch that is run again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(ticks: DataFrame) -> DataFrame:
    """Running totals of progress ticks (seq, scanned, skipped, bytes), the last one terminal."""
    from pyspark.sql import Window

    order = Window.partitionBy("scan_id").orderBy("seq")
    last = F.max("seq").over(Window.partitionBy("scan_id"))
    return ticks.select("scan_id", "seq", *(F.sum(c).over(order).alias(c) for c in ("scanned", "skipped", "bytes")), (F.col("seq") == last).alias("terminal"))


def fraction(done: Column, total: Column) -> Column:
    """Share done, at most 1; null where the total is 0 or was overrun by more than a tenth."""
    ratio = done / F.when(total > 0, total)
    return F.when(ratio <= 1.1, F.greatest(F.lit(0.0), F.least(ratio, F.lit(1.0))))
