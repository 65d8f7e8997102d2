"""Logical, allocated and shared sizes of files, and the interval join behind the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logical_size(kind: Column, has_inode: Column, target: Column, compressed: Column, uncompressed: Column, stream: Column) -> Column:
    """Precedence: link text, then 0 for non-files, then the compressed header, then the stream."""
    zero = F.lit(0).cast("long")
    return (
        F.when(kind == "symlink", F.coalesce(F.octet_length(target).cast("long"), zero))
        .when((kind != "file") | ~has_inode, zero)
        .when(compressed, F.coalesce(uncompressed, zero))
        .otherwise(F.coalesce(stream, zero))
    )


def allocated_size(kind: Column, has_inode: Column, compressed: Column, own: Column, header: Column, fork: Column, sparse: Column) -> Column:
    """0 for links and directories; null where unknown; holes of sparse files taken off."""
    zero = F.lit(0).cast("long")
    return (
        F.when(kind.isin("symlink", "dir"), zero)
        .when((kind != "file") | ~has_inode, F.lit(None).cast("long"))
        .when(compressed, F.coalesce(own, zero) + F.coalesce(header, zero) + F.coalesce(fork, zero))
        .when(sparse.isNotNull(), F.greatest(own - sparse, F.when(own.isNotNull(), zero)))
        .otherwise(own)
    )


def overlaps(left: DataFrame, right: DataFrame, width: int, factor: int = 16) -> DataFrame:
    """Pairs of half-open ranges [ls, le) and [rs, re) that overlap.

    Buckets come in widths of ``width`` times powers of ``factor``.  A range's own width is
    the least that is not below its length, so it lies in two buckets at most.  Of a
    pair the shorter range is laid out in the longer one's width too; ranges of one
    width meet in it.  A pair is kept in the bucket where it first overlaps.
    """
    sized = lambda frame, s, e: frame.filter(f"{e} > {s}").withColumn("own", F.greatest(F.lit(0), F.ceil(F.log(float(factor), (F.col(e) - F.col(s)) / F.lit(width)) - 1e-9)).cast("int"))
    left, right = sized(left, "ls", "le"), sized(right, "rs", "re")
    top = max((frame.agg(F.max("own")).first()[0] or 0) for frame in (left, right))
    widths = F.array(*(F.lit(width * factor**k).cast("long") for k in range(top + 1)))

    def laid(frame: DataFrame, s: str, e: str, wider: bool) -> DataFrame:
        """In the own width, or in every wider one."""
        levels = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda k: k > F.col("own")) if wider else F.array("own")
        wide = frame.withColumn("level", F.explode(levels)).withColumn("wide", F.get(widths, F.col("level")))
        return wide.withColumn("bucket", F.explode(F.expr(f"sequence({s} div wide, ({e} - 1) div wide)"))).drop("own")

    parts = [(laid(left, "ls", "le", False), laid(right, "rs", "re", False))]
    if top:
        parts += [(laid(left, "ls", "le", True), laid(right, "rs", "re", False)), (laid(left, "ls", "le", False), laid(right, "rs", "re", True))]
    met = [a.join(b.drop("wide"), ["level", "bucket"]).filter("ls < re AND rs < le AND greatest(ls, rs) div wide = bucket").drop("level", "bucket", "wide") for a, b in parts]
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    return out


def shared_bytes(extents: DataFrame, blocks: DataFrame, block_size: int, width: int = 64) -> DataFrame:
    """row_id and bytes: each overlap divided by its reference count, gaps counted in full.

    ``extents`` has row_id, ls and le; ``blocks`` has rs, re and refcnt, disjoint.
    """
    met = overlaps(extents, blocks, width)
    part = F.least("le", "re") - F.greatest("ls", "rs")
    sums = met.groupBy("row_id").agg(
        F.sum(F.floor(part * block_size / F.when(F.col("refcnt") > 0, F.col("refcnt")).otherwise(1))).alias("shared"), F.sum(part).alias("covered")
    )
    joined = extents.join(sums, "row_id", "left")
    gap = (F.col("le") - F.col("ls") - F.coalesce("covered", F.lit(0))) * block_size
    return joined.select("row_id", (F.coalesce("shared", F.lit(0)) + gap).cast("long").alias("bytes"))


def real_size(totals: DataFrame, owners: DataFrame) -> DataFrame:
    """file_id and real_size: a stream's total split evenly, the rest to its source row.

    ``totals`` has stream_id, bytes and refcnt; ``owners`` has file_id and stream_id.
    """
    count = F.when(F.coalesce("refcnt", F.lit(0)) > 0, F.col("refcnt")).otherwise(1)
    joined = owners.join(totals.withColumn("count", count), "stream_id", "left")
    rest = F.when(F.col("file_id") == F.col("stream_id"), F.expr("bytes % count")).otherwise(0)
    return joined.select("file_id", (F.expr("coalesce(bytes, 0) div coalesce(count, 1)") + F.coalesce(rest, F.lit(0))).cast("long").alias("real_size"))


def split_ranges(extents: DataFrame, blocks: DataFrame, width: int = 64) -> DataFrame:
    """row_id, s, e and refcnt of every stretch of a range: overlaps as they are, gaps with count 1."""
    met = overlaps(extents, blocks, width).select("row_id", "ls", "le", F.greatest("ls", "rs").alias("s"), F.least("le", "re").alias("e"), "refcnt")
    stops = extents.filter("le > ls").select("row_id", "ls", "le", F.col("le").alias("s"), F.col("le").alias("e"), F.lit(None).cast("long").alias("refcnt"))
    order = Window.partitionBy("row_id", "ls").orderBy("s", "e")
    after = met.unionByName(stops).withColumn("from", F.coalesce(F.lag("e").over(order), F.col("ls")))
    gaps = after.filter(F.col("from") < F.col("s")).select("row_id", F.col("from").alias("s"), F.col("s").alias("e"), F.lit(1).cast("long").alias("refcnt"))
    return met.select("row_id", "s", "e", F.col("refcnt").cast("long").alias("refcnt")).unionByName(gaps)
