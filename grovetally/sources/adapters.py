"""The engine's relations built from order, event and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ns_orders(spark: SparkSession, folder: str) -> DataFrame:
    """region/nation/customer/order: a namespace without hard links."""
    orders, customers, nations, regions = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    joined = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    size = F.round(F.col("o_totalprice") * 100).cast("long")
    return joined.select(
        F.concat_ws("/", "r_name", "n_name", "c_name", F.col("o_orderkey").cast("string")).alias("path"),
        F.lit("file").alias("entry_kind"),
        F.col("o_orderkey").alias("file_id"),
        size.alias("logical_size"),
        F.when(F.col("o_orderkey") % 97 != 0, (size + 4095).bitwiseAND(F.lit(~4095))).alias("allocated_size"),
    )


def ns_parts(spark: SparkSession, folder: str, conflict: bool = False, directories: bool = False) -> DataFrame:
    """supplier/order/line-part: parts are hard-linked, some have no allocated size.

    With ``directories`` suppliers have rows of their own, and orders but for every seventh.
    """
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("l_linenumber") * 1000 + F.col("l_partkey") if conflict else F.round(F.col("p_retailprice") * 100)
    files = joined.select(
        F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string"), F.concat_ws("-", "l_linenumber", "l_partkey")).alias("path"),
        F.lit("file").alias("entry_kind"),
        F.col("l_partkey").alias("file_id"),
        size.cast("long").alias("logical_size"),
        F.when(F.col("p_size") % 17 != 0, F.col("p_size").cast("long") * 4096).alias("allocated_size"),
    )
    if not directories:
        return files
    zero = F.lit(0).cast("long")
    listed = lambda path, rows: rows.select(path.alias("path")).distinct().select("path", F.lit("dir").alias("entry_kind"), F.xxhash64("path").alias("file_id"), zero.alias("logical_size"), zero.alias("allocated_size"))
    orders = listed(F.concat_ws("/", "l_suppkey", "l_orderkey"), lines.filter("l_orderkey % 7 <> 0"))
    return files.unionByName(listed(F.col("l_suppkey").cast("string"), lines)).unionByName(orders)


def ns_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Urls without scheme, query and fragment as paths of html files."""
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    pages = table(spark, folder, "pages").select(F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/").alias("path"), F.col("page_id").alias("file_id"), F.length("html").cast("long").alias("logical_size"))
    return pages.select("path", F.lit("file").alias("entry_kind"), "file_id", "logical_size", F.col("logical_size").alias("allocated_size"))


def omap(spark: SparkSession, folder: str) -> DataFrame:
    """Events as versions of objects (oid, xid, paddr, flags)."""
    flags = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_id") % 23 == 0, 4).otherwise(0)
    return table(spark, folder, "events").select(F.col("user_id").alias("oid"), F.col("event_id").alias("xid"), (F.col("event_id") * 7).alias("paddr"), flags.cast("long").alias("flags"))


def extents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """File extents of lines and disjoint block ranges of orders."""
    start = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    files = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").alias("row_id"), start.alias("ls"), (start + 1 + F.col("l_partkey") % 12).alias("le")
    ).distinct()
    blocks = table(spark, folder, "orders").filter("o_orderkey % 5 <> 0")
    return files, blocks.select((F.col("o_orderkey") * 8).alias("rs"), (F.col("o_orderkey") * 8 + 8).alias("re"), (F.col("o_custkey") % 4).alias("refcnt"))


def later_scan(scan: DataFrame) -> DataFrame:
    """A second scan of ``ns_orders``: some rows gone, changed or new."""
    k = F.col("file_id")
    return scan.filter(k % 11 != 0).select(
        F.when(k % 13 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"),
        "entry_kind",
        F.when(k % 19 == 0, k + 1).otherwise(k).alias("file_id"),
        F.when(k % 7 == 0, F.col("logical_size") + 1).otherwise(F.col("logical_size")).alias("logical_size"),
        F.when(k % 17 != 0, F.col("allocated_size")).alias("allocated_size"),
    )


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Per user and day: events, value in hundredths and last type."""
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return events.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.max_by("event_type", F.col("event_id")).alias("last_type")
    )


def fs_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a volume: suppliers as directories of the parts they sold, parts as inodes with attributes.

    Every ninth part has a second, later inode record, one byte longer.
    """
    c = F.col
    part = table(spark, folder, "part").withColumn("size", c("p_size").cast("long")).withColumn("own", c("p_partkey") * 10 + 4)
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    shape = "seq long, object_id long, family string, name string, file_id long, entry_type int, private_id long, stream_size long, stream_alloced long, sparse_bytes long, has_uncompressed boolean, uncompressed_size long, embedded boolean, payload_utf8 string, payload_hex string"
    kinds = dict(x.split(" ") for x in shape.split(", "))

    def records(rows: DataFrame, family: str, **values) -> DataFrame:
        values["family"] = F.lit(family)
        return rows.select(*(values.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()))

    kind = F.when(c("size") % 5 == 0, 10).when(c("size") % 7 == 0, 12).otherwise(8)
    folders = records(lines.select("l_suppkey").distinct(), "dir_rec", seq=c("l_suppkey"), object_id=F.lit(2), name=F.concat(F.lit("s"), c("l_suppkey")), file_id=c("l_suppkey") * 10 + 3, entry_type=F.lit(4))
    sold = lines.join(part, c("l_partkey") == c("p_partkey"))
    files = records(sold, "dir_rec", seq=c("p_partkey"), object_id=c("l_suppkey") * 10 + 3, name=F.concat(F.lit("p"), c("l_partkey")), file_id=c("own"), entry_type=kind)
    held = part.filter("size % 11 <> 0")
    stream = c("size") % 13 != 0
    inode = lambda rows, seq, more: records(rows, "inode", seq=seq, object_id=c("own"), private_id=c("own"), stream_size=F.when(stream, c("size") * 1000 + more), stream_alloced=F.when(stream, c("size") * 4096), sparse_bytes=F.when(c("size") % 4 == 0, 65536), has_uncompressed=c("size") % 2 == 0, uncompressed_size=c("size") * 100)
    digits = F.lpad(F.lower(F.hex(c("p_partkey") * 257)), 16, "0")
    header = F.concat(F.lit("66706d6303000000"), *(F.substring(digits, at, 2) for at in range(15, 0, -2)))
    payload = F.when(c("size") % 8 == 1, F.substring(header, 1, 24)).when(c("size") % 8 == 3, F.concat(F.lit("zz"), F.substring(header, 3, 30))).otherwise(header)
    xattr = lambda rows, name, **more: records(rows, "xattr", seq=c("p_partkey"), object_id=c("own"), name=F.lit(name), **more)
    every = [
        folders,
        files,
        inode(held, c("p_partkey"), 0),
        inode(held.filter("p_partkey % 9 = 0"), c("p_partkey") + 1000000000, 1),
        xattr(part.filter("size % 5 = 0"), "com.apple.fs.symlink", embedded=c("size") % 10 != 0, payload_utf8=F.concat("p_name", F.lit("\0\0"))),
        xattr(part.filter("size % 3 = 0"), "com.apple.decmpfs", payload_hex=payload, stream_alloced=F.when(c("size") % 2 == 0, 4096)),
        xattr(part.filter("size % 6 = 0"), "com.apple.ResourceFork", stream_alloced=F.lit(8192)),
        xattr(part, "com.apple.quarantine", payload_utf8=F.lit("q")),
    ]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out
