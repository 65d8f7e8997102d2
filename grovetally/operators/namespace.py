"""From a volume's records to path rows: indexes, joins by inode and sizes.

``records`` has seq (their order), object_id, family, name, and what a family holds:
file_id and entry_type of directory records; private_id, stream_size, stream_alloced,
sparse_bytes, has_uncompressed and uncompressed_size of inodes; embedded, payload_utf8,
payload_hex and stream_alloced of attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hierarchy, sizes
from .diff import last_of

# The root's id, kinds of directory records, and the attributes that sizes depend on.
ROOT_ID = 2
KINDS = {4: "dir", 8: "file", 10: "symlink"}
ATTRIBUTES = {"com.apple.fs.symlink": "link", "com.apple.decmpfs": "packed", "com.apple.ResourceFork": "fork"}


def kind_of_type(entry_type: Column) -> Column:
    kind = F.lit("other")
    for code, name in KINDS.items():
        kind = F.when(entry_type == code, F.lit(name)).otherwise(kind)
    return kind


def directory_records(records: DataFrame) -> DataFrame:
    """parent_id, name, file_id, entry_kind and entry_type."""
    rows = records.filter("family = 'dir_rec'")
    return rows.select(F.col("object_id").alias("parent_id"), "name", "file_id", kind_of_type(F.col("entry_type")).alias("entry_kind"), "entry_type")


def inodes(records: DataFrame) -> DataFrame:
    """One row of each inode; of several with one id the last counts."""
    fields = ["private_id", "stream_size", "stream_alloced", "sparse_bytes", "has_uncompressed", "uncompressed_size"]
    rows = records.filter("family = 'inode'").select(F.col("object_id").alias("file_id"), "seq", *fields)
    return last_of(rows, "file_id", F.col("seq")).drop("seq").withColumn("has_inode", F.lit(True))


def attributes(records: DataFrame) -> DataFrame:
    """file_id and one struct for each attribute that sizes depend on; of several of one name the last counts."""
    value = F.struct("embedded", "payload_utf8", "payload_hex", F.col("stream_alloced").alias("alloced"))
    rows = records.filter(F.col("family") == "xattr").filter(F.col("name").isin(*ATTRIBUTES))
    picked = [F.max_by(F.when(F.col("name") == name, value), F.when(F.col("name") == name, F.col("seq"))).alias(c) for name, c in ATTRIBUTES.items()]
    return rows.groupBy(F.col("object_id").alias("file_id")).agg(*picked)


def with_inodes(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows with a file_id, each with its inode and attributes where there are any."""
    joined = rows.join(inodes(records), "file_id", "left").join(attributes(records), "file_id", "left")
    return joined.withColumn("has_inode", F.coalesce("has_inode", F.lit(False)))


def unpacked_size(payload_hex: Column) -> Column:
    """The size a compression header tells: bytes 8 to 16, the least first; null where it is short or no hex."""
    sound = payload_hex.rlike("^([0-9A-Fa-f]{2}){16,}$")
    turned = F.concat(*(F.substring(payload_hex, at, 2) for at in range(31, 15, -2)))
    return F.when(sound, F.conv(turned, 16, -10).cast("long"))


def link_target(link: Column) -> Column:
    """The text of an embedded link, without the zero bytes at its end."""
    return F.when(link["embedded"], F.regexp_replace(link["payload_utf8"], "\\x00+$", ""))


def sized(rows: DataFrame) -> DataFrame:
    """``with_inodes`` rows as path, entry_kind, file_id, logical_size, allocated_size and symlink_target."""
    target = F.when(F.col("entry_kind") == "symlink", link_target(F.col("link")))
    packed = F.col("packed").isNotNull()
    told = F.when(F.col("has_uncompressed"), F.col("uncompressed_size")).otherwise(unpacked_size(F.col("packed.payload_hex")))
    logical = sizes.logical_size(F.col("entry_kind"), F.col("has_inode"), target, packed, told, F.col("stream_size"))
    allocated = sizes.allocated_size(F.col("entry_kind"), F.col("has_inode"), packed, F.col("stream_alloced"), F.col("packed.alloced"), F.col("fork.alloced"), F.col("sparse_bytes"))
    return rows.select("path", "entry_kind", "file_id", logical.alias("logical_size"), allocated.alias("allocated_size"), target.alias("symlink_target"))


def entries(records: DataFrame, root: int = ROOT_ID) -> tuple[DataFrame, DataFrame]:
    """The path rows of a volume, every name of a hard link on its own, and what was not followed."""
    found, skips = hierarchy.expand_edges(directory_records(records).drop("entry_type"), root)
    return sized(with_inodes(found, records)), skips


def real_sizes(records: DataFrame, totals: DataFrame, counts: DataFrame) -> DataFrame:
    """file_id and real_size of files: the share of the stream that the inode's private id names.

    ``totals`` has stream_id and bytes, ``counts`` stream_id and refcnt; what is missing counts 0 bytes once.
    """
    owners = inodes(records).select("file_id", F.col("private_id").alias("stream_id"))
    known = counts.join(totals, "stream_id", "full_outer").select("stream_id", F.coalesce("bytes", F.lit(0)).alias("bytes"), "refcnt")
    return sizes.real_size(known, owners)
