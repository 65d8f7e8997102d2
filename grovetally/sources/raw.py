"""Container images block by block: headers, checksums, checkpoints, B-tree nodes and object maps.

Images are read by ``spark.read.format("grove_blocks")`` in ranges of blocks, so an
image of any size is as many partitions as it needs.  Decoding works on Arrow
batches; rules that accept or reject rows are column expressions.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bounds, field offsets and bits of the on-disk format.
LEAST_BLOCK, MOST_BLOCK = 4096, 65536
TYPE_MASK, PHYSICAL, EPHEMERAL, ENCRYPTED, NO_HEADER = 0xFFFF, 0x40000000, 0x80000000, 0x10000000, 0x20000000
SUPERBLOCK_TYPE, SUPERBLOCK_MAGIC = 1, b"NXSB"
NODE_START, NODE_INFO, ROOT_NODE, FIXED_KEYS = 56, 40, 0x1, 0x4
OBJECT_ID_MASK = (1 << 60) - 1


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("block_size", LEAST_BLOCK))
        self.step = int(options.get("blocks_per_partition", 16384))
        if not LEAST_BLOCK <= self.size <= MOST_BLOCK or self.size & (self.size - 1):
            raise ValueError(f"block_size {self.size} is not a power of two from {LEAST_BLOCK} to {MOST_BLOCK}")
        if not os.path.isfile(self.path):
            raise ValueError(f"not an image: {self.path}")

    def partitions(self):
        count = os.path.getsize(self.path) // self.size
        return [_Range(i, min(i + self.step, count)) for i in range(0, count, self.step)]

    def read(self, partition: _Range):
        with open(self.path, "rb") as image:
            image.seek(partition.first * self.size)
            for paddr in range(partition.first, partition.last):
                block = image.read(self.size)
                if len(block) < self.size:
                    raise OSError(f"block {paddr} ends early")
                yield paddr, block


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grove_blocks"

    def schema(self) -> str:
        return "paddr long, block binary"

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def checksum(block: bytes) -> int:
    """Fletcher-64 over the 32-bit words after the stored checksum, as two check words."""
    words = np.frombuffer(block, "<u4", offset=8).astype(np.uint64)
    modulus = (1 << 32) - 1
    low = int(words.sum()) % modulus
    # The k-th word from the end counts k times; products stay below 2**46 a word.
    high = int((words * np.arange(len(words), 0, -1, dtype=np.uint64) % np.uint64(modulus)).sum()) % modulus
    first = modulus - (low + high) % modulus
    return (modulus - (low + first) % modulus) << 32 | first


def _u(block: bytes, at: int, size: int) -> int:
    return int.from_bytes(block[at : at + size], "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def headers(blocks: DataFrame) -> DataFrame:
    """Object header of every block, and whether its checksum holds; the block stays."""
    schema = "paddr long, block binary, oid long, xid long, object_type int, flags long, subtype long, checksum_ok boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [b.as_py() for b in batch.column("block")]
            kinds = [_u(b, 24, 4) for b in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("paddr"),
                    batch.column("block"),
                    pa.array([_signed(_u(b, 8, 8)) for b in rows], pa.int64()),
                    pa.array([_signed(_u(b, 16, 8)) for b in rows], pa.int64()),
                    pa.array([k & TYPE_MASK for k in kinds], pa.int32()),
                    pa.array([k & ~TYPE_MASK for k in kinds], pa.int64()),
                    pa.array([_u(b, 28, 4) for b in rows], pa.int64()),
                    pa.array([_u(b, 0, 8) == checksum(b) for b in rows]),
                ],
                names=["paddr", "block", "oid", "xid", "object_type", "flags", "subtype", "checksum_ok"],
            )

    return blocks.select("paddr", "block").mapInArrow(read, schema)


def reject_reason(object_type: int, storage: int, most_xid: int) -> Column:
    """Why a header is not the expected object, the first rule that fails; null if none does."""
    bit = lambda mask: F.col("flags").bitwiseAND(F.lit(mask)) != 0
    return (
        F.when(~F.col("checksum_ok"), "checksum")
        .when(F.col("object_type") != object_type, "object_type")
        .when(F.col("flags").bitwiseAND(F.lit(PHYSICAL | EPHEMERAL)) != storage, "storage_class")
        .when(bit(ENCRYPTED), "encrypted")
        .when(bit(NO_HEADER), "no_header")
        .when((F.lit(storage) == PHYSICAL) & (F.col("oid") != F.col("paddr")), "oid_is_not_address")
        .when(F.col("xid") > most_xid, "xid_too_large")
    )


def checkpoints(decoded: DataFrame) -> DataFrame:
    """Superblock candidates of decoded headers; ``valid`` tells those that may be chosen from the skipped."""
    magic = F.expr("substring(block, 33, 4)") == F.lit(SUPERBLOCK_MAGIC)
    found = decoded.filter(magic & (F.col("object_type") == SUPERBLOCK_TYPE))
    return found.select("xid", F.col("paddr").alias("descriptor_index"), F.col("paddr").alias("block"), F.col("checksum_ok").alias("valid"))


def node_entries(blocks: DataFrame) -> DataFrame:
    """paddr, level, entry_index, key and value of every entry of B-tree nodes.

    Values of nodes below the leaves, and fixed-size keys and values, have the
    sizes that the root's info names; they are given by ``key_size`` and
    ``value_size`` columns (0: variable).  An entry out of bounds fails the read.
    """
    schema = "paddr long, level int, entry_index int, key binary, value binary"

    def entries(paddr: int, b: bytes, key_size: int, value_size: int) -> list[tuple]:
        flags, level, count, start, length = _u(b, 32, 2), _u(b, 34, 2), _u(b, 36, 4), _u(b, 40, 2), _u(b, 42, 2)
        table, keys = NODE_START + start, NODE_START + start + length
        end = len(b) - (NODE_INFO if flags & ROOT_NODE else 0)
        out = []
        for i in range(count):
            if flags & FIXED_KEYS:
                k, v = _u(b, table + 4 * i, 2), _u(b, table + 4 * i + 2, 2)
                ks, vs = key_size, value_size if level == 0 else 8
            else:
                k, ks, v, vs = (_u(b, table + 8 * i + 2 * j, 2) for j in range(4))
            if keys + k + ks > end or v > end - keys or end - v + vs > end:
                raise ValueError(f"entry {i} of node {paddr} is out of bounds")
            out.append((paddr, level, i, b[keys + k : keys + k + ks], b[end - v : end - v + vs]))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("paddr", "block", "key_size", "value_size"))):
                if found := entries(*row):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["paddr", "level", "entry_index", "key", "value"])

    return blocks.select("paddr", "block", "key_size", "value_size").mapInArrow(read, schema)


def little_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned little-endian integer of a binary column as a long (8 bytes: two's complement)."""
    digits = F.hex(F.substring(data, F.lit(at + 1), F.lit(size)))
    pairs = F.transform(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), lambda i: F.substring(digits, 2 * i + 1, F.lit(2)))
    return F.conv(F.array_join(pairs, ""), 16, -10).cast("long") if size == 8 else F.conv(F.array_join(pairs, ""), 16, 10).cast("long")


def object_map(entries: DataFrame) -> DataFrame:
    """oid, xid, flags, size and paddr of the leaf entries of an object map."""
    leaves = entries.filter("level = 0")
    return leaves.select(
        little_endian(F.col("key"), 0, 8).alias("oid"), little_endian(F.col("key"), 8, 8).alias("xid"),
        little_endian(F.col("value"), 0, 4).alias("flags"), little_endian(F.col("value"), 4, 4).alias("size"), little_endian(F.col("value"), 8, 8).alias("paddr"),
    )


def record_keys(entries: DataFrame) -> DataFrame:
    """Object id and record type of file-system records; key and value stay."""
    word = little_endian(F.col("key"), 0, 8)
    return entries.filter("level = 0").select(
        "paddr", "entry_index", word.bitwiseAND(F.lit(OBJECT_ID_MASK)).alias("object_id"), F.shiftrightunsigned(word, 60).alias("raw_type"), "key", "value"
    )


def volume_verdict(flags: Column, incompatible: Column) -> Column:
    """Why a volume is not supported, the first rule that applies; null if it is."""
    # Feature bits, in the order in which they decide.
    known = 0x1 | 0x8 | 0x2 | 0x4 | 0x10 | 0x20
    return (
        F.when(flags.bitwiseAND(F.lit(0x1)) == 0, "encrypted")
        .when(incompatible.bitwiseAND(F.lit(~known)) != 0, "unknown_incompatible_features")
        .when(incompatible.bitwiseAND(F.lit(0x4)) != 0, "encryption_rolled")
        .when(incompatible.bitwiseAND(F.lit(0x2)) != 0, "dataless_snapshots")
        .when(incompatible.bitwiseAND(F.lit(0x10)) != 0, "incomplete_restore")
        .when(incompatible.bitwiseAND(F.lit(0x20)) != 0, "sealed")
    )
