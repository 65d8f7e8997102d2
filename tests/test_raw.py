import struct

import pytest
from pyspark.sql import functions as F

from grovetally.operators import asof
from grovetally.sources import raw


def block(oid, xid, kind, body=b"", size=4096, good=True):
    data = bytearray(size)
    data[8:32] = struct.pack("<QQII", oid, xid, kind, 0)
    data[32 : 32 + len(body)] = body
    data[0:8] = struct.pack("<Q", raw.checksum(bytes(data)) ^ (not good))
    return bytes(data)


def plain_checksum(data):
    low = high = 0
    for i in range(8, len(data), 4):
        low = (low + struct.unpack_from("<I", data, i)[0]) % 0xFFFFFFFF
        high = (high + low) % 0xFFFFFFFF
    first = 0xFFFFFFFF - (low + high) % 0xFFFFFFFF
    return (0xFFFFFFFF - (low + first) % 0xFFFFFFFF) << 32 | first


def node(entries, fixed, root=True, size=4096, level=0):
    width = 4 if fixed else 8
    table, keys, values = b"", b"", b""
    for key, value in entries:
        values = value + values
        table += struct.pack("<HH", len(keys), len(values)) if fixed else struct.pack("<HHHH", len(keys), len(key), len(values), len(value))
        keys += key
    body = struct.pack("<HHIHH", (1 if root else 0) | (4 if fixed else 0), level, len(entries), 0, width * len(entries)).ljust(24, b"\0") + table + keys
    data = bytearray(block(7, 7, 3, body, size))
    end = size - (40 if root else 0)
    data[end - len(values) : end] = values
    return bytes(data)


@pytest.fixture()
def image(tmp_path):
    blocks = [block(1, 30, 0x80000001, b"NXSB"), block(1, 99, 0x80000001, b"NXSB", good=False), block(1, 42, 0x80000001, b"NXSB"), block(3, 5, 0x40000002), b"\xff" * 4096]
    path = tmp_path / "image"
    path.write_bytes(b"".join(blocks))
    return str(path)


def test_checkpoints_of_an_image(spark, image):
    spark.dataSource.register(raw.BlockSource)
    blocks = spark.read.format("grove_blocks").option("path", image).option("blocks_per_partition", 2).load()
    assert blocks.count() == 5 and raw.checksum(bytes(range(256)) * 16) == plain_checksum(bytes(range(256)) * 16) and raw.checksum(b"\xff" * 65536) == plain_checksum(b"\xff" * 65536)
    decoded = raw.headers(blocks)
    found = raw.checkpoints(decoded)
    assert sorted((r.xid, r.valid) for r in found.collect()) == [(30, True), (42, True), (99, False)]
    assert asof.latest(found).first().xid == 42
    reasons = {r.paddr: r.why for r in decoded.select("paddr", raw.reject_reason(2, raw.PHYSICAL, 9).alias("why")).collect()}
    assert reasons == {0: "object_type", 1: "checksum", 2: "object_type", 3: None, 4: "object_type"}


def test_bad_options(spark, image):
    spark.dataSource.register(raw.BlockSource)
    for options in ({"path": image, "block_size": "5000"}, {"path": image + "x"}):
        with pytest.raises(Exception, match="block_size|not an image"):
            spark.read.format("grove_blocks").options(**options).load().collect()


def test_nodes_and_maps(spark):
    rows = [(100, 5, 0, 4096, 1000), (100, 10, 1, 4096, 2000), (1 << 63, 3, 8, 4096, (1 << 64) - 1)]
    fixed = node([(struct.pack("<QQ", o, x), struct.pack("<IIQ", f, s, p)) for o, x, f, s, p in rows], True)
    frame = spark.createDataFrame([(9, fixed, 16, 16)], "paddr long, block binary, key_size int, value_size int")
    got = [tuple(r) for r in raw.object_map(raw.node_entries(frame)).collect()]
    assert got == [(100, 5, 0, 4096, 1000), (100, 10, 1, 4096, 2000), (-(1 << 63), 3, 8, 4096, -1)]
    assert asof.as_of(raw.object_map(raw.node_entries(frame)), 20).filter("oid = 100").count() == 0
    keys = [(struct.pack("<Q", (9 << 60) | 42) + b"name\0", b"v" * 18), (struct.pack("<Q", (3 << 60) | 7), b"")]
    frame = spark.createDataFrame([(8, node(keys, False, root=False), 0, 0)], "paddr long, block binary, key_size int, value_size int")
    got = raw.record_keys(raw.node_entries(frame)).collect()
    assert [(r.object_id, r.raw_type, bytes(r.value)) for r in got] == [(42, 9, b"v" * 18), (7, 3, b"")]
    spoilt = bytearray(node(keys, False))
    spoilt[56:58] = b"\xff\xff"
    with pytest.raises(Exception, match="out of bounds"):
        raw.node_entries(spark.createDataFrame([(8, bytes(spoilt), 0, 0)], frame.schema)).collect()


def test_volume_verdict(spark):
    frame = spark.createDataFrame([(1, 0), (0, 0), (1, 0x100), (1, 4), (1, 2), (1, 0x10), (1, 0x20), (1, 1)], "f long, i long")
    got = [r[0] for r in frame.select(raw.volume_verdict(F.col("f"), F.col("i"))).collect()]
    assert got == [None, "encrypted", "unknown_incompatible_features", "encryption_rolled", "dataless_snapshots", "incomplete_restore", "sealed", None]
