import pytest
from pyspark.sql import functions as F

from grovetally.operators import namespace, probes
from grovetally.sources import listing

RECORD = "seq long, object_id long, family string, name string, file_id long, entry_type int, private_id long, stream_size long, stream_alloced long, sparse_bytes long, has_uncompressed boolean, uncompressed_size long, embedded boolean, payload_utf8 string, payload_hex string"
FIELDS = [x.split(" ")[0] for x in RECORD.split(", ")]


def records(spark, rows):
    return spark.createDataFrame([tuple({"seq": i, **r}.get(f) for f in FIELDS) for i, r in enumerate(rows)], RECORD)


def drec(parent, name, file_id, kind):
    return {"object_id": parent, "family": "dir_rec", "name": name, "file_id": file_id, "entry_type": kind}


def inode(i, **more):
    return {"object_id": i, "family": "inode", "private_id": i, "has_uncompressed": False, **more}


def xattr(i, name, **more):
    return {"object_id": i, "family": "xattr", "name": name, **more}


def test_entries_of_a_small_volume(spark):
    header = "66706d6303000000" + (70000).to_bytes(8, "little").hex()
    rows = [
        drec(2, "d", 10, 4), drec(10, "f", 11, 8), drec(2, "hard", 11, 8), drec(2, "link", 12, 10), drec(2, "broken", 13, 10), drec(10, "sock", 14, 12),
        drec(2, "packed", 15, 8), drec(2, "told", 16, 8), drec(2, "short", 17, 8), drec(2, "lost", 18, 8), drec(2, "holes", 19, 8), drec(2, ".fseventsd", 20, 4), drec(20, "x", 11, 8),
        inode(10), inode(11, stream_size=1, stream_alloced=4096), inode(11, stream_size=5, stream_alloced=8192), inode(12), inode(13),
        xattr(12, "com.apple.fs.symlink", embedded=True, payload_utf8="d/é\0"), xattr(13, "com.apple.fs.symlink", embedded=False, payload_utf8="no"),
        inode(15), xattr(15, "com.apple.decmpfs", payload_hex="00"), xattr(15, "com.apple.decmpfs", payload_hex=header), xattr(15, "com.apple.ResourceFork", stream_alloced=4096),
        inode(16, has_uncompressed=True, uncompressed_size=33, stream_alloced=1), xattr(16, "com.apple.decmpfs", payload_hex=header, stream_alloced=2),
        inode(17), xattr(17, "com.apple.decmpfs", payload_hex=header[:30]),
        inode(19, stream_size=10, stream_alloced=4096, sparse_bytes=8192),
    ]
    found, skips = namespace.entries(records(spark, rows))
    got = {r.path: tuple(r)[1:] for r in found.collect()}
    assert skips.count() == 0
    assert got == {
        "d": ("dir", 10, 0, 0, None), "d/f": ("file", 11, 5, 8192, None), "hard": ("file", 11, 5, 8192, None), "link": ("symlink", 12, 4, 0, "d/é"), "broken": ("symlink", 13, 0, 0, None),
        "d/sock": ("other", 14, 0, None, None), "packed": ("file", 15, 70000, 4096, None), "told": ("file", 16, 33, 3, None), "short": ("file", 17, 0, 0, None), "lost": ("file", 18, 0, None, None), "holes": ("file", 19, 10, 0, None),
    }


def test_real_sizes_without_counts(spark):
    rows = records(spark, [inode(11), inode(12, private_id=11), inode(13)])
    totals = spark.createDataFrame([(11, 101)], "stream_id long, bytes long")
    counts = spark.createDataFrame([(11, 2)], "stream_id long, refcnt long")
    assert {r.file_id: r.real_size for r in namespace.real_sizes(rows, totals, counts).collect()} == {11: 51, 12: 50, 13: 0}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("relative", "want"), [("a/b", "/r/a/b"), ("", "/r"), ("a/../..", None), ("./a//b/..", "/r/a"), ("..", None), ("a..b", "/r/a..b")])
def test_containment(spark, relative, want):
    assert one(spark, probes.resolved(F.lit("/r/"), F.lit(relative))) == want


def test_modes_options_and_mounts(spark):
    assert [one(spark, probes.admitted(F.lit(x))) for x in ("/dev/disk3", "/dev/rdisk3s1s2", "/dev/diskx", "a.DMG", "/dev/disk3/../x")] == [True, True, False, True, False]
    assert one(spark, probes.mode_of(F.lit("/x"), F.lit(True))) == "fallback" and one(spark, probes.mode_of(F.lit("/x.dmg"), F.lit(False))) == "raw"
    assert [one(spark, probes.threads(F.lit(x), 16)) for x in ("0", "3", "x", None)] == [4, 3, 4, 4]
    lines = spark.createDataFrame([("/dev/disk3s1 on / (apfs, sealed, local, read-only)",), ("map x on y (autofs)",), ("junk",)], "value string")
    assert sorted(tuple(r) for r in probes.mounts(lines).collect()) == [("/dev/disk3s1", "/", "apfs", True, True), ("map x", "y", "autofs", False, False)]


def test_listing(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"entries": [{"path": ".", "entry_kind": "dir", "file_id": 2},\n {"path": "l", "entry_kind": "symlink", "file_id": 5, "logical_size": 1, "symlink_target": "t", "more": 1}, {"path": "d", "entry_kind": "dir", "file_id": 6, "logical_size": 64}]}')
    rows = listing.comparable(listing.read_listing(spark, str(tmp_path / "o.json")))
    assert sorted(tuple(r) for r in rows.collect()) == [("d", "dir", 6, None, None), ("l", "symlink", 5, 1, "t")]
