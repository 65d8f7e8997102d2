import json

from pyspark.sql import functions as F

from grovetally.sources import sinks, snapshots
from grovetally.streaming import scans

ENTRY = "path string, entry_kind string, file_id long, logical_size long, allocated_size long, symlink_target string"


def lines(spark, text):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(text.split("\n"))], "source string, line_no int, value string")


def test_snapshot_listings(spark):
    plain = snapshots.names_of_lines(lines(spark, "Snapshots for disk /:\ncom.apple.TimeMachine.2024-01-01\ncom.apple.TimeMachine.2024-01-02\n\nNOTE: x"))
    assert tuple(snapshots.verdict(plain).first()) == (2, 0, "snapshots_may_hold_space")
    block = "Snapshots\n+-- 12345678-1234-1234-1234-123456789ABC\n|   Name:  com.apple.os.update-DEADBEEF\n|   XID:   77\n"
    rows = snapshots.names_of_blocks(lines(spark, block))
    assert [(r.name, r.xid, r.user_visible, r.uuid[:8]) for r in rows.collect()] == [("com.apple.os.update-DEADBEEF", 77, False, "12345678")]
    assert tuple(snapshots.verdict(rows).first()) == (0, 1, "no_user_snapshots")


def test_envelope_and_summary(spark):
    entries = spark.createDataFrame([("b", "file", 1, 5, None, None), ("a", "symlink", 2, 1, 0, "b")], ENTRY)
    totals = spark.createDataFrame([(".", 6)], "path string, value_logical long")
    skips = spark.createDataFrame([("x", "not_found"), ("y", "not_found")], "path string, reason string")
    records = [json.loads(r.value) for r in sinks.envelope(sinks.slim(entries), totals, skips).collect()]
    assert [r["record"] for r in records] == ["header", "entry", "entry", "aggregate", "skip", "skip", "trailer"]
    assert [r["path"] for r in records[1:3]] == ["a", "b"] and "symlink_target" not in records[2] and "allocated_size" not in records[1]
    assert records[-1] == {"record": "trailer", "done": True, "entry_count": 2, "aggregate_count": 1, "skip_count": 2}
    assert tuple(sinks.summary(entries, totals, skips).first()) == (2, 1, 2, "not_found=2")


def test_cache(spark, tmp_path):
    dirs = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "path string, mtime_ns long, ctime_ns long")
    sign = sinks.signature(dirs).first()
    assert sign == sinks.signature(dirs.orderBy(F.desc("path"))).first() != sinks.signature(dirs.filter("path = 'a'")).first()
    assert sinks.find_scan(spark, str(tmp_path), "k", sign.signature) is None
    sinks.save_scan(dirs, str(tmp_path), "k", sign.signature)
    assert sinks.find_scan(spark, str(tmp_path), "k", sign.signature).count() == 2


def test_streams(spark, tmp_path):
    schema = "path string, entry_kind string, file_id long, logical_size long, allocated_size long"
    for k, rows in enumerate([[("a/x.txt", "file", 1, 5, 5), ("a", "dir", 2, 0, 0)], [("a/b/y.TXT", "file", 3, 7, None), ("z", "file", 4, 1, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = scans.arriving(spark, str(tmp_path / "in" / "*"), schema, 1)
    for name, made in (("ext", scans.extension_totals(stream)), ("dirs", scans.directory_totals(stream))):
        made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("ext").collect())) == [("(no ext)", 1, 1), (".txt", 12, 2)]
    assert sorted(map(tuple, spark.table("dirs").collect())) == [(".", 13, None, 3), ("a", 12, None, 2), ("a/b", 7, None, 1)]
    scans.write_frames(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_progress(spark):
    ticks = spark.createDataFrame([("s", 1, 5, 0, 10), ("s", 2, 7, 1, 20)], "scan_id string, seq int, scanned long, skipped long, bytes long")
    assert [tuple(r) for r in scans.progress(ticks).orderBy("seq").collect()] == [("s", 1, 5, 0, 10, False), ("s", 2, 12, 1, 30, True)]
    shares = spark.createDataFrame([(5, 10), (10, 0), (105, 100), (120, 100)], "a long, b long").select(scans.fraction(F.col("a"), F.col("b")))
    assert [r[0] for r in shares.collect()] == [0.5, None, 1.0, None]
