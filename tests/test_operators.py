import os
import random

import pytest
from pyspark.sql import functions as F

from grovetally.operators import asof, diff, hierarchy, history, layout, search, sizes
from grovetally.sources import posix

ENTRY = "path string, entry_kind string, file_id long, logical_size long, allocated_size long"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def by_path(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


PROOF = [
    ("dst", "dir", 17, 0, 0), ("src", "dir", 16, 0, 0), ("dst/clone.txt", "file", 24, 6, 6), ("dst/hard.txt", "file", 20, 11, 11),
    ("dst/moved.txt", "file", 20, 11, 11), ("dst/sparse.bin", "file", 23, 1048576, 1048576), ("dst/link.txt", "symlink", 26, 9, 0),
]


def test_two_kinds_of_totals(spark):
    e = entries(spark, PROOF)
    unique = by_path(hierarchy.unique_inode(e))
    assert unique["."][0] == unique["dst"][0] == 1048593
    assert unique["src"] == (0, 0, 0)
    assert sorted(r.file_id for r in hierarchy.contributions(e).filter("path = '.'").collect()) == [20, 23, 24]
    summed = by_path(hierarchy.path_summed(e))
    assert summed["."] == (1048613, 1048604, 5) and summed["src"] == (0, 0, 0)


def test_unknown_sizes_collapse(spark):
    e = entries(spark, [("ordinary.txt", "file", 10, 100, 4096), ("a/sparse.bin", "file", 11, 200, None), ("b/x", "file", 12, 1, 8)])
    assert by_path(hierarchy.unique_inode(e))["."] == (301, None, 3)
    summed = by_path(hierarchy.path_summed(e))
    assert summed["."][1] is None and summed["a"][1] is None and summed["b"] == (1, 8, 1)


def test_first_path_wins_and_missing_directories(spark):
    files = [("z/f", "file", 1, 7, 7), ("a/deep/f", "file", 1, 5, None), ("a/deep/g", "file", 1, 6, 6)]
    assert by_path(hierarchy.unique_inode(entries(spark, files))) == {".": (5, None, 1)}
    # Directories without a row have no totals; what is below them counts further up.
    listed = files + [("a", "dir", 90, 0, 0), ("z", "dir", 91, 0, 0), ("empty", "dir", 92, 0, 0)]
    assert by_path(hierarchy.unique_inode(entries(spark, listed))) == {".": (5, None, 1), "a": (5, None, 1), "z": (7, 7, 1), "empty": (0, 0, 0)}
    assert by_path(hierarchy.unique_inode(entries(spark, [("a", "dir", 1, 0, 0), ("a/b/f", "file", 2, 3, 3)]))) == {".": (3, 3, 1), "a": (3, 3, 1)}


def test_sums_stop_at_the_largest_long(spark):
    most = (1 << 63) - 1
    e = entries(spark, [("a/x", "file", 1, most, most), ("a/y", "file", 2, 5, 5), ("a/c/z.q", "file", 3, most, None)])
    assert by_path(hierarchy.path_summed(e)) == {".": (most, None, 3), "a": (most, None, 3), "a/c": (most, None, 1)}
    assert by_path(search.by_extension(e)) == {".q": (most, None, 1), "(no ext)": (most, most, 2)}


def test_empty_scan(spark):
    assert by_path(hierarchy.path_summed(entries(spark, []))) == {".": (0, 0, 0)}
    assert by_path(hierarchy.unique_inode(entries(spark, []))) == {".": (0, 0, 0)}


def test_extensions_and_search(spark):
    e = entries(spark, [("a/Photo.JPG", "file", 1, 1000, 1), ("a/another.jpg", "file", 2, 2000, None), ("a/code.rs", "file", 3, 500, 1), ("a/no-ext", "file", 4, 250, 1), ("a/.hidden", "file", 5, 100, 1), ("ab/x.rs", "file", 6, 9, 1)])
    assert by_path(search.by_extension(e, "a")) == {".jpg": (3000, None, 2), ".rs": (500, 1, 1), "(no ext)": (350, 2, 2)}
    assert {r.path for r in search.matches(e, "pHo").collect()} == {"a/Photo.JPG"}
    assert {r.path for r in search.keep_set(e, "code").collect()} == {".", "a", "a/code.rs"}
    assert search.matches(e, "").count() == search.keep_set(e, "").count() == 0


def test_expand_edges(spark):
    edge = "parent_id long, name string, file_id long, entry_kind string"
    found, skips = hierarchy.expand_edges(spark.createDataFrame([(2, "a", 3, "dir"), (3, "b", 4, "dir"), (4, "up", 3, "dir"), (3, "f", 9, "file"), (2, "g", 9, "file")], edge), 2)
    assert {r.path for r in found.collect()} == {"a", "a/b", "a/b/up", "a/f", "g"}
    assert [tuple(r) for r in skips.collect()] == [("a/b/up", "drec_cycle(file_id=3)")]
    deep = spark.createDataFrame([(2 + i, "d", 3 + i, "dir") for i in range(6)], edge)
    found, skips = hierarchy.expand_edges(deep, 2, most_depth=4)
    assert found.count() == 4 and [tuple(r) for r in skips.collect()] == [("d/d/d/d", "depth_cap_reached(4)")]


def test_expand_a_deep_chain(spark):
    edge = "parent_id long, name string, file_id long, entry_kind string"
    rows = [(2 + i, "d", 3 + i, "dir") for i in range(40)] + [(2, ".fseventsd", 900, "dir"), (900, "x", 901, "file")]
    found, skips = hierarchy.expand_edges(spark.createDataFrame(rows, edge), 2)
    assert sorted(r.depth for r in found.collect()) == list(range(1, 41)) and skips.count() == 0


def test_digests_tell_every_change(spark):
    rows = [("a/x", "file", 1, 5, 1), ("a/y", "file", 2, 6, 1), ("b/c/z", "file", 3, 7, None), ("top", "file", 4, 8, 1)]
    digest = lambda r: by_path(hierarchy.digests(entries(spark, r), ["entry_kind", "file_id", "logical_size"], part=2))
    first, again, other = digest(rows), digest(rows[::-1]), digest(rows[:2] + [("b/c/z", "file", 3, 9, None)] + rows[3:])
    assert first == again and set(first) == {".", "a", "b", "b/c"}
    assert {k for k in first if first[k] != other[k]} == {".", "b", "b/c"}


def test_as_of_each_against_brute_force(spark):
    rng = random.Random(4)
    versions = list({(rng.choice([1, 1, 1, 2, 3]), rng.randint(-50, 3000)): 0 for _ in range(400)})
    versions = [(o, x, x * 7, rng.choice([0, 0, 1, 2, 4, 32])) for o, x in versions]
    probes = [(i, rng.choice([1, 1, 2, 3, 9]), rng.randint(-80, 3200)) for i in range(300)] + [(900, None, 5)]
    got = asof.as_of_each(spark.createDataFrame(probes, "probe_id long, oid long, most long"), spark.createDataFrame(versions, "oid long, xid long, paddr long, flags long"), cuts=7)
    want = []
    for i, o, most in probes:
        last = max((v for v in versions if v[0] == o and v[1] <= most), key=lambda v: v[1], default=None)
        if last and not last[3] & asof.DELETED:
            want.append((i, o, last[1], last[2], last[3], "unsupported_flags" if last[3] & ~3 else None))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_as_of(spark):
    v = lambda rows: spark.createDataFrame(rows, "oid long, xid long, paddr long, flags long")
    three = v([(100, 5, 1000, 0), (100, 10, 2000, 0), (100, 20, 3000, 0)])
    assert [tuple(r)[:3] for r in asof.as_of(three, 15).collect()] == [(100, 10, 2000)]
    assert asof.as_of(v([(100, 50, 1, 0)]), 10).count() == 0
    assert asof.as_of(v([(100, 4, 1, 0), (100, 5, 1, asof.DELETED)]), 100).count() == 0
    assert asof.as_of(v([(100, 5, 1, asof.ENCRYPTED)]), 100).first().reject == "unsupported_flags"
    assert asof.as_of(v([(100, 5, 1, asof.SAVED)]), 100).first().reject is None
    s = asof.summarise(v([(100, 5, 1, 8), (101, 5, 1, 1)]), 100).first()
    assert (s.mapping_count, s.n_noheader, s.n_deleted) == (2, 1, 1)
    c = spark.createDataFrame([(30, 0, 1, True), (99, 1, 2, False), (42, 2, 3, True), (42, 3, 4, True)], "xid long, descriptor_index long, block long, valid boolean")
    assert tuple(asof.latest(c).first()) == (42, 3, 4)


def extent(spark, files, blocks):
    f = spark.createDataFrame(files, "row_id string, ls long, le long")
    b = spark.createDataFrame(blocks, "rs long, re long, refcnt long")
    return {r.row_id: r.bytes for r in sizes.shared_bytes(f, b, 4096).collect()}


def test_shared_extents(spark):
    blocks = [(1176, 1272, 2), (1272, 1336, 1), (1336, 1432, 2), (2000, 2064, 1)]
    assert extent(spark, [("x", 1176, 1432)], blocks) == {"x": 655360}
    assert sum(extent(spark, [("1", 1176, 1272), ("2", 2000, 2064), ("3", 1336, 1432)], blocks).values()) == 655360
    assert extent(spark, [("gap", 500, 502), ("none", 7, 7)], [(9999, 10000, 1)]) == {"gap": 8192, "none": 0}


def test_overlaps_against_brute_force(spark):
    rng = random.Random(1)
    files = [(str(i), s, s + rng.randint(0, 300)) for i in range(200) for s in [rng.randint(0, 3000)]]
    blocks = [(s, s + rng.randint(1, 200), 1) for s in (rng.randint(0, 3000) for _ in range(100))]
    blocks = list(dict.fromkeys(blocks))
    got = sizes.overlaps(spark.createDataFrame(files, "row_id string, ls long, le long"), spark.createDataFrame(blocks, "rs long, re long, refcnt long"), 64)
    want = sorted((f, s, e, a, b) for f, s, e in files for a, b, _ in blocks if max(s, a) < min(e, b))
    assert sorted((r.row_id, r.ls, r.le, r.rs, r.re) for r in got.collect()) == want


def test_long_ranges_are_not_laid_out_in_narrow_buckets(spark):
    files = spark.createDataFrame([("long", 10, 1 << 36), ("short", 70, 90), ("mid", 5000, 9000), ("none", 4, 4)], "row_id string, ls long, le long")
    blocks = spark.createDataFrame([(0, 1 << 30, 2), (80, 81, 3), (1 << 35, 1 << 37, 4)], "rs long, re long, refcnt long")
    got = sorted((r.row_id, r.refcnt) for r in sizes.overlaps(files, blocks, 64).collect())
    assert got == [("long", 2), ("long", 3), ("long", 4), ("mid", 2), ("short", 2), ("short", 3)]


def test_real_size_conserves_bytes(spark):
    totals = spark.createDataFrame([(23, 65536, 5)], "stream_id long, bytes long, refcnt long")
    owners = spark.createDataFrame([(i, 23) for i in range(23, 28)], "file_id long, stream_id long")
    found = {r.file_id: r.real_size for r in sizes.real_size(totals, owners).collect()}
    assert found[23] == 13108 and set(found.values()) == {13107, 13108} and sum(found.values()) == 65536


def test_allocated_rules(spark):
    rows = [("file", True, False, 1056768, None, None, 1032192), ("file", True, False, 4096, None, None, 8192), ("file", True, False, 4096, None, None, None), ("file", True, True, None, 4096, 8192, None),
            ("file", True, True, None, None, None, None), ("symlink", True, False, 1, None, None, None), ("dir", False, False, 1, None, None, None), ("file", False, False, 1, None, None, None), ("other", True, False, 1, None, None, None),
            ("file", True, False, None, None, None, 5)]
    frame = spark.createDataFrame(rows, "kind string, inode boolean, packed boolean, own long, header long, fork long, sparse long")
    c = F.col
    got = [r[0] for r in frame.select(sizes.allocated_size(c("kind"), c("inode"), c("packed"), c("own"), c("header"), c("fork"), c("sparse"))).collect()]
    assert got == [24576, 0, 4096, 12288, 0, 0, 0, None, None, None]


def test_diff(spark):
    a = entries(spark, [("same", "file", 1, 1, None), ("size", "file", 2, 5, 1), ("null", "file", 3, 5, None), ("gone", "file", 4, 1, 1)])
    b = entries(spark, [("same", "file", 9, 1, None), ("size", "file", 2, 6, 1), ("null", "file", 3, 5, 7), ("new", "file", 4, 1, 1)])
    found = sorted(tuple(r) for r in diff.long_form(a, b, ["entry_kind", "logical_size", "allocated_size"]).collect())
    assert found == [("gone", "only_in_left", None, None), ("new", "only_in_right", None, None), ("null", "allocated_size", None, "7"), ("size", "logical_size", "5", "6")]
    assert diff.long_form(a, a, ["logical_size"]).count() == 0
    assert [tuple(r) for r in diff.last_of(spark.createDataFrame([("p", 1, 5), ("p", 2, 6)], "path string, seq int, v int"), "path", F.col("seq")).collect()] == [("p", 2, 6)]


def test_history(spark):
    s = spark.createDataFrame([("k", 1, 11, "a"), ("k", 2, 11, None), ("k", 3, 3, None)], "key string, seq int, size long, t string")
    assert sorted(tuple(r) for r in history.changes(s, "key", "seq", ["size", "t"]).collect()) == [("k", 2, True, False), ("k", 3, False, True)]
    assert history.path_history(s, "key", "seq", ["size"]).first().history == "11|11|3"
    n = spark.createDataFrame([(0, "a", "x"), (0, "b", "x"), (1, "a", "y"), (1, "c", "x")], "state_no long, node_key string, summary string")
    assert [tuple(r) for r in history.node_reuse(n).collect()] == [(1, 2, 1, 1)]


def test_squarify_fills_the_area(spark):
    rects = layout.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert [round((x1 - x0) * (y1 - y0), 6) for x0, y0, x1, y1 in rects] == [6, 6, 4, 3, 2, 2, 1]
    nodes = hierarchy.path_summed(entries(spark, [("a/x", "file", 1, 30, 1), ("b", "file", 2, 10, 1), ("c", "file", 3, 0, 1)]))
    found = layout.cells(nodes, 2, 100.0, 100.0).collect()
    at = {r.path: (r.x0, r.y0, r.x1, r.y1) for r in found}
    assert set(at) == {"a"} and all(0 <= r.x0 < r.x1 <= 100 for r in found)
    assert at["a"] == (0, 0, 100, 100)


def test_cells_keep_an_edge_and_a_label(spark):
    nodes = hierarchy.path_summed(entries(spark, [("a/x/f", "file", 1, 30, 1), ("b/f", "file", 2, 10, 1)]))
    at = {r.path: (r.x0, r.y0, r.x1, r.y1) for r in layout.cells(nodes, 2, 400.0, 100.0).collect()}
    assert at == {"a": (0, 0, 300, 100), "b": (300, 0, 400, 100), "a/x": (1, 15, 299, 99)}


def test_fill_colours(spark):
    names = [("a.rs", "file"), ("a.TXT", "file"), ("x.FOO", "file"), ("x.foo", "file"), (".rs", "file"), ("rs.", "file"), ("d.rs", "dir"), ("no", "file"), ("a.b.go", "file")]
    frame = spark.createDataFrame(names, "name string, kind string")
    got = {r[0]: r[1] for r in frame.select("name", layout.fill(F.col("name"), F.col("kind"), F.lit(False))).collect()}

    def hashed(text):
        import colorsys

        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % (1 << 32)
        r, g, b = (int(c * 255 + 1e-9) for c in colorsys.hls_to_rgb(h % 360 / 360, 0.70, 0.45))
        return r * 65536 + g * 256 + b

    assert got == {"a.rs": 0xFFC09F, "a.TXT": 0xA0C4FF, "x.FOO": hashed("FOO"), "x.foo": hashed("foo"), ".rs": 0x9AA3B2, "rs.": 0x9AA3B2, "d.rs": 0x1E2330, "no": 0x9AA3B2, "a.b.go": 0x9BF6FF}


@pytest.fixture()
def tree(tmp_path):
    for folder in ("a/b/c", "d", ".Trashes", "d/.Trashes"):
        os.makedirs(tmp_path / folder)
    (tmp_path / "a/b/c/f.txt").write_text("12345")
    os.link(tmp_path / "a/b/c/f.txt", tmp_path / "d/hard.txt")
    os.symlink("a/b", tmp_path / "link")
    (tmp_path / ".Trashes/x").write_text("x")
    (tmp_path / "top").write_bytes(b"\0" * 9000)
    return tmp_path


def test_posix_source(spark, tree):
    spark.dataSource.register(posix.PosixSource)
    rows = {r.path: r for r in spark.read.format("grove_posix").option("path", str(tree)).load().collect()}
    assert set(rows) == {"a", "a/b", "a/b/c", "a/b/c/f.txt", "d", "d/.Trashes", "d/hard.txt", "link", "top"}
    assert rows["a/b/c/f.txt"].file_id == rows["d/hard.txt"].file_id and rows["top"].logical_size == 9000
    assert (rows["link"].entry_kind, rows["link"].logical_size, rows["link"].symlink_target) == ("symlink", 3, "a/b")
    skips = spark.read.format("grove_posix").option("path", str(tree)).option("skips", "true").option("overlays", "a\tb").load()
    assert ("a", "firmlink_overlay_source") in {tuple(r) for r in skips.collect()}
    with pytest.raises(Exception, match="not a directory"):
        spark.read.format("grove_posix").option("path", str(tree / "absent")).load().collect()


def test_directory_identity(spark):
    e = entries(spark, [("a", "dir", 1, 0, 0), ("a/f", "file", 5, 1, 1), ("b", "dir", 1, 0, 0), ("b/f", "file", 5, 1, 1), ("bc", "file", 6, 1, 1)])
    kept, gone = posix.one_path_per_directory(e)
    assert {r.path for r in kept.collect()} == {"a", "a/f", "bc"} and [tuple(r) for r in gone.collect()] == [("b", "duplicate_dir_inode")]


def test_treemap_hits_asks_every_event(spark, tmp_path):
    from grovetally.plans import queries

    tables = {
        "region": ([(0, "r")], "r_regionkey int, r_name string"),
        "nation": ([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(0, "c", 0)], "c_custkey long, c_name string, c_nationkey int"),
        "orders": ([(1, 0, 10.0)], "o_orderkey long, o_custkey long, o_totalprice double"),
        "events": ([(i,) for i in range(200)], "event_id long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.point_id: r.path for r in queries.treemap_hits(spark, str(tmp_path)).collect()}
    where = lambda i: (i * 37 % 1024, i * 91 % 768)
    assert got == {i: "r/n" if 1 <= x < 1023 and 15 <= y < 767 else "r" for i in range(200) for x, y in [where(i)]}
