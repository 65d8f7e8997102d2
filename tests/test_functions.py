import pytest
from pyspark.sql import functions as F

from grovetally.functions import paths as p


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, "x string").select(*columns).collect()]


def test_paths(spark):
    rows = [(x,) for x in (".", "foo.txt", "a/b/c.txt")]
    assert values(spark, rows, p.parent(F.col("x")), p.basename(F.col("x")), p.depth(F.col("x"))) == [(None, "", 0), (".", "foo.txt", 1), ("a/b", "c.txt", 3)]
    assert values(spark, rows[1:], p.ancestors(F.col("x"))) == [(["."],), ([".", "a", "a/b"],)]
    odd = [(x,) for x in ("", "/", "a//b", "/a/b/", ".")]
    assert [v[0] for v in values(spark, odd, p.normalised(F.col("x")))] == [".", ".", "a/b", "a/b", "."]


def test_inside_goes_by_whole_segments(spark):
    rows = [(x,) for x in ("a", "a/b", "ab", "ab/c", ".")]
    assert [v[0] for v in values(spark, rows, p.inside(F.col("x"), "a"))] == [True, True, False, False, False]


@pytest.mark.parametrize(
    "name, want",
    [("a.tar.gz", ".gz"), (".gitignore", "(no ext)"), ("file.", "(no ext)"), (".b.c", ".c"), ("a.b.", "(no ext)"), ("Photo.JPG", ".jpg"), ("x.É", ".É"), ("plain", "(no ext)")],
)
def test_extension(spark, name, want):
    assert values(spark, [(name,)], p.extension(F.col("x"), F.lit("file"))) == [(want,)]
    assert values(spark, [(name,)], p.extension(F.col("x"), F.lit("symlink"))) == [("(symlink)",)]


def test_null_sum(spark):
    frame = spark.createDataFrame([(1, 5), (1, None), (2, 5), (2, 6)], "k int, v long")
    assert sorted(frame.groupBy("k").agg(p.null_sum(F.col("v"))).collect()) == [(1, None), (2, 11)]
    assert frame.limit(0).agg(p.null_sum(F.col("v"))).first()[0] == 0


def test_sanitised_and_hash(spark):
    assert values(spark, [("a\tb\n\x01\x7f‮⁦é",)], p.sanitised(F.col("x"))) == [("a\tb\n����é",)]

    def fnv(data):
        h = 2166136261
        for b in data:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    words = ["", ".rs", "é.txt", "a" * 300]
    assert [v[0] for v in values(spark, [(w,) for w in words], p.fnv1a(F.col("x")))] == [fnv(w.encode()) for w in words]


def test_modes_and_labels(spark):
    frame = spark.createDataFrame([(0o100644,), (0o040755,), (0o120777,), (0o060600,)], "m int")
    assert [r[0] for r in frame.select(p.kind_of_mode(F.col("m"))).collect()] == ["file", "dir", "symlink", "other"]
    flags = spark.createDataFrame([(0,), (5,)], "f long")
    assert [r[0] for r in flags.select(p.labels(F.col("f"), {1: "one", 2: "two", 4: "four"})).collect()] == ["", "one,four"]
