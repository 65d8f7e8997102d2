"""Differences between two scans, by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of(frame: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each key, the last by ``order``."""
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def long_form(left: DataFrame, right: DataFrame, fields: list[str], key: str = "path", order: str | None = None) -> DataFrame:
    """path, field, left and right (text) of every field that differs, null equal to null.

    A path in one side only is the field ``only_in_left`` or ``only_in_right``.  With
    ``order`` a path may have several rows on a side; the last by it counts.
    """
    if order:
        left, right = (last_of(side.select(key, *fields, order), key, F.col(order)) for side in (left, right))
    a = left.select(key, *(F.col(f).cast("string").alias(f"l_{f}") for f in fields), F.lit(True).alias("in_l"))
    b = right.select(key, *(F.col(f).cast("string").alias(f"r_{f}") for f in fields), F.lit(True).alias("in_r"))
    both = a.join(b, key, "full_outer")
    here = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    row = lambda name, x, y: F.struct(F.lit(name).alias("field"), x.alias("left_value"), y.alias("right_value"))
    nothing = F.lit(None).cast("string")
    found = [F.when(here & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), row(f, F.col(f"l_{f}"), F.col(f"r_{f}"))) for f in fields]
    found += [F.when(F.col("in_r").isNull(), row("only_in_left", nothing, nothing)), F.when(F.col("in_l").isNull(), row("only_in_right", nothing, nothing))]
    return both.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def only_in(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def changed_fields(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and the names of the fields that differ, comma-joined; rows of one side only say so."""
    a = left.select(*keys, F.struct(*fields).alias("l"))
    b = right.select(*keys, F.struct(*fields).alias("r"))
    both = a.join(b, keys, "full_outer")
    names = F.array_join(F.filter(F.array(*(F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ",")
    what = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise(names)
    return both.select(*keys, what.alias("changed")).filter("changed <> ''")
