"""The path functions under their names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Each is one expression that the planner inlines.
_PARTS = "split(path, '/')"
FUNCTIONS = {
    "grove_ancestors(path STRING) RETURNS ARRAY<STRING>": f"transform(sequence(0, size({_PARTS}) - 1), i -> if(i = 0, '.', array_join(slice({_PARTS}, 1, i), '/')))",
    "grove_parent(path STRING) RETURNS STRING": "CASE WHEN path = '.' THEN NULL WHEN instr(path, '/') = 0 THEN '.' ELSE regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) END",
    "grove_basename(path STRING) RETURNS STRING": f"CASE WHEN path = '.' THEN '' ELSE element_at({_PARTS}, -1) END",
    "grove_depth(path STRING) RETURNS INT": f"CASE WHEN path = '.' THEN 0 ELSE size({_PARTS}) END",
}


def register(spark: SparkSession) -> None:
    """Temporary functions of the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
