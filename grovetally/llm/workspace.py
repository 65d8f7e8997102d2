"""Shared scratch tables: where lineage is cut so that lost executors cost little.

Tables are written as Parquet below the folder that ``spark.checkpoint.dir``
names, which driver and executors share.  Only a local master may fall back to
a temporary folder of its own (tests).
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .tokens import trim

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session as a URI, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="grovetally-"))
    return found.rstrip("/")


def relieve(spark: SparkSession) -> None:
    """Drops what the driver no longer uses.

    Loops of many small jobs leave plans, generated classes, broadcasts and shuffle
    files behind; Spark cleans those up when the driver's JVM collects its garbage.
    """
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


class Workspace:
    """A folder of scratch tables for one run of one operator.

    ``keep`` writes a DataFrame and returns it reread, so nothing upstream is
    computed twice.  ``drop`` deletes a table that no later plan reads; the rest
    goes when the driver's JVM ends, because the returned DataFrame is lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        relieve(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/grovetally/{name}-{uuid.uuid4().hex[:12]}"
        self._fs().deleteOnExit(self._path(self.root))

    def _path(self, where: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs().delete(self._path(self.path(name)), True)
