"""Tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names.

Only a local master may fall back to a temporary folder of its own (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    option = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (option.get() if option.isDefined() else None)
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(context, "_grovetally_scratch", None) or "file://" + tempfile.mkdtemp(prefix="grovetally-")
        context._grovetally_scratch = found
    return found.rstrip("/")


class Scratch:
    """A folder for one run of one operator; it goes when the driver's JVM ends, as results are lazy."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/grovetally/{name}-{uuid.uuid4().hex[:12]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")
