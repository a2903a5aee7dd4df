"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Only used where spark.checkpoint.dir is unset, as in tests on one machine.
LOCAL_DIR = "/tmp/checkpoints"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; sets a local one where none is named and there is no cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_DIR)
        found = LOCAL_DIR
    return found.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage: a lost executor costs a re-read, not a re-run.

    ``save`` writes a DataFrame and returns a scan of the files; ``drop`` deletes
    a table that no later plan reads. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/parley-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        # A table is made by one execution, whose shuffle files nobody reads afterwards.
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.scratch_path)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jvm is None:
            return
        try:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        except (OSError, Py4JError):  # the session has ended
            return
