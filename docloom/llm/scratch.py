"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new temporary folder on a local master, and an error on a cluster."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.conf.get("docloom.scratch.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("docloom.scratch.dir", own)
    return own


class Scratch:
    """Writes a DataFrame as Parquet and reads it back, which cuts its lineage.

    A lost executor costs the tasks it ran, not the tables that were written before.
    ``drop`` frees a table that no later plan reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._end)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        self._delete(table.scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone already; then so is the session's folder in tests
            pass
