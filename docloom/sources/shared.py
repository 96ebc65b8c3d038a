"""The folder that all executors share, and cutting the lineage of loops there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one temporary folder a session on a local master, and an error on a cluster."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.conf.get("docloom.shared.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("docloom.shared.dir", own)
    return own


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver next collects its garbage."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The table written as Parquet to the shared folder and read back, which ends its lineage; columns that later steps don't name are not read."""
    path = f"{folder or shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Cuts:
    """Tables that are cut for one job; their files go when it is done, so nothing that is read later may be made of them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/cuts-{uuid.uuid4().hex}"

    def __enter__(self) -> Cuts:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return cut(df, self.folder)

    def __exit__(self, *_) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
