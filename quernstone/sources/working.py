"""Tables that cut lineage outside a graph's own folder: in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below the session's ``spark.checkpoint.dir``, which goes when the application ends. Unset, that is a local folder in local mode and an error elsewhere."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        at = f"file://{local}"
    return passing_folder(spark, at)


def passing_folder(spark: SparkSession, at: str) -> str:
    """A new path below ``at``, which goes when the application ends."""
    path = f"{at.rstrip('/')}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


class Working:
    """``kept`` for operators that read a table several times: it is written below ``at``, by default the shared folder, and read back. It stays until the application ends."""

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark, self.path, self.made = spark, shared_folder(spark) if at is None else passing_folder(spark, at), 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
