"""Tables that cut lineage, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset a local one is made, in local mode only: on a cluster
executors would write to their own disks. Each application has a folder of its own in it, which goes when the application ends, in any
store that Hadoop's file system reaches; release() deletes earlier, once a caller has stored its result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes an execution's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}
_leaving: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The application's part of the shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    at = f"{at.rstrip('/')}/quernstone-{spark.sparkContext.applicationId}"
    if at not in _leaving:
        where, fs = _reach(spark, at)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _leaving.add(at)
    return at


def save(df: DataFrame, name: str, owner: str = "query") -> DataFrame:
    """``df`` written as Parquet and read back: what follows no longer depends on how it was made, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, None)
    _made.setdefault(owner, []).append(path)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, table: DataFrame) -> None:
    """Delete the files of a table of save() that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        _delete(spark, path)


def release(spark: SparkSession, owner: str) -> None:
    """Delete every table that was saved for ``owner``."""
    for path in _made.pop(owner, []):
        _delete(spark, path)


def _reach(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, fs = _reach(spark, path)
    fs.delete(where, True)
