"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..graph import BeliefGraph


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of ``folder``, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest_stream(docs: DataFrame, graph: BeliefGraph, checkpoint: str, check: bool = True, snapshots: bool = False) -> StreamingQuery:
    """Ingests (source_doc, text) as it arrives. Batches come in the order in which files arrive; within one, documents go by
    source_doc. A batch that runs again after a failure skips what the log already has. ``snapshots``: each batch is kept under its number."""

    def batch(df: DataFrame, number: int) -> None:
        graph.ingest(df, check)
        if snapshots:
            graph.snapshot(f"batch_{number:06d}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(docs: DataFrame, made: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends ``made(batch)`` to a Parquet table with its batch number; a repeated batch replaces its own rows only."""

    def batch(df: DataFrame, number: int) -> None:
        made(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
