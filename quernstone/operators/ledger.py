"""A ledger of what models said: each request is sent once, whatever asks for it, and however often tasks fail.

A request is addressed by the digest of its content: the model's name, and the messages and schema of a chat or the text of an embedding.
Requests of a table are made distinct and anti-joined with the replies there are; only new ones are dealt to tasks and sent. A task
notes each reply in a journal as it comes, so one that runs again after a failure, in the same job or in a later one, goes on where it
stopped; only a call that was under way is made again. Once a job ends, its replies are a part of the ledger's table and its
journal goes. Failed calls are not noted, so they are made again when they are next asked for.

The ledger lies in a folder that the driver and all executors reach: Spark writes the table, the tasks' Python the journal.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import models

#: Replies of a chat that are noted together: as many calls may be lost, and made again, when a task dies.
NOTED = 1
#: A request's key and what was said, as JSON.
SCHEMA = "key string, reply string"


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def replies(self) -> DataFrame:
        """(key, reply) of all requests that were answered."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/replies")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/replies")

    def answered(self, asked: DataFrame, call: Callable[[], Callable[[list[str]], list[str | None]]], size: int) -> DataFrame:
        """(key, reply) for ``asked`` (key, request), new requests being sent. ``call`` makes, once in each task, a function from ``size`` requests at most to their replies, null where there is none."""
        self._recover()
        asked = asked.select("key", "request").where("key is not null").dropDuplicates(["key"])
        new = asked.join(self.replies().select("key").distinct(), "key", "left_anti")
        # as few parts as there are calls to make, and no more than tasks that run at a time
        parts = max(1, min(2 * self.spark.sparkContext.defaultParallelism, -(-new.count() // size)))
        journal = f"{self.path}/journal/{uuid.uuid4().hex}"

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, at = pafs.FileSystem.from_uri(journal)
            client = None
            for pdf in batches:
                for part, rows in pdf.groupby("part"):
                    noted = _noted(fs, f"{at}/{part}")
                    asked_ = list(zip(rows["key"], rows["request"], strict=True))
                    told = {k: noted[k] for k, _ in asked_ if k in noted}
                    left = [r for r in asked_ if r[0] not in told]
                    for i in range(0, len(left), size):
                        client = client or call()
                        some = left[i : i + size]
                        got = {k: v for (k, _), v in zip(some, client([r for _, r in some]), strict=True) if v is not None}
                        _note(fs, f"{at}/{part}", got)
                        told |= got
                    yield pd.DataFrame({"key": list(told), "reply": list(told.values())}, dtype=object)

        # a part is in one task, so no two tasks note the same request
        dealt = new.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "key")
        dealt.mapInPandas(send, SCHEMA).write.mode("append").parquet(f"{self.path}/replies")
        self._remove(journal)
        return self.replies().dropDuplicates(["key"]).join(asked.select("key"), "key", "left_semi")

    def _recover(self) -> None:
        """What jobs that did not end have noted becomes part of the table. A ledger has one job at a time; of two, the other one's failed tasks would ask again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/journal/*/*/*.parquet")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path):
            noted = self.spark.read.schema(SCHEMA).parquet(path.toString()).dropDuplicates(["key"])
            noted.join(self.replies().select("key").distinct(), "key", "left_anti").write.mode("append").parquet(f"{self.path}/replies")
            self._remove(f"{self.path}/journal")

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    # what the engine asks

    def asking(self, rows: DataFrame, prompt: Callable[[dict], models.Messages], connect: Callable[[], models.Chat], reply: str = "reply", schema: dict | str | None = None, tries: int = models.TRIES, wait: float = models.WAIT, model: str = "chat") -> DataFrame:
        """As models.asking(), through the ledger. ``model`` is part of a request's address: another model is asked anew."""

        def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                told = [json.dumps([model, schema, [list(m) for m in prompt(row)]], sort_keys=True) for row in pdf.to_dict("records")]
                yield pdf.assign(_request=pd.Series(told, index=pdf.index, dtype=object))

        def call() -> Callable[[list[str]], list[str | None]]:
            client = connect()

            def one(request: str) -> str | None:
                messages = [tuple(m) for m in json.loads(request)[2]]
                try:
                    if schema is None:
                        return models.chat_text(client, messages, tries, wait)
                    return json.dumps(models.chat_json(client, messages, schema if isinstance(schema, dict) else None, tries, wait))
                except models.Failed:
                    return None

            return lambda asked: [one(r) for r in asked]

        made = rows.mapInPandas(requests, T.StructType([*rows.schema.fields, T.StructField("_request", T.StringType())])).withColumn("_key", F.sha2("_request", 256))
        got = self.answered(made.select(F.col("_key").alias("key"), F.col("_request").alias("request")), call, NOTED)
        return made.join(got.select(F.col("key").alias("_key"), F.col("reply").alias(reply)), "_key", "left").drop("_key", "_request")

    def embedder(self, connect: Callable[[], models.Embedding], size: int = models.EMBED_BATCH, tries: int = models.TRIES, wait: float = models.WAIT, model: str = "embedding") -> Embedder:
        """As models.embedder(), through the ledger; for BeliefGraph's ``embed``."""
        return Embedder(self, connect, size, tries, wait, model)


class Embedder:
    """Vectors of the texts of a table, each text sent once."""

    def __init__(self, ledger: Ledger, connect: Callable[[], models.Embedding], size: int, tries: int, wait: float, model: str):
        self.ledger, self.connect, self.size, self.tries, self.wait, self.model = ledger, connect, size, tries, wait, model

    def on_table(self, rows: DataFrame, text: Column, vector: str = "embedding") -> DataFrame:
        """``rows`` with ``vector``, null where the text is null or its call failed."""
        connect, size, tries, wait = self.connect, self.size, self.tries, self.wait

        def call() -> Callable[[list[str]], list[str | None]]:
            client = connect()

            def many(texts: list[str]) -> list[str | None]:
                try:
                    return [json.dumps(v) for v in models.embed(client, texts, size, tries, wait)]
                except models.Failed:
                    return [None] * len(texts)

            return many

        keyed = rows.withColumn("_key", F.sha2(F.concat(F.lit(f"{self.model}\x1f"), text), 256))
        got = self.ledger.answered(keyed.select(F.col("_key").alias("key"), text.alias("request")), call, size)
        got = got.select(F.col("key").alias("_key"), F.from_json("reply", "array<double>").alias(vector))
        return keyed.join(got, "_key", "left").drop("_key")


def _noted(fs: pafs.FileSystem, at: str) -> dict[str, str]:
    """The replies that the journal has under ``at``; a file that a dying task left unfinished has none."""
    out: dict[str, str] = {}
    for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if info.is_file and info.path.endswith(".parquet"):
            got = pq.read_table(fs.open_input_file(info.path)).to_pydict()
            out |= dict(zip(got["key"], got["reply"], strict=True))
    return out


def _note(fs: pafs.FileSystem, at: str, replies: dict[str, str]) -> None:
    """Written under another name first, so that what is listed is whole."""
    if replies:
        fs.create_dir(at, recursive=True)
        name = f"{at}/{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.part") as out:
            pq.write_table(pa.table({"key": list(replies), "reply": list(replies.values())}), out)
        fs.move(f"{name}.part", f"{name}.parquet")
