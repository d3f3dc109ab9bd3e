"""The graph's state: parts of Parquet tables behind a pointer.

A commit writes what is new or changed, one part for each of schemas.TABLES that has any, and then the pointer file that lists the
parts of every table. Parts are complete before the pointer names them, and the pointer is replaced by one rename that overwrites, so readers
see a whole version or the one before, vectors and log included; a crash in between leaves parts that nothing names. So a
commit costs what it adds. In the tables that have a key (schemas.KEYS) a later part's row replaces an earlier one's. A table of
more than PARTS parts is written anew as one, every PARTS-th time it changes. Files are reached through Hadoop's file system, so
the state may lie in any store that Spark writes. Snapshots keep a version's list of parts under a label; vacuum() deletes what no list names. A commit
that builds on a version which another writer has replaced meanwhile fails.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce
from types import EllipsisType

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schemas

#: Parts of a table before it is written as one.
PARTS = 16


#: Seconds after which a writer that claimed a version and did not replace it counts as dead.
LEASE = 3600


class Moved(RuntimeError):
    """Another writer has replaced, or is replacing, the version that a commit builds on."""


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        fs = self._fs()
        if not fs.exists(self._at(name)) or fs.getFileStatus(self._at(name)).getLen() == 0:
            return None  # a missing or blank file is an empty graph
        with_bytes = self.spark.read.format("binaryFile").load(f"{self.path}/{name}").select("content").first()
        return json.loads(bytes(with_bytes["content"]))

    def _write(self, name: str, value: dict) -> None:
        """In a file of its own first, then renamed over; that file goes if anything fails."""
        jvm, part = self.spark._jvm, self._at(f".{name}-{uuid.uuid4().hex}")
        fs = self._fs()
        try:
            out = fs.create(part, True)
            out.write(bytearray(json.dumps(value).encode()))
            out.close()
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
            files.rename(fs.makeQualified(part), fs.makeQualified(self._at(name)), options)
        finally:
            fs.delete(part, False)

    def remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    # versions

    def version(self) -> str | None:
        pointer = self._read("current.json")
        return pointer and pointer["version"]

    def tables(self, pointer: dict | None = None) -> dict[str, DataFrame]:
        """The tables of a pointer, by default of the current one; empty ones before the first commit."""
        pointer = pointer or self._read("current.json") or {"parts": {}}
        return {name: self._merged(name, pointer["parts"].get(name, [])) for name in schemas.TABLES}

    def _merged(self, name: str, parts: list[str]) -> DataFrame:
        """The rows of a table's parts; of rows with one key those of the last part."""
        schema, key = schemas.TABLES[name], schemas.KEYS.get(name)
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/parts/{p}" for p in parts]
        if not key or len(parts) == 1:
            return self.spark.read.schema(schema).parquet(*paths)
        each = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p).withColumn("_part", F.lit(i)) for i, p in enumerate(paths)])
        last = each.groupBy(*key).agg(F.max_by(F.struct(*schema.fieldNames()), "_part").alias("x"))
        return last.select("x.*")

    def commit(self, new: dict[str, DataFrame], replaced: tuple[str, ...] = (), base: str | None | EllipsisType = ..., **note: str) -> str:
        """Writes new and changed rows as parts, and a pointer to them after all parts there are; tables not in ``new`` stay, those in ``replaced`` are only what is new.

        ``base``: the version that ``new`` was made from (None: an empty graph). If that is no longer the current one, Moved is raised and nothing
        changes; so of two writers that read the same version one fails and neither update is lost. Not given: whatever is current.
        """
        before = self._read("current.json") or {"parts": {}}
        found = before.get("version")
        if base is not ... and base != found:
            raise Moved(f"the graph moved from {base} to {found}")
        claim = self._claim(found)
        try:
            if self.version() != found:
                raise Moved(f"the graph moved from {found} to {self.version()}")
            return self._commit(new, replaced, before, note)
        finally:
            self._fs().delete(claim, False)

    def _claim(self, version: str | None):
        """A file that only one writer at a time can make; who has it may replace ``version``."""
        claim, fs = self._at(f"claim-{version or 'first'}"), self._fs()
        if fs.exists(claim) and fs.getFileStatus(claim).getModificationTime() < (time.time() - LEASE) * 1000:
            fs.delete(claim, False)
        try:
            fs.create(claim, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            raise Moved(f"another writer is replacing {version}") from None
        return claim

    def _commit(self, new: dict[str, DataFrame], replaced: tuple[str, ...], before: dict, note: dict[str, str]) -> str:
        version = uuid.uuid4().hex
        listed = dict(before["parts"])
        for name, rows in new.items():
            fields = schemas.TABLES[name].fields
            rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(f"{self.path}/parts/{version}/{name}")
            listed[name] = [*(listed.get(name, []) if name not in replaced else []), f"{version}/{name}"]
            if len(listed[name]) > PARTS:
                self._merged(name, listed[name]).write.parquet(f"{self.path}/parts/{version}/{name}-whole")
                listed[name] = [f"{version}/{name}-whole"]
        self._write("current.json", {"version": version, "parts": listed, **note})
        return version

    def snapshot(self, label: str, when: str) -> None:
        """Keeps the current version under ``label``."""
        now = self._read("current.json") or {"version": None, "parts": {}}
        self._write(f"snapshot_{label}.json", {"version": now["version"], "parts": now["parts"], "snapshot_label": label, "snapshot_time": when})

    def at_snapshot(self, label: str) -> dict[str, DataFrame]:
        found = self._read(f"snapshot_{label}.json")
        if found is None:
            raise KeyError(label)
        return self.tables(found)

    def vacuum(self, older_than: float = 24 * 3600) -> int:
        """Deletes parts that neither the current version nor a snapshot names and that are older than so many seconds (readers may still use them before); returns how many."""
        fs, limit, gone = self._fs(), (time.time() - older_than) * 1000, 0
        kept: set[str] = set()
        for status in fs.globStatus(self._at("current.json")) or []:
            kept |= {p for parts in self._read(status.getPath().getName())["parts"].values() for p in parts}
        for status in fs.globStatus(self._at("snapshot_*.json")) or []:
            kept |= {p for parts in self._read(status.getPath().getName())["parts"].values() for p in parts}
        for status in fs.globStatus(self._at("parts/*/*")) or []:
            part = f"{status.getPath().getParent().getName()}/{status.getPath().getName()}"
            if part not in kept and status.getModificationTime() < limit:
                gone += bool(fs.delete(status.getPath(), True))
        return gone

    def reset(self) -> None:
        """Graph, vectors and log are empty afterwards; snapshots stay."""
        self._fs().delete(self._at("current.json"), False)


def ordered(rows: DataFrame, item: Column, seq: str) -> Column | DataFrame:
    """One row: all items as an array in order of ``seq``. For export only: it gathers a table."""
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("_s"), item.alias("_x")))), lambda x: x["_x"]).alias("x"))


def to_json(tables: dict[str, DataFrame], label: str | None = None, time: str | None = None) -> DataFrame:
    """One row (json): the graph as a single object, for exchange with other tools. Edges follow their source node's place, then their own."""
    place = tables["entities"].select(F.col("name").alias("source"), "node_seq")
    edges = tables["relationships"].join(place, "source", "left").withColumn("_o", F.struct("node_seq", "edge_seq"))
    claim = F.struct("entity", "claim", "confidence", "source_doc", "ingested_at", "id")
    parts = {
        "nodes": ordered(tables["entities"], F.struct("name", "type", "aliases"), "node_seq"), "edges": ordered(edges, F.struct("source", "target", "relation"), "_o"),
        "claims": ordered(tables["claims"], claim, "claim_seq"), "contradictions": ordered(tables["contradictions"], F.struct("existing_claim", "new_claim", "relation", "explanation", "detected_at"), "con_seq"),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumnRenamed("x", name)
        out = part if out is None else out.join(part, F.lit(True))
    extra = [F.lit(v).alias(k) for k, v in (("snapshot_label", label), ("snapshot_time", time)) if v is not None]
    return out.select(F.to_json(F.struct(*parts, *extra)).alias("json"))


def from_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an exported graph; sequence numbers follow the arrays. Vectors are not part of it."""
    whole = spark.read.schema(schemas.GRAPH).option("multiLine", True).json(path)
    pick = lambda part, seq: whole.select(F.posexplode(F.col(part)).alias("_i", "_x")).select(F.col("_i").cast("long").alias(seq), "_x.*")
    tables = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    got = {"entities": pick("nodes", "node_seq"), "relationships": pick("edges", "edge_seq"), "claims": pick("claims", "claim_seq"), "contradictions": pick("contradictions", "con_seq")}
    for name, df in got.items():
        tables[name] = df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[name].fields])
    return tables
