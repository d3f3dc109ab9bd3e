"""From chunks to entities, claims and relationships, and the keep-first deduplication of a document.

An extractor is any function from chunks (source_doc, chunk_idx, chunk) to the same rows with an ``extraction`` struct. Two are
here: a deterministic rule set in column expressions, and the parsing of stored model replies. A model is a third:
``from_model`` calls a client once for each chunk, one client for each partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from . import models, schemas


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def rules(chunks: DataFrame) -> DataFrame:
    """The default extractor. A sentence ends at a period or a line; it is a claim about its first word, and consecutive first
    words are related. Types, confidences and relations follow from lengths, so that any engine can say the same."""
    said = F.filter(F.transform(F.split("chunk", r"[.\n]+"), strip), lambda s: s != "")
    rows = chunks.withColumn("_said", said)
    # each sentence is looked at by itself, and neighbours by two shifted arrays: the work is linear in the sentences
    first = lambda s: F.regexp_substr(s, F.lit(r"(?U)\S+"))
    claim = lambda s: F.struct(first(s).alias("entity"), s.alias("claim"), _pick(schemas.CONFIDENCES, F.length(s)).alias("confidence"))
    entity = lambda n: F.struct(n.alias("name"), _pick(schemas.ENTITY_TYPES, F.length(n)).alias("type"), F.when(F.length(n) > 4, F.array(F.substring(n, 1, 4))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    edge = lambda a, b: F.struct(a.alias("source"), b.alias("target"), _pick(schemas.RELATIONS, F.length(a) + F.length(b)).alias("relation"))
    rows = rows.withColumn("_names", F.transform("_said", first))
    most = F.greatest(F.size("_said") - 1, F.lit(0))
    edges = F.zip_with(F.slice("_names", F.lit(1), most), F.slice("_names", F.lit(2), most), edge)
    return rows.withColumn("extraction", F.struct(F.transform("_names", entity).alias("entities"), F.transform("_said", claim).alias("claims"), edges.alias("relationships"))).drop("_said", "_names")


def parsed(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Stored replies (JSON) as extractions: a key that is missing, or a reply that is no JSON, is an empty list."""
    rows = replies.withColumn("_x", F.from_json(column, schemas.EXTRACTION))
    empty = lambda f: F.coalesce(F.col(f"_x.{f.name}"), F.array().cast(f.dataType)).alias(f.name)
    return rows.withColumn("extraction", F.struct(*map(empty, schemas.EXTRACTION.fields))).drop("_x")


def from_model(chunks: DataFrame, connect: Callable[[], Callable], tries: int = models.TRIES, wait: float = models.WAIT, rules: str = models.EXTRACTION_RULES, ask: Callable[..., DataFrame] = models.asking) -> DataFrame:
    """Asks a model: ``connect`` makes a chat client (messages, schema) in each task; it is sent the rules, the chunk and the schema of a reply. A chunk
    without a usable answer after ``tries`` calls has an empty extraction. ``ask``: models.asking(), or a ledger's."""
    rows = chunks.select("source_doc", "chunk_idx", "chunk")
    prompt = lambda row: [("system", rules), ("user", row["chunk"])]
    return parsed(ask(rows, prompt, connect, schema=models.EXTRACTION_SCHEMA, tries=tries, wait=wait)).drop("reply")


def items(extracted: DataFrame, part: str) -> DataFrame:
    """One row for each item of ``part`` of a document's chunks, in order of (chunk_idx, pos)."""
    fields = [f.name for f in schemas.EXTRACTION[part].dataType.elementType.fields]
    rows = extracted.select("source_doc", "chunk_idx", F.posexplode(F.col(f"extraction.{part}")).alias("pos", "_x"))
    return rows.select("source_doc", "chunk_idx", "pos", *[F.col(f"_x.{f}").alias(f) for f in fields])


def keep_first(rows: DataFrame, *key: Column) -> DataFrame:
    """The first row of each key within a document."""
    order = Window.partitionBy("source_doc", *key).orderBy("chunk_idx", "pos")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def distinct_claims(claims: DataFrame) -> DataFrame:
    return keep_first(claims, F.lower("entity"), strip(F.lower("claim")))


def distinct_relationships(edges: DataFrame) -> DataFrame:
    return keep_first(edges, F.lower("source"), F.lower("target"), F.col("relation"))


def distinct_entities(entities: DataFrame) -> DataFrame:
    """First name and type of each case-folded name. Aliases of several are their sorted union; a single one keeps its own as they are."""
    seq = F.struct("chunk_idx", "pos")
    got = entities.groupBy("source_doc", F.lower("name").alias("_k")).agg(
        F.min_by(F.struct("chunk_idx", "pos", "name", "type", "aliases"), seq).alias("x"), F.array_sort(F.flatten(F.collect_set("aliases"))).alias("every"), F.count("*").alias("n")
    )
    aliases = F.when(F.col("n") == 1, F.col("x.aliases")).otherwise(F.array_distinct("every"))
    return got.select("source_doc", "x.chunk_idx", "x.pos", "x.name", "x.type", aliases.alias("aliases"))


def worth_keeping(extracted: DataFrame) -> DataFrame:
    """Chunks' documents that gave an entity or a claim; relationships alone do not count."""
    some = F.max(F.greatest(F.size("extraction.entities"), F.size("extraction.claims"))) > 0
    return extracted.groupBy("source_doc").agg(some.alias("_some")).where("_some").select("source_doc")
