"""Joins and upserts that keep the graph: resolution, nodes, edges, candidates and conflicts.

Rows have no order, so every table carries the sequence number that "first" and "last" refer to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import nearest
from ..functions.text import clipped
from . import schemas

THRESHOLD = 0.75
CANDIDATES, BATCH = 10, 5


# resolution


def alias_index(entities: DataFrame) -> DataFrame:
    """(key, canonical): for each case-folded name or alias the earliest node that has it."""
    names = F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entities.select("node_seq", "name", names.alias("_n")).groupBy(F.lower("_n").alias("key")).agg(F.min_by("name", "node_seq").alias("canonical"))


def resolve_by_alias(names: DataFrame, entities: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with ``canonical``, null where no node has the name."""
    return names.join(alias_index(entities), F.lower(F.col(column)) == F.col("key"), "left").drop("key")


def resolve(names: DataFrame, entities: DataFrame, vectors: DataFrame | None = None, threshold: float = THRESHOLD, search: Callable[..., DataFrame] = nearest) -> DataFrame:
    """(name, canonical, how): by alias, else by the nearest stored vector at ``threshold`` or above, else the name itself.

    ``names``: name[, embedding]; a null embedding is only resolved by alias. ``vectors``: node_seq, name, embedding[, cell]. ``search``: nearest(), or an index's.
    """
    found = resolve_by_alias(names, entities)
    if vectors is None:
        return found.select("name", F.coalesce("canonical", "name").alias("canonical"), F.when(F.col("canonical").isNull(), "new").otherwise("alias").alias("how"))
    open_ = found.where("canonical is null and embedding is not null").select(F.xxhash64("name").alias("q"), "name", F.col("embedding").alias("vec"))
    stored = vectors.select(F.col("node_seq").alias("seq"), F.col("embedding").alias("vec"), *[c for c in ("cell",) if c in vectors.columns])
    hits = search(open_.select("q", "vec"), stored, 1).where(F.col("sim") >= threshold)
    near = hits.join(vectors.select(F.col("node_seq").alias("seq"), F.col("name").alias("near")), "seq").join(open_.select("q", F.col("name").alias("_name")), "q").select("_name", "near")
    got = found.join(near, F.col("name") == F.col("_name"), "left")
    how = F.when(F.col("canonical").isNotNull(), "alias").when(F.col("near").isNotNull(), "vector").otherwise("new")
    return got.select("name", F.coalesce("canonical", "near", "name").alias("canonical"), how.alias("how"))


def remap(rows: DataFrame, resolved: DataFrame, *columns: str) -> DataFrame:
    """Names in ``columns`` replaced by their canonical ones; unmapped names stay."""
    for c in columns:
        table = resolved.select(F.col("name").alias("_from"), F.col("canonical").alias("_to"))
        rows = rows.join(table, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return rows


# upserts


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes after adding ``incoming`` (node_seq, canonical, name, type, aliases) to ``stored`` (node_seq, name, type, aliases).

    A new node keeps its first type, an old one its own; aliases are the sorted union of all, with every incoming name that
    is not the canonical one. Old nodes that nothing touches stay as they are.
    """
    none = F.array().cast("array<string>")
    old = stored.select(F.col("name").alias("canonical"), "node_seq", "type", F.coalesce("aliases", none).alias("aliases"), F.lit(True).alias("old"))
    own = F.when(F.col("name") == F.col("canonical"), none).otherwise(F.array("name"))
    new = incoming.select("canonical", "node_seq", "type", F.array_union(F.coalesce("aliases", none), own).alias("aliases"), F.lit(False).alias("old"))
    first = F.struct(F.when(F.col("old"), 0).otherwise(1).alias("a"), F.col("node_seq").alias("b"))
    got = old.unionByName(new).groupBy("canonical").agg(
        F.min_by(F.struct("node_seq", "type", "aliases", "old"), first).alias("x"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("every")
    )
    return got.select(F.col("x.node_seq").alias("node_seq"), F.col("canonical").alias("name"), F.col("x.type").alias("type"), F.when(F.col("n") == 1, F.col("x.aliases")).otherwise(F.col("every")).alias("aliases"))


def resolve_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Both ends as they are where both are nodes, else each by alias, else as it is."""
    nodes = entities.select(F.col("name").alias("_n")).distinct()
    is_node = lambda rows, c: rows.join(nodes.withColumnRenamed("_n", f"_{c}"), F.col(c) == F.col(f"_{c}"), "left")
    rows = is_node(is_node(edges, "source"), "target").withColumn("_both", F.col("_source").isNotNull() & F.col("_target").isNotNull()).drop("_source", "_target")
    for c in ("source", "target"):
        rows = resolve_by_alias(rows, entities, c).withColumn(c, F.when(F.col("_both"), F.col(c)).otherwise(F.coalesce("canonical", c))).drop("canonical")
    return rows.drop("_both")


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: the place of the first, the relation of the last."""
    return edges.groupBy("source", "target").agg(F.min("edge_seq").alias("edge_seq"), F.max_by("relation", "edge_seq").alias("relation"))


def bare_nodes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of edges that are no node yet, in order of first use; they have no type and no aliases."""
    ends = edges.select("edge_seq", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("source").alias("name")), F.struct(F.lit(1).alias("o"), F.col("target").alias("name")))).alias("e"))
    firsts = ends.groupBy("e.name").agg(F.min(F.struct("edge_seq", "e.o")).alias("first"))
    return firsts.join(entities.select("name"), "name", "left_anti").select("name", F.col("first.edge_seq").alias("first_edge"), F.col("first.o").alias("first_end"))


# claims, candidates and conflicts


def claims_of(claims: DataFrame, name: str) -> DataFrame:
    """Claims about exactly this entity; case counts."""
    return claims.where(F.col("entity") == name)


def similar_claims(new: DataFrame, vectors: DataFrame, k: int = CANDIDATES, search: Callable[..., DataFrame] = nearest) -> DataFrame:
    """(q, seq, sim, rank): the k nearest stored claims of other sources. ``new``: q, source_doc, embedding. Where both tables have ``at``, only claims of a smaller one count."""
    side = lambda df, key, name: df.select(F.col(key).alias(name), F.col("source_doc").alias("grp"), F.col("embedding").alias("vec"), *[c for c in ("at", "cell") if c in df.columns])
    return search(side(new, "q", "q"), side(vectors, "claim_seq", "seq"), k, exclude_own_group=True)


def hit_to_claim(hits: DataFrame, claims: DataFrame, size: int = 500) -> DataFrame:
    """Claims of hits (claim_text, entity): the earliest stored claim with the same first ``size`` characters and entity. Hits without one vanish."""
    first = claims.groupBy(F.substring("claim", 1, size).alias("claim_text"), "entity").agg(F.min("claim_seq").alias("claim_seq"))
    return hits.join(first, ["claim_text", "entity"])


def batches(candidates: DataFrame, size: int = BATCH) -> DataFrame:
    """Candidates (source_doc, new_idx, rank, entity, claim, ...) with batch_id and the number, from 1, of the new claim and of the existing one.

    New claims that have candidates are taken ``size`` at a time in order of their index (0, 1, ... within a document, so the
    number of a group is a count over one document's claims). Within a batch an existing claim (entity, claim) that several
    candidates name has one number, by first appearance.
    """
    groups = candidates.select("source_doc", "new_idx").distinct().withColumn("_g", F.row_number().over(Window.partitionBy("source_doc").orderBy("new_idx")) - 1)
    rows = candidates.join(groups.withColumns({"batch_id": F.floor(F.col("_g") / size).cast("int"), "new_no": (F.col("_g") % size + 1).cast("int")}).drop("_g"), ["source_doc", "new_idx"])
    place = F.min(F.struct("new_no", "rank"))
    firsts = rows.groupBy("source_doc", "batch_id", "entity", "claim").agg(place.alias("_p"))
    numbered = firsts.withColumn("existing_no", F.row_number().over(Window.partitionBy("source_doc", "batch_id").orderBy("_p"))).drop("_p")
    return rows.join(numbered, ["source_doc", "batch_id", "entity", "claim"])


def batch_questions(numbered: DataFrame) -> DataFrame:
    """One row a batch: source_doc, batch_id, n_new, n_existing and the claims to compare, new and existing (arrays of no, entity, claim, source_doc).

    ``numbered``: batches() with new_entity, new_claim and existing_source. A batch has BATCH new claims and CANDIDATES existing ones for each at most.
    """
    new = F.struct(F.col("new_no").alias("no"), F.col("new_entity").alias("entity"), F.col("new_claim").alias("claim"), "source_doc")
    old = F.struct(F.col("existing_no").alias("no"), "entity", "claim", F.col("existing_source").alias("source_doc"))
    got = numbered.groupBy("source_doc", "batch_id").agg(F.max("new_no").alias("n_new"), F.max("existing_no").alias("n_existing"), F.collect_set(new).alias("new"), F.collect_set(old).alias("existing"))
    return got.withColumns({c: F.array_sort(c) for c in ("new", "existing")})


def valid_verdicts(replies: DataFrame, sizes: DataFrame, column: str = "reply") -> DataFrame:
    """Kept results of a classifier's replies (source_doc, batch_id, reply): conflicts whose two numbers exist in their batch.

    ``sizes``: source_doc, batch_id, n_new, n_existing. Numbers that are no JSON integers, out of range, and other relations go; so
    does a reply that is null or no JSON.
    """
    rows = replies.select("source_doc", "batch_id", F.posexplode(F.from_json(column, schemas.CLASSIFICATION)["results"]).alias("pos", "r"))
    whole = lambda c: F.when(F.schema_of_variant(f"r.{c}") == "BIGINT", F.try_variant_get(f"r.{c}", "$", "int"))
    rows = rows.select("source_doc", "batch_id", "pos", whole("new_claim_index").alias("new_no"), whole("existing_claim_index").alias("existing_no"), "r.relation", "r.explanation")
    rows = rows.where(F.col("relation").isin(*schemas.CONFLICTS)).join(sizes, ["source_doc", "batch_id"])
    return rows.where("new_no between 1 and n_new and existing_no between 1 and n_existing").drop("n_new", "n_existing")


def verdict_claims(verdicts: DataFrame, numbered: DataFrame, *existing: str) -> DataFrame:
    """Verdicts joined back by their numbers: source_doc, batch_id, pos, new_idx, the columns ``existing`` of the claim meant, relation, explanation."""
    new = numbered.select("source_doc", "batch_id", "new_no", "new_idx").distinct()
    old = numbered.select("source_doc", "batch_id", "existing_no", *existing).distinct()
    rows = verdicts.join(new, ["source_doc", "batch_id", "new_no"]).join(old, ["source_doc", "batch_id", "existing_no"])
    return rows.select("source_doc", "batch_id", "pos", "new_idx", *existing, "relation", "explanation")


def default_verdict(new: Column, old: Column) -> Column:
    """A deterministic stand-in for a model: claims that share most words and differ in negation contradict, others that do refine."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}']+"))
    shared = F.size(F.array_intersect(words(new), words(old))) / F.greatest(F.size(words(new)), F.size(words(old)))
    negated = lambda c: F.lower(c).rlike(r"\b(not|no|never|cannot|without)\b|n't\b")
    return F.when(shared < 0.6, "unrelated").when(negated(new) != negated(old), "contradicts").when(new == old, "confirms").otherwise("refines")


def default_classifier(batches: DataFrame) -> DataFrame:
    """The rows of batch_questions() with ``reply``: default_verdict() of every pair of a batch, as a model would write it."""
    one = lambda n, e: F.struct(n["no"].alias("new_claim_index"), e["no"].alias("existing_claim_index"), default_verdict(n["claim"], e["claim"]).alias("relation"), F.lit("by shared words and negation").alias("explanation"))
    pairs = F.flatten(F.transform("new", lambda n: F.transform("existing", lambda e: one(n, e))))
    return batches.withColumn("reply", F.to_json(F.struct(F.filter(pairs, lambda x: x["relation"].isin(*schemas.CONFLICTS)).alias("results"))))


# reports

COUNTED = ("entities", "relationships", "claims", "contradictions")


def stats(rows: DataFrame) -> DataFrame:
    """One row: how many rows (kind) there are of each of COUNTED."""
    return rows.agg(*[F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0)).alias(k) for k in COUNTED])


def claim_counts(entities: DataFrame, claims: DataFrame) -> DataFrame:
    n = claims.groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("claim_count"))
    return entities.join(n, "name", "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0)))


def conflict_counts(entities: DataFrame, conflicts: DataFrame) -> DataFrame:
    """A contradiction counts once for a node, also where both of its sides are that node. ``conflicts``: e1, e2."""
    n = conflicts.select(F.explode(F.array_distinct(F.array("e1", "e2"))).alias("name")).groupBy("name").agg(F.count("*").alias("conflict_count"))
    return entities.join(n, "name", "left").withColumn("conflict_count", F.coalesce("conflict_count", F.lit(0)))


def view_nodes(entities: DataFrame, claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Nodes as a picture shows them: label, type, counts, radius and opacity."""
    rows = conflict_counts(claim_counts(entities, claims), conflicts)
    return rows.select(
        "name", F.coalesce("type", F.lit("unknown")).alias("type"), clipped(F.col("name"), 25).alias("label"), "claim_count", "conflict_count",
        (6 + F.sqrt("claim_count") * 3).alias("radius"), F.when(F.col("conflict_count") > 0, 1.0).otherwise(0.7).alias("opacity"),
    )


def view_links(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between known nodes, with a default relation and a width."""
    known = entities.select("name")
    rows = edges.join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi")
    relation = F.coalesce("relation", F.lit("related"))
    return rows.select("source", "target", relation.alias("relation"), F.when(relation == "contradicts", 2.5).otherwise(1.5).alias("width"))


def view_conflicts(contradictions: DataFrame) -> DataFrame:
    """The two claims of each contradiction side by side; missing texts are empty, missing sources a question mark."""
    side = lambda s: [F.coalesce(F.col(f"{s}.entity"), F.lit("")).alias(f"{s}_entity"), F.coalesce(F.col(f"{s}.claim"), F.lit("")).alias(f"{s}_text"), F.coalesce(F.col(f"{s}.source_doc"), F.lit("?")).alias(f"{s}_source")]
    return contradictions.select("con_seq", *side("existing_claim"), *side("new_claim"), "relation", F.coalesce("explanation", F.lit("")).alias("explanation"))
