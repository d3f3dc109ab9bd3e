"""Declared schemas and closed vocabularies of the belief graph; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
ENTITY_TYPES = ("concept", "method", "person", "organization", "dataset", "metric")
CONFIDENCES = ("stated_directly", "implied", "speculative")
RELATIONS = ("improves_upon", "is_variant_of", "uses", "contradicts", "evaluates_on")
VERDICTS = ("confirms", "refines", "contradicts", "unrelated")
CONFLICTS = ("contradicts", "refines")
SUFFIXES = (".txt", ".pdf", ".md")

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ENTITY = struct(name=S, type=S, aliases=T.ArrayType(S))
CLAIM = struct(entity=S, claim=S, confidence=S)
EDGE = struct(source=S, target=S, relation=S)
#: What an extractor returns for a chunk.
EXTRACTION = struct(entities=T.ArrayType(ENTITY), claims=T.ArrayType(CLAIM), relationships=T.ArrayType(EDGE))
#: What a classifier returns for a batch of claim pairs; numbers keep the kind that JSON gave them.
CLASSIFICATION = struct(results=T.ArrayType(struct(new_claim_index=T.VariantType(), existing_claim_index=T.VariantType(), relation=S, explanation=S)))

STORED_CLAIM = struct(entity=S, claim=S, confidence=S, source_doc=S, ingested_at=S, id=S)
STORED_CONFLICT = struct(existing_claim=STORED_CLAIM, new_claim=STORED_CLAIM, relation=S, explanation=S, detected_at=S)
#: The graph as one JSON object.
GRAPH = struct(nodes=T.ArrayType(ENTITY), edges=T.ArrayType(EDGE), claims=T.ArrayType(STORED_CLAIM), contradictions=T.ArrayType(STORED_CONFLICT))

#: The tables of the state; *_seq is the order of insertion.
TABLES = {
    "entities": struct(node_seq=L, name=S, type=S, aliases=T.ArrayType(S)),
    "relationships": struct(edge_seq=L, source=S, target=S, relation=S),
    "claims": struct(claim_seq=L, id=S, entity=S, claim=S, confidence=S, source_doc=S, ingested_at=S),
    "contradictions": struct(con_seq=L, existing_claim=STORED_CLAIM, new_claim=STORED_CLAIM, relation=S, explanation=S, detected_at=S),
    "entity_vectors": struct(node_seq=L, name=S, embedding=T.ArrayType(D), cell=I),
    "claim_vectors": struct(claim_seq=L, id=S, entity=S, source_doc=S, claim_text=S, embedding=T.ArrayType(D), cell=I),
    "centroids": struct(kind=S, cell=I, probes=I, vec=T.ArrayType(D)),
    "ingest_log": struct(source=S, entities_extracted=L, claims_extracted=L, relationships_extracted=L, conflicts_detected=L, skipped=T.BooleanType(), reason=S),
}

#: Tables of which a row is replaced by a later one with the same key; the others only grow.
KEYS = {"entities": ("name",), "relationships": ("source", "target")}
