"""Adapters between Spark and models that are reached by a client: chat to JSON, chat to text, and embeddings.

A *chat client* is called with (messages, schema): messages are (role, text) pairs, schema is a JSON schema, "object" for any JSON
object, or None for plain text; it returns the reply's text. An *embedding client* is called with a list of texts and returns (index,
vector) pairs in any order. ``connect`` makes a client; it runs once in each task, so clients are never sent over the wire.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

Messages = Sequence[tuple[str, str]]
Chat = Callable[[Messages, object], str]
Embedding = Callable[[list[str]], list[tuple[int, list[float]]]]

TRIES, WAIT = 3, 1.0
#: Texts of one embedding call.
EMBED_BATCH = 2048


class Failed(RuntimeError):
    """A model gave no usable reply."""


def _again(call: Callable[[int], object], tries: int, wait: float) -> object:
    """The first result of ``call(attempt)``; it is tried again after 1, 2, 4, ... times ``wait`` seconds, but not after the last try."""
    last: Exception | None = None
    for i in range(tries):
        try:
            return call(i)
        except Exception as e:  # noqa: BLE001  a service may fail in any way
            last = e
            if i + 1 < tries:
                time.sleep(wait * 2**i)
    raise Failed(f"no usable reply in {tries} tries") from last


def chat_text(client: Chat, messages: Messages, tries: int = TRIES, wait: float = WAIT) -> str:
    """A reply that is not empty."""

    def call(_: int) -> str:
        if not (reply := client(messages, None)):
            raise ValueError("empty reply")
        return reply

    return _again(call, tries, wait)


def chat_json(client: Chat, messages: Messages, schema: dict | None = None, tries: int = TRIES, wait: float = WAIT) -> dict:
    """A reply that is a JSON object. If the first one under a schema is no JSON, the next tries ask for any object."""
    asked: list[object] = [schema or "object"]

    def call(attempt: int) -> dict:
        if not (reply := client(messages, asked[0])):
            raise ValueError("empty reply")
        try:
            got = json.loads(reply)
        except json.JSONDecodeError:
            if attempt == 0:
                asked[0] = "object"
            raise
        if not isinstance(got, dict):
            raise ValueError("not an object")
        return got

    return _again(call, tries, wait)


def embed(client: Embedding, texts: list[str], size: int = EMBED_BATCH, tries: int = TRIES, wait: float = WAIT) -> list[list[float]]:
    """A vector for each text, ``size`` texts a call; vectors are put in order by their index."""
    out: list[list[float]] = []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]

        def call(_: int, part: list[str] = part) -> list[list[float]]:
            got = [vector for _, vector in sorted(client(part), key=lambda x: x[0])]
            if len(got) != len(part):
                raise ValueError("a text has no vector")
            return got

        out += _again(call, tries, wait)
    return out


# on columns and tables


def embedder(connect: Callable[[], Embedding], size: int = EMBED_BATCH, tries: int = TRIES, wait: float = WAIT) -> Callable[[Column], Column]:
    """Text column -> vector column. Texts of a batch that fails have no vector, and are then resolved by their names alone."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = connect()
        for texts in batches:
            some = texts.notna()
            try:
                got = embed(client, texts[some].tolist(), size, tries, wait)
            except Failed:
                got = [None] * int(some.sum())
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[some] = pd.Series(got, index=texts.index[some], dtype=object)
            yield out

    return lambda text: vectors(text)


def asking(rows: DataFrame, prompt: Callable[[dict], Messages], connect: Callable[[], Chat], reply: str = "reply", schema: dict | str | None = None, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """``rows`` with ``reply``: what the model says to ``prompt(row)``, as text, or as a JSON object's text under a schema. A row that fails gets null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for pdf in batches:
            got = []
            for row in pdf.to_dict("records"):
                try:
                    said = chat_text(client, prompt(row), tries, wait) if schema is None else json.dumps(chat_json(client, prompt(row), schema if isinstance(schema, dict) else None, tries, wait))
                except Failed:
                    said = None
                got.append(said)
            yield pdf.assign(**{reply: pd.Series(got, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(reply, T.StringType())]))


def answerer(connect: Callable[[], Chat], system: str = "Answer from the context only, and cite the source of each statement in brackets.", ask: Callable[..., DataFrame] = asking, **how) -> Callable[[DataFrame], DataFrame]:
    """From question.contexts() to (qid, answer) by a model; a question whose call fails has no answer (null). ``ask``: asking(), or a ledger's."""
    parts = (("Entities", "entities"), ("Claims", "claims"), ("Conflicts", "conflicts"), ("Relationships", "edges"))

    def prompt(row: dict) -> Messages:
        told = "\n\n".join(f"{title}:\n{row[part]}" for title, part in parts if row[part])
        return [("system", system), ("user", f"{told}\n\nQuestion: {row['question']}")]

    return lambda contexts: ask(contexts, prompt, connect, "answer", **how).select("qid", "answer")


#: What a classifier's reply must look like.
VERDICT_SCHEMA = {
    "type": "object", "required": ["results"], "additionalProperties": False,
    "properties": {"results": {"type": "array", "items": {
        "type": "object", "required": ["new_claim_index", "existing_claim_index", "relation", "explanation"], "additionalProperties": False,
        "properties": {"new_claim_index": {"type": "integer"}, "existing_claim_index": {"type": "integer"}, "relation": {"type": "string", "enum": [*schemas.VERDICTS]}, "explanation": {"type": "string"}},
    }}},
}


def classifier(connect: Callable[[], Chat], system: str = "Report the pairs of a new and an existing claim that contradict or refine each other, by their numbers.", ask: Callable[..., DataFrame] = asking, **how) -> Callable[[DataFrame], DataFrame]:
    """From graph.batch_questions() to the same rows with ``reply``; a batch whose call fails has none, and so no verdicts. ``ask``: asking(), or a ledger's."""

    def prompt(row: dict) -> Messages:
        lines = lambda mark, part: "\n".join(f"{mark}{c['no']}. [{c['entity']}] {c['claim']} ({c['source_doc']})" for c in row[part])
        return [("system", system), ("user", f"New claims:\n{lines('N', 'new')}\n\nExisting claims:\n{lines('E', 'existing')}")]

    return lambda batches: ask(batches, prompt, connect, schema=VERDICT_SCHEMA, **how)


#: What an extractor's reply must look like: the three lists of schemas.EXTRACTION, with their closed vocabularies.
EXTRACTION_SCHEMA = {
    "type": "object", "required": ["entities", "claims", "relationships"], "additionalProperties": False,
    "properties": {
        "entities": {"type": "array", "items": {
            "type": "object", "required": ["name", "type", "aliases"], "additionalProperties": False,
            "properties": {"name": {"type": "string"}, "type": {"type": "string", "enum": [*schemas.ENTITY_TYPES]}, "aliases": {"type": "array", "items": {"type": "string"}}},
        }},
        "claims": {"type": "array", "items": {
            "type": "object", "required": ["entity", "claim", "confidence"], "additionalProperties": False,
            "properties": {"entity": {"type": "string"}, "claim": {"type": "string"}, "confidence": {"type": "string", "enum": [*schemas.CONFIDENCES]}},
        }},
        "relationships": {"type": "array", "items": {
            "type": "object", "required": ["source", "target", "relation"], "additionalProperties": False,
            "properties": {"source": {"type": "string"}, "target": {"type": "string"}, "relation": {"type": "string", "enum": [*schemas.RELATIONS]}},
        }},
    },
}

#: Told to an extractor beside the schema.
EXTRACTION_RULES = """List what the text says, and nothing that it does not say.
Entities: every concept, method, person, organization, dataset or metric that a claim or relationship names, under its full name, with other names that the text uses for it as aliases.
Claims: one checkable statement each, complete without the text around it, about one of the entities; numbers and conditions stay in it. Confidence says whether the text states it, implies it or speculates about it.
Relationships: pairs of the entities; contradicts is for findings that exclude each other, improves_upon for a comparison that the text makes."""
