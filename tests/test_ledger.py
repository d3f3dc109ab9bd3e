import json
import os

import pytest

from quernstone.graph import BeliefGraph
from quernstone.operators import extract, models
from quernstone.operators.ledger import Ledger


def notes(path):
    """Every call that a client got: one file a call, as clients live in workers."""
    return sorted((path / x).read_text() for x in os.listdir(path))


def noting(path, die_at=None):
    """Makes chat clients that note each request and answer it by its length; once, at the request ``die_at``, the worker dies."""
    at = str(path)

    def connect():
        import os
        import uuid

        def client(messages, schema):
            said = messages[-1][1]
            if said == die_at and not os.path.exists(f"{at}-died"):
                open(f"{at}-died", "w").close()
                os._exit(1)
            with open(f"{at}/{uuid.uuid4().hex}", "w") as out:
                out.write(said)
            if said == "mute":
                raise ValueError("no reply")
            return json.dumps({"n": len(said)}) if schema else f"{len(said)} characters"

        return client

    return connect


def test_each_request_is_sent_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "bb", "a", "ccc", "mute", "bb"])], "i int, text string")
    ask = lambda df, **how: ledger.asking(df, lambda row: [("user", row["text"])], noting(calls), wait=0.0, tries=1, **how)
    got = ask(rows)
    assert {r["i"]: r["reply"] for r in got.collect()} == {0: "1 characters", 1: "2 characters", 2: "1 characters", 3: "3 characters", 4: None, 5: "2 characters"}
    got.count()
    assert notes(calls) == ["a", "bb", "ccc", "mute"]
    # a second use asks for what is new and for what failed; another schema or model is another request
    ask(rows.unionByName(spark.createDataFrame([(9, "dddd")], "i int, text string"))).collect()
    assert notes(calls) == ["a", "bb", "ccc", "dddd", "mute", "mute"]
    assert {r["reply"] for r in ask(rows.where("i = 0"), schema="object").collect()} == {'{"n": 1}'}
    ask(rows.where("i = 0"), model="other").collect()
    assert notes(calls).count("a") == 3


def test_a_dead_task_asks_nothing_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    texts = [f"text {i}" for i in range(40)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    ask = lambda: ledger.asking(rows, lambda row: [("user", row["text"])], noting(calls, "text 17"))
    with pytest.raises(Exception):  # noqa: B017,PT011  in local mode a failed task fails its job
        ask()
    before = len(notes(calls))
    assert 0 < before < 40
    assert {r["reply"] for r in ask().collect()} == {"6 characters", "7 characters"}
    assert notes(calls) == sorted(texts)


def test_a_graph_through_a_ledger(spark, tmp_path):
    """Extraction, embeddings and verdicts go through it; the same documents in another graph cost no call."""
    calls = tmp_path / "calls"
    calls.mkdir()
    at, ledger = str(calls), Ledger(spark, f"file://{tmp_path}/ledger")

    def chat():
        import uuid

        def client(messages, schema):
            with open(f"{at}/{uuid.uuid4().hex}", "w") as out:
                out.write("chat " + messages[-1][1][:20])
            if schema == models.EXTRACTION_SCHEMA:
                assert messages[0] == ("system", models.EXTRACTION_RULES)
                name, _, claim = messages[-1][1].partition(" ")
                return json.dumps({"entities": [{"name": name, "type": "method", "aliases": []}], "claims": [{"entity": name, "claim": claim, "confidence": "implied"}], "relationships": []})
            return json.dumps({"results": [{"new_claim_index": 1, "existing_claim_index": 1, "relation": "contradicts", "explanation": "x"}]})

        return client

    def vectors():
        import uuid

        def client(texts):
            with open(f"{at}/{uuid.uuid4().hex}", "w") as out:
                out.write(f"embed {len(texts)}")
            return [(i, [1.0, float(len(t))]) for i, t in enumerate(texts)]

        return client

    def graph(name):
        return BeliefGraph(
            spark, f"file://{tmp_path}/{name}", extractor=lambda chunks: extract.from_model(chunks, chat, ask=ledger.asking), embed=ledger.embedder(vectors), classify=models.classifier(chat, ask=ledger.asking)
        )

    docs = spark.createDataFrame([("a", "Net is fast"), ("b", "Net is slow")], "source_doc string, text string")
    one = graph("one")
    one.ingest_batch(docs)
    first = notes(calls)
    assert [x for x in first if x.startswith("chat Net")] == ["chat Net is fast", "chat Net is slow"] and len(first) == 5 and first.count("embed 1") == 1 and first.count("embed 2") == 1
    assert one.stats().first()["contradictions"] == 1
    two = graph("two")
    two.ingest_batch(docs)
    assert notes(calls) == first and two.stats().first() == one.stats().first()
