import json
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions.order import numbered, sums_before
from quernstone.graph import BeliefGraph
from quernstone.operators import extract

STEMS = ["alpha", "beta", "gamma net", "gamma nets", "delta", "Delta", "ALPHA", "eps", "zeta model", "zeta models", "eta"]
CLAIMS = ["it is fast and good at work", "it is not fast and good at work", "it needs much data to learn", "it needs little data to learn"]


def replies(seed, n=5):
    """Documents whose text is what an extractor says: names in many cases, aliases that bridge nodes, edges to unknown ends."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        names = rng.sample(STEMS, rng.randint(1, 5))
        entities = [{"name": x, "type": rng.choice(["method", "metric"]), "aliases": rng.sample(STEMS + ["x1", "x2", "x2"], rng.randint(0, 2))} for x in names]
        claims = [{"entity": rng.choice(names).upper(), "claim": rng.choice(CLAIMS) + rng.choice(["", " now"]), "confidence": "implied"} for _ in range(rng.randint(0, 3))]
        ends = STEMS + ["x1", "X2", "bare one", "Bare One", "bare two"]
        edges = [{"source": rng.choice(ends), "target": rng.choice(ends), "relation": rng.choice(["uses", "contradicts"])} for _ in range(rng.randint(0, 4))]
        out.append((f"d{i:02d}", json.dumps({"entities": entities, "claims": claims, "relationships": edges})))
    return out


def said(chunks):
    return extract.parsed(chunks, "chunk")


def contents(graph):
    drop = {"ingest_log": ["reason"]}
    return {k: sorted(map(str, df.drop(*drop.get(k, [])).collect())) for k, df in graph.state.tables().items()}


def graphs(spark, path):
    return [BeliefGraph(spark, f"{path}/{k}", extractor=said, clock=lambda: "now") for k in ("one", "all")]


@pytest.mark.parametrize("seed", [1])
def test_batch_is_one_after_the_other(spark, tmp_path, seed):
    docs = spark.createDataFrame(replies(seed), "source_doc string, text string")
    one, every = graphs(spark, tmp_path)
    one.ingest(docs)
    every.ingest_batch(docs.where("source_doc < 'd02'"))  # and what is stored is resolved against
    log = every.ingest_batch(docs, snapshot="all")
    assert contents(every) == contents(one)
    assert [r["source"] for r in log.orderBy("source").collect()] == [f"d{i:02d}" for i in range(2, 5)]
    assert every.state.at_snapshot("all")["claims"].count() == one.table("claims").count()
    assert every.ingest_batch(docs).collect() == []


def test_chain_of_changes(spark, tmp_path):
    """Each name leads to the next one's node: the longest chain that these documents can make."""
    entity = lambda name, *aliases: {"name": name, "type": "method", "aliases": list(aliases)}
    rows = [(f"d{i}", json.dumps({"entities": [entity(f"n{i}", f"n{i + 1}")]})) for i in range(3)]
    rows += [("d3", json.dumps({"entities": [entity("n3", "other")], "relationships": [{"source": "OTHER", "target": "loose", "relation": "uses"}]})), ("d4", json.dumps({"entities": [entity("Loose")], "relationships": [{"source": "loose", "target": "n3", "relation": "uses"}]}))]
    docs = spark.createDataFrame(rows, "source_doc string, text string")
    one, every = graphs(spark, tmp_path)
    one.ingest(docs, check=False)
    every.ingest_batch(docs, check=False)
    assert contents(every) == contents(one)
    assert {r["name"] for r in every.table("entities").collect()} == {"n0", "loose"}


def test_documents_that_add_nothing(spark, tmp_path):
    rows = [(None, "text"), ("a", None), ("b", "  "), ("c", "no json"), ("d", '{"relationships": [{"source": "x", "target": "y", "relation": "uses"}]}'), ("e" * 255, '{"entities": [{"name": "E"}]}'), ("é" * 200 + "/x", '{"entities": [{"name": "F"}]}')]
    docs = spark.createDataFrame(rows, "source_doc string, text string")
    one, every = graphs(spark, tmp_path)
    reports = one.ingest(docs)
    assert [(r["source"], r["reason"]) for r in reports if r["skipped"]] == [(None, "no name"), ("a", "blank"), ("b", "blank"), ("c", "nothing extracted"), ("d", "nothing extracted")]
    every.ingest_batch(docs)
    assert contents(every) == contents(one) and every.table("entities").count() == 2
    assert every.ingest_batch(docs.limit(0)).collect() == []


def test_each_text_is_embedded_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(text):
        asked.add(1)
        return [1.0, float(len(text))]

    rows = [(f"d{i}", json.dumps({"entities": [{"name": x} for x in names], "claims": [{"entity": "a", "claim": f"c{i}"}]})) for i, names in enumerate((["a", "b", "c"], ["b", "d", "e"]))]
    docs = spark.createDataFrame(rows, "source_doc string, text string")
    BeliefGraph(spark, f"{tmp_path}/one", extractor=said, embed=lambda c: counted(c)).ingest(docs)
    assert asked.value == 6 + 2  # names of each document, and claims
    BeliefGraph(spark, f"{tmp_path}/all", extractor=said, embed=lambda c: counted(c)).ingest_batch(docs)
    assert asked.value == 8 + 5 + 2  # different names, and claims


def test_numbers_and_sums_along_an_order(spark, tmp_path):
    made = []

    def kept(df, name):
        made.append(f"{tmp_path}/{name}-{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    words = [f"w{i * 7919 % 1000:04d}" for i in range(1000)]
    got = numbered(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), "w", kept)
    assert [(r["w"], r["k"]) for r in got.orderBy("w").collect()] == [(w, i) for i, w in enumerate(sorted(words))]
    sums = sums_before(spark.range(200_000).selectExpr("id as k", "id % 3 as v"), "k", "v", "base", 10)
    assert {r["k"]: r["base"] for r in sums.where("k in (0, 1, 2, 65536, 199999)").collect()} == {k: 10 + sum(i % 3 for i in range(k)) for k in (0, 1, 2, 65536, 199999)}
