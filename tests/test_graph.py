import difflib
import math

import pytest
from pyspark.sql import functions as F

from quernstone.functions import similarity
from quernstone.operators import evaluate, extract, graph, models, question, schemas


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_cosine_and_nearest(spark):
    v = frame(spark, [(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [0.0, 0.0]), (4, [6.0, 8.0]), (5, [-3.0, -4.0])], "seq long, vec array<double>")
    q = frame(spark, [(10, [3.0, 4.0]), (11, [0.0, 0.0])], "q long, vec array<double>")
    got = {(r["q"], r["rank"]): (r["seq"], r["sim"]) for r in similarity.nearest(q, v, 3, tile=2).collect()}
    assert got[10, 1] == (1, 1.0) and got[10, 2] == (4, 1.0) and got[10, 3] == (2, 0.96) and got[11, 1] == (1, 0.0)
    c = v.join(q.where("q = 10").select(F.col("vec").alias("o")), F.lit(True)).select("seq", similarity.cosine(F.col("vec"), F.col("o")).alias("c")).collect()
    assert {r["seq"]: round(r["c"], 6) for r in c} == {1: 1.0, 2: 0.96, 3: 0.0, 4: 1.0, 5: -1.0}


def test_own_source_is_excluded_unless_it_has_no_name(spark):
    stored = frame(spark, [(1, "a", [1.0, 0.0]), (2, "b", [1.0, 1.0])], "claim_seq long, source_doc string, embedding array<double>")
    new = frame(spark, [(7, "a", [1.0, 0.0]), (8, "", [1.0, 0.0])], "q long, source_doc string, embedding array<double>")
    assert {(r["q"], r["seq"]) for r in graph.similar_claims(new, stored, 1).collect()} == {(7, 2), (8, 1)}


def test_fuzzy_ratio_is_difflibs(spark):
    pairs = [("abcd", "bcda"), ("transformer", "transformers"), ("", ""), ("france?", "france"), ("kitten", "sitting")]
    got = frame(spark, pairs, "a string, b string").select(similarity.ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [difflib.SequenceMatcher(None, *p).ratio() for p in pairs]
    q = frame(spark, [(1, "what is a Transformers net"), (2, "abc transforme")], "qid long, question string")
    names = frame(spark, [("transformer",), ("net",), ("abc",)], "name string")
    assert rows(question.resembles(q, names)) == [(1, "transformer"), (2, "transformer")]


ENTITIES = [(0, "Alpha", "method", ["A1", "common"]), (1, "Beta", "person", ["alpha", "COMMON"]), (2, "gamma", None, None)]
SCHEMA = "node_seq long, name string, type string, aliases array<string>"


def test_first_node_wins(spark):
    entities = frame(spark, ENTITIES, SCHEMA)
    names = frame(spark, [("ALPHA",), ("a1",), ("common",), ("beta",), ("GAMMA",), ("new",)], "name string")
    assert rows(graph.resolve_by_alias(names, entities)) == rows(frame(spark, [("ALPHA", "Alpha"), ("a1", "Alpha"), ("common", "Alpha"), ("beta", "Beta"), ("GAMMA", "gamma"), ("new", None)], "name string, canonical string"))


def test_threshold_is_inclusive(spark):
    entities = frame(spark, ENTITIES, SCHEMA)
    vectors = frame(spark, [(0, "Alpha", [1.0, 0.0])], "node_seq long, name string, embedding array<double>")
    s = math.sqrt(1 - 0.75**2)
    names = frame(spark, [("at", [0.75, s]), ("below", [0.749, math.sqrt(1 - 0.749**2)]), ("none", None), ("zero", [0.0, 0.0]), ("beta", [1.0, 0.0])], "name string, embedding array<double>")
    assert rows(graph.resolve(names, entities, vectors)) == [("at", "Alpha", "vector"), ("below", "below", "new"), ("beta", "Beta", "alias"), ("none", "none", "new"), ("zero", "zero", "new")]


def test_upserts(spark):
    old = frame(spark, ENTITIES, SCHEMA)
    new = frame(spark, [(10, "Alpha", "alfa", "dataset", ["z"]), (11, "Delta", "Delta", "metric", ["d", "d"]), (12, "Delta", "delta!", "person", [])], "node_seq long, canonical string, name string, type string, aliases array<string>")
    got = {r["name"]: (r["node_seq"], r["type"], r["aliases"]) for r in graph.upsert_nodes(old, new).collect()}
    assert got == {"Alpha": (0, "method", ["A1", "alfa", "common", "z"]), "Beta": (1, "person", ["alpha", "COMMON"]), "gamma": (2, None, []), "Delta": (11, "metric", ["d", "delta!"])}
    edges = frame(spark, [(1, "a", "b", "uses"), (2, "b", "a", "uses"), (3, "a", "b", "contradicts"), (4, "a", "a", None)], "edge_seq long, source string, target string, relation string")
    assert rows(graph.upsert_edges(edges)) == [("a", "a", 4, None), ("a", "b", 1, "contradicts"), ("b", "a", 2, "uses")]
    ends = graph.resolve_ends(frame(spark, [(1, "Alpha", "gamma"), (2, "A1", "gamma"), (3, "x", "BETA")], "edge_seq long, source string, target string"), old)
    assert rows(ends.select("edge_seq", "source", "target")) == [(1, "Alpha", "gamma"), (2, "Alpha", "gamma"), (3, "x", "Beta")]
    assert rows(graph.bare_nodes(edges, frame(spark, [("b",)], "name string"))) == [("a", 1, 0)]


def test_extraction_contract_and_deduplication(spark):
    replies = ['{"entities": [{"name": "Net", "type": "method", "aliases": ["N"]}, {"name": "NET", "type": "person", "aliases": ["M", "N"]}, {"name": "x", "type": "t", "aliases": ["b", "b", "a"]}], "claims": [{"entity": "Net", "claim": " Works "}, {"entity": "net", "claim": "works"}]}', '{"relationships": [{"source": "a", "target": "B", "relation": "uses"}, {"source": "A", "target": "b", "relation": "uses"}, {"source": "A", "target": "b", "relation": "Uses"}]}', "no json", None, "{}"]
    got = extract.parsed(frame(spark, [("d", i, r) for i, r in enumerate(replies)], "source_doc string, chunk_idx int, reply string"))
    assert rows(extract.distinct_claims(extract.items(got, "claims"))) == [("d", 0, 0, "Net", " Works ", None)]
    assert rows(extract.distinct_entities(extract.items(got, "entities"))) == [("d", 0, 0, "Net", "method", ["M", "N"]), ("d", 0, 2, "x", "t", ["b", "b", "a"])]
    assert [r[2:] for r in rows(extract.distinct_relationships(extract.items(got, "relationships")))] == [(0, "a", "B", "uses"), (2, "A", "b", "Uses")]
    assert extract.worth_keeping(got.where("chunk_idx > 0")).collect() == [] and extract.worth_keeping(got).count() == 1


def test_model_adapter_retries_and_gives_up(spark):
    def connect():
        seen = {}

        def ask(messages, schema):
            chunk = messages[-1][1]
            assert schema in (models.EXTRACTION_SCHEMA, "object") and messages[0][0] == "system"
            seen[chunk] = seen.get(chunk, 0) + 1
            if chunk == "bad" or seen[chunk] < 3:
                raise OSError
            return '{"claims": [{"entity": "e", "claim": "%s"}]}' % chunk

        return ask

    got = extract.from_model(frame(spark, [("d", 0, "good"), ("d", 1, "bad")], "source_doc string, chunk_idx int, chunk string"), connect, wait=0.0)
    assert [r["claim"] for r in extract.items(got, "claims").collect()] == ["good"]


def test_verdicts_are_validated(spark):
    reply = '{"results": [{"new_claim_index": 1, "existing_claim_index": 2, "relation": "refines"}, {"new_claim_index": 0, "existing_claim_index": 1, "relation": "refines"}, {"new_claim_index": 1, "existing_claim_index": 3, "relation": "refines"}, {"new_claim_index": 1.5, "existing_claim_index": 1, "relation": "refines"}, {"new_claim_index": "x", "existing_claim_index": 1, "relation": "refines"}, {"new_claim_index": "1", "existing_claim_index": 1, "relation": "refines"}, {"new_claim_index": 1, "existing_claim_index": null, "relation": "refines"}, {"new_claim_index": 2, "existing_claim_index": 1, "relation": "confirms"}, {"new_claim_index": 2, "existing_claim_index": 1, "relation": "contradicts", "explanation": "y"}]}'
    replies = frame(spark, [("d", 0, reply), ("d", 1, "garbage"), ("d", 2, None)], "source_doc string, batch_id int, reply string")
    sizes = frame(spark, [("d", i, 2, 2) for i in range(3)], "source_doc string, batch_id int, n_new int, n_existing int")
    assert [r[3:6] for r in rows(graph.valid_verdicts(replies, sizes))] == [(1, 2, "refines"), (2, 1, "contradicts")]


def test_hit_with_a_shared_prefix_is_the_first_claim(spark):
    long = "p" * 500
    claims = frame(spark, [(1, "e", long + "one"), (2, "e", long + "two"), (3, "f", "other")], "claim_seq long, entity string, claim string")
    hits = frame(spark, [(long, "e"), ("other", "e"), ("other", "f")], "claim_text string, entity string")
    assert rows(graph.hit_to_claim(hits, claims).select("claim_seq")) == [(1,), (3,)]


def test_questions_fallbacks_and_semijoins(spark):
    entities = frame(spark, [(0, "Deep Net"), (1, "Rho"), (2, "")], "node_seq long, name string")
    q = frame(spark, [(1, "is DEEP NETwork good"), (2, "nothing here"), (3, "rho?")], "qid long, question string")
    named = entities.where("name <> ''")
    assert rows(question.relevant(q, named).select("qid", "name")) == [(1, "Deep Net"), (3, "Rho")]
    assert {r["qid"] for r in question.in_question(q, entities).where("name = ''").collect()} == {1, 2, 3}
    claims = frame(spark, [(5, "Rho", "c5", None, "s"), (6, "zeta", "c6", "implied", None)], "claim_seq long, entity string, claim string, confidence string, source_doc string")
    side = schemas.STORED_CLAIM
    con = spark.createDataFrame([(1, ("Rho", "x", None, "a", None, None), ("Rho", "y", None, None, None, None), "refines", None, None), (2, ("eta", "x", None, "a", None, None), ("zeta", "y", None, None, None, None), "contradicts", None, None)], schemas.TABLES["contradictions"])
    assert con.schema["new_claim"].dataType == side
    edges = frame(spark, [(1, "Rho", "Rho", None), (2, "a", "b", "uses")], "edge_seq long, source string, target string, relation string")
    got = {r["qid"]: r for r in question.contexts(q, named, edges, claims, con).collect()}
    assert got[3]["claims"] == "1. [s] Rho: c5 (confidence: ?)" and got[3]["edges"] == "Rho ? Rho" and got[3]["conflicts"].count("\n") == 0 and got[3]["answerable"]
    # no entity of question 1 has a claim or a contradiction: all of them, but no relationship
    assert got[1]["claims"].count("\n") == 1 and got[1]["conflicts"].count("\n") == 1 and got[1]["edges"] == ""
    assert got[2]["entities"] == "Deep Net\nRho" and not got[2]["answerable"]
    assert {r["qid"]: r["answer"] for r in question.answers(question.contexts(q, named, edges, claims, con)).collect()}[2] == question.REFUSAL
    lists = {r["qid"]: r["contexts"] for r in question.answer_contexts(q, named, claims, con).collect()}
    assert len(lists[3]) == 2 and lists[3][1].startswith("CONFLICT: REFINES") and lists[1] == ["[s] Rho: c5", "[?] zeta: c6"]
    empty = question.contexts(q, named.limit(0), edges, claims.limit(0), con.limit(0)).collect()
    assert len(empty) == 3 and all(r["claims"] == "" for r in empty)


def test_reports(spark):
    entities = frame(spark, [(0, "n" * 30, None), (1, "b", "method")], "node_seq long, name string, type string")
    claims = frame(spark, [("b", 1), ("b", 2), ("b", 3), ("b", 4)], "entity string, i int")
    both = frame(spark, [("b", "b"), ("b", "zz")], "e1 string, e2 string")
    got = {r["name"][0]: tuple(r)[1:] for r in graph.view_nodes(entities, claims, both).collect()}
    assert got == {"n": ("unknown", "n" * 22 + "...", 0, 0, 6.0, 0.7), "b": ("method", "b", 4, 2, 12.0, 1.0)}
    edges = frame(spark, [("b", "n" * 30, None), ("b", "gone", "uses"), ("b", "b", "contradicts")], "source string, target string, relation string")
    assert rows(graph.view_links(edges, entities)) == [("b", "b", "contradicts", 2.5), ("b", "n" * 30, "related", 1.5)]


def test_means_leave_out_nan_and_null(spark):
    df = frame(spark, [(1.0, float("nan")), (0.0, 0.5), (None, None)], "faithfulness double, context_recall double")
    assert rows(evaluate.means(df)) == [("context_recall", 0.5, 1), ("faithfulness", 0.5, 2)]
    got = evaluate.overlap(frame(spark, [("a b", "b c d"), ("", "x")], "contexts_text string, ground_truth string")).select("overlap_precision", "overlap_recall").collect()
    assert got[0][0] == 0.5 and round(got[0][1], 3) == 0.333 and got[1][0] is None and got[1][1] == 0.0


@pytest.mark.parametrize("new,old,want", [("it works well on all", "it works not well on all", "contradicts"), ("it works well", "it works well", "confirms"), ("it works well on all", "it works well on most", "refines"), ("a b c", "x y z", "unrelated")])
def test_default_verdict(spark, new, old, want):
    assert frame(spark, [(new, old)], "n string, o string").select(graph.default_verdict(F.col("n"), F.col("o"))).first()[0] == want


def test_questions_find_nodes_by_their_aliases(spark):
    entities = frame(spark, [(0, "Direct Preference Optimization", "method", ["DPO", None]), (1, "Rho", None, None), (2, "Sigma", "metric", ["sum of squares"])], SCHEMA)
    q = frame(spark, [(1, "what is dpo good for?"), (2, "the squares"), (3, "nothing here"), (4, "a DPOs rhoo")], "qid long, question string")
    assert rows(question.relevant(q, entities)) == [(1, "Direct Preference Optimization", 0), (2, "Sigma", 2), (4, "Direct Preference Optimization", 0), (4, "Rho", 1)]
    claims = frame(spark, [(5, "Direct Preference Optimization", "works", None, "s"), (6, "Rho", "stands", None, "t")], "claim_seq long, entity string, claim string, confidence string, source_doc string")
    none = frame(spark, [], schemas.TABLES["contradictions"])
    edges = frame(spark, [(1, "Rho", "Sigma", "uses")], "edge_seq long, source string, target string, relation string")
    got = {r["qid"]: r for r in question.contexts(q, entities, edges, claims, none).collect()}
    assert got[1]["claims"] == "1. [s] Direct Preference Optimization: works (confidence: ?)" and got[1]["answerable"] and got[2]["edges"] == "Rho uses Sigma"
    # what no node matches draws on everything, made once
    assert not got[3]["answerable"] and got[3]["entities"].count("\n") == 2 and got[3]["claims"].count("\n") == 1 and got[3]["edges"] == "Rho uses Sigma"


def test_batches_and_their_classifiers(spark):
    """Seven new claims in two batches; a claim that several name has one number; a failing batch has no verdicts, and does not stop the other."""
    made = [("d", i, r, "e", f"claim {(i + r) % 4} works well", i * 10 + r) for i in range(7) for r in (1, 2)]
    table = frame(spark, made, "source_doc string, new_idx long, rank int, entity string, claim string, claim_seq long").withColumns({"new_entity": F.lit("n"), "new_claim": F.concat(F.lit("claim "), F.col("new_idx") % 4, F.lit(" works not well")), "existing_source": F.lit("old")})
    numbered = graph.batches(table)
    asked = graph.batch_questions(numbered)
    got = {r["batch_id"]: r for r in asked.collect()}
    assert [(got[b]["n_new"], len(got[b]["new"]), got[b]["n_existing"]) for b in (0, 1)] == [(5, 5, 4), (2, 2, 3)] and [x["no"] for x in got[0]["existing"]] == [1, 2, 3, 4]

    def connect():
        def client(messages, schema):
            if "N5" in messages[-1][1]:
                raise OSError("down")
            return '{"results": [{"new_claim_index": 2, "existing_claim_index": 1, "relation": "refines", "explanation": "why"}]}'

        return client

    said = models.classifier(connect, wait=0.0)(asked)
    verdicts = graph.valid_verdicts(said, asked)
    assert [(r["batch_id"], r["new_idx"], r["claim"], r["explanation"]) for r in graph.verdict_claims(verdicts, numbered, "claim").collect()] == [(1, 6, "claim 2 works well", "why")]
    ruled = graph.valid_verdicts(graph.default_classifier(asked), asked)
    want = {(i, (i + r) % 4) for i in range(7) for r in (1, 2)}
    pairs = {(r["new_idx"], int(r["claim"][6])) for r in graph.verdict_claims(ruled, numbered, "claim").where("relation = 'contradicts'").collect()}
    assert pairs and pairs >= {(i, k) for i, k in want if i % 4 == k}


def test_chat_and_embedding_adapters():
    asked = []

    def strict(messages, schema):
        asked.append(schema)
        return "no json" if isinstance(schema, dict) else '{"a": 1}'

    assert models.chat_json(strict, [("user", "x")], {"type": "object"}, wait=0.0) == {"a": 1} and asked == [{"type": "object"}, "object"]
    for reply in ("[1]", "", "nope"):
        with pytest.raises(models.Failed):
            models.chat_json(lambda m, s, reply=reply: reply, [], wait=0.0)
    left = ["", "fine"]
    assert models.chat_text(lambda m, s: left.pop(0), [], wait=0.0) == "fine"
    with pytest.raises(models.Failed):
        models.chat_text(lambda m, s: "", [], wait=0.0)
    sizes = []

    def vectors(texts):
        sizes.append(len(texts))
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    assert models.embed(vectors, ["x" * i for i in range(5)], size=2) == [[0.0], [1.0], [2.0], [3.0], [4.0]] and sizes == [2, 2, 1]
    assert models.embed(vectors, []) == []
    with pytest.raises(models.Failed):
        models.embed(lambda texts: [], ["a"], wait=0.0)


def test_embeddings_and_answers_of_a_model(spark):
    def connect():
        def client(texts):
            if "bad" in texts:
                raise OSError
            return [(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)]

        return client

    df = frame(spark, [("a",), ("bcd",), (None,)], "t string").coalesce(1)
    assert rows(df.select("t", models.embedder(connect, wait=0.0)(F.col("t")).alias("v"))) == [("a", [1.0, 1.0]), ("bcd", [3.0, 1.0]), (None, None)]
    assert rows(frame(spark, [("bad",)], "t string").select(models.embedder(connect, wait=0.0)(F.col("t")).alias("v"))) == [(None,)]
    told = frame(spark, [(1, "q?", True, "e", "c", "", ""), (2, "fail", True, "e", "c", "", "")], "qid long, question string, answerable boolean, entities string, claims string, conflicts string, edges string")

    def chat():
        def client(messages, schema):
            if "fail" in messages[-1][1]:
                raise OSError
            return messages[-1][1]

        return client

    got = {r["qid"]: r["answer"] for r in models.answerer(chat, wait=0.0)(told).collect()}
    assert got[1] == "Entities:\ne\n\nClaims:\nc\n\nQuestion: q?" and got[2] is None
