import json
import os

import pytest

from quernstone.graph import BeliefGraph
from quernstone.operators import report, schemas
from quernstone.sources import documents, state
from quernstone.streaming.ingest import ingest_stream

ONE = "Falcon is a fast method. Falcon works well on large images. Rhodes wrote about it"
TWO = "Falcon works not well on large images. Dataset seven is used"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    g = BeliefGraph(spark, f"file://{tmp_path_factory.mktemp('graph')}", clock=lambda: "2024-01-01T00:00:00+00:00")
    docs = spark.createDataFrame([("01_one.txt", ONE), ("02_two.txt", TWO), ("03_blank.txt", " \n\t")], "source_doc string, text string")
    g.reports = g.ingest(docs, snapshots=True)
    return g


def test_documents_go_in_one_after_the_other(graph):
    one, two, three = graph.reports
    assert one["claims_extracted"] == 3 and one["conflicts_detected"] == 0 and not one["skipped"]
    assert two["conflicts_detected"] == 1 and three["reason"] == "blank"
    con = graph.table("contradictions").collect()
    assert [c["relation"] for c in con] == ["contradicts"] and con[0]["existing_claim"]["source_doc"] == "01_one.txt" and con[0]["new_claim"]["id"]
    names = [r["name"] for r in graph.entities().collect()]
    assert names == sorted(names) and names.count("Falcon") == 1
    assert [r["claim_seq"] for r in graph.table("claims").orderBy("claim_seq").collect()] == list(range(5))
    stats = graph.stats().first().asDict()
    assert stats["claims"] == 5 and stats["contradictions"] == 1 and stats["entities"] == len(names)


def test_again_is_a_no_op(spark, graph):
    before = graph.state.version()
    got = graph.ingest(spark.createDataFrame([("01_one.txt", ONE)], "source_doc string, text string"))
    assert got[0]["skipped"] and got[0]["reason"] == "already ingested" and graph.state.version() == before


def test_answers_and_tools(spark, graph):
    q = spark.createDataFrame([(1, "what about Falcon?"), (2, "zzz")], "qid long, question string")
    got = {r["qid"]: r for r in graph.ask_with_contexts(q).collect()}
    assert "[01_one.txt] Falcon: Falcon is a fast method" in got[1]["answer"] and "CONTRADICTS" in got[1]["answer"] and got[2]["answer"].startswith("I don't know")
    assert graph.tool("get_entity_claims", "Falcon").count("\n") == 2 and "Falcon" in graph.tool("get_entity_claims", "falc")
    assert graph.tool("get_entity_claims", "nobody") == "Entity 'nobody' not found."
    assert graph.tool("get_contradictions").startswith("1. CONTRADICTS") and json.loads(graph.tool("get_graph_stats"))["claims"] == 5
    assert graph.tool("list_entities").startswith(f"{graph.entities().count()} entities") and graph.tool("nothing").startswith("Unknown tool") and "Falcon" in graph.tool("query_knowledge_graph", "Falcon")


def test_snapshots_export_and_reset(spark, graph, tmp_path):
    early = graph.state.at_snapshot("00_01_one")
    assert early["claims"].count() == 3 and early["contradictions"].count() == 0
    with pytest.raises(KeyError):
        graph.state.at_snapshot("none")
    whole = json.loads(graph.export("x"))
    assert [n["name"] for n in whole["nodes"]][0] == "Falcon" and whole["snapshot_label"] == "x" and len(whole["claims"]) == 5
    (tmp_path / "g.json").write_text(json.dumps(whole))
    back = state.from_json(spark, f"file://{tmp_path}/g.json")
    assert json.loads(state.to_json(back).first()["json"])["claims"] == whole["claims"]
    other = BeliefGraph(spark, f"file://{tmp_path}/other")
    other.state.commit(graph.state.tables())
    other.reset()
    assert other.stats().first()["claims"] == 0 and other.tool("get_contradictions") == "No contradictions detected."
    (tmp_path / "other" / "current.json").write_text("")
    assert other.state.version() is None


def test_page_escapes_what_texts_hold(spark, graph):
    tables = graph.state.tables()
    evil = spark.createDataFrame([(99, "</script><b>", None, [])], tables["entities"].schema)
    html = report.page(tables | {"entities": tables["entities"].unionByName(evil)})
    assert html.count("</script>") == 1 and "\\u003c/script\\u003e" in html
    assert all(f'"{k}": "#' in html for k in (*schemas.RELATIONS, *schemas.ENTITY_TYPES)) and 'id="legend"' in html
    data = report.payload(tables)
    assert data["counts"]["contradictions"] == 1 and data["counts"]["nodes"] == graph.entities().count()


def test_scan(spark, tmp_path):
    (tmp_path / "b.TXT").write_text("two é")
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "skip.json").write_text("{}")
    os.mkdir(tmp_path / "sub")
    (tmp_path / "sub" / "c.txt").write_text("no")
    got = documents.scan(spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [(r["source_doc"], r["text"]) for r in got] == [("a.md", "one"), ("b.TXT", "two é")]
    (tmp_path / "p.pdf").write_bytes(b"x|y")
    assert documents.scan(spark, f"file://{tmp_path}", lambda b: [*b.decode().split("|"), None]).where("source_doc = 'p.pdf'").first()["text"] == "x\ny\n"
    with pytest.raises(Exception, match="reader"):
        documents.scan(spark, f"file://{tmp_path}").count()
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="MALFORMED"):
        documents.scan(spark, f"file://{tmp_path}", lambda b: []).collect()


def test_stream(spark, tmp_path):
    for i, (name, text) in enumerate((("a.txt", ONE), ("b.txt", TWO))):
        spark.createDataFrame([(name, text)], "source_doc string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    g = BeliefGraph(spark, f"file://{tmp_path}/g", clock=lambda: "t")
    docs = spark.readStream.schema("source_doc string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(docs, g, f"{tmp_path}/seen", snapshots=True).awaitTermination()
    assert g.stats().first()["claims"] == 5 and g.table("ingest_log").count() == 2
    assert [g.state.at_snapshot(f"batch_{i:06d}")["claims"].count() for i in range(2)] == [3, 5]


def test_command_line(spark, tmp_path, capsys):
    from quernstone.__main__ import main

    os.mkdir(tmp_path / "docs")
    assert main([f"{tmp_path}/s", "--documents", f"{tmp_path}/docs"], spark) == 1
    (tmp_path / "docs" / "a.md").write_text(ONE)
    (tmp_path / "q.txt").write_text("Falcon?\n\n")
    assert main([f"{tmp_path}/s", "--documents", f"{tmp_path}/docs", "--questions", f"{tmp_path}/q.txt", "--interactive", "--page", f"{tmp_path}/p.html"], spark, ["what of Rhodes\n", "quit\n", "never\n"]) == 0
    out = capsys.readouterr().out
    assert "a.md: 3 entities" in out or "a.md: 2 entities" in out
    assert "[a.md] Rhodes" in out and "> Falcon?" in out and (tmp_path / "p.html").read_text().startswith("<!doctype html>")


def test_evaluation(spark, graph, tmp_path):
    from quernstone.operators import evaluate

    q = spark.createDataFrame([(1, "what about Falcon?", "Falcon is a fast method"), (2, "zzz", "nothing known")], "qid long, question string, ground_truth string")
    got = {r["metric"]: r for r in evaluate.run(graph, q, f"{tmp_path}/scores").collect()}
    assert got["overlap_recall"]["n"] == 2 and got["overlap_recall"]["mean"] > 0.4
    assert spark.read.json(f"{tmp_path}/scores").count() == 2

    def broken(df):
        raise RuntimeError

    assert all(r["n"] == 0 for r in evaluate.run(graph, q, f"{tmp_path}/raw", broken).collect())
    assert {"answer", "contexts", "ground_truth"} <= set(spark.read.json(f"{tmp_path}/raw").columns)


def test_a_crash_between_the_steps_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = state.State(spark, f"file://{tmp_path}/s")
    entity = lambda *r: spark.createDataFrame([r], schemas.TABLES["entities"])
    first = s.commit({"entities": entity(0, "a", "method", [])})
    monkeypatch.setattr(s, "_write", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        s.commit({"entities": entity(1, "b", "metric", [])})
    monkeypatch.undo()
    assert s.version() == first and [r["name"] for r in s.tables()["entities"].collect()] == ["a"]
    # the pointer is replaced, never missing: a failing rename leaves the old one
    real = s._at
    monkeypatch.setattr(s, "_at", lambda name: real("nowhere/x" if name == "current.json" else name))
    with pytest.raises(Exception, match="nowhere"):
        s._write("current.json", {"version": "x", "parts": {}})
    monkeypatch.undo()
    assert s.version() == first and not [f for f in os.listdir(tmp_path / "s") if f.startswith(".current") and not f.endswith(".crc")]


def test_commits_write_what_they_add(spark, tmp_path, monkeypatch):
    """Parts are merged by key, a table is written as one when it has many, and snapshots keep what they saw."""
    monkeypatch.setattr(state, "PARTS", 3)
    s = state.State(spark, f"file://{tmp_path}/s")
    rows = lambda t: sorted((r["node_seq"], r["name"], r["type"]) for r in t["entities"].collect())
    for i in range(5):
        new = spark.createDataFrame([(0, "a", f"t{i}", [str(i)]), (i + 1, f"n{i}", None, [])], schemas.TABLES["entities"])
        s.commit({"entities": new, "ingest_log": spark.createDataFrame([(f"d{i}", 1, 0, 0, 0, False, None)], schemas.TABLES["ingest_log"])})
        if i == 1:
            s.snapshot("early", "t")
    assert rows(s.tables()) == [(0, "a", "t4"), *((i + 1, f"n{i}", None) for i in range(5))] and s.tables()["ingest_log"].count() == 5
    assert rows(s.at_snapshot("early")) == [(0, "a", "t1"), (1, "n0", None), (2, "n1", None)]
    assert len(s._read("current.json")["parts"]["entities"]) <= 3 and s.tables()["claims"].count() == 0


def test_engine_asks_a_classifier_in_batches(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def classify(batches):
        from pyspark.sql import functions as F

        seen.add(batches.count())
        one = '{"results": [{"new_claim_index": 1, "existing_claim_index": 1, "relation": "refines", "explanation": "told so"}, {"new_claim_index": 9, "existing_claim_index": 1, "relation": "refines", "explanation": "no such"}]}'
        return batches.withColumn("reply", F.when(F.col("batch_id") == 0, one))

    g = BeliefGraph(spark, f"file://{tmp_path}/g", classify=classify, clock=lambda: "t")
    many = ". ".join(f"Falcon {i} works on large images" for i in range(7))
    g.ingest(spark.createDataFrame([("a.txt", ONE), ("b.txt", many)], "source_doc string, text string"))
    con = g.table("contradictions").collect()
    assert seen.value == 2 and [(c["relation"], c["explanation"], c["new_claim"]["source_doc"], c["existing_claim"]["source_doc"]) for c in con] == [("refines", "told so", "b.txt", "a.txt")]
    assert con[0]["new_claim"]["claim"].startswith("Falcon 0") and not os.listdir(tmp_path / "g" / "working") and not os.listdir(tmp_path / "g" / "incoming")
    # without vectors nothing is compared, and nothing is lost
    from pyspark.sql import functions as F

    blind = BeliefGraph(spark, f"file://{tmp_path}/h", embed=lambda c: F.lit(None).cast("array<double>"), clock=lambda: "t")
    got = blind.ingest(spark.createDataFrame([("a.txt", ONE), ("b.txt", TWO)], "source_doc string, text string"))
    assert got[1]["conflicts_detected"] == 0 and blind.table("claims").count() == 5 and blind.table("claim_vectors").count() == 0


def test_of_two_writers_one_fails_and_old_parts_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 2)
    one, other = (state.State(spark, f"file://{tmp_path}/s") for _ in range(2))
    claim = lambda i: {"claims": spark.createDataFrame([(i, f"i{i}", "e", "c", None, "d", "t")], schemas.TABLES["claims"])}
    one.commit(claim(0), base=None)
    read = other.version()
    one.commit(claim(1), base=one.version())
    with pytest.raises(state.Moved):
        other.commit(claim(2), base=read)
    assert sorted(r["claim_seq"] for r in one.tables()["claims"].collect()) == [0, 1]
    # one that is under way keeps others out, until it counts as dead
    held = other._claim(other.version())
    with pytest.raises(state.Moved):
        one.commit(claim(3), base=one.version())
    monkeypatch.setattr(state, "LEASE", -1)
    one.commit(claim(3), base=one.version())
    assert not other._fs().exists(held)
    one.snapshot("three", "t")
    one.commit(claim(4))
    assert one.vacuum() == 0  # readers may still use what is young
    gone = one.vacuum(older_than=-1)
    assert gone == 3 and sorted(r["claim_seq"] for r in one.tables()["claims"].collect()) == [0, 1, 3, 4]
    assert one.at_snapshot("three")["claims"].count() == 3 and one.vacuum(older_than=-1) == 0
