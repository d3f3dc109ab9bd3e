import json

import numpy as np
import pyarrow.parquet as pq
import pytest

from quernstone.functions.similarity import nearest
from quernstone.functions.vector_index import fit, in_cells, search
from quernstone.graph import BeliefGraph
from quernstone.operators import extract


def pairs(df):
    return {(r["q"], r["seq"]) for r in df.collect()}


@pytest.mark.parametrize("tile", [4096, 40])
def test_recall_on_embeddings(spark, tile):
    """Held against exact search: of unit vectors at random most cells are probed, of clustered ones few."""
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    drawn = [(int(i), [float(x) for x in v]) for i, v in zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True)]
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16))
    grouped = [(i, (middle[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(800)]
    for rows, share in ((drawn, 1.0), (grouped, 0.4)):
        stored = spark.createDataFrame(rows, "seq long, vec array<double>")
        cells = fit(stored, cells=16)
        asked = stored.where("seq % 10 = 0").withColumnRenamed("seq", "q")
        got, want = pairs(search(asked, in_cells(stored, cells), cells, 10, tile=tile)), pairs(nearest(asked, stored, 10))
        assert len(got & want) / len(want) >= 0.9 and len(cells.centroids) == 16
        assert cells.probes / 16 <= share


def test_odd_vectors(spark):
    rows = [(i, [float(i % 5), 1.0], "a") for i in range(60)] + [(90, None, "b"), (91, [], "b"), (92, [1.0], "b"), (93, [0.0, 0.0], "b")]
    stored = spark.createDataFrame(rows, "seq long, vec array<double>, grp string")
    cells = fit(stored, cells=3)
    assert {r["seq"]: r["cell"] for r in in_cells(stored, cells).where("seq >= 90").collect()} == {90: None, 91: None, 92: None, 93: 0}
    assert fit(stored.limit(5)) is None and fit(stored.limit(0)) is None
    good = stored.where("seq < 60 or seq = 93")
    asked = good.where("seq < 3").withColumnRenamed("seq", "q")
    # without a cell yet, all are met by all; and a query's own group can be left out
    loose = good.selectExpr("seq", "vec", "grp", "cast(null as int) as cell")
    assert pairs(search(asked, loose, cells, 4)) == pairs(nearest(asked, good, 4))
    assert {s for _, s in pairs(search(asked, loose, cells, 4, exclude_own_group=True))} == {93}


def test_an_index_grows_with_commits(spark, tmp_path):
    said = lambda chunks: extract.parsed(chunks, "chunk")
    doc = lambda a, b: json.dumps({"entities": [{"name": f"name {i} of many"} for i in range(a, b)], "claims": [{"entity": f"name {i} of many", "claim": f"claim {i % 7} says {i}"} for i in range(a, b)]})
    docs = spark.createDataFrame([("a", doc(0, 40)), ("b", doc(100, 104)), ("c", doc(2, 4))], "source_doc string, text string")
    graph = BeliefGraph(spark, f"file://{tmp_path}/g", extractor=said, threshold=0.999)
    graph.ingest_batch(docs.where("source_doc = 'a'"))
    made = graph.index_vectors(cells=4, recall=1.0)
    assert {k: v[0] for k, v in made.items()} == {"entity_vectors": 4, "claim_vectors": 4}
    before = graph.state._read("current.json")["parts"]["claim_vectors"]
    graph.ingest_batch(docs.where("source_doc = 'b'"))
    graph.ingest(docs.where("source_doc = 'c'"))
    after = graph.state._read("current.json")["parts"]["claim_vectors"]
    assert after[: len(before)] == before and len(after) == len(before) + 2  # parts are added, none is written again
    exact = BeliefGraph(spark, f"file://{tmp_path}/h", extractor=said, threshold=0.999)
    exact.ingest_batch(docs)
    for k in ("entities", "claims"):
        assert sorted(map(str, graph.table(k).drop("ingested_at").collect())) == sorted(map(str, exact.table(k).drop("ingested_at").collect()))
    assert graph.table("contradictions").count() == exact.table("contradictions").count()
    assert graph.table("claim_vectors").where("cell is null").count() == 0 and graph.table("entity_vectors").where("cell is null").count() == 0
