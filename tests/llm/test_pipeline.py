import re
from collections import Counter

import pytest

import corpus_pipeline
from quernstone.llm import mixing, scratch
from test_dedup import chunk_brute, classes
from test_media_and_packing import check_packing
from quernstone.llm.line_dedup import GRIDS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    words = "the of and house garden river stone water light morning evening winter summer north south".split()
    other = "der die das und haus garten fluss stein wasser licht morgen abend winter sommer nord".split()
    block = "\n".join(f"shared line number {i} stands in many texts" for i in range(10))
    rows = []
    for i in range(60):
        w = words if i % 3 else other
        body = "\n".join(" ".join(w[(i * 7 + j * k) % len(w)] + ("" if k else str(i)) for k in range(12)) for j in range(6))
        rows.append((i, (block + "\n" + body) if i % 10 == 0 else body, "en" if i % 3 else "de", f"s{i % 4}", len(body)))
    rows += [(100 + i, rows[i][1] + " end", rows[i][2], rows[i][3], 0) for i in range(1, 6)]
    rows += [(200, None, None, "s1", 0), (201, "12 34", "en", "s1", 0), (202, "", "de", None, 0), (203, rows[1][1], "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages_in_turn_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, folder), name, "test")
        assert docs.columns == columns, name
        kept.append([r.asDict() for r in docs.collect()])
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    identified, lines, near, mixed = kept
    # language: what has no letter goes, the rest stays as it is
    assert {r["doc_id"]: r["text"] for r in identified} == {d: t for d, t in source.items() if t and re.search("[a-z]", t)}
    # lines
    want = {d: t for d, t, _, gone in chunk_brute([(r["doc_id"], r["text"]) for r in identified], GRIDS) if not gone or t}
    assert {r["doc_id"]: r["text"] for r in lines} == want and any(want[d] != source[d] for d in want)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    # near copies: the smallest of each class
    groups = classes([(r["doc_id"], r["text"]) for r in lines], 5, 80)
    assert sorted(r["doc_id"] for r in near) == sorted(d for d, _, c in groups if d == c)
    # the mix
    count = Counter(r["doc_id"] for r in mixed)
    table = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in near], "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(table).collect() if r["taken"]}
    assert count == taken and {r["doc_id"]: r["text"] for r in mixed} == {r["doc_id"]: r["text"] for r in near if r["doc_id"] in taken}
    # sequences
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in mixed], 2048)
    whole = corpus_pipeline.run(spark, folder).collect()
    cut = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert cut(whole) == cut(packed)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
