import json

import pytest

from quernstone.settings import Settings
from quernstone.sources.questions import questions


def test_settings_come_from_the_session(spark, tmp_path):
    with pytest.raises(ValueError, match="state"):
        Settings.of(spark)
    try:
        spark.conf.set("spark.quernstone.state", f"file://{tmp_path}/g")
        spark.conf.set("spark.quernstone.threshold", "0.9")
        got = Settings.of(spark, chat_model="m")
        assert (got.threshold, got.chat_model, got.ledger) == (0.9, "m", None) and Settings.of(spark, threshold=0.5).threshold == 0.5
        graph = got.graph(spark)
        assert graph.threshold == 0.9 and graph.state.path == f"file://{tmp_path}/g"
    finally:
        spark.conf.unset("spark.quernstone.state")
        spark.conf.unset("spark.quernstone.threshold")


def test_tables_of_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("\n".join([json.dumps({"question": "What?", "ground_truth": "That."}), "", json.dumps({"question": " Why? "}), "no json", json.dumps({"question": " "})]))
    (tmp_path / "q.txt").write_text("one\r\n\n two \n")
    assert [tuple(r) for r in questions(spark, f"file://{tmp_path}/q.jsonl").orderBy("qid").collect()] == [(1, "What?", "That."), (2, "Why?", None)]
    assert [tuple(r) for r in questions(spark, f"file://{tmp_path}/q.txt").orderBy("qid").collect()] == [(1, "one", None), (2, "two", None)]
