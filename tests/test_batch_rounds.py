"""Rounds of a batch without edges."""

from quernstone.operators import batch


def test_rounds_without_edges_write_names_once(spark):
    """Each round once wrote all names, ends and bare nodes, and made the holders of keys twice."""
    names = spark.createDataFrame([(0, 1, "Abcde", ["Abcd"]), (1, 1, "abcd", []), (2, 1, "Abcd", ["x"]), (3, 1, "X", []), (3, 2, "new", [])], "k long, n long, name string, aliases array<string>")
    none = [spark.createDataFrame([], x) for x in ("k long, n long, source string, target string", "node_seq long, name string, aliases array<string>")]
    made = []
    got = batch.resolve_batch(names, *none, lambda df, name: made.append(name) or df.localCheckpoint())
    assert {(r["k"], r["n"]): (r["canonical"], r["how"]) for r in got.names.collect()} == {(0, 1): ("Abcde", "new"), (1, 1): ("Abcde", "alias"), (2, 1): ("Abcde", "alias"), (3, 1): ("Abcde", "alias"), (3, 2): ("new", "new")}
    assert made == ["holders"] * (got.rounds + 1) + ["names"]
