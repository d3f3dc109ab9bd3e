import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as T


def lengths(text):
    return [min(b, len(text)) - a for a, b in T.windows(text)]


@pytest.mark.parametrize("n,want", [(0, [0]), (9_999, [9_999]), (10_000, [10_000]), (10_001, [10_000, 501]), (10_200, [10_000, 700]), (19_400, [10_000, 9_900, 400]), (19_500, [10_000, 10_000, 500])])
def test_lengths_of_chunks(n, want):
    assert lengths("x" * n) == want


def test_last_blank_line_of_the_search_window_ends_a_chunk():
    text = "a" * 8_500 + "\n\n" + "b" * 900 + "\n\n" + "c" * 9_000
    assert next(iter(T.windows(text))) == (0, 9_402)
    early = "a" * 7_999 + "\n\n" + "b" * 9_000  # begins a character before the window
    assert next(iter(T.windows(early))) == (0, 10_000)
    assert next(iter(T.windows("a" * 8_000 + "\n\n" + "b" * 9_000))) == (0, 8_000)
    assert next(iter(T.windows("a" * 9_999 + "\n\n" + "b" * 9_000))) == (0, 10_000)  # not wholly inside


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 600), st.integers(0, 10**6))
def test_chunks_cover_the_text_and_overlap(n, seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("ab\n", k=n))
    at = 0
    for i, (a, b) in enumerate(T.windows(text, 100, 10, 20)):
        assert (a == at - 10 if i else a == 0) and b - a <= max(100, n)
        at = b
    assert at >= len(text)


def test_chunk_table(spark):
    rows = [(1, "  short \n"), (2, None), (3, ""), (4, " " * 12_000), (5, "\t" + "x" * 10_100 + " \u00a0")]
    got = T.chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["chunk"])
    assert by[1] == ["  short \n"] and by[3] == [""] and 2 not in by and 4 not in by and [len(c) for c in by[5]] == [9_999, 601]


def test_strip_tokens_and_labels(spark):
    df = spark.createDataFrame([("\u00a0\t a  b\u2003c\n", "x" * 26)], "s string, l string")
    r = df.select(T.strip(F.col("s")).alias("a"), T.tokens(F.col("s")).alias("b"), T.clipped(F.col("l"), 25).alias("c"), T.citation(F.lit(None).cast("string"), F.lit("e"), F.lit("c"), F.lit(None).cast("string")).alias("d")).first()
    assert r["a"] == "a  b\u2003c" and r["b"] == ["a", "b", "c"] and r["c"] == "x" * 22 + "..." and r["d"] == "[?] e: c (confidence: ?)"


def test_chunks_of_one_batch_leave_in_slices(spark, monkeypatch):
    """A task's Python once held a whole batch, all of its chunks and a table of them at the same time: one batch in, one out."""
    taken = {}
    whole = spark.range(1, numPartitions=1)
    monkeypatch.setattr(type(whole), "mapInArrow", lambda df, f, schema: taken.setdefault("f", f))
    T.chunks(whole.select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    docs = ["ab " * 5000, None, "", "y" * 9000] * 50 + ["z" * 3_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], names=["doc_id", "text"])
    got = list(taken["f"](iter([batch])))
    assert max(sum(len(x) for x in b.column(4).to_pylist()) for b in got) <= T.SLICE + T.CHUNK
    rows = [r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = []
    for k, t in enumerate(docs):
        if t is not None:
            cut = [(a, b, t[a:b] if len(t) <= T.CHUNK else t[a:b].strip()) for a, b in T.windows(t)]
            want += [(k, i, *c) for i, c in enumerate(c for c in cut if c[2] or len(t) <= T.CHUNK)]
    assert rows == want
