"""Every registered query that has SQL, against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as registry
from quernstone.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.sql(catalog.SQL[name])
    assert columns == sorted(want.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).count() > 0


def test_context_overlap_uses_every_item(spark, tmp_path):
    """More items than 40, and ids with gaps."""
    spark.createDataFrame([(i, f"a b{i}") for i in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3 * i + 1, f"a c{i}") for i in range(130)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["item_id"]) for r in catalog.eval_context_overlap(spark, str(tmp_path)).collect())
    assert got == [(i, 3 * (i % 130) + 1) for i in range(300)]
