"""Each registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from folioscan.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations nation sales client_changes".split():
        path = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def _plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert _plain([r[c] for c in columns] for r in df.collect()) == _plain([r[i] for i in order] for r in rel.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_keyword_topk_asks_every_benchmark_item(spark, con):
    """Each item of benchmark that shares a token with a document, not those of some ids alone, in the query and in its SQL."""
    items = {r["item_id"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id").collect()}
    assert len(items) > 1 and {r["query_id"] for r in QUERIES["r4_keyword_topk"](spark, DATA).collect()} == items
    assert {r[0] for r in con.sql(f"select query_id from ({SQL['r4_keyword_topk']})").fetchall()} == items
