"""Every registry query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kinfold.plans import branch_queries, enrichment_queries, minting_queries, more_queries, queries, reconcile_queries, registry_queries  # noqa: F401  (the others add to the same tables)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: None if v is None else f"{v:.6g}" if isinstance(v, float) else f"{float(v):.6g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted((tuple(show(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    answer = sql.execute(queries.SQL[name])
    want = rows([c[0] for c in answer.description], answer.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
