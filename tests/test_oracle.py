"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from scripts.check_oracle import TABLES, rows_of

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield c
    c.close()


@pytest.fixture(autouse=True)
def few_iterations(monkeypatch):
    """The oracles hold whatever the number of iterations; the keys run all of
    them in scripts/check_oracle.py."""
    from pyspark.ml.clustering import LDA
    init = LDA.__init__
    monkeypatch.setattr(LDA, "__init__", lambda self, **kw: init(self, **{**kw, "maxIter": 3}))
    monkeypatch.setattr(E, "SWEEP_ITER", 3)


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
