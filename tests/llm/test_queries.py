"""The registered training-data queries: SQL where there is one, else whole results."""

import duckdb
import pytest

import corpus_pipeline
from opinio.llm import queries as Q
from tools.oracle_check import TABLES, canon, type_diff

SF = "/root/testdata/sf0.001"
QUERIES = Q.queries() | {"pipeline": corpus_pipeline.run}
ORACLES = Q.oracle_sql()
#: Rows of a result for each row of its table.
TABLE = {"op7_arc_to_warc": ("pages", 1), "op12_whitening": ("embeddings", 16)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF)
    rows = sdf.collect()
    rel = con.sql(ORACLES[key])
    assert type_diff(sdf, rel.columns, rel.types) == {}
    cur = con.execute(ORACLES[key])
    assert canon(sdf.columns, rows) == canon([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_every_row(spark, key):
    """The contents are checked beside each operator."""
    table, each = TABLE.get(key, ("documents", 1))
    total = spark.read.parquet(f"{SF}/{table}.parquet").count() * each
    n = QUERIES[key](spark, SF).count()
    assert 0 < n <= total if key == "pipeline" else n == total
