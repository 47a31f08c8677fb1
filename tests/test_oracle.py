"""Every registered query against its DuckDB oracle on the smallest tables,
plus the entry smoke check (the driver runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from opinio.plans import registry
from tools.oracle_check import TABLES, canon, type_diff

from conftest import SF_SMALL

ORACLES = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["time", "sentiment_simple_average"]
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    srows = sdf.collect()
    rel = con.sql(ORACLES[key])
    assert type_diff(sdf, rel.columns, rel.types) == {}
    cur = con.execute(ORACLES[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    sc, sv = canon(sdf.columns, srows)
    oc, ov = canon(ocols, orows)
    assert sc == oc
    assert sv == ov


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, key):
    """Queries without SQL; the classifier predicts every row of the test split,
    known classes only."""
    rows = QUERIES[key](spark, SF_SMALL)
    if key == "train_classifier":
        got = {r.key: r for r in rows.collect()}
        test = {r.key: r.label for r in QUERIES["one_hot_split"](spark, SF_SMALL).filter("split = 'test'").collect()}
        assert {k: r.label for k, r in got.items()} == test and {r.prediction for r in got.values()} <= {-1, 0, 1}
    else:
        assert rows.count() > 0


def test_entry_lists_the_registry():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
